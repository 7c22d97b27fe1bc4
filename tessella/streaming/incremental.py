"""Batch by batch: statistics merge, drift decides, models grow."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.linear import Universal
from tessella.operators.monitoring import DriftRule, psi
from tessella.operators.preprocess import StandardScaler
from tessella.sources.models import universal_from_json, universal_json
from tessella.streaming.state import Versions


@dataclass
class Incremental:
    """What grows batch by batch. With a folder its state is durable: it is read back on a restart, and a batch counts once.

    Without one the state lives as long as the object, and a batch whose id isn't above the last one's is passed over.
    """

    folder: str | None = field(default=None, kw_only=True)
    latest: int = field(default=-1, kw_only=True)

    def dump(self) -> str:
        raise NotImplementedError

    def restore(self, text: str | None) -> None:
        """Takes over a version's state; None is the state before all batches."""
        raise NotImplementedError

    def add(self, batch: DataFrame) -> None:
        raise NotImplementedError

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Adds a batch; without an id it is the next one."""
        if not self.folder:
            batch_id = self.latest + 1 if batch_id is None else batch_id
            if batch_id > self.latest:
                self.add(batch)
                self.latest = batch_id
            return
        versions = Versions(batch.sparkSession, self.folder)
        last = versions.latest()
        batch_id = (-1 if last is None else last) + 1 if batch_id is None else batch_id
        if batch_id in versions.done():
            self.restore(versions.read_text(batch_id))
        elif last is not None and batch_id < last:
            # An old batch whose version has been let go is part of every later one.
            self.restore(versions.read_text(last))
            batch_id = last
        else:
            self.restore(None if last is None else versions.read_text(last))
            self.add(batch)
            versions.commit_text(self.dump(), batch_id)
        self.latest = batch_id

    def resume(self, spark: SparkSession) -> None:
        """Reads the last committed state, for use before the next batch."""
        versions = Versions(spark, self.folder)
        last = versions.latest()
        self.restore(None if last is None else versions.read_text(last))
        self.latest = -1 if last is None else last


@dataclass
class IncrementalScaler(Incremental):
    """A scaler that each micro-batch of a stream adds to."""

    columns: list[str]
    state: StandardScaler | None = None

    def dump(self) -> str:
        return json.dumps(self.state.params)

    def restore(self, text: str | None) -> None:
        self.state = None if text is None else StandardScaler(self.columns, json.loads(text))

    def add(self, batch: DataFrame) -> None:
        new = StandardScaler(self.columns).fit(batch)
        self.state = new if self.state is None else self.state.merge(new)


@dataclass
class IncrementalCounts:
    """Category counts over all batches so far, as a table in ``folder``, one version for each batch.

    A restarted stream goes on from the last version; a batch that is run again after a
    failure finds its version written and adds nothing.
    """

    column: str
    folder: str
    latest: int = -1

    def counts(self, spark: SparkSession) -> DataFrame:
        """(column, n): the sums of all batches."""
        versions = Versions(spark, self.folder)
        last = versions.latest()
        if last is None:
            return spark.createDataFrame([], "n long").select(F.lit(None).cast("string").alias(self.column), "n")
        return versions.read(last)

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        versions = Versions(batch.sparkSession, self.folder)
        done = versions.done()
        if not done or batch_id > done[-1]:
            own = batch.groupBy(self.column).agg(F.count("*").alias("n"))
            if done:
                own = own.unionByName(versions.read(done[-1])).groupBy(self.column).agg(F.sum("n").alias("n"))
            versions.commit(own, batch_id)
        self.latest = max([batch_id, *done])


@dataclass
class GatedModel(Incremental):
    """A model that takes a batch's trees unless the batch has drifted too far.

    The model, the log and the rule's history are one state, committed together.
    """

    model: Universal
    reference: DataFrame
    rounds: int = 2
    rule: DriftRule = field(default_factory=DriftRule)
    log: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.first = self.dump()

    def dump(self) -> str:
        return json.dumps({"model": universal_json(self.model), "log": self.log, "history": self.rule.history})

    def restore(self, text: str | None) -> None:
        x = json.loads(self.first if text is None else text)
        self.model, self.log, self.rule.history = universal_from_json(x["model"]), x["log"], x["history"]

    def add(self, batch: DataFrame) -> None:
        n, m = self.reference.count(), batch.count()
        if not m:
            return
        levels = {f: self.rule.level(psi(self.reference, batch, f).first()[0] or 0.0, n, m) for f in self.model.trees.features}
        advice = self.rule.recommend(levels)
        self.log.append(advice)
        if advice != "retrain":
            self.model = self.model.update(batch, self.rounds)


def run(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feeds what a stream has now to an updater, a batch at a time."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(stream: DataFrame, ts: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Means by tumbling window of a stream, late rows up to a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "mean", "n")
