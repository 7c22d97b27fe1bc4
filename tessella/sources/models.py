"""Model persistence through Spark's own writers: JSON lines, and a journal of updates."""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.auto import Answer, AutoModel, FeaturePlan, LabelsModel
from tessella.operators.cohorts import Multiclass
from tessella.operators.extend import chain_from_json, chain_to_json
from tessella.operators.linear import Linear, LinearTree, Universal
from tessella.operators.pipeline import Pipeline
from tessella.operators.trees import GBDT, Node


def save(spark: SparkSession, model: GBDT, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> GBDT:
    return GBDT.from_json(spark.read.text(path, wholetext=False).first()[0])


SEGMENT = "n int, kind string, rows long, crc long, payload string"


class Journal:
    """A base model and the updates after it, each a segment with its checksum; damaged segments end the replay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, kind: str, payload: str, rows: int) -> int:
        """Writes the next segment; what stands in its place and can't be read is written over."""
        n = len(self.segments())
        row = [(n, kind, rows, zlib.crc32(payload.encode()), payload)]
        self.spark.createDataFrame(row, SEGMENT).coalesce(1).write.parquet(f"{self.path}/segment-{n}", mode="overwrite")
        return n

    def segments(self) -> list[dict]:
        """The segments in order, up to the first that is missing, torn or damaged."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: list[dict] = []
        while files.exists(jvm.Path(root, f"segment-{len(out)}")):
            try:
                rows = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segment-{len(out)}").collect()
            except Exception:  # a torn file: whatever Spark raises, replay ends here
                break
            if len(rows) != 1 or rows[0].n != len(out) or rows[0].payload is None or zlib.crc32(rows[0].payload.encode()) != rows[0].crc:
                break
            out.append(rows[0].asDict())
        return out

    def model(self) -> GBDT:
        base = None
        for s in self.segments():
            part = GBDT.from_json(s["payload"])
            base = part if s["kind"] == "base" else GBDT(base.features, base.bounds, base.base, base.trees + part.trees, base.config, base.interval)
        return base


def write_predictions(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """Predictions as JSON, one object a row."""
    df.select(F.col(key).alias("row"), *columns).write.mode("overwrite").json(path)


def dump_config(config: dict) -> str:
    return json.dumps(config, sort_keys=True, indent=1)


def load_config(text: str, kind: type):
    """A configuration's dataclass from its JSON; settings that it doesn't know are an error, absent ones take their defaults."""
    x = json.loads(text)
    unknown = sorted(set(x) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**x)


def universal_json(model: Universal) -> str:
    return json.dumps({"mode": model.mode, "linear": asdict(model.linear) if model.linear else None, "trees": model.trees.to_json(), "target": model.target, "key": model.key, "history": model.history})


def universal_from_json(text: str) -> Universal:
    x = json.loads(text)
    return Universal(x["mode"], Linear(**x["linear"]) if x["linear"] else None, GBDT.from_json(x["trees"]), x["target"], x["key"], x["history"])


def vector_json(model: tuple) -> list:
    """Vector trees: bounds, base scores, and each node with its outputs' values."""
    bounds, base, trees = model
    return [bounds, base, [[[asdict(n), v] for n, v in t] for t in trees]]


def vector_from_json(x: list) -> tuple:
    return x[0], x[1], [[(Node(**n), v) for n, v in t] for t in x[2]]


def packed(model) -> str:
    """Any model of the library as JSON, with its kind."""
    if isinstance(model, GBDT):
        body = json.loads(model.to_json())
    elif isinstance(model, Universal):
        body = json.loads(universal_json(model))
    elif isinstance(model, LinearTree):
        body = {"base": json.loads(model.base.to_json()), "leaves": {str(k): v for k, v in model.leaves.items()}}
    elif isinstance(model, Multiclass):
        body = json.loads(model.to_json())
    elif isinstance(model, LabelsModel):
        linear = {y: asdict(m) for y, m in model.model[0].items()} if model.mode == "linear_then_trees" else None
        body = {"labels": model.labels, "features": model.features, "mode": model.mode, "thresholds": model.thresholds, "probes": model.probes, "linear": linear, "trees": vector_json(model.model[1] if linear else model.model)}
    elif isinstance(model, AutoModel):
        body = {f.name: getattr(model, f.name) for f in fields(model) if f.name in ("target", "key", "task", "probes", "dropped", "seconds", "notes")}
        body |= {"features": asdict(model.features), "encoding": model.encoding.to_json(), "stages": chain_to_json(model.stages), "model": packed(model.model), "answer": asdict(model.answer), "others": [packed(m) for m in model.others]}
    else:
        raise ValueError(f"{type(model).__name__} has no saved form")
    return json.dumps({"kind": type(model).__name__, "body": body})


def unpacked(text: str):
    """The model that ``packed`` wrote."""
    x = json.loads(text)
    kind, body = x["kind"], x["body"]
    if kind == "GBDT":
        return GBDT.from_json(json.dumps(body))
    if kind == "Universal":
        return universal_from_json(json.dumps(body))
    if kind == "LinearTree":
        return LinearTree(GBDT.from_json(json.dumps(body["base"])), {int(k): v for k, v in body["leaves"].items()})
    if kind == "Multiclass":
        return Multiclass.from_json(json.dumps(body))
    if kind == "LabelsModel":
        vector = vector_from_json(body.pop("trees"))
        linear = body.pop("linear")
        return LabelsModel(model=({y: Linear(**m) for y, m in linear.items()}, vector) if linear else vector, **body)
    if kind == "AutoModel":
        plan = body.pop("features")
        pairs = {k: [tuple(p) for p in plan[k]] for k in ("ratios", "interactions")}
        made = {"features": FeaturePlan(**plan | pairs), "encoding": Pipeline.from_json(body.pop("encoding")), "stages": chain_from_json(body.pop("stages")), "model": unpacked(body.pop("model")), "answer": Answer(**body.pop("answer")), "others": [unpacked(m) for m in body.pop("others")]}
        return AutoModel(**body, **made)
    raise ValueError(f"{kind} has no saved form")


def save_model(spark: SparkSession, model, path: str) -> None:
    spark.createDataFrame([(packed(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    return unpacked(spark.read.text(path, wholetext=True).first()[0])


class ModelJournal(Journal):
    """A journal of any model: the whole of it, then what each update adds.

    An update's trees, linear parts and all else are one segment, written in one commit, so a
    reader sees all of an update or nothing. ``load`` replays to the last version or to an earlier one.
    """

    def save(self, model, rows: int) -> int:
        return self.append("model", packed(model), rows)

    def update(self, model, rows: int) -> int:
        """Appends what the model has more than the journal's; a model that isn't such a continuation is written whole."""
        held = self.load()
        before, after = (parts(m) for m in (held, model))
        if type(held) is not type(model) or len(before) != len(after) or not after or any(a.trees[: len(b.trees)] != b.trees for b, a in zip(before, after)):
            return self.save(model, rows)
        delta = {"trees": [[[asdict(n) for n in t] for t in a.trees[len(b.trees) :]] for b, a in zip(before, after)]}
        delta["rest"] = packed(without_trees(model))
        return self.append("update", json.dumps(delta), rows)

    def versions(self) -> list[tuple[int, str, int]]:
        """(version, kind, rows) of each segment."""
        return [(s["n"], s["kind"], s["rows"]) for s in self.segments()]

    def load(self, version: int | None = None):
        model = None
        for s in self.segments():
            if version is not None and s["n"] > version:
                break
            if s["kind"] == "model":
                model = unpacked(s["payload"])
                continue
            delta = json.loads(s["payload"])
            held = [p.trees for p in parts(model)]
            model = unpacked(delta["rest"])
            for p, old, new in zip(parts(model), held, delta["trees"]):
                p.trees[:] = [*old, *[[Node(**n) for n in t] for t in new]]
        return model


def parts(model) -> list[GBDT]:
    """The ensembles inside a model that updates add trees to."""
    if isinstance(model, GBDT):
        return [model]
    if isinstance(model, Universal):
        return [model.trees]
    if isinstance(model, AutoModel):
        return [g for m in (model.model, *model.others) for g in parts(m)]
    return []


def without_trees(model):
    """A copy whose ensembles hold no trees."""
    copy = unpacked(packed(model))
    for p in parts(copy):
        p.trees.clear()
    return copy


def save_universal(spark: SparkSession, model: Universal, path: str) -> None:
    spark.createDataFrame([(universal_json(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_universal(spark: SparkSession, path: str) -> Universal:
    return universal_from_json(spark.read.text(path).first()[0])


def save_linear_tree(spark: SparkSession, model: LinearTree, path: str) -> None:
    text = json.dumps({"base": model.base.to_json(), "leaves": {str(k): v for k, v in model.leaves.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_linear_tree(spark: SparkSession, path: str) -> LinearTree:
    x = json.loads(spark.read.text(path).first()[0])
    return LinearTree(GBDT.from_json(x["base"]), {int(k): v for k, v in x["leaves"].items()})
