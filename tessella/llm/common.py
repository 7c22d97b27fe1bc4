"""What several corpus operators share: staged tables, size-checked broadcasts, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; a few dozen bytes each, so some MB at most.
BROADCAST_ROWS = 100_000
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests), a new temporary folder takes its place for
    the life of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


#: Paths staged since a scope began, innermost scope last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are deleted at the end, but those that are taken out of the yielded list of paths."""
    _SCOPES.append(paths := [])
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends here, and a lost executor costs nothing already staged.

    The writer counts the rows on the way, which ``small`` then needs no job for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES[-1:]:
        paths.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_rows, out.staged_path = seen.get["rows"], path
    return out


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; call it when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join: marked for broadcast if it has ``limit`` rows at most, else left to a shuffled join."""
    rows = getattr(df, "staged_rows", None)
    return F.broadcast(df) if (df.limit(limit + 1).count() if rows is None else rows) <= limit else df


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null and empty texts have none."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(flat) > 0, F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES at most (but one row), so that long texts don't fill a worker. Sets the session's limit."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def training_fold(doc_id: Column) -> Column:
    """Rows that a model may learn labels from: crc32 of the id's text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)) != 2
