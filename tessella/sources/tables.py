"""Table readers that go through Spark's own file sources."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, its types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new temporary folder only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tessella-")
