"""Tables written once to the shared folder, where lineage ends: what long computations read again and again."""

from __future__ import annotations

import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.tables import shared_folder


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder for the tables of one computation, deleted at its end but for what is kept.

    A table costs one write and survives lost executors; nothing before it is computed again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def put(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``df`` as a written table."""
        path = f"{self.root}{'-kept' if keep else ''}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, in place of the last one, which it may have been made from."""
        old = self.paths[-1:]
        out = self.put(df)
        for path in old:
            delete(self.spark, path)
            self.paths.remove(path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        self.close()

    def close(self) -> None:
        delete(self.spark, self.root)
