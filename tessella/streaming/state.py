"""State of a stream as versions by batch id, each committed by Spark's own writer.

A version is a folder with a success marker, so that a half-written one doesn't count. A
batch starts from the latest version below its id and writes its own; a batch that is run
again, after a failure or a restart, finds its version and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay: the last one, and those that a retried batch may start from.
KEPT = 3


class Versions:
    """The versions in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path_of(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, batch_id: int) -> str:
        return f"{self.folder}/version-{batch_id}"

    def done(self) -> list[int]:
        """Ids of the committed versions, in order."""
        root = self.path_of(self.folder)
        if not self.files.exists(root):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(root)]
        ids = [int(n.removeprefix("version-")) for n in names if n.startswith("version-") and n.removeprefix("version-").isdigit()]
        return sorted(i for i in ids if self.files.exists(self.path_of(f"{self.path(i)}/_SUCCESS")))

    def latest(self, below: int | None = None) -> int | None:
        found = [i for i in self.done() if below is None or i < below]
        return found[-1] if found else None

    def commit(self, df: DataFrame, batch_id: int) -> None:
        """Writes a version and lets old ones go."""
        df.write.mode("overwrite").parquet(self.path(batch_id))
        for old in self.done()[:-KEPT]:
            self.files.delete(self.path_of(self.path(old)), True)

    def read(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self.path(batch_id))

    def commit_text(self, text: str, batch_id: int) -> None:
        self.commit(self.spark.createDataFrame([(text,)], "value string").coalesce(1), batch_id)

    def read_text(self, batch_id: int) -> str:
        return self.read(batch_id).first()[0]
