"""Count-min sketches as tables of counters (row, slot, n), so that they merge by an aggregation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountMin:
    """``width`` slots in each of ``depth`` rows: an estimate is never too small, and too large by more than eps of all counts seldom."""

    eps: float = 0.01
    confidence: float = 0.99

    @property
    def width(self) -> int:
        return math.ceil(2 / self.eps)

    @property
    def depth(self) -> int:
        return max(1, math.ceil(-math.log2(1 - self.confidence)))

    def slots(self, value: Column) -> Column:
        """A value's slot in every row: parts of the MD5 of the value and the row's number."""
        text = value.cast("string")
        slot = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), text)), 1, 12), 16, 10).cast("long") % self.width
        return F.array(*[F.struct(F.lit(k).alias("row"), slot(k).cast("int").alias("slot")) for k in range(self.depth)])

    def add(self, df: DataFrame, value: str, count: Column | None = None) -> DataFrame:
        """The sketch of a column's values; NULLs aren't counted. Counts are summed before the shuffle: width * depth rows a task at most."""
        rows = df.where(F.col(value).isNotNull()).select(F.inline(self.slots(F.col(value))), *([count.alias("c")] if count is not None else []))
        return rows.groupBy("row", "slot").agg((F.sum("c") if count is not None else F.count("*")).alias("n"))

    def merge(self, *sketches: DataFrame) -> DataFrame:
        out = sketches[0]
        for s in sketches[1:]:
            out = out.unionByName(s)
        return out.groupBy("row", "slot").agg(F.sum("n").alias("n"))

    def halve(self, sketch: DataFrame) -> DataFrame:
        """All counters halved, rounded down: older counts fade."""
        return sketch.withColumn("n", F.floor(F.col("n") / 2))

    def clear(self, sketch: DataFrame) -> DataFrame:
        return sketch.limit(0)

    def estimate(self, sketch: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """The values and their estimates: the least of a value's counters. The sketch's size is fixed, so it is broadcast."""
        asked = values.select(value).distinct().select(value, F.inline(self.slots(F.col(value))))
        found = asked.join(F.broadcast(sketch), ["row", "slot"], "left")
        return found.groupBy(value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
