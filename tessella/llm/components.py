"""Connected components of a link table by alternating stars, without any node in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (u, v) of comparable ids one row (id, class) for every id that isn't its class's smallest.

    Loops and repeated links change nothing; no links give no rows.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        ends = joined.select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m")
        edges = staged(ends.select("u", F.col("m").alias("v")).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
