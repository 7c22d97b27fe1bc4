"""Contiguous shards of near equal bytes from global prefix sums.

The rows have one order: by key range of the text's digest, ordinary texts first, then by
digest and id. Equal texts are neighbours in it. Every range is summed where it lies; a
prefix sum over the few range totals gives each range its global offset, and a running sum
inside the range gives each row its own. Shard k takes what begins in the k-th equal part
of all bytes.

A group of equal texts goes where it begins, so it isn't cut, unless it holds more than
``whole`` of a shard's target in bytes or rows: such a group (there are at most
2 * shards / whole of them) gets ranges of its own by its ids' digests, so that no task
holds all of it, and is cut like any other run of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import read, staged

#: Bits of the digest prefix that orders texts, and of the part of it that names a range.
DIGEST_BITS, RANGE_BITS = 60, 12


def digest(value: Column) -> Column:
    """The first 60 bits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", whole: float = 0.01) -> DataFrame:
    """Each row's shard and place: id_col, size, text_crc32, shard (0 to shards - 1), slot (0 to the shard's rows - 1).

    A null text counts as empty: size 1, CRC 0. Rows with a null or repeated id keep their
    own places; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), digest(text).alias("h"))
    rows = staged(rows.withColumn("d", digest(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(1)), F.count("*")).first()
    hot = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > F.lit(total * whole / shards)) | (F.col("n") > F.lit(max(64.0, count * whole / shards))))
    # A hot group has as many ranges as its rows fill ranges of the mean size.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * 2**RANGE_BITS / F.lit(max(count, 1)))).cast("long")
    hot = staged(hot.select("h", parts.alias("parts")), "hot")
    cut = F.shiftright("d", DIGEST_BITS - 24) * F.col("parts")
    rows = rows.join(F.broadcast(hot), "h", "left").withColumns(
        {
            "range": F.shiftright("h", DIGEST_BITS - RANGE_BITS),
            "group": F.when(F.col("parts").isNotNull(), F.col("h")).otherwise(F.lit(-1)),
            "part": F.coalesce(F.shiftright(cut, 24), F.lit(0)),
        }
    )
    key = ["range", "group", "part"]
    ahead = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    # At most 2^12 ranges and as many again for hot groups, whatever the input: one task sums them.
    offsets = totals.select(*key, F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*key).orderBy("h", "d", "id", "size")
    placed = rows.join(F.broadcast(offsets), key).withColumns(
        {
            "begin": F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "row": F.col("n0") + F.row_number().over(inside) - 1,
        }
    )
    start = F.when(F.col("group") == -1, F.min("begin").over(Window.partitionBy(*key, "h"))).otherwise(F.col("begin"))
    shard = F.least(F.lit(shards - 1), F.floor(start.cast("decimal(38,0)") * shards / F.lit(total))).cast("int")
    placed = staged(placed.select("id", "size", "crc", "row", shard.alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``bytes``."""
    out = byte_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
