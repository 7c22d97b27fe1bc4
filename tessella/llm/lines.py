"""Removal of lines that many sites share.

A line is its text without blanks at either end. For each distinct line a HyperLogLog
sketch of its sites is built in every task and merged by the aggregation. Where the
estimate lies within the sketch's error of the threshold, the line's distinct sites are
counted exactly. Lines on ``sites`` or more sites are boilerplate: the holder with the
smallest id keeps the line, all others lose it, whatever else they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read, small, staged

SITES, MIN_WORDS, PRECISION = 8, 4, 12
BLANKS = " \t\r"


def line_key(line: Column) -> Column:
    """128 bits of a line's text: two hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def counted(line: Column, min_words: int) -> Column:
    """Lines of min_words or more, by the blanks between words."""
    return (F.length(line) > 0) & (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= min_words - 1)


def line_spread(lines: DataFrame, sites: int, precision: int = PRECISION) -> DataFrame:
    """From (a, b, site, id) the boilerplate occurrences: (a, b, id) of all but each line's first holder."""
    band = 4 * 1.04 / math.sqrt(2**precision)
    low, high = math.floor(sites * (1 - band)), sites * (1 + band)
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(precision)))
    spread = lines.groupBy("a", "b").agg(sketch.alias("estimate"), F.min("id").alias("keeper")).where(F.col("estimate") >= low)
    spread = staged(spread, "spread")
    held = staged(lines.join(small(spread), ["a", "b"]), "held")
    near = held.where(F.col("estimate") <= high).groupBy("a", "b").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= sites)
    near = staged(near.select("a", "b"), "near")
    over = held.where(F.col("estimate") > high).unionByName(held.where(F.col("estimate") <= high).join(small(near), ["a", "b"], "left_semi"))
    return over.where(F.col("id") != F.col("keeper")).select("a", "b", "id")


def drop_boilerplate(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed_col: str = "lines_removed") -> DataFrame:
    """All rows and columns of ``docs`` with cleaned text, and removed_col (int), which replaces a column of that name.

    Lines of fewer than min_words words stay, as do all lines of rows with a null id or
    null site, which don't count as holders either. Null texts stay null. Rows that share
    an id count as one holder. Other columns pass through, whatever their names.
    An empty table gives an empty one.
    """
    held = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*held.values())
    i, text, site = (F.col(held[c]) for c in (id_col, text_col, site_col))
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = own.where(i.isNotNull() & site.isNotNull()).select(i.alias("id"), site.alias("site"), F.explode(F.split(text, "\n")).alias("line")).where(counted(line, min_words))
    lines = lines.select("id", "site", line_key(line).alias("k")).select("id", "site", "k.a", "k.b")
    drops = line_spread(lines, sites).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("drops"))
    drops = staged(drops, "drops").hint("merge")
    trimmed = lambda x: F.btrim(x, F.lit(BLANKS))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("drops"), line_key(trimmed(x))))
    out = own.join(drops, i == F.col("id"), "left").withColumn("kept", F.when(F.col("drops").isNotNull() & site.isNotNull(), kept))
    clean = F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n"))
    gone = F.coalesce(F.size(F.split(text, "\n")) - F.size("kept"), F.lit(0))
    return out.select(*[(clean if c == text_col else F.col(held[c])).alias(c) for c in docs.columns if c != removed_col], gone.alias(removed_col))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the boilerplate that eight or more sources share."""
    return drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


#: The same rows from exact counts.
OP1_SQL = r"""
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), lines AS (
  SELECT doc_id, source, k, line, trim(line, chr(32) || chr(9) || chr(13)) AS t FROM parts
), wide AS (
  SELECT t, min(doc_id) AS keeper FROM lines
  WHERE doc_id IS NOT NULL AND source IS NOT NULL AND length(t) > 0 AND length(t) - length(replace(t, ' ', '')) >= 3
  GROUP BY t HAVING count(DISTINCT source) >= 8
), marked AS (
  SELECT l.*, w.t IS NOT NULL AS gone FROM lines l LEFT JOIN wide w ON w.t = l.t AND w.keeper <> l.doc_id
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed
FROM marked GROUP BY doc_id
"""
