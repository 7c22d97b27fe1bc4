"""Benchmark decontamination in DataFrame operations alone.

Windows as long as a benchmark item are fingerprinted by SimHash over their words. A
window can only resemble an item if the two share a shingle, so windows are laid where a
document's shingles meet an item's: at the start that lines the shared shingle up with its
place in the item, and ``slack`` words to either side of it. Fingerprints of windows and
items of one length meet in multi-index blocks: of ``radius`` + 1 blocks at least one is
equal within the radius, so no pair within it is missed. Weighted shingle similarity, the
sum of the smaller over the sum of the larger multiplicities, then decides exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read, small, staged, words

SHINGLE, SIMILARITY, RADIUS, SLACK = 5, 0.8, 17, 2
BITS = 64


def shingles(hashes: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words, in order, from the words' hashes; fewer words have none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))
    return F.when(F.size(hashes) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of word hashes: bit b is set where most words, with repeats, have it."""
    zero = F.lit(0).cast("bigint")
    votes = lambda b: F.aggregate(hashes, zero, lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)))
    mark = lambda b: F.when(votes(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(zero)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), zero, lambda bits, b: bits.bitwiseOR(mark(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks of the fingerprint's bits, as (block, value)."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger multiplicities of two shingle arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, radius: int = RADIUS, slack: int = SLACK) -> DataFrame:
    """One row for each document and item it holds: id_col, item_col, similarity, start (word of the best window), hamming.

    Texts and items of fewer than five words, null and empty ones among them, match
    nothing. Rows that repeat an id count as one document; rows with a null id are one
    document without an id. Documents shorter than an item are one window. Ties in
    similarity go to the first window. Other columns are ignored.
    """
    hashed = lambda c: F.transform(words(c), lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(item_col).alias("item"), hashed(F.col(text_col)).alias("ih")).where(F.size("ih") >= SHINGLE)
    items = items.select("item", F.size("ih").alias("n"), shingles(F.col("ih")).alias("igrams"), simhash(F.col("ih")).alias("ifp"))
    items = staged(items.dropDuplicates(["item", "igrams"]), "items")
    grams = staged(items.select("n", F.posexplode("igrams").alias("off", "gram")).distinct(), "grams")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), hashed(F.col(text_col)).alias("h"))
    met = own.select("id", "t", F.posexplode(shingles(F.col("h"))).alias("pos", "gram")).join(small(grams), "gram")
    starts = met.select("id", "t", "n", (F.col("pos") - F.col("off")).alias("s")).distinct().groupBy("id", "t").agg(F.collect_set(F.struct("n", "s")).alias("starts"))
    starts = staged(starts, "starts")
    spread = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.transform(F.sequence(x.s - slack, x.s + slack), lambda s: F.struct(x.n.alias("n"), F.greatest(F.lit(0), F.least(s, F.size("h") - x.n)).alias("s"))))))
    near = own.join(small(starts.withColumnsRenamed({"id": "id2", "t": "t2"}), 20_000), F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")))
    near = near.select("id", "t", "h", spread.alias("spread")).dropDuplicates(["id", "t"])
    laid = near.select("id", "t", F.explode(F.transform("spread", lambda x: F.struct(x.n.alias("n"), x.s.alias("s"), F.slice("h", x.s + 1, x.n).alias("w")))).alias("x"))
    windows = laid.select("id", "t", "x.n", "x.s", simhash(F.col("x.w")).alias("fp"), shingles(F.col("x.w")).alias("grams"))
    windows = staged(windows, "windows")
    left = windows.select("id", "t", "n", "s", "fp", F.inline(blocks(F.col("fp"), radius)))
    right = items.select("item", "n", "ifp", F.inline(blocks(F.col("ifp"), radius)))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    pairs = left.join(small(staged(right, "blocks")), ["n", "block", "value"]).select("id", "t", "n", "s", "item", away.alias("hamming")).where(F.col("hamming") <= radius).distinct()
    pairs = staged(pairs, "pairs")
    own = windows.select(F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("s").alias("s2"), "grams")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")) & (F.col("n") == F.col("n2")) & (F.col("s") == F.col("s2"))
    scored = own.join(pairs, same).join(small(items.select("item", "n", "igrams")), ["item", "n"])
    scored = scored.select("id", "item", "s", "hamming", weighted_similarity(F.col("grams"), F.col("igrams")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("id", "item").agg(F.min_by(F.struct("similarity", "s", "hamming"), F.struct(-F.col("similarity"), "s", "hamming")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.similarity", F.col("x.s").alias("start"), "x.hamming")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
