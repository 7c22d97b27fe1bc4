"""Phrase collocations from word-id suffix arrays.

Each task cuts its texts into shards of some MB per language. A shard's words become ids,
its suffixes are sorted by prefix doubling, and neighbours' common prefixes (LCP, in words)
cut the sorted suffixes into intervals: an interval of suffixes that share L words is a
phrase of L words with its count. Counts are summed by phrase over all shards.

There are three passes: words, pairs, and phrases of three words or more. A phrase can't be
frequent if a word or pair inside it isn't, so a pass leaves out what holds an infrequent
part. Which parts are frequent is told to the shards by a bitmap of hashes of bounded size:
a false positive costs time and changes no count, and the sums decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, small, staged

MOST, LEAST, TOP, NO_LANG = 5, 100, 2000, "und"
#: Bytes of a shard's text; a piece without any separator stays whole.
SHARD = 8 << 20
#: Bits of a bitmap for each of its entries, and at most: 16 MB.
BITS_EACH, MOST_BITS = 32, 27
#: What ends a piece, as bytes; the first of them stands for all. Words are what spaces and tabs divide.
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
MARKED = bytes.maketrans(SEPARATORS, SEPARATORS[:1] * len(SEPARATORS))
SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
KEY = ["lang", "size", "phrase"]


class Vocabulary(dict):
    """Ids of words by first use; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shards(texts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Marked texts, joined and cut at separators, of ``most`` bytes at least but the last, and of few more."""
    held, size = [], 0
    for text in texts:
        at = 0
        while size + len(text) - at >= most:
            cut = text.find(b".", at + most - size)
            cut = len(text) if cut < 0 else cut
            yield b".".join([*held, text[at:cut]])
            held, size, at = [], 0, cut
        held.append(text[at:])
        size += len(text) - at + 1
    if held:
        yield b".".join(held)


def chains(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The runs of ids whose neighbours are linked (each with the next), with a 0 after each run."""
    end = ~linked
    keep = np.flatnonzero(linked | np.r_[False, linked[:-1]])
    ends = end[keep]
    out = np.zeros(len(keep) + int(ends.sum()), np.int64)
    out[np.arange(len(keep)) + np.r_[0, np.cumsum(ends)[:-1]] if len(keep) else []] = ids[keep]
    return out


def suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words, by prefix doubling."""
    rank, h = ids, 1
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - h)] = rank[h:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]
        h *= 2
    return np.argsort(rank, kind="stable")


def interval_counts(ids: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the places where its phrases begin, one for each phrase, and their counts. 0 is in no phrase."""
    order = suffixes(ids, sizes[-1])
    zeros = np.r_[np.flatnonzero(ids == 0), len(ids)]
    reach = zeros[np.searchsorted(zeros, order)] - order
    order = order[reach >= sizes[0]]
    reach = reach[reach >= sizes[0]]
    lcp, same = np.zeros(max(0, len(order) - 1), np.int64), np.ones(max(0, len(order) - 1), bool)
    padded = np.r_[ids, np.zeros(sizes[-1], np.int64)]
    for k in range(sizes[-1]):
        a = padded[order + k]
        same &= (a[1:] == a[:-1]) & (a[1:] != 0)
        lcp += same
    for size in sizes:
        starts = np.flatnonzero(np.r_[True, lcp < size]) if len(order) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(order)])
        keep = reach[starts] >= size
        yield size, order[starts[keep]], counts[keep]


def bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the hashes; its length is a power of two."""
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def shard_counts(lang: str, data: bytes, sizes: range, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of the sizes in one shard with their counts; with size 1 also size 0, all words."""
    tokens, vocabulary = data.replace(b".", b" . ").split(), Vocabulary({b".": 0})
    ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    if bitmap is not None and len(ids):
        start = lang.encode() + b"\t"
        h = np.array([xxhash.xxh64_intdigest(start + w, 42) for w in vocabulary], np.uint64)
        if sizes[-1] == 2:
            good = bit(bitmap, h)
            good[0] = False
            good = good[ids]
            linked = good & np.r_[good[1:], False]
        else:
            h, inside = h[ids], ids != 0
            linked = inside & np.r_[inside[1:], False] & bit(bitmap, h << np.uint64(1) ^ np.r_[h[1:], h[:1]])
        ids = chains(ids, linked)
    found = []
    words = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
    for size, at, counts in interval_counts(ids, sizes):
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + k])) for k in range(size)], " ")
        found.append((size, phrase, pa.array(counts, pa.int64())))
    if sizes[0] == 1:
        found.append((0, pa.array([""]), pa.array([int((ids != 0).sum())], pa.int64())))
    for size, phrase, f in found:
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), size, np.int32)), phrase, f], schema=SCHEMA)


def counter(sizes: range, bitmap: Broadcast | None, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        held: dict[str, list[bytes]] = {}
        sizes_held: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py().lower().translate(MARKED)
                held.setdefault(lang, []).append(data)
                sizes_held[lang] = sizes_held.get(lang, 0) + len(data) + 1
                if sum(sizes_held.values()) >= most:
                    lang = max(sizes_held, key=sizes_held.get)
                    for shard in shards(iter(held.pop(lang)), most):
                        yield from shard_counts(lang, shard, sizes, bits)
                    del sizes_held[lang]
        for lang, texts in held.items():
            for shard in shards(iter(texts), most):
                yield from shard_counts(lang, shard, sizes, bits)

    return counts


def bitmap_of(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashes (h), some BITS_EACH bits for each of n, 2^MOST_BITS at most. Its words are set on Spark and fetched."""
    bits = 1 << min(MOST_BITS, max(16, (BITS_EACH * n - 1).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    slots = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[slots["slot"].to_numpy()] = slots["word"].to_numpy().view(np.uint64)
    return out


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.concat("lang", F.lit("\t"), word))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """Phrases of 1 to ``most`` words that occur ``least`` times or more in a language: lang, size, phrase, f; size 0 has all its words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)), F.coalesce(F.col(text_col), F.lit("")))
    found: list[DataFrame] = []
    for sizes in (range(1, 2), range(2, 3), range(3, most + 1)):
        if not sizes:
            break
        bitmap = None
        if found:
            before = found[-1].where(F.col("size") == len(found))
            parts = F.split("phrase", " ")
            h = word_hash(F.col("phrase")) if len(found) == 1 else F.shiftleft(word_hash(parts[0]), 1).bitwiseXOR(word_hash(parts[1]))
            bitmap = spark.sparkContext.broadcast(bitmap_of(before.select(h.alias("h")), found[-1].staged_rows))
        counted = map_batches(rows, counter(sizes, bitmap, shard), "lang string, size int, phrase string, f long")
        summed = counted.groupBy(*KEY).agg(F.sum("f").alias("f"))
        found.append(staged(summed.where((F.col("f") >= least) | (F.col("size") == 0)), "phrases"))
        if bitmap is not None:
            bitmap.unpersist()
    return staged(reduce(DataFrame.unionByName, found), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, least: int = LEAST, top: int = TOP, covered: int = 100, shard: int = SHARD) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``most`` words and ``least`` occurrences a. Each cut into two parts
    with l and r occurrences among the language's n words scores floor(1000 a n / (l r));
    the lowest counts, the first of equal ones. Candidates inside a longer one that has
    ``covered`` per cent of their occurrences or more are dropped.

    Null and empty texts hold no words, a null language is ``und``; repeated rows count each
    time; no rows give no phrases; other columns are ignored. Equal scores are ordered by a,
    then by the phrase's bytes.
    """
    phrases = phrase_counts(docs, text_col, lang_col, most, least, shard)
    totals = staged(phrases.where("size = 0").select("lang", F.col("f").alias("n")), "totals")
    known = phrases.where("size > 0")
    candidates = known.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    # Which are inside a longer one with as many occurrences: every shorter part of a candidate tells of it.
    inner = candidates.where("size > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    inner = inner.select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(small(staged(inner, "inner")), ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= covered * F.col("a"), F.lit(False)))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    parts = known.where(F.col("size") < most)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(1000 * a * n AS decimal(38,0)) div cast(l * r AS decimal(38,0))")
    scored = cuts.join(small(totals), "lang").select("lang", "phrase", "k", *(wide(c).alias(c) for c in "alrn")).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, 6)) AS size FROM lists WHERE len(w) > 0),
begun AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM begun),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
inner_sizes AS (SELECT *, unnest(range(2, size)) AS k FROM candidates WHERE size > 2),
inner_parts AS (SELECT *, unnest(range(1, size - k + 2)) AS i FROM inner_sizes),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""
