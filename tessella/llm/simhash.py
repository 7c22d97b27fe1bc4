"""Near duplicates by SimHash fingerprints; pivot distance tables discard pairs.

A fingerprint's row of the table holds its Hamming distances to 64 references, the code
words of a Hadamard matrix. Distances to a reference of two fingerprints differ by their own
distance at most, so a pair whose rows differ by more than ``radius`` in any column is
discarded; survivors are verified bit by bit. The references are orthogonal: the squares of
a pair's 64 differences add up to 64 times its distance, so every pair further apart than
radius squared is sure to be discarded by the table alone.

No column deals fingerprints out well (random ones lie 32 +- 4 from any reference), so pairs
meet in buckets: of ``blocks`` groups of bits, two fingerprints within the radius agree on
all but ``radius`` of them, and each choice of so many groups is a key. More fingerprints
get more blocks, which makes buckets smaller and loses no pair.

Buckets of ordinary size lie in runs of a sorted partition. What is in one class already
needs no comparison, and a bucket only gives the links that join its members to its classes.
In larger buckets, members first meet a few hubs; then the rows outside the largest class
meet all rows, in tasks of block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, small, staged
from tessella.llm.components import components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Members of a bucket that one run compares; larger ones are cut into blocks of BLOCK.
RUN, BLOCK, HUBS = 1024, 2048, 3
#: Fingerprints that a bucket holds on average, from which the number of blocks of bits follows.
BUCKET = 64
#: Shingles whose bits are counted at once.
CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A to Z and ASCII white space alone
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, flat = [0, *ends[:-1].tolist()], b" ".join(words)
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, total, counts = xxhash.xxh64_intdigest, len(ends), np.zeros(BITS, np.int64)
    for at in range(0, total, CHUNK):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, fp (the fingerprint's 64 bits as a signed number)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fingerprinted, f"id {kind}, fp long")


def references() -> np.ndarray:
    """The 64 code words of Sylvester's Hadamard matrix, as columns of +1 and -1."""
    return reduce(lambda m, _: np.block([[m, m], [m, -m]]), range(6), np.ones((1, 1), np.float32))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    signs = 1 - 2 * np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    return ((BITS - signs @ references()) / 2).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those within the radius: discarded by the table, 8 columns at a time, then verified."""
    for at in range(0, table.shape[1], 8):
        keep = (np.abs(table[i, at : at + 8] - table[j, at : at + 8]) <= radius).all(axis=1)
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[keep], j[keep]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; labels are the first member of a class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, to := label[label]):
            label[:] = to


def run_links(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of each run of equal keys to the first of their class."""
    table, label = pivot_table(fps), np.arange(len(key))
    i, away = np.arange(len(key)), 0
    while len(i):
        away += 1
        i = i[i + away < len(key)]
        i = i[key[i] == key[i + away]]
        for at in range(0, len(i), 1 << 18):
            a = i[at : at + (1 << 18)]
            a = a[label[a] != label[a + away]]
            merge(label, *near(fps, table, a, a + away, radius))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def link_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def sorted_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (key, fp) in order of key: the links of every run, whole, wherever batches are cut."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if batch.num_rows:
                key = np.r_[key, batch.column(0).to_numpy()]
                fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
                last = int(np.searchsorted(key, key[-1]))
                yield link_batch(*run_links(key[:last], fps[:last], radius))
                key, fps = key[last:], fps[last:]
        yield link_batch(*run_links(key, fps, radius))

    return links


def block_links(radius: int) -> Callable[[pa.Table], pa.Table]:
    """For one task's rows (fp, class, rest): the links of rows outside the largest class with the others of another class."""

    def links(table: pa.Table) -> pa.Table:
        fps, of, rest = (table.column(c).to_numpy() for c in ("fp", "class", "rest"))
        fps = fps.view(np.uint64)
        pivots, label = pivot_table(fps), np.unique(of, return_index=True, return_inverse=True)
        label = label[1][label[2]].astype(np.int64)
        for i in np.flatnonzero(rest):
            j = np.flatnonzero(label != label[i])
            merge(label, *near(fps, pivots, np.full(len(j), i), j, radius))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table(link_batch(fps[moved], fps[label[moved]]).to_pydict(), schema=pa.schema({"u": pa.int64(), "v": pa.int64()}))

    return links


def blocks_for(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> int:
    """The fewest blocks of bits with which n random fingerprints leave ``bucket`` or fewer in a bucket."""
    return next(b for b in range(radius + 1, 2 * radius + 1) if b == 2 * radius or n / 2 ** (BITS * (b - radius) / b) <= bucket)


def keys(fp: Column, blocks: int, radius: int = RADIUS) -> list[Column]:
    """A key for each choice of the blocks that two fingerprints within the radius may have in common."""
    cuts = [round(BITS * k / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    assert len(chosen) == comb(blocks, radius)
    return [F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(chosen)]


def hub_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links of the members of large buckets (key, fp) with a few members of each."""
    hubs = [F.expr(f"min_by(fp, xxhash64(fp, {s}))") for s in range(HUBS)]
    hubs = staged(hot.groupBy("key").agg(F.array_distinct(F.array(*hubs)).alias("hubs")), "hubs")
    met = hot.join(small(hubs), "key").select("fp", F.explode("hubs").alias("hub"))
    return met.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius) & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def hot_links(hot: DataFrame, links: DataFrame, radius: int) -> DataFrame:
    """Links that are still missing in large buckets (key, fp), given the links (u, v) found so far."""
    known = staged(links.unionByName(hub_links(hot, radius)).distinct(), "known")
    classes = components(known).toDF("fp", "class")
    members = staged(hot.join(small(classes), "fp", "left").withColumn("class", F.coalesce("class", "fp")), "hot_members")
    sizes = members.groupBy("key", "class").count().groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("classes"))
    sizes = staged(sizes.where("classes > 1").select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    own = members.join(small(sizes), "key").withColumn("salt", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    # A row outside the largest class meets the rows of every block, from the side of its own block.
    rest = own.where("class <> main").select("key", F.col("salt").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "fp", "class", F.lit(True).alias("rest"))
    sides = staged(own.where("class <> main").select("key", F.col("salt").alias("a")).distinct(), "sides")
    other = own.join(small(sides), "key").select("key", "a", F.col("salt").alias("b"), "fp", "class", F.lit(False).alias("rest"))
    found = rest.unionByName(other).groupBy("key", "a", "b").applyInArrow(block_links(radius), "u long, v long")
    return known.unionByName(staged(found.distinct(), "hot_links"))


def fingerprint_classes(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, run: int = RUN) -> DataFrame:
    """From distinct fingerprints (fp) one row (id, class) for each that isn't the smallest of its class."""
    n = getattr(fps, "staged_rows", None)
    blocks = blocks or blocks_for(fps.count() if n is None else n, radius)
    keyed = fps.select(F.explode(F.array(*keys(F.col("fp"), blocks, radius))).alias("key"), "fp")
    large = staged(keyed.groupBy("key").count().where(F.col("count") > run).select("key"), "large")
    ordinary = keyed.join(small(large), "key", "left_anti") if large.staged_rows else keyed
    links = staged(ordinary.repartition("key").sortWithinPartitions("key").mapInArrow(sorted_links(radius), "u long, v long"), "links")
    if large.staged_rows:
        links = hot_links(staged(keyed.join(small(large), "key", "left_semi"), "hot"), links, radius)
    return components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row: id_col, fingerprint (16 hexadecimal digits), component_id (the smallest id that links reach).

    Null texts and texts without words have fingerprint zero, which links like any other.
    Rows of one id are judged apart, each by its own text. A row with a null id links others,
    and its component is null only if it holds no id at all. No rows give no rows; other
    columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    classes = fingerprint_classes(nodes, radius).toDF("fp", "class")
    # Only fingerprints with links need another id than their own rows' smallest.
    linked = staged(classes.unionByName(classes.select(F.col("class").alias("fp"), "class").distinct()), "linked")
    linked = nodes.join(small(linked), "fp")
    component = linked.groupBy("class").agg(F.min("least").alias("component"))
    named = staged(linked.join(component, "class").select("fp", "component"), "components")
    named = nodes.join(small(named), "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
