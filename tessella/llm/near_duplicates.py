"""Near duplicates by Order MinHash and banded alignment.

Equal texts are one node. A node's k-mers are its runs of five words, each labelled with
its occurrence. Each of ``samples`` hash functions picks the ``width`` smallest labelled
k-mers and keeps them in text order; nodes with an equal sample are candidates. Such a
sample agrees with about the width-th power of the alignment similarity. Samples of short
texts agree less often, so texts of ``SHORT`` k-mers at most meet by single k-mers: of their
labelled k-mers in the order of a hash, each keeps so many of the first that two with a link
must share one.

Candidates are verified in rounds. In each of the first two, a member of a bucket's largest
class so far, at first of any, meets the members of other classes, which only saves work. Then, where a bucket still holds
several classes, all members of different ones meet: as pairs where the bucket has ``few`` members at most, else in
blocks by length and salt, any two of which are one task; a task counts the k-mers that each two of its
texts share and aligns those that share enough and aren't yet in one class. Pairs whose lengths rule a
link out are left out. The similarity of two nodes is the number
of k-mers that an alignment matches over all k-mers of both less those; links have 0.8 or
more, and classes are the connected components.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, small, staged
from tessella.llm.components import components

K, SIMILARITY, SAMPLES, WIDTH, FEW = 5, 0.8, 24, 4, 32
#: Texts of up to so many k-mers meet by single k-mers, without loss.
SHORT = 15
#: Members, and their k-mers, that a block of a large bucket holds on average.
BLOCK, BLOCK_KMERS = 1024, 500_000
SEED = 20_240_229
WORD = regex.compile(r"[\p{L}\p{N}]+")


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of usual length seen lately: some 12 MB at most."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def kmers(text: str | None, hashes: WordHashes, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words, in order; one of all words if there are fewer, none without words."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence number mixed in."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return x
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return x ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F))


def order_minhash(x: np.ndarray, samples: int = SAMPLES, width: int = WIDTH) -> np.ndarray:
    """One key for each sample: the hash of its smallest labelled k-mers in text order."""
    x = labelled(x)
    rng = np.random.default_rng(SEED)
    xor, mul = rng.integers(0, 2**63, samples, np.uint64), rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
    width = min(width, len(x))
    keys = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    step = max(1, 400_000 // len(x))
    for a in range(0, samples, step):
        h = (x[None, :] ^ xor[a : a + step, None]) * mul[a : a + step, None]
        h ^= h >> np.uint64(32)
        at = np.sort(np.argpartition(h, width - 1, axis=1)[:, :width], axis=1)
        for column in x[at].T:
            keys[a : a + step] = (keys[a : a + step] ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys[a : a + step] ^= keys[a : a + step] >> np.uint64(31)
    return keys


def node_keys(x: np.ndarray) -> np.ndarray:
    """The keys by which texts meet: single k-mers up to SHORT k-mers, samples wherever the other text may be longer."""
    keys = []
    if len(x) <= SHORT:
        single = np.sort((labelled(x) ^ np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(single[: len(x) - math.ceil(SIMILARITY * len(x) - 1e-9) + 1])
    if len(x) > SIMILARITY * SHORT:
        keys.append(order_minhash(x))
    return np.concatenate(keys)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence that stays within ``band`` of the diagonal, bit-parallel."""
    masks: dict[int, int] = {}
    wanted = set(b)
    for i, x in enumerate(a):
        if x in wanted:
            masks[x] = masks.get(x, 0) | 1 << i
    low = high = matched = row = 0
    for i, x in enumerate(b):
        top = min(len(a), i + band + 1)
        row |= ((1 << (top - high)) - 1) << (high - low)
        high = top
        if i - band > low:
            matched += 1 - (row & 1)
            row >>= 1
            low += 1
            if low >= high:
                return matched
        if hit := (masks.get(x, 0) >> low) & ((1 << (high - low)) - 1) & row:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
    return matched + (high - low) - row.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched k-mers over all k-mers of both less the matched; 0 as soon as it must lie below ``least``."""
    total = len(a) + len(b)
    need = least / (1 + least) * total - 1e-9
    if not total or min(len(a), len(b)) < need:
        return 0.0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    matched = head + tail
    if a and b:
        if matched + sum((Counter(a) & Counter(b)).values()) < need:
            return 0.0
        # Unmatched k-mers of both sides bound how far a good alignment leaves the diagonal.
        matched += aligned(a, b, int(total - 2 * need) + 1)
    return matched / (total - matched) if matched >= need else 0.0


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, keys, sizes = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if len(x := kmers(text.as_py(), hashes)):
                ids.append(i)
                keys.append(node_keys(x))
                sizes.append(len(x))
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        each = np.array([len(k) for k in keys], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), each)), pa.array(flat), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["id", "key", "n"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, cache = WordHashes(), OrderedDict()

    def of(i: int, text: str) -> np.ndarray:
        held = cache.get(i)
        if held is None or held[0] != text:
            held = cache[i] = (text, kmers(text, hashes))
        cache.move_to_end(i)
        if len(cache) > 64:
            cache.popitem(last=False)
        return held[1]

    for batch in batches:
        u, v, s = [], [], []
        for a, b, ta, tb in zip(*(batch.column(c) for c in range(4))):
            a, b = a.as_py(), b.as_py()
            if score := alignment_similarity(of(a, ta.as_py()), of(b, tb.as_py())):
                u.append(a), v.append(b), s.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among candidate pairs (u, v)."""
    joined = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    return staged(map_batches(joined.select("u", "v", "tu", "tv"), verified, "u long, v long, similarity double"), "links")


def near_classes(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that a few hops reach. Parts of the true classes, for a few joins."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("class")).withColumn("class", F.least("id", "class"))
    hop = both.join(label.select(F.col("id").alias("v"), "class"), "v").groupBy(F.col("u").alias("id")).agg(F.min("class").alias("class"))
    label = staged(hop.withColumn("class", F.least("id", "class")), "near_classes")
    for _ in range(2):  # pointer jumping doubles the reach
        to = label.select(F.col("id").alias("class"), F.col("class").alias("next"))
        label = staged(label.join(small(to), "class").select("id", F.least("class", "next").alias("class")), "near_classes")
    return label


def pair(a, b) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def fits(a, b):
    """Whether two nodes' lengths allow a link."""
    return F.least(a["n"], b["n"]) >= SIMILARITY * F.greatest(a["n"], b["n"])


def star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Candidate pairs of one member of each bucket's largest class, drawn by the seed, with the members of other classes."""
    node = F.struct("id", "n", "class")
    classes = members.groupBy("key", "class").agg(F.count("*").alias("size"), F.min_by(node, F.xxhash64("id", "key", F.lit(seed))).alias("one"))
    main = classes.groupBy("key").agg(F.max_by("one", F.struct("size", F.xxhash64("class", "key", F.lit(seed)))).alias("o"), F.count("*").alias("classes")).where("classes > 1")
    star = members.join(small(staged(main.select("key", "o"), "main")), "key").where((F.col("class") != F.col("o.class")) & fits(F.struct("n"), F.col("o")))
    return star.select(*pair(F.col("id"), F.col("o.id"))).distinct()


def mixed_pairs(members: DataFrame, few: int) -> DataFrame:
    """All candidate pairs of different classes in buckets of ``few`` members at most, from (key, id, n, class)."""
    keys = members.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("least"), F.max("class").alias("most"))
    keys = staged(keys.where((F.col("least") != F.col("most")) & (F.col("members") <= few)).select("key"), "keys")
    listed = members.join(small(keys), "key", "left_semi")
    of = listed.groupBy("key").agg(F.collect_list(F.struct("id", "n", "class")).alias("others"))
    near = F.filter("others", lambda o: (o["id"] > F.col("id")) & (o["class"] != F.col("class")) & fits(o, F.struct("n")))
    return listed.join(of, "key").select("id", F.explode(near).alias("o")).select(*pair(F.col("id"), F.col("o.id"))).distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share; a set with itself counts only what others hold too."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, columns, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, columns = rows[held[columns] > 1], columns[held[columns] > 1]
    columns = np.unique(columns, return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, 2048):
        a, b = np.searchsorted(columns, [at, at + 2048])
        held = np.zeros((len(sets), 2048), np.float32)
        held[rows[a:b], columns[a:b] - at] = 1
        out += held @ held.T
    return out


def block_links(table: pa.Table) -> pa.Table:
    """Links that join different classes among the rows (id, class, text): all that aren't implied by those before."""
    ids, classes = table.column("id").to_pylist(), table.column("class").to_pylist()
    u, v = [], []
    if len(set(classes)) > 1:
        hashes = WordHashes()
        x = [kmers(t.as_py(), hashes) for t in table.column("text")]
        n = np.array([len(k) for k in x])
        need = SIMILARITY / (1 + SIMILARITY) * (n[:, None] + n[None, :]) - 1e-6
        first = {c: k for k, c in reversed(list(enumerate(classes)))}
        root = [first[c] for c in classes]

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for i, j in np.argwhere(np.triu(overlaps([labelled(k) for k in x]) >= need, 1)).tolist():
            a, b = top(i), top(j)
            if a != b and alignment_similarity(x[i], x[j]):
                root[max(a, b)] = min(a, b)
                u.append(min(ids[i], ids[j])), v.append(max(ids[i], ids[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def wide_links(members: DataFrame, texts: DataFrame, few: int, block: int = BLOCK) -> DataFrame:
    """The links (u, v) that join the classes of buckets of more than ``few`` members, from (key, id, n, class)."""
    mixed = [F.count("*").alias("members"), F.sum("n").alias("kmers"), F.min("class").alias("least"), F.max("class").alias("most")]
    keys = members.groupBy("key").agg(*mixed).where((F.col("least") != F.col("most")) & (F.col("members") > few))
    wide = members.join(small(staged(keys.select("key"), "keys")), "key", "left_semi")
    # Two texts that can be linked lie in the same length class or in neighbouring ones.
    level = F.floor(F.log(F.col("n")) / -math.log(SIMILARITY)).cast("int")
    wide = wide.select("key", "id", "n", "class", F.explode(F.array(level, level + 1)).alias("level"))
    wide = staged(wide.select(F.xxhash64("key", "level").alias("key"), "id", "n", "class").distinct(), "wide")
    keys = wide.groupBy("key").agg(*mixed).where(F.col("least") != F.col("most"))
    keys = keys.select("key", F.ceil(F.greatest(F.col("members") / block, F.col("kmers") / BLOCK_KMERS)).cast("int").alias("blocks"))
    own = wide.join(small(staged(keys, "keys")), "key").withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("key", F.least("salt", "with").alias("a"), F.greatest("salt", "with").alias("b"), "id", "class")
    tasks = own.join(texts.select("id", "text"), "id").groupBy("key", "a", "b")
    return staged(tasks.applyInArrow(block_links, "u long, v long").distinct(), "wide_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """One row for each id: id_col and class_id, the smallest id of its class.

    Null and empty texts, and texts without letters or digits, are alike only to equal
    texts; a null text equals other null texts. Texts of fewer than five words are one
    k-mer. Rows that share an id are one document in one class. Rows with a null id give
    no row. Ids must be whole numbers.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = own.select("id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    groups = named.groupBy("a", "b").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1")
    copies = staged(named.join(groups, ["a", "b"]).where("id <> class").select("id", "class").distinct(), "copies")
    nodes = own.join(small(copies.select("id").distinct()), "id", "left_anti")
    sketch = staged(map_batches(nodes.where("text is not null"), sketched, "id long, key long, n int").distinct(), "sketch")
    shared = sketch.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(sketch.join(small(staged(shared.select("key"), "shared")), "key", "left_semi"), "members")
    texts = staged(nodes.join(small(members.select("id").distinct()), "id", "left_semi").distinct(), "texts")
    found, tried = [], None
    for seed in (1, 2, None):
        classed = members.select("key", "id", "n", F.col("id").alias("class"))
        if found:
            classed = classed.drop("class").join(small(near_classes(reduce(DataFrame.unionByName, found))), "id", "left").withColumn("class", F.coalesce("class", "id"))
        classed = staged(classed, "classed")
        pairs = mixed_pairs(classed, few) if seed is None else star_pairs(classed, seed)
        pairs = staged(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found.append(verify(pairs, texts).select("u", "v"))
    found.append(wide_links(classed, texts, few))
    classes = components(reduce(DataFrame.unionByName, [*found, copies.toDF("u", "v")]))
    out = own.select("id").distinct().join(small(classes), "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
