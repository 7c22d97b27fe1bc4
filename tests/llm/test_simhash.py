"""SimHash near duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    listed = sorted(parent)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if (a ^ b).bit_count() <= radius and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def checked(spark, rows, found):
    fps = [plain_fingerprint(t) for _, t in rows]
    of, least = plain_components(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = [(i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, fps)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    return want


def test_documents_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"Word{k}" for k in range(500)]
    rows = []
    for k in range(60):
        words = rng.choice(vocabulary, rng.integers(1, 400)).tolist()
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), " ".join(words)))
            words[rng.integers(len(words))] = "edited"
    rows += [(1000, None), (1001, ""), (1002, " \t\x0b\n"), (1003, "x"), (1004, "A b"), (1005, "a\x0bB"), (1005, "other text of id five"), (None, "a b"), (None, "alone"), (1006, "ÀÉ é one word\u0085"), (1007, "w " * 60_000), (1008, "w " * 59_999)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")).withColumn("class", F.lit(2))
    want = checked(spark, rows, simhash.near_duplicates(df).collect())
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def around(rng, centre, n, bits):
    out = np.full(n, centre, np.uint64)
    for k in range(n):
        for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
            out[k] ^= np.uint64(1) << np.uint64(b)
    return out


@pytest.mark.parametrize("blocks", [5, 6, 8])
@pytest.mark.parametrize("run", [8, 1024])
def test_classes_of_fingerprints_equal_brute_force(spark, blocks, run):
    rng = np.random.default_rng(blocks)
    fps = [rng.integers(0, 2**64, 300, np.uint64), around(rng, 0, 120, 3), around(rng, 0xFFFF_FFFF_FFFF_0000, 120, 6), around(rng, 0xFFFF_FFFF_FF00_0000, 120, 5)]
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.id % 2**64: r["class"] % 2**64 for r in simhash.fingerprint_classes(df, blocks=blocks, run=run).collect()}
    of = plain_components([int(f) for f in fps])
    groups = {}
    for f, c in of.items():
        groups.setdefault(c, set()).add(f)
    found = {}
    for f in of:
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_the_table_alone_discards_what_is_far():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 400, np.uint64)
    table = simhash.pivot_table(fps)
    refs = [int("".join("1" if s < 0 else "0" for s in column), 2) for column in simhash.references().T]
    swapped = [int.from_bytes(int(f).to_bytes(8, "little"), "big") for f in fps]  # the table reads bytes as they lie in memory
    assert len(set(refs)) == 64 and table.tolist() == [[(f ^ r).bit_count() for r in refs] for f in swapped]
    i, j = np.triu_indices(len(fps), 1)
    apart = np.bitwise_count(fps[i] ^ fps[j])
    most = np.abs(table[i].astype(int) - table[j]).max(axis=1)
    assert (most <= apart).all() and (most[apart > 16] > 4).all()


def test_more_fingerprints_get_more_blocks():
    assert [simhash.blocks_for(n) for n in (0, 400_000, 10_000_000, 10**10, 10**13)] == [5, 5, 6, 7, 8]
