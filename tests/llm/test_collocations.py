"""Phrase collocations against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import collocations

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=5, least=100, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(a, inside[p[i : i + size]])
        found = []
        for p, a in candidates.items():
            if 100 * inside[p] < 100 * a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shard", [1, 200, collocations.SHARD])
def test_equal_to_brute_force(spark, shard):
    rng = np.random.default_rng(0)
    words = [f"W{k}" for k in range(12)] + ["é", "Él", "a b", "tab\tbed", "\x01", "日本"]
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(words, rng.integers(0, 40)))
        for mark in rng.choice(list(".,;:!?\n\r\x0b\x0c"), 3):
            at = rng.integers(0, len(text) + 1)
            text = text[:at] + mark + text[at:]
        rows.append((text, ["en", "de", None][k % 3]))
    rows += [(None, "en"), ("", "en"), ("...", None), (" \t ", "x"), ("one two three four five six " * 30, "en"), ("same old words. " * 40, "de"), ("same old words. " * 40, "de")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], DOCS).withColumns({"size": F.lit(1), "f": F.lit("x"), "phrase": F.lit(2)})
    for least, top in ((3, 2000), (20, 4)):
        got = collocations.collocations(df.repartition(3), least=least, top=top, shard=shard)
        want = plain(rows, least=least, top=top)
        assert rows_of(got) == want and len(want) > 4
        assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_a_long_text_pairs_only_and_no_rows(spark):
    rows = [("Ab ab cd " * 60_000, "en"), ("x" * 100_000 + " ab", "en")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], DOCS)
    assert rows_of(collocations.collocations(df)) == plain(rows)
    assert rows_of(collocations.collocations(df, most=2)) == plain(rows, most=2)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    wide = "cast(1000 * a * n AS decimal(38,0)) div cast(l * r AS decimal(38,0))"
    a, l, r, n = 3 * 10**12 + 7, 10**13 + 1, 10**13 + 3, 10**15 + 9
    df = spark.createDataFrame([(a, l, r, n)], "a long, l long, r long, n long").select(*(F.col(c).cast("decimal(19,0)") for c in "alrn"))
    assert df.select(F.expr(wide)).first()[0] == 1000 * a * n // (l * r)


def test_intervals_count_what_is_shared():
    ids = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0, 2, 0, 0, 1])
    for size, at, counts in collocations.interval_counts(ids, range(1, 6)):
        want = collections.Counter(tuple(ids[i : i + size]) for i in range(len(ids) - size + 1) if ids[i : i + size].all())
        assert {tuple(ids[i : i + size]): c for i, c in zip(at, counts)} == want and len(at) == len(want)
    order = collocations.suffixes(ids, 4)
    assert [tuple(np.r_[ids, [0] * 4][i : i + 4]) for i in order] == sorted(tuple(np.r_[ids, [0] * 4][i : i + 4]) for i in range(len(ids)))
