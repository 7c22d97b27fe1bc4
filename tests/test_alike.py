"""Trainings that learn from rows alike together, against those that read every row."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.operators import cohorts, trees


def few_kinds(spark, n=4000):
    x = [F.when(F.xxhash64("id", F.lit(i)) % 11 != 0, F.pmod(F.xxhash64("id", F.lit(-i)), F.lit(6)).cast("double")) for i in (1, 2)]
    df = spark.range(n).select(F.col("id").alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    return df.withColumn("y", F.coalesce("x0", F.lit(9.0)) * 2 + F.coalesce("x1", F.lit(-3.0))).withColumn("c", (F.col("y") / 6).cast("int") % 3)


def test_rows_alike_are_learnt_from_together(spark, monkeypatch):
    df = few_kinds(spark)
    cfg = trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=6, bins=8, least_rows=40)
    read = []
    cells = cohorts.level_cells
    monkeypatch.setattr(cohorts, "level_cells", lambda rows, *more: read.append(rows.count()) or cells(rows, *more))

    def models():
        read.clear()
        out = [trees.train_gbdt(df, ["x0", "x1"], "y", "k", cfg), *cohorts.train_many(df, ["x0", "x1"], "y", "k", [cfg, replace(cfg, rate=0.2)])]
        return [*out, *cohorts.train_multiclass(df, ["x0", "x1"], "c", "k", 3, cfg).models], max(read)

    few, most = models()
    scored, folds = cohorts.cross_validated(df, ["x0", "x1"], "y", "k", [cfg], 2)
    assert most <= 60 and scored.count() == 4000
    monkeypatch.setattr(cohorts, "ALIKE", 10**9)
    each, all_ = models()
    alone, _ = cohorts.cross_validated(df, ["x0", "x1"], "y", "k", [cfg], 2)
    assert all_ == 4000
    for a, b in zip(few, each, strict=True):
        shape = lambda m: [[(n.feature, n.bin, n.left, n.rows, n.missing_left) for n in t] for t in m.trees]
        assert shape(a) == shape(b)
        assert [n.value for t in a.trees for n in t] == pytest.approx([n.value for t in b.trees for n in t])
    far = scored.join(alone.select("k", F.col("p_0").alias("q")), "k").agg(F.max(F.abs(F.col("p_0") - F.col("q"))), F.count("*")).first()
    assert far[0] < 1e-9 and far[1] == 4000


def test_scores_of_many_trees_come_from_arrays(spark, monkeypatch):
    df = few_kinds(spark, 500)
    model = cohorts.train_multiclass(df, ["x0", "x1"], "c", "k", 3, trees.TreeConfig(rounds=8, rate=0.5, depth=3, leaves=8, bins=8))
    assert "ArrowEvalPython" in model.predict_proba(df)._jdf.queryExecution().toString()
    got = model.predict_class(df, proba="p").orderBy("k").collect()
    monkeypatch.setattr(cohorts, "COMPILED", 10**9)
    want = model.predict_class(model.predict_proba(df)).orderBy("k").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
