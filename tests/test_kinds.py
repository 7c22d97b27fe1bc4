"""Trainings, boundaries and predictions that work on kinds of rows, against those on every row."""

import pytest
from pyspark.sql import functions as F
from test_alike import few_kinds

from tessella.operators import auto, cohorts, encoding, pipeline, trees, tuning

CFG = trees.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=6, bins=8, least_rows=40)


def same(a, b):
    shape = lambda m: [[(n.feature, n.bin, n.left, n.rows, n.missing_left) for n in t] for t in m.trees]
    return shape(a) == shape(b) and [n.value for t in a.trees for n in t] == pytest.approx([n.value for t in b.trees for n in t])


def test_values_are_binned_once_for_each_kind(spark, monkeypatch):
    df = few_kinds(spark)
    kinds = df.groupBy("x0", "x1", "y").agg(F.count("*").alias("__n"))
    assert encoding.boundaries(kinds, ["x0", "x1"], 8) == encoding.boundaries(df, ["x0", "x1"], 8)
    found = []
    boundaries = trees.boundaries
    monkeypatch.setattr(trees, "boundaries", lambda rows, *more: found.append(rows.count()) or boundaries(rows, *more))
    model = trees.train_gbdt(df, ["x0", "x1"], "y", "k", CFG)
    given = trees.train_gbdt(kinds, ["x0", "x1"], "y", "k", CFG)
    assert max(found) <= 60 and same(given, model)
    with pytest.raises(ValueError):
        trees.train_gbdt(kinds, ["x0", "x1"], "y", "k", trees.TreeConfig(rounds=1, subsample=0.5))
    # Predictions compare values with boundaries, missing ones too.
    far = model.with_bins(model.predict(df)).agg(F.max(F.abs(F.col("prediction") - model.raw()))).first()[0]
    assert far < 1e-12


def test_a_forest_sums_its_weights_over_kinds(spark, monkeypatch):
    df = few_kinds(spark, 2000)
    cfg = trees.replace(CFG, forest=True, rate=1.0, rounds=3)
    read = []
    cells = cohorts.level_cells
    monkeypatch.setattr(cohorts, "level_cells", lambda rows, *more: read.append(rows.count()) or cells(rows, *more))
    monkeypatch.setattr(trees, "BLOCK", 2)
    few = trees.train_gbdt(df, ["x0", "x1"], "y", "k", cfg)
    assert max(read) <= 60
    monkeypatch.setattr(cohorts, "ALIKE", 10**9)
    each = trees.train_gbdt(df, ["x0", "x1"], "y", "k", cfg)
    assert max(read) > 1000 and same(each, few)


def test_evaluations_gather_rows_alike(spark, monkeypatch):
    df = few_kinds(spark, 3000).withColumn("text", F.when(F.col("x1") > 2, "a").when(F.col("x1").isNotNull(), "b"))
    model = tuning.realistic(lambda names: tuning.tree_model(names, "y", "k", trees.replace(CFG, rounds=1)), pipeline.Pipeline("y", pipeline.PipelineConfig(bins=8)), ["x0", "text"])
    read = []
    fit = pipeline.Pipeline.fit
    monkeypatch.setattr(pipeline.Pipeline, "fit", lambda self, rows, *more: read.append(rows.count()) or fit(self, rows, *more))
    of = {"holdout": {}, "folds": {"folds": 2}, "conformal": {}}
    values = lambda: {k: tuning.EVALUATIONS[k](df, "k", "y", model, {}, **more) for k, more in of.items()}
    few = values()
    assert max(read) <= 60
    monkeypatch.setattr(cohorts, "ALIKE", 10**9)
    each = values()
    assert max(read) > 1000
    for k in of:
        assert few[k] == pytest.approx(each[k])


def test_automatic_modelling_encodes_and_learns_from_kinds(spark, monkeypatch):
    df = few_kinds(spark, 3000).select("k", "y", "x0", "x1")
    read = []
    fit, cells = pipeline.Pipeline.fit, cohorts.level_cells
    monkeypatch.setattr(pipeline.Pipeline, "fit", lambda self, rows, *more: read.append(rows.count()) or fit(self, rows, *more))
    monkeypatch.setattr(cohorts, "level_cells", lambda rows, *more: read.append(rows.count()) or cells(rows, *more))
    cfg = auto.AutoConfig(engineer=False, tree=trees.replace(CFG, rounds=1, depth=2))
    few = auto.build(df, "y", "k", cfg, mode="linear_then_trees")
    assert max(read) <= 60
    monkeypatch.setattr(cohorts, "ALIKE", 10**9)
    each = auto.build(df, "y", "k", cfg, mode="linear_then_trees")
    assert max(read) > 1000 and few.probes == pytest.approx(each.probes) and same(few.model.trees, each.model.trees)
