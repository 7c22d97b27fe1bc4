"""Vector trees for several labels by direct sums."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.functions import losses
from tessella.operators import cohorts, ensembles, evaluation, trees
from tessella.operators.trees import TreeConfig

CFG = TreeConfig(rounds=1, rate=0.5, depth=1, leaves=2, bins=6)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(2)])
    df = df.withColumn("x1", F.when(F.col("k") % 4 != 0, F.col("x1")))
    return df.withColumns({"u": (F.col("x0") > 0.6).cast("double"), "v": (F.col("x1").isNull() | (F.col("x1") > 0.9)).cast("double"), "rare": ((F.col("x0") > 0.9) & (F.col("k") % 3 == 0)).cast("double")}).cache()


def best_by_hand(rows, pairs, features, lam=1.0):
    """(feature, bin, missing left, left values, right values) of the split with the largest sum of gains."""
    k = len(pairs[0])
    sums = lambda ids: [(sum(pairs[i][o][0] for i in ids), sum(pairs[i][o][1] for i in ids)) for o in range(k)]
    score = lambda s: sum(g * g / (h + lam) for g, h in s)
    whole, best = sums(range(len(rows))), None
    for f in range(features):
        for low in (0, 1) if any(r[f] == 0 for r in rows) else (0,):
            for b in sorted({r[f] for r in rows if r[f] >= low}):
                left = [i for i, r in enumerate(rows) if low <= r[f] <= b]
                if 0 < len(left) < len(rows):
                    a = sums(left)
                    c = [(G - g, H - h) for (G, H), (g, h) in zip(whole, a)]
                    gain = score(a) + score(c) - score(whole)
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = (gain, f, b, low == 0, [-g / (h + lam) * 0.5 for g, h in a], [-g / (h + lam) * 0.5 for g, h in c])
    return best[1:]


@pytest.mark.parametrize("loss", ["log_loss", "focal"])
def test_a_split_by_direct_sums(spark, table, loss):
    bounds, base, trees = ensembles.train_multilabel(table, ["x0", "x1"], ["u", "v"], CFG, loss=loss)
    bins = [ensembles.binned(F.col(f), bounds[f]).alias(f) for f in ("x0", "x1")]
    pairs = [c.alias(f"{n}{k}") for k, y in enumerate(("u", "v")) for n, c in zip("gh", losses.LOSSES[loss].pair(F.col(y), F.lit(base[k])))]
    rows = table.select(*bins, *pairs).collect()
    (top, _), (_, left), (_, right) = trees[0]
    want = best_by_hand([(r.x0, r.x1) for r in rows], [((r.g0, r.h0), (r.g1, r.h1)) for r in rows], 2)
    assert (top.feature, top.bin, top.missing_left) == want[:3] and left == pytest.approx(want[3]) and right == pytest.approx(want[4])


def test_presets_change_what_they_name(table):
    plain = trees.preset("standard")
    assert (plain.rounds, plain.rate, plain.depth, plain.subsample, plain.colsample, plain.goss) == (100, 0.1, 6, 1.0, 1.0, None)
    accuracy, robust = trees.preset("accuracy"), trees.preset("robust", TreeConfig(goss=(0.5, 0.5)))
    assert (accuracy.depth, accuracy.rate, accuracy.rounds, accuracy.subsample, accuracy.colsample) == (10, 0.05, 200, 0.8, 0.8)
    assert (robust.goss, robust.subsample, robust.colsample) == (None, 0.8, 0.8) and trees.preset("speed").depth == 4
    short = TreeConfig(rounds=1, leaves=4, bins=8)
    models = cohorts.train_many(table, ["x0"], "u", "k", [replace(trees.preset(p, short), rounds=1) for p in trees.PRESETS])
    assert all(len(m.trees) == 1 for m in models)
    assert trees.train_gbdt(table, ["x0"], "u", "k", trees.preset("conformal", short)).interval is not None
    with pytest.raises(ValueError, match="unknown preset"):
        trees.preset("fast")


def test_missing_values_take_their_own_side(table):
    model = ensembles.train_multilabel(table, ["x0", "x1"], ["v"], TreeConfig(rounds=8, rate=0.5, depth=2, leaves=4, bins=12))
    out = ensembles.predict_multilabel(table, model, ["v"]).groupBy(F.col("x1").isNull().alias("m")).agg(F.min("p_v"), F.avg("p_v")).collect()
    mean = {r.m: r["avg(p_v)"] for r in out}
    assert mean[True] > 0.75 and mean[False] < 0.25


def test_focal_loss_finds_rare_labels_and_rows_without_a_label(table):
    cfg = TreeConfig(rounds=7, rate=0.5, depth=2, leaves=4, bins=12)
    for loss in ("log_loss", "focal"):
        model = ensembles.train_multilabel(table, ["x0", "x1"], ["u", "rare"], cfg, loss=loss)
        out = ensembles.predict_multilabel(table, model, ["u", "rare"])
        assert evaluation.auc(out, "rare", "p_rare").first()[0] > 0.9
    holes = table.withColumn("u", F.when(F.col("k") % 2 == 0, F.col("u")))
    half = ensembles.train_multilabel(holes, ["x0"], ["u"], CFG)
    alone = ensembles.train_multilabel(holes.where("u is not null"), ["x0"], ["u"], CFG)
    assert math.isclose(half[1][0], alone[1][0]) and half[2][0][1][1] != [0.0]
