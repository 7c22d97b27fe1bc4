"""Many models in one pass, against models trained by themselves."""

import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.functions.losses import multiclass
from tessella.operators import cohorts, ensembles, evaluation, trees, tuning

FOUR = ["x0", "x1", "x2", "x3"]


def noisy(spark, n=1200):
    df = spark.range(n).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(4)])
    noise = F.pmod(F.xxhash64("k", F.lit(9)), F.lit(1000)) / 1000 - 0.5
    df = df.withColumn("y", 3 * F.col("x0") + F.when(F.col("x1") > 0.5, 2.0).otherwise(0.0) * F.col("x2") + noise)
    df = df.withColumn("x3", F.when(F.col("k") % 7 != 0, F.col("x3"))).withColumn("y", F.when(F.col("x3").isNull(), F.col("y") + 1).otherwise(F.col("y")))
    return df.withColumn("b", (F.col("y") > 2.5).cast("double"))


def same(a, b):
    """Equal splits; values up to the order of sums."""
    assert len(a.trees) == len(b.trees) and math.isclose(a.base, b.base, abs_tol=1e-9)
    for s, t in zip(a.trees, b.trees):
        assert [(n.feature, n.bin, n.left, n.right, n.rows, n.missing_left) for n in s] == [(n.feature, n.bin, n.left, n.right, n.rows, n.missing_left) for n in t]
        assert [n.value for n in s] == pytest.approx([n.value for n in t], abs=1e-9)


BASE = trees.TreeConfig(rounds=2, rate=0.4, depth=3, leaves=6, bins=16)


@pytest.mark.parametrize(
    "cfg",
    [
        replace(BASE, rounds=7), replace(BASE, loss="log_loss", subsample=0.7, colsample=0.5), replace(BASE, least_rows=20, seed=5), replace(BASE, forest=True, rate=1.0, rounds=3), replace(BASE, monotone={"x0": -1}, groups=[["x0", "x1"], ["x2", "x3"]]),
        replace(BASE, loss="log_loss", entropy=0.5, rounds=2), replace(BASE, validation=0.3, patience=1, rate=1.5, rounds=9), replace(BASE, prune=0.5, least_gain=0.1, least_hessian=5.0),
    ],
)
def test_a_member_equals_the_model_trained_alone(spark, cfg):
    df = noisy(spark)
    target = "b" if cfg.loss == "log_loss" else "y"
    alone = trees.train_gbdt(df, FOUR, target, "k", cfg)
    other = replace(cfg, depth=2, seed=77, rounds=2)
    first, second = cohorts.train_many(df, FOUR, target, "k", [cfg, other])
    same(first, alone)
    same(second, trees.train_gbdt(df, FOUR, target, "k", other))


def test_folds_equal_separate_training(spark):
    df = noisy(spark).withColumn("extra", F.lit(1))
    out, models = cohorts.cross_validated(df, FOUR, "y", "k", [BASE, replace(BASE, depth=2)], 3)
    fold = cohorts.fold_of("k", 3)
    got = {r.k: (r.p_0, r.p_1) for r in out.collect()}
    for c, cfg in enumerate([BASE, replace(BASE, depth=2)]):
        for k in range(3):
            part = df.where(fold != k)
            start = trees.GBDT(FOUR, models[c][k].bounds, part.agg(F.avg("y")).first()[0], [], cfg)
            alone = trees.train_gbdt(part, FOUR, "y", "k", cfg, start)
            same(models[c][k], alone)
            for r in alone.predict(df.where(fold == k)).select("k", "prediction").collect():
                assert math.isclose(got[r.k][c], r.prediction, abs_tol=1e-9)
    assert len(got) == df.count()


def jobs(spark, f):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("counted", "")
    f()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_folds_and_classes_cost_the_jobs_of_one(spark):
    df = noisy(spark, 300).withColumn("c", F.floor(F.col("x0") * 3).cast("int"))
    cfg = replace(BASE, rounds=2)
    one = jobs(spark, lambda: cohorts.train_many(df, FOUR, "y", "k", [cfg]))
    assert jobs(spark, lambda: cohorts.cross_validated(df, FOUR, "y", "k", [cfg, replace(cfg, seed=3)], 4)) <= one + 2
    assert jobs(spark, lambda: cohorts.train_multiclass(df, FOUR, "c", "k", 3, cfg)) <= one + 6


def plain_multiclass(rows, classes, cfg, rounds):
    """Stumps for each class by direct sums, bin 0 on either side; rows are (bins, label)."""
    priors = [math.log(max(sum(y == k for _, y in rows) / len(rows), 1e-6)) for k in range(classes)]
    raw = [list(priors) for _ in rows]
    for _ in range(rounds):
        p = [[math.exp(v) / sum(map(math.exp, r)) for v in r] for r in raw]
        for k in range(classes):
            g = [q[k] - (y == k) for q, (_, y) in zip(p, rows)]
            h = [max(q[k] * (1 - q[k]), 1e-7) for q in p]
            G, H, best = sum(g), sum(h), None
            for f in range(len(rows[0][0])):
                for low, b in [(low, b) for low in (0, 1) for b in sorted({x[f] for x, _ in rows}) if b >= low]:
                    left = [i for i, (x, _) in enumerate(rows) if low <= x[f] <= b]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = 0.5 * (gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1))
                    if hl >= 1 and H - hl >= 1 and gain > 0 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, low, b, -gl / (hl + 1) * cfg.rate, -(G - gl) / (H - hl + 1) * cfg.rate)
            for i, (x, _) in enumerate(rows):
                raw[i][k] += best[4] if best[2] <= x[best[1]] <= best[3] else best[5]
    return [[math.exp(v) / sum(map(math.exp, r)) for v in r] for r in raw]


def test_classes_by_brute_force(spark):
    df = noisy(spark, 240).drop("x3").withColumn("c", F.when(F.col("k") % 50 == 0, None).when(F.col("k") % 51 == 0, 9).otherwise(F.floor(F.col("y")).cast("int") % 3))
    cfg = replace(BASE, rounds=3, depth=1, leaves=2, bins=8)
    model = cohorts.train_multiclass(df, FOUR[:3], "c", "k", 3, cfg)
    rows = model.models[0].with_bins(df).where("c between 0 and 2").orderBy("k").select(*[f"__b_{f}" for f in FOUR[:3]], "c").collect()
    want = plain_multiclass([(tuple(r[:3]), r.c) for r in rows], 3, cfg, 3)
    got = model.predict_class(model.predict_proba(df)).where("c between 0 and 2").orderBy("k").collect()
    for r, p in zip(got, want):
        assert [r.p_0, r.p_1, r.p_2] == pytest.approx(p, abs=1e-9) and r.predicted == p.index(max(p))
    again = cohorts.Multiclass.from_json(model.to_json())
    assert again.predict_proba(df).orderBy("k").select("p_1").collect() == model.predict_proba(df).orderBy("k").select("p_1").collect()
    assert math.isclose(sum(model.importance().values()), 1)


def test_rounds_of_classes_take_time_in_proportion_and_stop(spark):
    df = noisy(spark, 800).withColumn("c", F.floor(F.col("y") / 2).cast("int")).withColumn("late", F.col("k") % 4 == 0)
    seconds = []
    for rounds in (2, 4, 12):
        start = time.time()
        cohorts.train_multiclass(df, FOUR, "c", "k", 3, replace(BASE, rounds=rounds, depth=2))
        seconds.append(time.time() - start)
    assert seconds[2] < 6 * seconds[1]
    seen = []
    cfg = replace(BASE, rounds=40, rate=2.0, patience=2, subsample=0.8)
    model = cohorts.train_multiclass(df, FOUR, "c", "k", 3, cfg, validation=F.col("late"), on_round=lambda r, v: seen.append(v))
    best = seen.index(min(seen))
    assert [len(m.trees) for m in model.models] == [best + 1] * 3 and len(seen) == best + 3 < 40
    halted = cohorts.train_multiclass(df, FOUR, "c", "k", 3, cfg, on_round=lambda r, v: r < 1)
    assert [len(m.trees) for m in halted.models] == [2] * 3
    held = model.predict_proba(df).where("late and c between 0 and 2").agg(evaluation.multiclass_log_loss(F.col("c"), [F.col(f"p_{k}") for k in range(3)])).first()[0]
    assert math.isclose(held, min(seen), rel_tol=1e-9)


def test_odd_tables(spark):
    df = noisy(spark, 200)
    empty = cohorts.train_many(df.limit(0), FOUR, "y", "k", [BASE])[0]
    assert {r.prediction for r in empty.predict(df).select("prediction").collect()} == {0.0}
    gone = df.withColumn("y", F.when(F.col("k") < 100, F.col("y"))).withColumn("x1", F.lit(None).cast("double"))
    same(cohorts.train_many(gone, FOUR, "y", "k", [BASE])[0], trees.train_gbdt(gone, FOUR, "y", "k", BASE))
    with pytest.raises(ValueError, match="levels"):
        cohorts.train_many(df, FOUR, "y", "k", [replace(BASE, depth=20)])


def test_trials_train_together_by_each_metric(spark):
    df = noisy(spark, 500).withColumn("era", F.col("k") % 5)
    base = replace(BASE, rounds=2, loss="log_loss")
    model = tuning.tree_model(FOUR, "b", "k", base)
    trials = [{"rate": 0.2}, {"rate": 0.6, "bins": 8}]
    alone = lambda params: lambda train, _: tuning.train_many(train, FOUR, "b", "k", [tuning.known_settings(base, params)])[0].predict
    for metric in ("log_loss", "f1", "auc", "rank_ic"):
        got = model.together(df, trials, "eras", metric, era="era")
        for t, g in zip(trials, got):
            want = tuning.evaluate_eras(df, "k", "b", alone(t), t, "era", metric=tuning.metric_of(metric, "era"))["value"]
            # Bins come from all rows here and from the training rows there.
            assert math.isclose(g["value"], want, abs_tol=0.06), metric
    log = tuning.tune(df, "k", "b", model, [tuning.Parameter("rate", 0.05, 0.9)], tuning.TunerConfig(steps=2, points=3, evaluation="folds", metric="auc"))
    assert log.larger and log.best().value == max(t.value for t in log.trials) > 0.7 and len(log.trials) >= 5 and "deviation" in log.trials[0].metrics


def test_out_of_fold_seeds_differ(spark):
    df = noisy(spark, 300)
    out = ensembles.out_of_fold(df, FOUR, "y", "k", replace(BASE, rounds=1), [1, 2], 2)
    assert out.columns == ["k", "y", "oof_1", "oof_2"] and out.where("oof_1 <> oof_2").count() > 0 and out.where("oof_1 is null").count() == 0


def test_one_sided_sampling_learns(spark):
    df = noisy(spark, 800)
    model = cohorts.train_many(df, FOUR, "y", "k", [replace(BASE, goss=(0.3, 0.2), rounds=4)])[0]
    assert model.predict(df).agg(evaluation.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).first()[0] > 0.6


def test_gradients_of_classes_match_the_loss(spark):
    row = spark.range(1).select(*[c for k, p in enumerate(multiclass(F.lit(1), [F.lit(0.0), F.lit(0.0)])) for c in (p[0].alias(f"g{k}"), p[1].alias(f"h{k}"))]).first()
    assert tuple(row) == (0.5, 0.25, -0.5, 0.25)
