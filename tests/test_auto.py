"""Automatic modelling by task and budget."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.operators import auto, cohorts, evaluation, linear, trees

TREE = trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=16)
PLAIN = auto.AutoConfig(tree=TREE, engineer=False, modes=("trees",))


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(500).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(3)])
    return df.withColumn("y", 3 * F.col("x0") + F.when(F.col("x1") > 0.5, 2.0).otherwise(0.0) * F.col("x2")).cache()


def test_two_classes_get_probabilities_by_log_loss(table):
    df = table.withColumn("b", F.when(F.col("y") > 2.2, "yes").otherwise("no")).drop("y")
    model = auto.build(df, "b", "k", replace(PLAIN, modes=("trees", "linear_then_trees")))
    assert model.task == "binary" and model.model.trees.config.loss == "log_loss" and set(model.probes) == {"trees", "linear_then_trees"}
    out = model.predict_class(df).agg(F.min("prediction"), F.max("prediction"), F.avg((F.col("predicted") == F.col("b")).cast("int"))).first()
    assert 0 < out[0] < out[1] < 1 and out[2] > 0.85
    assert len(model.update(df, 2).model.trees.trees) == 5
    assert model.predict(df.drop("b")).count() == 500


def test_linear_part_and_trees_share_the_link(table):
    df = table.withColumn("b", (F.col("y") > 2.2).cast("double"))
    model = linear.train_universal(df, ["x0", "x1", "x2"], "b", "k", "linear_then_trees", replace(TREE, loss="log_loss"))
    rows = model.trees.with_bins(df).withColumn("raw", model.trees.raw() + model.linear.column()).select("raw", "k").collect()
    got = {r.k: r.prediction for r in model.predict(df).collect()}
    assert model.trees.base == 0 and all(math.isclose(got[r.k], 1 / (1 + math.exp(-r.raw))) for r in rows)
    loss = lambda m: m.predict(df).agg(evaluation.binary_metrics(F.col("b"), F.col("prediction"))["log_loss"]).first()[0]
    assert loss(model.update(df, 2)) < loss(model) and len(model.update(df, 1, 0.5).trees.trees) == 4


def test_several_classes_of_text(table):
    df = table.withColumn("c", F.when(F.col("y") < 1, "low").when(F.col("y") < 2.5, "mid").when(F.col("k") % 50 > 0, "top"))
    model = auto.build(df.drop("y"), "c", "k", PLAIN)
    assert model.task == "multiclass" and model.answer.classes == ["low", "mid", "top"] and isinstance(model.model, cohorts.Multiclass)
    out = model.predict(df)
    assert out.where("c is not null").agg(F.avg((F.col("prediction") == F.col("c")).cast("int"))).first()[0] > 0.85 and {"p_0", "p_1", "p_2"} <= set(out.columns)
    assert "multiclass" in model.report() and model.trees() == 3
    with pytest.raises(ValueError, match="isn't updated"):
        model.update(df, 1)
    with pytest.raises(ValueError, match="classes"):
        auto.build(df.withColumn("c", F.col("k").cast("string")), "c", "k", PLAIN)


def test_targets_are_freed_from_their_bounds(table):
    skewed = table.withColumn("y", F.exp(2 * F.col("y")))
    model = auto.build(skewed, "y", "k", replace(PLAIN, transform=True))
    assert model.answer.transform == "log1p" and "transform log1p" in model.report()
    low, high = skewed.agg(F.min("y"), F.max("y")).first()
    a, b = model.predict(skewed).agg(F.min("prediction"), F.max("prediction")).first()
    assert low <= a < b <= high
    share = table.withColumn("y", F.col("y") / 5)
    model = auto.build(share, "y", "k", replace(PLAIN, transform=True))
    a, b = model.predict(share).agg(F.min("prediction"), F.max("prediction")).first()
    assert model.answer.transform == "logit" and 0 < a < b < 1


class Clock:
    """A second passes with each look."""

    def __init__(self, step=1.0):
        self.now, self.step = 0.0, step

    def __call__(self):
        self.now += self.step
        return self.now


def test_a_budget_shortens_the_build(table):
    wanted = replace(PLAIN, engineer=True, modes=("trees", "forest"), tuning="quick", seeds=3, tree=replace(TREE, rounds=40))
    phases = []
    model = auto.build(table, "y", "k", replace(wanted, budget=12.0), on_phase=lambda name, s: phases.append(name), clock=Clock())
    assert model.trees() < 40 and model.notes and "shortened" in model.report() and not model.trials.trials
    assert phases == ["profile", "features", "encode", "probes", "tuning", "encode", "train"] and set(model.seconds) == set(phases)
    assert model.predict(table).where("prediction is null").count() == 0 and not model.others
    budget = auto.Budget(100.0, clock=Clock())
    assert budget.fits("train", 50) and not budget.fits("train", 95) and len(budget.notes) == 1
    assert auto.Budget(None).fits("tuning", 1e9)


def test_trials_are_halved_and_seeds_averaged(table):
    model = auto.build(table, "y", "k", replace(PLAIN, tuning="quick", seeds=2, tree=replace(TREE, rounds=4)))
    steps = [t.step for t in model.trials.trials]
    assert steps == [0] * 6 + [1] * 2 and model.trees() == 4 and len(model.others) == 1
    assert model.model.trees.config.rate in {t.params["rate"] for t in model.trials.trials if t.step == 1}
    each = [m.predict(model.prepare(table)).orderBy("k").select("prediction").collect() for m in (model.model, *model.others)]
    both = model.predict(table).orderBy("k").select("prediction").collect()
    assert all(math.isclose(r[0], (a[0] + b[0]) / 2) for r, a, b in zip(both, *each))


def test_own_validation_panels_and_modes(table):
    panel = table.withColumns({"g": F.col("k") % 5, "t": F.floor(F.col("k") / 5)}).withColumn("y", F.col("y") + F.col("x0"))
    model = auto.build(panel, "y", "k", replace(PLAIN, engineer=True, group="g", time="t"), mode="linear_then_trees", validation=panel.where("k % 5 = 0"))
    assert model.features.panel["group"] == "g" and set(model.probes) == {"linear_then_trees"}
    assert any("_lag_1" in f for f in model.features.names(panel)) and model.predict(panel).count() == 500


def test_labels_choose_mode_and_thresholds(table):
    df = table.withColumns({"u": (F.col("x0") > 0.7).cast("double"), "v": (F.col("y") > 2).cast("double")})
    model = auto.build_labels(df, ["x0", "x1", "x2"], ["u", "v"], "k", replace(PLAIN, modes=("trees", "linear_then_trees", "forest")))
    assert set(model.probes) == {"trees", "linear_then_trees"} and model.mode == min(model.probes, key=model.probes.get)
    out = model.predict(df).agg(F.avg((F.col("is_u") == F.col("u")).cast("int")), F.avg((F.col("is_v") == F.col("v")).cast("int"))).first()
    assert min(out) > 0.9 and all(0 < t < 1 for t in model.thresholds.values())
