"""Edge cases on hand-written frames."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import losses, scalar
from tessella.operators import auto, encoding, evaluation, extend, linear, monitoring, preprocess, sketch, trees, tuning
from tessella.sources import models


def frame(spark, values, schema="k long, x double"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def test_scalers_on_constant_and_empty_columns(spark):
    constant = frame(spark, [2.0, 2.0])
    assert [r.x for r in preprocess.StandardScaler(["x"]).fit(constant).transform(constant).collect()] == [0.0, 0.0]
    assert [r.x for r in preprocess.MinMaxScaler(["x"]).fit(constant).transform(constant).collect()] == [0.0, 0.0]
    empty = frame(spark, []).limit(0)
    assert preprocess.RobustScaler(["x"]).fit(empty).transform(empty).count() == 0
    missing = frame(spark, [None, None])
    assert [r.x for r in preprocess.Imputer(["x"], strategy="constant", constant=5.0).fit(missing).transform(missing).collect()] == [0.0, 0.0]


def test_bins_put_boundaries_right_and_missing_in_zero(spark):
    df = frame(spark, [None, float("nan"), float("inf"), 0.0, 1.0, 1.5, 2.0, 9.0])
    assert [r.b for r in df.select(encoding.binned(F.col("x"), [1.0, 2.0]).alias("b")).collect()] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_yeo_johnson_inverse(spark):
    df = frame(spark, [-3.0, -0.5, 0.0, 0.5, 4.0])
    for lam in (-1.0, 0.0, 0.5, 2.0, 3.0):
        back = df.select("x", scalar.yeo_johnson_inverse(scalar.yeo_johnson(F.col("x"), lam), lam).alias("b")).collect()
        assert all(math.isclose(r.x, r.b, abs_tol=1e-9) for r in back)


def test_digamma(spark):
    got = spark.range(1).select(losses.digamma(F.lit(1.0)).alias("a"), losses.digamma(F.lit(0.5)).alias("b")).first()
    assert math.isclose(got.a, -0.5772156649, abs_tol=1e-8) and math.isclose(got.b, -1.9635100260, abs_tol=1e-8)


def test_training_lowers_the_error_and_survives_a_round_trip(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.when(F.col("a") > 10, 5.0).otherwise(0.0) + F.col("b"))
    model = trees.train_gbdt(df, ["a", "b"], "y", "k", trees.TreeConfig(rounds=8, rate=0.5, depth=3, leaves=8, bins=16))
    r2 = model.predict(df).agg(evaluation.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).first()[0]
    assert r2 > 0.95
    models.save(spark, model, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert again.to_json() == model.to_json()
    journal = models.Journal(spark, str(tmp_path / "j"))
    journal.append("base", model.to_json(), 400)
    journal.append("trees", model.truncated(2).to_json(), 400)
    assert len(journal.model().trees) == len(model.trees) + 2


def test_monotone_constraint_and_missing_direction(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("a"))
    df = df.withColumn("y", F.when(F.col("a").isNull(), 100.0).otherwise(-F.col("a")))
    held = trees.train_gbdt(df, ["a"], "y", "k", trees.TreeConfig(rounds=3, depth=3, leaves=6, bins=8, monotone={"a": 1}))
    assert all(n.missing_left is False or n.left < 0 or t for t in held.trees for n in t)
    free = trees.train_gbdt(df, ["a"], "y", "k", trees.TreeConfig(rounds=8, rate=0.5, depth=4, leaves=10, bins=16))
    out = free.predict(df).groupBy(F.col("a").isNull().alias("m")).agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("e")).collect()
    assert all(r.e < 25 for r in out)


def test_ridge_recovers_weights(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b") + 4)
    assert [round(w, 4) for w in linear.fit_linear(df, ["a", "b"], "y", lam=0.0).weights] == [4.0, 2.0, -1.0]


def test_drift_of_equal_tables_is_zero(spark):
    df = frame(spark, [1.0, 2.0, 2.0, 5.0])
    assert monitoring.ks(df, df, "x").first()[0] == 0 and abs(monitoring.jsd(df, df, "x").first()[0]) < 1e-12
    assert monitoring.DriftRule().recommend({"a": "critical", "b": "critical"}) == "retrain"


def test_time_series_splits():
    assert evaluation.time_series_splits(10, 3) == [(2, 2, 4), (4, 4, 6), (6, 6, 10)]


def test_concat_needs_the_same_columns(spark):
    with pytest.raises(ValueError):
        encoding.concat_binned(frame(spark, [1.0]), frame(spark, [1.0], "k long, z double"))


def test_weighted_mean_over_gaps(spark):
    from tessella.operators import windows

    values = [None] + [float(i % 7) if i % 150 == 0 else None for i in range(1400)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, t int, x double")
    for alpha in (0.1, 0.01):
        config = windows.TimeSeriesConfig((), (), (), (alpha,), ())
        got = [r[-1] for r in windows.grouped_time_series(df, "g", ["t"], ["x"], config).orderBy("t").collect()]
        e, want = None, []
        for v in values:
            e = e if v is None else v if e is None else alpha * v + (1 - alpha) * e
            want.append(e)
        assert got[0] is None and got[1:] == pytest.approx(want[1:], abs=1e-12)


BINARY = trees.TreeConfig(rounds=6, rate=0.5, depth=6, leaves=31, bins=32)


def noisy(spark, n=3000):
    df = spark.range(n).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(4)])
    noise = F.pmod(F.xxhash64("k", F.lit(9)), F.lit(1000)) / 1000 - 0.5
    return df.withColumn("y", 3 * F.col("x0") + F.when(F.col("x1") > 0.5, 2.0).otherwise(0.0) * F.col("x2") + noise)


FOUR = ["x0", "x1", "x2", "x3"]


def brute_tree(rows, features, cfg, level, base):
    """The leaf value of each row of a tree grown to full depth, every split by direct sums."""
    out = {}

    def go(part, depth):
        G, H = sum(p - y for _, y, p in part), len(part)
        best = None
        for f in range(len(features)) if depth < cfg.depth else ():
            for b in sorted({r[f] for r, _, _ in part})[:-1]:
                left = [x for x in part if x[0][f] <= b]
                g, h = sum(p - y for _, y, p in left), len(left)
                gain = 0.5 * (g * g / (h + 1) + (G - g) ** 2 / (H - h + 1) - G * G / (H + 1))
                if gain > 0 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b)
        if best is None:
            out.update({id(r): -G / (H + 1) * cfg.rate for r, _, _ in part})
        else:
            for side in (True, False):
                go([x for x in part if (x[0][best[1]] <= best[2]) is side], depth + 1)

    go(rows, 0)
    return out


def test_boosting_by_brute_force(spark):
    df = noisy(spark, 250)
    cfg = trees.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=8)
    model = trees.train_gbdt(df, FOUR, "y", "k", cfg)
    got = {r.k: r.prediction for r in model.predict(df).select("k", "prediction").collect()}
    binned = model.with_bins(df).select("k", "y", *[f"__b_{f}" for f in FOUR]).collect()
    pred = {r.k: model.base for r in binned}
    assert math.isclose(model.base, sum(r.y for r in binned) / len(binned))
    for _ in range(2):
        rows = [(tuple(r[2:]), r.y, pred[r.k]) for r in binned]
        value = brute_tree(rows, FOUR, cfg, 0, model.base)
        pred = {r.k: pred[r.k] + value[id(x[0])] for r, x in zip(binned, rows)}
    assert all(math.isclose(got[k], pred[k], abs_tol=1e-9) for k in got)


def test_depth_six_compiles_and_learns(spark):
    df = noisy(spark)
    model = trees.train_gbdt(df, FOUR, "y", "k", BINARY)
    out = model.predict(df)
    assert out.agg(evaluation.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).first()[0] > 0.9
    assert max(len(t) for t in model.trees) > 31


@pytest.mark.parametrize("loss", ["mse", "log_loss", "tweedie"])
def test_intervals_cover_on_the_targets_scale(spark, loss):
    df = noisy(spark).withColumn("y", F.when(F.lit(loss == "log_loss"), (F.col("y") > 2.5).cast("double")).otherwise(F.abs("y")))
    cfg = trees.TreeConfig(rounds=4, rate=0.5, depth=3, leaves=8, bins=16, loss=loss, calibration=0.3, quantile=0.9)
    out = trees.train_gbdt(df, FOUR, "y", "k", cfg).predict(df)
    inside, width = out.agg(F.avg(F.col("y").between(F.col("prediction_low"), F.col("prediction_high")).cast("double")), F.max(F.col("prediction_high") - F.col("prediction_low"))).first()
    assert 0.84 < inside <= 1 and width < (1.01 if loss == "log_loss" else 10)


def test_intervals_move_with_the_linear_part(spark):
    df = noisy(spark).withColumn("y", 1000 + 500 * F.col("x0") + F.col("y"))
    cfg = trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=16, calibration=0.3, quantile=0.9)
    out = linear.train_universal(df, FOUR, "y", "k", "linear_then_trees", cfg).predict(df)
    assert out.agg(F.avg(F.col("y").between(F.col("prediction_low"), F.col("prediction_high")).cast("double"))).first()[0] > 0.84


def test_early_stop_keeps_the_best_round_by_the_models_loss(spark):
    df = noisy(spark).withColumn("b", (F.col("y") > 2.5).cast("double"))
    seen = []
    cfg = trees.TreeConfig(rounds=30, rate=2.5, depth=5, leaves=24, bins=32, loss="log_loss", validation=0.3, patience=2)
    model = trees.train_gbdt(df, FOUR, "b", "k", cfg, on_round=lambda r, v: seen.append(v))
    assert len(model.trees) == seen.index(min(seen)) + 1 and len(seen) == len(model.trees) + 2 < 30
    halted = trees.train_gbdt(df, FOUR, "b", "k", cfg, on_round=lambda r, v: r < 1)
    assert len(halted.trees) <= 2


def test_eras_groups_and_outside_validation(spark):
    df = noisy(spark).withColumn("era", F.col("k") % 3).withColumn("y", F.col("y") + F.when(F.col("era") == 0, 8.0).otherwise(-4.0) * F.col("x3"))
    cfg = trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=8, patience=1)
    model = trees.train_gbdt(df, FOUR, "y", "k", cfg, validation=df.where("k > 2000"), era="era")
    assert all(n.left < 0 or n.feature != 3 for n in model.trees[0]) and model.trees[0][0].left > 0
    grouped = trees.train_gbdt(df, FOUR, "y", "k", trees.TreeConfig(rounds=3, rate=0.5, depth=4, leaves=16, bins=8, groups=[["x0", "x1"], ["x2", "x3"]]))

    def paths(tree, at=0, used=frozenset()):
        n = tree[at]
        return [used] if n.left < 0 else paths(tree, n.left, used | {n.feature}) + paths(tree, n.right, used | {n.feature})

    assert all(p <= {0, 1} or p <= {2, 3} for t in grouped.trees for p in paths(t))


def test_a_torn_segment_ends_the_journal(spark, tmp_path):
    df = noisy(spark, 200)
    model = trees.train_gbdt(df, FOUR, "y", "k", trees.TreeConfig(rounds=2, depth=2, bins=4))
    journal = models.Journal(spark, str(tmp_path / "j"))
    for kind in ("base", "trees", "trees"):
        journal.append(kind, model.to_json(), 200)
    part = next((tmp_path / "j" / "segment-1").glob("part-*"))
    part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])
    for crc in (tmp_path / "j" / "segment-1").glob(".part-*"):
        crc.unlink()
    assert len(journal.segments()) == 1 and len(journal.model().trees) == 2
    assert journal.append("trees", model.to_json(), 200) == 1 and len(journal.segments()) == 3


def test_saved_models_come_back(spark, tmp_path):
    df = noisy(spark, 300)
    cfg = trees.TreeConfig(rounds=1, depth=2, bins=4)
    both = linear.train_universal(df, FOUR, "y", "k", "linear_then_trees", cfg)
    models.save_universal(spark, both, str(tmp_path / "u"))
    one = linear.train_linear_tree(df, FOUR, "y", "k", depth=2, leaves=3)
    models.save_linear_tree(spark, one, str(tmp_path / "l"))
    for a, b in ((both, models.load_universal(spark, str(tmp_path / "u"))), (one, models.load_linear_tree(spark, str(tmp_path / "l")))):
        assert [r.prediction for r in a.predict(df).orderBy("k").collect()] == [r.prediction for r in b.predict(df).orderBy("k").collect()]
    text = models.dump_config({"rounds": 3, "depth": 2})
    assert models.load_config(text, trees.TreeConfig) == trees.TreeConfig(rounds=3, depth=2)
    with pytest.raises(ValueError, match="unknown settings: size"):
        models.load_config('{"size": 1}', trees.TreeConfig)


def test_stages_are_read_again_and_own_ones_register(spark):
    df = frame(spark, [1.0, 2.0, None, 9.0])
    chain = preprocess.Chain(preprocess.Imputer(["x"], strategy="median"), preprocess.StandardScaler(["x"])).fit(df)
    again = extend.chain_from_json(extend.chain_to_json(chain))
    assert [r.x for r in again.transform(df).collect()] == [r.x for r in chain.transform(df).collect()]

    @extend.register_stage
    class Doubler(preprocess.Stage):
        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumns({c: F.col(c) * 2 for c in self.columns})

    assert [r.x for r in extend.stage_from_json(Doubler(["x"]).to_json()).transform(df).collect()] == [2.0, 4.0, None, 18.0]
    with pytest.raises(ValueError):
        extend.stage_from_json('{"kind": "Nothing"}')


def test_sketch_bounds_counts_from_above(spark):
    df = spark.range(2000).select((F.col("id") % 37).alias("v"))
    cm = sketch.CountMin(0.05, 0.9)
    got = {r.v: r.estimate for r in cm.estimate(cm.add(df, "v"), df.unionByName(spark.range(99, 100).toDF("v")), "v").collect()}
    true = {v: len(range(v, 2000, 37)) for v in range(37)}
    assert all(true[v] <= got[v] <= true[v] + 0.05 * 2000 for v in true) and len(got) == 38
    assert cm.add(df.limit(0), "v").count() == 0 and cm.clear(cm.add(df, "v")).count() == 0


def test_tuner_zooms_stops_and_evaluates(spark):
    df = noisy(spark, 400).cache()
    model = tuning.tree_model(FOUR, "y", "k", trees.TreeConfig(rounds=2, depth=2, leaves=4, bins=8))
    log = tuning.tune(df, "k", "y", model, [tuning.Parameter("rate", 0.05, 1.0, log=True)], tuning.TunerConfig(steps=2, points=3))
    assert log.best().value == min(t.value for t in log.trials) and [t.spread for t in log.trials] == [1.0] * 3 + [0.5] * 3
    assert log.to_csv().count("\n") == 7 and '"trials": 6' in log.summary()
    assert len(tuning.tune(df, "k", "y", model, [tuning.TUNABLE["lam"]], tuning.TunerConfig(steps=3, points=2), on_trial=lambda t: False).trials) == 1
    folds = tuning.evaluate_folds(df, "k", "y", model, {"rate": 0.5})
    assert folds["value"] > 0 and folds["deviation"] >= 0
    assert 0.8 < tuning.evaluate_conformal(df, "k", "y", model, {"rate": 0.5})["coverage"] <= 1
    narrow = tuning.constrained([tuning.Parameter("rate", 0.05, 1.0)], log.trials, 0.34)[0]
    assert narrow.low <= log.best().params["rate"] <= narrow.high
    assert [p.at(p.share(v)) for p, v in ((tuning.TUNABLE["rate"], 0.1), (tuning.TUNABLE["depth"], 4))] == pytest.approx([0.1, 4])


def test_finite_sample_level(spark):
    df = spark.range(1, 20).select(F.col("id").cast("double").alias("r"))
    assert tuning.conformal_level(df, F.col("r"), 0.9) == 18.0 and tuning.conformal_level(df.limit(0), F.col("r"), 0.9) == 0.0
    assert tuning.conformal_level(df, F.col("r"), 0.99) == 19.0


def test_auto_builds_reports_and_updates(spark):
    df = noisy(spark, 600).withColumns({"c": F.concat(F.lit("c"), F.col("k") % 4), "same": F.lit(1.0), "day": F.expr("date_add(date'2024-01-01', cast(k % 90 as int))")})
    model = auto.build(df, "y", "k", auto.AutoConfig(tree=trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=16), modes=("trees", "linear_then_trees")))
    out = model.predict(df)
    assert out.agg(evaluation.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).first()[0] > 0.7
    assert model.dropped["same"] == "constant" and model.task == "regression" and set(model.probes) == {"trees", "linear_then_trees"}
    assert "mode " in model.report() and '"mode"' in model.config_json()
    assert len(model.update(df, 2).model.trees.trees) == 5


@pytest.mark.parametrize("few", [0, 250_000])
def test_positions_and_quantiles_from_range_totals(spark, monkeypatch, few):
    from tessella.operators import ordering

    monkeypatch.setattr(ordering, "FEW", few)
    values = [((i * 7919) % 1009) / 10 for i in range(3000)] + [float("inf"), 5.0, 5.0, None]
    df = spark.createDataFrame([(i, v, f"g{i % 3}") for i, v in enumerate(values)], "k long, x double, g string")
    by_key = lambda out: {r.k: r.at for r in out.collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert by_key(ordering.numbered(df, ["x", "k"], "at")) == {k: n for n, k in enumerate(order)}
    inside: dict = {}
    want = {k: inside.update({k % 3: inside.get(k % 3, -1) + 1}) or inside[k % 3] for k in order}
    assert by_key(ordering.numbered(df, ["x", "k"], "at", "g")) == want
    names = spark.createDataFrame([(i, f"{chr(97 + i * 7 % 26)}{i}") for i in range(500)], "k long, x string")
    assert by_key(ordering.numbered(names, ["x"], "at")) == {k: n for n, (_, k) in enumerate(sorted((f"{chr(97 + i * 7 % 26)}{i}", i) for i in range(500)))}
    finite = df.where("x < 1000")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    assert ordering.quantiles(finite, F.col("x"), shares) == pytest.approx(finite.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0])
    assert ordering.quantiles(df.limit(0), F.col("x"), shares) is None
    assert [r.t for r in spark.range(7).select(ordering.tile(F.col("id"), 7, 3).alias("t")).collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert ordering.ranked(df.limit(0), "x", "at").count() == 0


def test_strings_with_a_common_beginning_spread_over_ranges(spark):
    from tessella.operators import ordering

    df = spark.range(40_000).select(F.concat(F.lit("https://one-site.example/articles/"), F.md5(F.col("id").cast("string"))).alias("x"))
    sizes = [r["count"] for r in ordering.ranged(df, F.col("x")).groupBy("__range").count().collect()]
    assert len(sizes) > 900 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_labels_invert_and_refuse_unknown_ones(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    d = encoding.labels(df.where("c <> 'c'"), "c")
    out = encoding.label_index(df, "c", d, "n")
    assert {r.c: r.n for r in out.collect()} == {"a": 0, "b": 1, "c": 2, None: 2}
    assert {r.c: r.back for r in encoding.label_inverse(out, "n", d, "c", "back").collect()} == {"a": "a", "b": "b", "c": None, None: None}
    with pytest.raises(Exception, match="unknown category"):
        encoding.label_index(df, "c", d, "n", strict=True).collect()


def test_noise_is_pruned_and_signal_kept(spark):
    df = noisy(spark, 1500)
    model = trees.train_gbdt(df.where("k < 700"), FOUR, "y", "k", trees.TreeConfig(rounds=1, rate=1.0, depth=6, leaves=60, bins=32))
    pruned = trees.noise_pruned(model, df.where("k >= 700"), "y")
    error = lambda m: m.residuals(df.where("k >= 700"), "y").agg(F.avg(F.col("residual") * F.col("residual"))).first()[0]
    splits = lambda m: sum(n.left >= 0 for n in m.trees[0])
    assert 0 < splits(pruned) < splits(model) and error(pruned) < error(model)
    assert [n.left for n in trees.noise_pruned(model, df.limit(0), "y").trees[0]][0] == -1


def test_forms_of_prediction(spark):
    df = noisy(spark, 600).withColumn("b", (F.col("y") > 2.5).cast("double"))
    model = trees.train_gbdt(df, FOUR, "b", "k", trees.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=16, loss="log_loss"))
    out = model.predict_raw(model.predict_class(model.predict(df), 0.3)).collect()
    assert all(math.isclose(r.prediction, 1 / (1 + math.exp(-r.raw))) and r.predicted == (r.prediction >= 0.3) for r in out)
    assert len(model.appended(model.trees).trees) == 6
    top = model.top_features(df, 2).collect()
    assert len(top) == 2 and top[0].attribution >= top[1].attribution > 0


def test_linear_part_follows_a_batch(spark):
    a = noisy(spark, 400).withColumn("y", 5 * F.col("x0"))
    b = a.withColumn("y", 9 * F.col("x0") + 1)
    model = linear.train_universal(a, ["x0"], "y", "k", "linear_then_trees", trees.TreeConfig(rounds=1, depth=1, bins=4))
    slopes = [model.update(b, 1, blend).linear.weights[1] for blend in (0.0, 0.5, 1.0)]
    assert slopes[0] == model.linear.weights[1] < slopes[1] < slopes[2] < 9.5


def test_outliers_are_listed(spark):
    df = frame(spark, [1.0, 2.0, 2.5, 3.0, 99.0, None])
    found = preprocess.Outliers(["x"]).fit(df).detect(df, "k").collect()
    assert [(r.k, r.feature, r.value) for r in found] == [(4, "x", 99.0)]
    with pytest.raises(Exception, match="unknown category"):
        encoding.frequency_encode(frame(spark, ["a", "b"], "k long, x string"), "x", encoding.frequency(frame(spark, ["a"], "k long, x string"), "x"), "f", strict=True).collect()
