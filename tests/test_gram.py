"""Sums over all pairs of columns against NumPy, and Newton fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import encoding, gram, linear, profile


def table(spark, x):
    return spark.createDataFrame([tuple(None if v is not None and np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(x.shape[1])))


def test_a_thousand_columns_in_one_pass(spark):
    d = 1000
    df = spark.range(300).repartition(5).select(*[((F.xxhash64("id", F.lit(i)) % 1000) / 1000).alias(f"c{i}") for i in range(d)])
    x = np.array(df.toPandas())
    got = gram.pair_sums(df, [F.col(c) for c in df.columns])
    assert np.allclose(got.correlation(), np.corrcoef(x.T), atol=1e-9) and np.allclose(got.variance(), x.var(axis=0))
    assert np.allclose(gram.products(df, [F.col(c) for c in df.columns]), x.T @ x)
    assert len(profile.drop_collinear(df.withColumn("twin", F.col("c7") + 1e-9), [*df.columns, "twin"], "c0")) == d


def test_missing_values_and_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) + [0, 1e6, -3, 0, 5]
    x[:, 3] = 2.0
    x[rng.random(x.shape) < 0.2] = np.nan
    df = table(spark, x).withColumn("w", F.lit(0.5))
    got = gram.pair_sums(df, [F.col(f"c{i}") for i in range(5)]).correlation()
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.nan if 3 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert np.isclose(got[i, j], want, atol=1e-9, equal_nan=True)
    plain = np.nan_to_num(x)
    assert np.allclose(gram.products(df, [F.col(f"c{i}") for i in range(5)], F.col("w")), 0.5 * plain.T @ plain)
    assert gram.products(df.limit(0), [F.col("c0")]).tolist() == [[0.0]]
    rows = {(r.a, r.b): r["corr"] for r in profile.correlations(df, ["c0", "c3"]).collect()}
    assert rows == {("c0", "c3"): None} and profile.correlations(df, ["c0"]).count() == 0


def test_bundles_from_products(spark):
    df = spark.range(100).select(*[(F.col("id") % 10 == i).cast("double").alias(f"x{i}") for i in range(4)], F.lit(1.0).alias("full"))
    assert encoding.bundle(df, df.columns, dict.fromkeys(df.columns, 3), most=9) == [["full"], ["x0", "x1", "x2"], ["x3"]]


def logistic(x, y, lam, l1_ratio):
    """Penalised logistic loss by long proximal descent on standardised columns."""
    sd = x.std(axis=0)
    z = x / sd
    w, b, step = np.zeros(x.shape[1]), 0.0, 4.0 / (len(x) * (1 + (z**2).mean(axis=0).sum()))
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        v = w - step * (z.T @ (p - y) + lam * (1 - l1_ratio) * w)
        w, b = np.sign(v) * np.maximum(np.abs(v) - step * lam * l1_ratio, 0), b - step * (p - y).sum()
    return np.r_[b, w / sd]


@pytest.mark.parametrize("lam, l1_ratio", [(0.0, 0.0), (5.0, 0.0), (12.0, 1.0), (8.0, 0.5)])
def test_newton_elastic_net_reaches_the_minimum(spark, lam, l1_ratio):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2]
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.1 * x[:, 1])))).astype(float)
    df = table(spark, np.c_[x, y]).withColumnRenamed("c3", "y")
    got = linear.fit_newton(df, ["c0", "c1", "c2"], "y", lam=lam, l1_ratio=l1_ratio)
    assert got.weights == pytest.approx(logistic(x, y, lam, l1_ratio), abs=2e-4)
    again = linear.fit_newton(df, ["c0", "c1", "c2"], "y", lam=lam, l1_ratio=l1_ratio, start=np.array(got.weights), steps=1)
    assert again.weights == pytest.approx(got.weights, abs=1e-5)


def test_newton_on_other_losses_and_odd_tables(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), F.exp((F.col("id") % 10) / 10).alias("y"))
    got = linear.fit_newton(df, ["a"], "y", loss="tweedie", lam=0.0)
    assert got.weights == pytest.approx([0.0, 0.1], abs=1e-5)
    plain = linear.fit_newton(df, ["a"], "y", loss="mse", lam=0.0)
    assert plain.weights == pytest.approx(linear.fit_linear(df, ["a"], "y", lam=0.0).weights, abs=1e-6)
    same = df.withColumn("y", F.lit(1.0)).withColumn("b", F.lit(None).cast("double"))
    assert all(map(math.isfinite, linear.fit_newton(same, ["a", "b"], "y", lam=1.0).weights))
    assert linear.fit_newton(df.limit(0), ["a"], "y").weights == [0.0, 0.0]


def test_profiles_by_sketches_decide_like_exact_ones(spark):
    n = 12_000
    df = spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 10_300).alias("nearly_id"), (F.col("id") % 9_000).alias("not_id"), (F.col("id") % 2).alias("two"), F.lit(7).alias("one"), F.lit(None).cast("double").alias("none"),
        F.concat(F.lit("a rather long text "), F.col("id") % 101).alias("text"), F.concat(F.lit("a rather long text "), F.col("id") % 100).alias("words"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("third"), (F.col("id") % 5 == 0).alias("flag"), F.current_date().alias("day"),
    )
    exact = {r.column: r.asDict() for r in profile.profile(df).collect()}
    quick = {r.column: r.asDict() for r in profile.profile(df, exact=False).collect()}
    for c, p in exact.items():
        q = quick[c]
        assert (q["kind"], q["is_constant"], q["is_binary"], profile.drop_reason(c, q)) == (p["kind"], p["is_constant"], p["is_binary"], profile.drop_reason(c, p))
        assert q["n_unique"] == p["n_unique"] if p["n_unique"] < 2000 else abs(q["n_unique"] - p["n_unique"]) < 0.06 * p["n_unique"]
    assert quick["nearly_id"]["n_unique"] == 10_300
    plan = df.agg(*[profile.distinct_sketch(df, c) for c in df.columns])._jdf.queryExecution().toString()
    assert "Expand" not in plan
    assert [profile.task_of(df, c) for c in ("two", "one", "third", "row_id")] == ["binary", "regression", "regression", "regression"]
    assert profile.profile(df.limit(0), exact=False).count() == len(df.columns)
