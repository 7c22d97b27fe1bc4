"""Steps that must stay whole and spread as tables grow."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluation, ordering, pipeline
from tessella.plans import pipelines


@pytest.mark.parametrize("few", [0, 250_000])
def test_monotonicity_counts_every_pair(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(ordering, "FEW", few)
    rng = np.random.default_rng(1)
    n = 2500
    x, y = rng.integers(0, 900, n), rng.integers(0, 25, n)
    y[:300] = x[:300] // 40
    up = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / ((x[:, None] != x) & (y[:, None] != y)).sum()
    rows = [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))] + [(n, None, 3), (n + 1, 5.0, None)]
    df = spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int")
    df.write.parquet(f"{tmp_path}/supplier.parquet")
    assert pipelines.ag11(spark, str(tmp_path)).first()[0] == pytest.approx(abs(up), abs=1e-6)
    value = lambda t, *more: pipeline.monotonicity(t, "s_acctbal", "s_nationkey", *more).first()[0]
    assert value(df.where("s_nationkey = 4")) == value(df.limit(0)) == 0.5
    assert value(df.withColumn("s_nationkey", F.col("s_acctbal")), "s_suppkey", 50) == 1


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


def test_holdout_moves_no_row(spark):
    df = spark.range(3000).withColumn("x", F.col("id") * 2).repartition(3)
    out = evaluation.holdout(df, "id", 0.2, 0.1)
    assert "Exchange hashpartitioning(__r" not in plan(out) and "Window" not in plan(out)
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").collect()]
    want = {k: "calibration" if i < 300 else "validation" if i < 900 else "train" for i, k in enumerate(order)}
    assert {r.id: r.split for r in out.collect()} == want
    # One key for all rows, and missing keys: shares stay exact.
    for key in (F.lit(7), F.lit(None).cast("int"), F.col("id") % 3):
        sizes = {r.split: r["count"] for r in evaluation.holdout(df.withColumn("k", key), "k", 0.2, 0.1).groupBy("split").count().collect()}
        assert sizes == {"calibration": 300, "validation": 600, "train": 2100}
    assert evaluation.holdout(df.limit(0), "id", 0.2).count() == 0
