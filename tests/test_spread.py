"""Chunked groups against one window for each group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ordering, spread, windows

CONFIG = windows.TimeSeriesConfig((1, 5), (3, 9), ("mean", "std", "median"), (0.1, 1.0), (1, 4), 2)


@pytest.mark.parametrize("few", [0, 250_000])
def test_chunks_give_what_one_window_gives(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [(["hot", "b", None, "c"][0 if rng.random() < 0.7 else int(rng.integers(1, 4))], i, None if rng.random() < 0.3 or 100 < i < 160 else float(rng.normal())) for i in range(700)]
    df = spark.createDataFrame([(g, t, x, 2.0 * t) for g, t, x in rows], "g string, t int, x double, z double").repartition(3)
    want = windows.grouped_time_series(df, "g", ["t"], ["x", "z"], CONFIG).orderBy("t")
    for chunk in (9, 50, 10_000):
        got = spread.spread_time_series(df, "g", ["t"], ["x", "z"], CONFIG, chunk).orderBy("t")
        assert got.columns == want.columns
        for a, b in zip(got.collect(), want.collect(), strict=True):
            assert [x if x is None or isinstance(x, str) else pytest.approx(x, abs=1e-9) for x in b] == list(a)


def test_a_hot_group_lies_in_many_chunks_and_odd_tables(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    sizes = [r["count"] for r in spread.chunked(df, "g", ["t"], 7, 500).groupBy("g", "__chunk").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 507
    plain = windows.TimeSeriesConfig((1,), (), (), (), ())
    assert spread.spread_time_series(df, "g", ["t"], ["x"], plain, 500).where("x_lag_1 = x - 1").count() == 4999
    assert spread.spread_time_series(df.limit(0), "g", ["t"], ["x"], CONFIG, 50).count() == 0
    with pytest.raises(ValueError, match="look back"):
        spread.spread_time_series(df, "g", ["t"], ["x"], windows.TimeSeriesConfig((60,), (), (), (), ()), 50)
