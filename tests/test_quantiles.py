"""Exact quantiles that put few values in order."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import encoding, ordering
from tessella.plans import preparation


@pytest.mark.parametrize("values", ["id / 100D", "id % 7", "pow(id - 2500, 3)", "4"])
def test_exact_quantiles_hold_few_values_in_a_task(spark, monkeypatch, values):
    df = spark.range(5000).select(F.when(F.col("id") % 13 != 0, F.expr(values).cast("double")).alias("x")).repartition(3)
    q = [0.0, 0.1, 0.5, 0.501, 0.9, 1.0]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, q)))).first()[0]
    monkeypatch.setattr(ordering, "FEW", 0)
    sizes = []
    held = ordering.at_positions
    monkeypatch.setattr(ordering, "at_positions", lambda counts, wanted: sizes.append(counts.count()) or held(counts, wanted))
    assert ordering.quantiles(df, F.col("x"), q) == pytest.approx(want)
    assert max(sizes) <= 40
    assert encoding.boundaries(df, ["x"], 4, exact=True)["x"] == pytest.approx(sorted(set(df.agg(F.percentile("x", F.array(*map(F.lit, [0.25, 0.5, 0.75])))).first()[0])))


def test_percentiles_and_boundaries_use_no_map_of_all_values(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("percentile gathers every distinct value in one task")

    monkeypatch.setattr(F, "percentile", refused)
    assert preparation.ag13(spark, "/root/testdata/sf0.001").count() == 1
    assert preparation.bn01(spark, "/root/testdata/sf0.001").count() == 7
