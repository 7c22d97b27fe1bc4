"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int)) or hasattr(v, "__float__"):
        return float(v) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    want = oracle.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_zoom_tunes_on_the_whole_table(spark, monkeypatch):
    from tessella.plans import models

    class Stop(Exception):
        pass

    def counted(df, *_):
        raise Stop(df.count())

    monkeypatch.setattr(models.E, "holdout", counted)
    with pytest.raises(Stop) as found:
        catalog.QUERIES["tu03_zoom"](spark, SF)
    assert found.value.args[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
