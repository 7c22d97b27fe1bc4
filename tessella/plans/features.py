"""Row-wise, window and cross-sectional feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.operators import spread as Z
from tessella.operators import windows as W
from tessella.plans.registry import query, r6
from tessella.sources.tables import table

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def line(spark, d):
    return table(spark, d, "lineitem")


def with_columns(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(n) for n, c in cols.items()])


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("sc01_polynomial", f"""SELECT {LINE}, round(l_tax*l_tax,6) AS l_tax_sq, round(l_tax*l_tax*l_tax,6) AS l_tax_cb, round(sqrt(abs(l_tax)),6) AS l_tax_sqrt, round(ln(abs(l_tax)+1),6) AS l_tax_log1p FROM lineitem""")
def sc01(spark, d):
    return with_columns(line(spark, d), KEYS, S.polynomial("l_tax"))


@query("sc02_ratio", f"""SELECT {LINE}, round(l_tax/(l_quantity+1e-10),6) AS l_tax_div_l_quantity FROM lineitem""")
def sc02(spark, d):
    return with_columns(line(spark, d), KEYS, S.ratio("l_tax", "l_quantity"))


@query("sc03_interactions", f"""SELECT {LINE}, round(l_tax*l_discount,6) AS l_tax_mul_l_discount, round(l_tax+l_discount,6) AS l_tax_add_l_discount, round(abs(l_tax-l_discount),6) AS l_tax_sub_l_discount, round(least(l_tax,l_discount),6) AS l_tax_min_l_discount, round(greatest(l_tax,l_discount),6) AS l_tax_max_l_discount FROM lineitem""")
def sc03(spark, d):
    return with_columns(line(spark, d), KEYS, S.interactions("l_tax", "l_discount"))


@query("sc05_yeo_johnson", "SELECT o_orderkey, round((pow(o_totalprice/1000+1, 0.3)-1)/0.3,6) AS yj, round(CASE WHEN o_totalprice/1000-150 >= 0 THEN (pow(o_totalprice/1000-150+1,0.5)-1)/0.5 ELSE -(pow(1-(o_totalprice/1000-150),1.5)-1)/1.5 END,6) AS yj_signed FROM orders")
def sc05(spark, d):
    x = F.col("o_totalprice") / 1000
    return table(spark, d, "orders").select("o_orderkey", r6(S.yeo_johnson(x, 0.3)).alias("yj"), r6(S.yeo_johnson(x - 150, 0.5)).alias("yj_signed"))


@query("sc05_yeo_johnson_inverse", "SELECT o_orderkey, round(o_totalprice,4) AS back FROM orders")
def sc05b(spark, d):
    x = F.col("o_totalprice") - 150000
    return table(spark, d, "orders").select("o_orderkey", F.round(S.yeo_johnson_inverse(S.yeo_johnson(x, 0.5), 0.5) + 150000, 4).alias("back"))


@query("sc06_sigmoid_softmax", "WITH e AS (SELECT o_orderkey, o_totalprice/100000 AS a, exp(o_totalprice/100000) AS x, exp(1.0) AS y FROM orders) SELECT o_orderkey, round(1/(1+exp(-a)),6) AS sigmoid, round(x/(x+y),6) AS p0, round(y/(x+y),6) AS p1 FROM e")
def sc06(spark, d):
    a = F.col("o_totalprice") / 100000
    p = S.softmax([a, F.lit(1.0)])
    return table(spark, d, "orders").select("o_orderkey", r6(S.sigmoid(a)).alias("sigmoid"), r6(p[0]).alias("p0"), r6(p[1]).alias("p1"))


CALENDAR = """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST((dayofweek(ts)+6)%7 AS INT) AS dow, CAST(day(ts) AS INT) AS dom, CAST(dayofyear(ts) AS INT) AS doy,
CAST(least(floor(dayofyear(ts)/7)+1,53) AS INT) AS woy, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(year(ts) AS INT) AS year, CAST((dayofweek(ts)+6)%7 >= 5 AS INT) AS is_weekend FROM events"""


@query("sc07_calendar", CALENDAR)
def sc07(spark, d):
    return table(spark, d, "events").select("event_id", *[c.cast("int").alias(n) for n, c in S.calendar(F.col("ts")).items()])


@query("sc08_cyclic", f"WITH c AS ({CALENDAR}) SELECT event_id, round(sin(2*pi()*hour/24),6)+0.0 AS hour_sin, round(cos(2*pi()*hour/24),6)+0.0 AS hour_cos, round(sin(2*pi()*dow/7),6)+0.0 AS dow_sin, round(cos(2*pi()*dow/7),6)+0.0 AS dow_cos FROM c")
def sc08(spark, d):
    parts, out = S.calendar(F.col("ts")), {}
    for n in ("hour", "dow"):
        s, c = S.cyclic(parts[n], S.PERIODS[n])
        out |= {f"{n}_sin": s, f"{n}_cos": c}
    return with_columns(table(spark, d, "events"), ["event_id"], out)


@query("sc09_trigonometric", "SELECT event_id, round(sin(2*pi()*coalesce(CASE WHEN event_id%7=0 THEN NULL ELSE value END,0)/50),6)+0.0 AS v_sin, round(cos(2*pi()*coalesce(CASE WHEN event_id%7=0 THEN NULL ELSE value END,0)/50),6)+0.0 AS v_cos FROM events")
def sc09(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return with_columns(df, ["event_id"], S.trigonometric("v", 50))


@query("sc10_formula", f"SELECT {LINE}, round(CASE WHEN abs(l_discount) < 1e-10 THEN 0 ELSE l_tax/l_discount END + 2*l_quantity + sqrt(greatest(l_quantity-10,0)) + least(greatest(l_quantity,5),20) + sin(l_tax) + abs(l_tax-l_discount) + ln(1+l_tax) + pow(l_tax,2),6) AS f FROM lineitem")
def sc10(spark, d):
    E = S.Expr
    t, q, c = E.col("l_tax"), E.col("l_quantity"), E.col("l_discount")
    e = t / c + E.const(2) * q + (q - E.const(10)).sqrt() + q.clamp(5, 20) + t.sin() + (t - c).abs() + t.log1p() + t.pow(2)
    return with_columns(line(spark, d), KEYS, {"f": e.column})


@query("sc11_weighted_formula", f"SELECT {LINE}, round(1.5 + 0.5*l_quantity - 2*l_tax + CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 3.0 ELSE -1.0 END,6) AS f FROM lineitem")
def sc11(spark, d):
    return with_columns(line(spark, d), KEYS, {"f": S.formula({"l_quantity": 0.5, "l_tax": -2.0}, 1.5, [("l_returnflag", {"A": 1.0, "R": 3.0}, -1.0)])})


@query("sc12_lut", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 4.0 ELSE 0.5 END AS w FROM orders")
def sc12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.lookup(F.col("o_orderpriority"), {"1-URGENT": 5.0, "2-HIGH": 4.0}, 0.5).alias("w"))


@query("sc13_logit", f"WITH p AS (SELECT *, least(greatest(l_discount/0.2,1e-6),1-1e-6) AS q FROM lineitem) SELECT {LINE}, round(ln(q/(1-q)),6) AS z, round(0.2*q,6) AS back, round(least(greatest(l_tax,0.02),0.05),6) AS held FROM p")
def sc13(spark, d):
    z = S.logit(F.col("l_discount"), 0.0, 0.2)
    return with_columns(line(spark, d), KEYS, {"z": z, "back": S.logit_inverse(z, 0.0, 0.2), "held": S.clamp(F.col("l_tax"), 0.02, 0.05)})


@query("sc14_target_bounds", "SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def sc14(spark, d):
    return line(spark, d).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("pr08_fill_engineered", f"SELECT {LINE}, coalesce(nullif(l_discount,0),0) AS x FROM lineitem")
def pr08(spark, d):
    return S.fill_engineered(line(spark, d).select(*KEYS, F.nullif("l_discount", F.lit(0.0)).alias("x")))


W0 = "PARTITION BY user_id ORDER BY ts, event_id"
#: A value with gaps.
GAPS = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


def events(spark, d):
    return table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def own():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("ts01_lag", f"SELECT event_id, lag(value,1) OVER w AS lag_1, lag(value,7) OVER w AS lag_7, coalesce(lag(value,2) OVER w, first_value(value) OVER w) AS lag_2_first, coalesce(lag(value,3) OVER w, -1.0) AS lag_3_const FROM events WINDOW w AS ({W0})")
def ts01(spark, d):
    w = own()
    return events(spark, d).select("event_id", W.lag("value", 1, w).alias("lag_1"), W.lag("value", 7, w).alias("lag_7"), W.lag("value", 2, w, "first").alias("lag_2_first"), W.lag("value", 3, w, -1.0).alias("lag_3_const"))


_FRAME = f"({W0} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_STATS = {"mean": "avg(v)", "std": "stddev_samp(v)", "var": "var_samp(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "CAST(count(v) AS DOUBLE)", "median": "median(v)"}


@query("ts02_rolling", "SELECT event_id, " + ", ".join(f"round(CASE WHEN count(v) OVER f >= 3 THEN {e} OVER f END,6) AS v_{s}".replace("CAST(count(v) AS DOUBLE) OVER f", "CAST(count(v) OVER f AS DOUBLE)") for s, e in _STATS.items()) + f" FROM {GAPS} WINDOW f AS {_FRAME}")
def ts02(spark, d):
    f = W.trailing(own(), 7)
    return with_columns(events(spark, d), ["event_id"], {f"v_{s}": W.rolling("v", s, f, 3) for s in _STATS})


@query("ts03_centred", f"SELECT event_id, round(avg(v) OVER f,6) AS m, round(stddev_samp(v) OVER f,6) AS s FROM {GAPS} WINDOW f AS ({W0} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def ts03(spark, d):
    f = W.centred(own(), 5)
    return with_columns(events(spark, d), ["event_id"], {"m": W.rolling("v", "mean", f), "s": W.rolling("v", "std", f)})


@query("ts04_ewma", f"SELECT event_id, round(list_reduce(list(value) OVER ({W0} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: 0.3*x+0.7*a),6) AS e FROM events")
def ts04(spark, d):
    return with_columns(W.with_ewma(events(spark, d), "e", "value", 0.3, "user_id", ["ts", "event_id"]), ["event_id"], {"e": F.col("e")})


@query("ts05_momentum", f"SELECT event_id, round(CASE WHEN abs(lag(value,1) OVER w) > 1e-10 THEN (value - lag(value,1) OVER w)/lag(value,1) OVER w END,6) AS m1, round(CASE WHEN abs(lag(value,7) OVER w) > 1e-10 THEN (value - lag(value,7) OVER w)/lag(value,7) OVER w END,6) AS m7 FROM events WINDOW w AS ({W0})")
def ts05(spark, d):
    return with_columns(events(spark, d), ["event_id"], {"m1": W.momentum("value", 1, own()), "m7": W.momentum("value", 7, own())})


@query("ts06_grouped", f"SELECT event_id, round(lag(value,1) OVER w,6) AS value_lag_1, round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),6) AS value_roll_7_mean, round(CASE WHEN abs(lag(value,1) OVER w) > 1e-10 THEN (value - lag(value,1) OVER w)/lag(value,1) OVER w END,6) AS value_momentum_1 FROM events WINDOW w AS ({W0})")
def ts06(spark, d):
    df = W.grouped_time_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"], W.PRESETS["minimal"])
    return with_columns(df, ["event_id"], {c: F.col(c) for c in ("value_lag_1", "value_roll_7_mean", "value_momentum_1")})


_ONE = "ORDER BY ts, event_id"


@query("ts09_one_group", f"""SELECT event_id, round(lag(value,7) OVER w,6) AS lag_7, round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),6) AS mean_7, round(CASE WHEN abs(lag(value,1) OVER w) > 1e-10 THEN (value - lag(value,1) OVER w)/lag(value,1) OVER w END,6) AS momentum_1,
round(list_reduce(list(value) OVER (w ROWS BETWEEN 400 PRECEDING AND CURRENT ROW), lambda a, x: 0.3*x+0.7*a),6) AS ewma FROM events WINDOW w AS ({_ONE})""")
def ts09(spark, d):
    """All events as one group, which is cut into chunks of 1,000 rows. (In the SQL, what is older than 400 rows weighs below 1e-60.)"""
    df = table(spark, d, "events").withColumn("all", F.lit(1))
    config = W.TimeSeriesConfig((7,), (7,), ("mean",), (0.3,), (1,))
    out = Z.spread_time_series(df, "all", ["ts", "event_id"], ["value"], config, 1000)
    return with_columns(out, ["event_id"], {"lag_7": F.col("value_lag_7"), "mean_7": F.col("value_roll_7_mean"), "momentum_1": F.col("value_momentum_1"), "ewma": F.col("`value_ewma_0.30`")})


def _preset_sql(config) -> str:
    at = lambda k: f"lag(value,{k}) OVER w"
    cols = {f"value_lag_{k}": at(k) for k in config.lags}
    cols |= {f"value_roll_{n}_{s}": f"{'avg' if s == 'mean' else 'stddev_samp'}(value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in config.windows for s in config.stats}
    cols |= {f"value_ewma_{a:.2f}": f"list_reduce(list(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: {a}*x+(1-{a})*a)" for a in config.alphas}
    cols |= {f"value_momentum_{k}": f"CASE WHEN abs({at(k)}) > 1e-10 THEN (value - {at(k)})/{at(k)} END" for k in config.momenta}
    return "SELECT event_id, " + ", ".join(f'round({v}+1e-9,6) AS "{k}"' for k, v in cols.items()) + f" FROM events WINDOW w AS ({W0})"


for _preset, _config in W.PRESETS.items():

    def _preset_query(spark, d, config=_config):
        base = table(spark, d, "events")
        df = W.grouped_time_series(base, "user_id", ["ts", "event_id"], ["value"], config)
        # Means of values in hundredths often lie between two sixth decimals; both engines are nudged off such ties.
        return df.select("event_id", *[r6(F.col(f"`{c}`") + 1e-9).alias(c) for c in df.columns if c not in base.columns])

    query(f"ts07_preset_{_preset}", _preset_sql(_config))(_preset_query)


@query("ts08_nulls_as_zero", f"SELECT event_id, round(avg(coalesce(v,0)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),6) AS m FROM {GAPS} WINDOW w AS ({W0})")
def ts08(spark, d):
    df = events(spark, d).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return with_columns(df, ["event_id"], {"m": W.rolling("v", "mean", W.trailing(own(), 7))})


@query("xs01_cross_section", """SELECT o_orderkey, round(coalesce(CASE WHEN stddev_samp(o_totalprice) OVER g > 0 THEN (o_totalprice-avg(o_totalprice) OVER g)/stddev_samp(o_totalprice) OVER g END,0),6) AS o_totalprice_zscore,
round(o_totalprice-median(o_totalprice) OVER g,6) AS o_totalprice_vs_median,
round(CASE WHEN count(*) OVER g > 1 THEN (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice)-1)/2.0 - 1)/(count(*) OVER g - 1) ELSE 0.5 END,6) AS o_totalprice_rank
FROM orders WINDOW g AS (PARTITION BY o_orderpriority)""")
def xs01(spark, d):
    df = W.cross_sectional(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice"])
    return with_columns(df, ["o_orderkey"], {c: F.col(c) for c in ("o_totalprice_zscore", "o_totalprice_vs_median", "o_totalprice_rank")})


@query("xs03_rank_nulls", f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM {GAPS})
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL WHEN count(v) OVER (PARTITION BY day) > 1 THEN (rank() OVER (PARTITION BY day ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY day, v)-1)/2.0 - 1)/(count(v) OVER (PARTITION BY day) - 1) ELSE 0.5 END,6) AS r FROM e""")
def xs03(spark, d):
    return with_columns(events(spark, d).withColumn("day", F.to_date("ts")), ["event_id"], {"r": W.unit_rank("v", "day")})


@query("rk01_rank", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal)-1)/2.0 - 1)/(count(*) OVER () - 1),6) AS r FROM customer")
def rk01(spark, d):
    return W.whole_rank(table(spark, d, "customer"), "c_acctbal", "r").select("c_custkey", r6("r").alias("r"))


def flagship(spark, d):
    """Grouped time-series features and each day's cross-section in one frame."""
    df = W.grouped_time_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"], W.TimeSeriesConfig(alphas=()))
    return W.cross_sectional(df.withColumn("day", F.to_date("ts")), "day", ["value"]).drop("props")
