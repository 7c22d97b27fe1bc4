"""Scans, preprocessing, encoding, binning and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import encoding as N
from tessella.operators import preprocess as P
from tessella.operators import profile as R
from tessella.operators.ordering import quantiles
from tessella.plans.features import KEYS, LINE, line, with_columns
from tessella.plans.registry import query, r6
from tessella.sources.tables import table

#: Lineitems with gaps in the discount.
GAPS = "(SELECT *, nullif(l_discount, 0) AS disc FROM lineitem)"


def gaps(spark, d):
    return line(spark, d).withColumn("disc", F.nullif("l_discount", F.lit(0.0)))


@query("io01_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def io01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice > 100000")


@query("io09_split_types", "SELECT * FROM (VALUES ('l_returnflag','text'),('l_linestatus','text'),('l_orderkey','number'),('l_partkey','number'),('l_suppkey','number'),('l_linenumber','number'),('l_quantity','number'),('l_extendedprice','number'),('l_discount','number'),('l_tax','number')) t(name, kind)")
def io09(spark, d):
    numbers, texts = R.split_by_type(line(spark, d))
    return spark.createDataFrame([(c, "number") for c in numbers] + [(c, "text") for c in texts], "name string, kind string")


@query("pp01_standard", f"WITH s AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s FROM lineitem) SELECT {LINE}, round((l_quantity-m)/s,6) AS l_quantity FROM lineitem, s")
def pp01(spark, d):
    df = line(spark, d)
    return with_columns(P.StandardScaler(["l_quantity"]).fit(df).transform(df), KEYS, {"l_quantity": F.col("l_quantity")})


@query("pp02_merge", "SELECT count(l_tax) AS n, round(avg(l_tax),6) AS mean, round(var_pop(l_tax),9) AS variance FROM lineitem")
def pp02(spark, d):
    df = line(spark, d)
    a, b = (P.StandardScaler(["l_tax"]).fit(df.where(f"l_linenumber {op} 3")) for op in ("<=", ">"))
    p = a.merge(b).params["l_tax"]
    return spark.createDataFrame([(p["n"], round(p["mean"], 6), round(p["m2"] / p["n"], 9))], "n long, mean double, variance double")


@query("pp03_minmax", f"WITH s AS (SELECT min(l_quantity) a, max(l_quantity) b FROM lineitem) SELECT {LINE}, round(-1+2*(l_quantity-a)/(b-a),6) AS l_quantity FROM lineitem, s")
def pp03(spark, d):
    df = line(spark, d)
    return with_columns(P.MinMaxScaler(["l_quantity"], low=-1.0, high=1.0).fit(df).transform(df), KEYS, {"l_quantity": F.col("l_quantity")})


@query("pp04_robust", f"WITH s AS (SELECT quantile_cont(l_extendedprice,.25) a, quantile_cont(l_extendedprice,.5) m, quantile_cont(l_extendedprice,.75) b FROM lineitem) SELECT {LINE}, round((l_extendedprice-m)/(b-a),6) AS l_extendedprice FROM lineitem, s")
def pp04(spark, d):
    df = line(spark, d)
    return with_columns(P.RobustScaler(["l_extendedprice"]).fit(df).transform(df), KEYS, {"l_extendedprice": F.col("l_extendedprice")})


for _kind, _sql in {"mean": "avg(disc)", "median": "median(disc)", "constant": "-1.0", "mode": "(SELECT min(v) FROM (SELECT min(disc) v, count(*) n, round(disc,2) b FROM g WHERE disc IS NOT NULL GROUP BY b ORDER BY n DESC, b LIMIT 1))"}.items():

    def _impute(spark, d, kind=_kind):
        df = gaps(spark, d)
        return with_columns(P.Imputer(["disc"], strategy=kind, constant=-1.0).fit(df).transform(df), KEYS, {"disc": F.col("disc")})

    query(f"pp05_impute_{_kind}", f"WITH g AS {GAPS}, s AS (SELECT {_sql} AS m FROM {'g' if _kind != 'mode' else '(SELECT 1)'}{' LIMIT 1' if _kind == 'constant' else ''}) SELECT {LINE}, round(coalesce(disc,m),6) AS disc FROM g, s")(_impute)


@query("pp06_indicator", f"SELECT {LINE}, CAST(disc IS NULL AS DOUBLE) AS disc_missing FROM {GAPS}")
def pp06(spark, d):
    df = gaps(spark, d)
    return P.MissingIndicator(["disc", "l_tax"]).fit(df).transform(df).select(*KEYS, "disc_missing")


IQR = "WITH q AS (SELECT quantile_cont(o_totalprice,.25) a, quantile_cont(o_totalprice,.75) b FROM orders), s AS (SELECT a-0.4*(b-a) lo, b+0.4*(b-a) hi FROM q)"


def iqr(spark, d):
    df = table(spark, d, "orders")
    return P.Outliers(["o_totalprice"], threshold=0.4).fit(df), df


@query("pp07_iqr_cap", IQR + " SELECT o_orderkey, round(least(greatest(o_totalprice,lo),hi),4) AS o_totalprice FROM orders, s")
def pp07a(spark, d):
    s, df = iqr(spark, d)
    return s.cap(df).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("pp07_iqr_flag", IQR + " SELECT o_orderkey, CAST(o_totalprice<lo OR o_totalprice>hi AS DOUBLE) AS o_totalprice_outlier FROM orders, s")
def pp07b(spark, d):
    s, df = iqr(spark, d)
    return s.flag(df).select("o_orderkey", "o_totalprice_outlier")


@query("pp07_iqr_remove", IQR + " SELECT o_orderkey FROM orders, s WHERE o_totalprice BETWEEN lo AND hi")
def pp07c(spark, d):
    s, df = iqr(spark, d)
    return s.remove(df).select("o_orderkey")


@query("ag26_outlier_counts", IQR + " SELECT count(*) FILTER (WHERE o_totalprice<lo OR o_totalprice>hi) AS o_totalprice FROM orders, s")
def ag26(spark, d):
    s, df = iqr(spark, d)
    return s.counts(df)


@query("pp08_zscore_flag", "WITH s AS (SELECT avg(o_totalprice) m, greatest(stddev_pop(o_totalprice),1e-10) s FROM orders) SELECT o_orderkey, CAST(abs(o_totalprice-m) > 1.5*s AS DOUBLE) AS o_totalprice_outlier FROM orders, s")
def pp08(spark, d):
    df = table(spark, d, "orders")
    return P.Outliers(["o_totalprice"], method="zscore", threshold=1.5).fit(df).flag(df).select("o_orderkey", "o_totalprice_outlier")


def _finest(passes: int = 4, steps: int = 21) -> str:
    """The likelihood of each lambda of a grid, and a finer grid around the best, four times."""
    out = "WITH x AS (SELECT ln(1+o_totalprice) l FROM orders), b0 AS (SELECT -5.0::DOUBLE a, 5.0::DOUBLE b)"
    for p in range(passes):
        out += f""", g{p} AS (SELECT a+(b-a)*i/{steps - 1}.0 AS lam, (b-a)/{steps - 1}.0 AS step FROM b{p}, range({steps}) t(i)),
s{p} AS (SELECT lam, step, -0.5*ln(greatest(var_pop(CASE WHEN abs(lam) < 1e-9 THEN l ELSE (exp(lam*l)-1)/lam END), 1e-300))+(lam-1)*avg(l) AS score FROM x, g{p} GROUP BY lam, step),
b{p + 1} AS (SELECT lam, greatest(-5.0, lam-step) AS a, least(5.0, lam+step) AS b FROM s{p} ORDER BY score DESC, lam LIMIT 1)"""
    return out + f""" SELECT 'o_totalprice' AS "column", round(lam,3) AS lambda FROM b{passes}"""


@query("pp10_yeo_johnson_fit", _finest())
def pp10(spark, d):
    s = P.YeoJohnson(["o_totalprice"]).fit(table(spark, d, "orders"))
    return spark.createDataFrame([("o_totalprice", round(s.params["o_totalprice"], 3))], "column string, lambda double")


@query("pp11_chain", f"WITH g AS {GAPS}, s AS (SELECT avg(disc) m FROM g), f AS (SELECT g.*, coalesce(disc,m) x FROM g, s), t AS (SELECT avg(x) a, stddev_pop(x) b FROM f) SELECT {LINE}, round((x-a)/b,6)+0.0 AS disc FROM f, t")
def pp11(spark, d):
    df = gaps(spark, d)
    return with_columns(P.Chain(P.Imputer(["disc"]), P.StandardScaler(["disc"])).fit(df).transform(df), KEYS, {"disc": F.col("disc")})


@query("en01_frequency", "SELECT p_partkey, (count(*) OVER (PARTITION BY p_brand))::DOUBLE AS freq FROM part")
def en01(spark, d):
    df = table(spark, d, "part")
    return N.apply_dictionary(df, N.frequency(df, "p_brand"), "p_brand", "freq", "freq", F.lit(0.0)).select("p_partkey", "freq")


@query("en02_label", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type)-1 AS INT) AS label FROM part")
def en02(spark, d):
    df = table(spark, d, "part")
    return N.apply_dictionary(df, N.labels(df, "p_type"), "p_type", "label", "label", F.lit(-1)).select("p_partkey", F.col("label").cast("int").alias("label"))


@query("en03_onehot", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag='N' AS DOUBLE) AS l_returnflag_N, CAST(l_returnflag='R' AS DOUBLE) AS l_returnflag_R FROM lineitem")
def en03(spark, d):
    return N.one_hot(line(spark, d), "l_returnflag", ["A", "N", "R"], drop_first=True).select(*KEYS, "l_returnflag_N", "l_returnflag_R")


@query("en04_ordered_target", """WITH t AS (SELECT o_orderkey, count(*) OVER c n, coalesce(sum(o_totalprice) OVER c,0) s, coalesce(avg(o_totalprice) OVER g,0) m FROM orders
WINDOW c AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, round(CASE WHEN n>0 THEN (s+10*m)/(n+10) ELSE m END,4) AS te FROM t""")
def en04(spark, d):
    return N.ordered_target(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"], "te").select("o_orderkey", F.round("te", 4).alias("te"))


@query("en05_target_map", "WITH m AS (SELECT avg(o_totalprice) m FROM orders) SELECT o_orderpriority, round((sum(o_totalprice)+10*any_value(m))/(count(*)+10),4) AS mean FROM orders, m GROUP BY 1")
def en05(spark, d):
    return N.target_means(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("mean", 4).alias("mean"))


@query("en06_rare_filter", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_size) >= 40 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END AS p_size FROM part")
def en06(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return N.rare_to_unknown(df, "p_size", 40).select("p_partkey", "p_size")


@query("en08_first_seen", "WITH f AS (SELECT o_orderpriority c, min(o_orderkey) a FROM orders GROUP BY 1) SELECT c AS o_orderpriority, CAST(row_number() OVER (ORDER BY a)-1 AS INT) AS label FROM f")
def en08(spark, d):
    return N.first_seen(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").withColumn("label", F.col("label").cast("int"))


QS = ", ".join(f"{i}/8.0" for i in range(1, 8))


@query("bn01_boundaries", f"SELECT round(unnest(list_sort(list_distinct(quantile_cont(l_extendedprice, [{QS}])))),6) AS boundary FROM lineitem")
def bn01(spark, d):
    b = N.boundaries(line(spark, d), ["l_extendedprice"], 8, exact=True)["l_extendedprice"]
    return spark.createDataFrame([(round(x, 6),) for x in b], "boundary double")


@query("bn02_bin", f"WITH b AS (SELECT list_distinct(quantile_cont(l_quantity, [{QS}])) b FROM lineitem) SELECT {LINE}, CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE len(list_filter(b, lambda x: x <= l_quantity)) END AS INT) AS bin FROM lineitem, b")
def bn02(spark, d):
    df = line(spark, d)
    bounds = N.boundaries(df, ["l_quantity"], 8, exact=True)["l_quantity"]
    return df.select(*KEYS, N.binned(F.when(F.col("l_linenumber") != 1, F.col("l_quantity")), bounds).cast("int").alias("bin"))


@query("bn04_category_bin", f"""WITH m AS (SELECT avg(p_retailprice) m FROM part), g AS (SELECT p_brand, count(*) n FROM part GROUP BY 1), k AS (SELECT p_partkey, CASE WHEN n >= 5 THEN p_brand ELSE 'unknown' END AS b, p_retailprice FROM part JOIN g USING (p_brand)),
t AS (SELECT b, (sum(p_retailprice)+10*any_value(m))/(count(*)+10) AS te FROM k, m GROUP BY 1), e AS (SELECT p_partkey, te FROM k JOIN t USING (b)), q AS (SELECT list_distinct(quantile_cont(te, [{', '.join(f'{i}/16.0' for i in range(1, 16))}])) AS c FROM e)
SELECT p_partkey, CAST(len(list_filter(c, lambda x: x <= te)) AS INT) AS bin FROM e, q""")
def bn04(spark, d):
    df = N.rare_to_unknown(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", 5)
    df = N.apply_dictionary(df, N.target_means(df, "p_brand", "p_retailprice"), "p_brand", "mean", "te", F.lit(0.0))
    return df.select("p_partkey", N.binned(F.col("te"), N.boundaries(df, ["te"], 16, exact=True)["te"]).alias("bin"))


@query("bn06_bundles", """WITH r AS (SELECT CAST(l_returnflag='A' AS INT) a, CAST(l_returnflag='R' AS INT) r, CAST(l_tax<>0 AS INT) t FROM lineitem),
s AS (SELECT avg(a) <= 0.5 AND avg(r) <= 0.5 AND avg(a*r) <= 0.001 AS ar, avg(t) <= 0.5 AS sparse_t FROM r)
SELECT CASE WHEN ar THEN 'flag_A,flag_R' ELSE 'flag_A' END AS bundle FROM s UNION ALL SELECT 'flag_R' FROM s WHERE NOT ar UNION ALL SELECT CASE WHEN sparse_t THEN 'not expected' ELSE 'l_tax' END FROM s""")
def bn06(spark, d):
    df = line(spark, d).select((F.col("l_returnflag") == "A").cast("int").alias("flag_A"), (F.col("l_returnflag") == "R").cast("int").alias("flag_R"), "l_tax")
    groups = N.bundle(df, ["flag_A", "flag_R", "l_tax"], {"flag_A": 2, "flag_R": 2, "l_tax": 9})
    return spark.createDataFrame([(",".join(sorted(g)),) for g in groups], "bundle string")


@query("se01_concat", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus='F'")
def se01(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return N.concat_binned(a, a.where("o_orderstatus = 'F'")).select("o_orderkey")


@query("se02_categories", "SELECT DISTINCT o_orderpriority FROM orders")
def se02(spark, d):
    return table(spark, d, "orders").select("o_orderpriority").distinct()


_COLS = ["o_orderkey", "o_totalprice", "o_orderpriority"]


@query("ag01_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", CAST(0 AS DOUBLE) AS null_ratio, count(DISTINCT {c}) AS n_unique, {'CAST(min(' + c + ') AS DOUBLE)' if c != 'o_orderpriority' else 'NULL'} AS \"min\", {'CAST(max(' + c + ') AS DOUBLE)' if c != 'o_orderpriority' else 'NULL'} AS \"max\", count(DISTINCT {c}) <= 1 AS is_constant FROM orders" for c in _COLS))
def ag01(spark, d):
    return R.profile(table(spark, d, "orders"), _COLS).select("column", "rows", "null_ratio", "n_unique", "min", "max", "is_constant")


@query("ag02_moments", "WITH m AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders) SELECT round(avg(pow((o_totalprice-m)/s,3)),6) AS skewness, round(avg(pow((o_totalprice-m)/s,4))-3,6) AS kurtosis, round(corr(o_totalprice,o_custkey),6) AS corr FROM orders, m")
def ag02(spark, d):
    df = table(spark, d, "orders")
    both = R.correlations(df, ["o_totalprice", "o_custkey"]).select(r6("corr").alias("corr"))
    return R.profile(df, ["o_totalprice"], exact=False).select(r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis")).crossJoin(both)


_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) n, count(DISTINCT {c}) u, {'NULL' if num else f'avg(length(CAST({c} AS VARCHAR)))'} l, {num} AS num FROM orders" for c, num in (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)))


@query("ag03_kinds", f"""SELECT c AS "column", CASE WHEN num THEN 'numeric' WHEN (u > 100 AND l > 20) OR (u > 0.9*n AND u > 50 AND l > 15) THEN 'text' ELSE 'categorical' END AS kind FROM ({_KINDS})""")
def ag03(spark, d):
    return R.profile(table(spark, d, "orders")).select("column", "kind")


@query("ag04_task", """WITH v AS (SELECT 'o_orderstatus' AS target, CAST(ascii(o_orderstatus) AS DOUBLE) v FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders),
s AS (SELECT target, avg(CAST(abs(v-round(v)) < 0.01 AS INT)) w, count(DISTINCT round(v)) n FROM v GROUP BY 1)
SELECT target, CASE WHEN w < 0.9 THEN 'regression' WHEN n = 2 THEN 'binary' WHEN n BETWEEN 3 AND 20 THEN 'multiclass' ELSE 'regression' END AS task FROM s""")
def ag04(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderstatus", F.ascii("o_orderstatus"))
    return spark.createDataFrame([(c, R.task_of(df, c)) for c in ("o_orderstatus", "o_totalprice")], "target string, task string")


@query("ag06_panel", "WITH g AS (SELECT user_id, count(*) n FROM events GROUP BY 1), s AS (SELECT count(*) AS \"groups\", CAST(sum(n) AS BIGINT) AS \"rows\", min(n) a, max(n) b, avg(n) m FROM g) SELECT \"groups\", \"rows\", a AS min_obs, b AS max_obs, round(0.4*sqrt(least(m,100)/100)+0.3*a/b+0.3*(1-\"groups\"/\"rows\"),6) AS score FROM s")
def ag06(spark, d):
    return R.panel_score(table(spark, d, "events"), "user_id").select("groups", "rows", "min_obs", "max_obs", r6("score").alias("score"))


@query("ag07_granularity", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) d FROM events), g AS (SELECT datediff('day', lag(d) OVER (ORDER BY d), d) gap FROM d), r AS (SELECT gap, row_number() OVER (ORDER BY gap) k, count(*) OVER () n FROM g WHERE gap > 0)
SELECT CAST(gap AS INT) AS gap, CASE WHEN gap <= 1 THEN 'daily' WHEN gap <= 10 THEN 'weekly' WHEN gap <= 45 THEN 'monthly' WHEN gap <= 120 THEN 'quarterly' ELSE 'yearly' END AS granularity FROM r WHERE k = n//2+1""")
def ag07(spark, d):
    return R.granularity(table(spark, d, "events"), "ts")


@query("ag08_statistics", "SELECT round(avg(l_tax),6) AS mean, round(var_pop(l_tax),9) AS variance, round(stddev_pop(l_tax),6) AS std, round(max(l_tax)-min(l_tax),6) AS spread FROM lineitem")
def ag08(spark, d):
    return line(spark, d).agg(r6(F.avg("l_tax")).alias("mean"), F.round(F.var_pop("l_tax"), 9).alias("variance"), r6(F.stddev_pop("l_tax")).alias("std"), r6(F.max("l_tax") - F.min("l_tax")).alias("spread"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ag09_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def ag09(spark, d):
    return R.correlations(line(spark, d), _NUM).select("a", "b", r6("corr").alias("corr"))


@query("ag10_noise_floor", "WITH c AS (SELECT o_totalprice y, ntile(20) OVER (ORDER BY o_totalprice, o_orderkey) k FROM orders), i AS (SELECT avg(v) a FROM (SELECT var_pop(y) v FROM c GROUP BY k)) SELECT round(a/(SELECT var_pop(y) FROM c),6) AS noise_floor FROM i")
def ag10(spark, d):
    return R.noise_floor(table(spark, d, "orders"), "o_totalprice", "o_totalprice", "o_orderkey").select(r6("noise_floor").alias("noise_floor"))


@query("ag13_percentiles", "SELECT round(quantile_cont(o_totalprice,.1),4) AS p10, round(median(o_totalprice),4) AS p50, round(quantile_cont(o_totalprice,.9),4) AS p90 FROM orders")
def ag13(spark, d):
    found = quantiles(table(spark, d, "orders"), F.col("o_totalprice"), [0.1, 0.5, 0.9]) or [None] * 3
    return spark.createDataFrame([tuple(found)], "p10 double, p50 double, p90 double").select(*[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")])


@query("ag23_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ag23(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("fs01_select", """WITH r AS (SELECT l_tax o, l_tax*2 a, l_quantity b, l_discount*100 c, l_quantity-50*l_discount y FROM lineitem),
s AS (SELECT 'twice' AS feature, var_pop(a) v, corr(a,o) r, corr(a,y) t FROM r UNION ALL SELECT 'l_quantity', var_pop(b), corr(b,o), corr(b,y) FROM r UNION ALL SELECT 'l_discount', var_pop(c), corr(c,o), corr(c,y) FROM r)
SELECT feature FROM s WHERE v >= 0.01 AND abs(r) < 0.95 ORDER BY abs(t) DESC LIMIT 50""")
def fs01(spark, d):
    df = line(spark, d).select("l_tax", (F.col("l_tax") * 2).alias("twice"), "l_quantity", (F.col("l_discount") * 100).alias("l_discount"), (F.col("l_quantity") - 50 * F.col("l_discount")).alias("y"))
    return spark.createDataFrame([(f,) for f in R.select_features(df, ["l_tax"], ["twice", "l_quantity", "l_discount"], "y")], "feature string")


@query("fs02_collinear", """WITH r AS (SELECT l_quantity a, l_quantity*2+l_tax/10 b, l_tax c, l_quantity y FROM lineitem),
p AS (SELECT 'l_quantity' AS x, 'near' AS z, corr(a,b) r FROM r UNION ALL SELECT 'l_quantity', 'l_tax', corr(a,c) FROM r UNION ALL SELECT 'near', 'l_tax', corr(b,c) FROM r),
t AS (SELECT 'l_quantity' AS feature, abs(corr(a,y)) t FROM r UNION ALL SELECT 'near', abs(corr(b,y)) FROM r UNION ALL SELECT 'l_tax', abs(corr(c,y)) FROM r)
SELECT feature FROM t WHERE feature NOT IN (SELECT CASE WHEN m.t < n.t THEN x ELSE z END FROM p JOIN t m ON m.feature = x JOIN t n ON n.feature = z WHERE abs(r) > 0.99)""")
def fs02(spark, d):
    df = line(spark, d).select("l_tax", "l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax") / 10).alias("near"), F.col("l_quantity").alias("y"))
    return spark.createDataFrame([(f,) for f in R.drop_collinear(df, ["l_quantity", "near", "l_tax"], "y")], "feature string")
