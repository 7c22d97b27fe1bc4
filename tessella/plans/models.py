"""Loss, tree, model, resampling, metric and drift queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.functions import losses as L
from tessella.operators import evaluation as E
from tessella.operators import auto as A
from tessella.operators import cohorts as C
from tessella.operators import linear as M
from tessella.operators import monitoring as D
from tessella.operators import trees as T
from tessella.operators import tuning as U
from tessella.operators.encoding import binned, boundaries
from tessella.plans.features import KEYS, LINE, line, with_columns
from tessella.plans.registry import query, r6
from tessella.sources.tables import table

FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: A target that can be learnt.
TARGET = "l_quantity * (1 - l_discount) + 10 * l_tax"


def rows(spark, d):
    """Lineitems with the derived target and a key from all columns that tell rows apart."""
    df = line(spark, d).withColumn("y", F.expr(TARGET))
    return df.withColumn("key", F.xxhash64(*[c for c in df.columns if c != "y"]))


_Y, _P = "l_quantity/50", "0.3"
_S = "(1/(1+exp(-0.3)))"
_FW = f"(CASE WHEN {_Y} > 0.5 THEN 0.25*pow(1-{_S},2) ELSE 0.75*pow({_S},2) END)"
_T = f"least(greatest({_Y},1e-4),1-1e-4)"


def _percentage(scale: str) -> tuple[str, str]:
    w = f"(1/{scale})"
    s = f"(1+pow(({_P}-{_Y})*{w},2))"
    return f"({_P}-{_Y})*{w}/sqrt({s})*{w}", f"greatest({w}*{w}*pow({s},-1.5),1e-7)"


def _digamma(x: float) -> float:
    """For the SQL: from far out, where the asymptotic series is exact to double precision."""
    shift = sum(1 / (x + i) for i in range(60))
    x += 60
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - shift


_LOSS_SQL = {
    "mse": (f"{_P}-{_Y}", "1.0"),
    "pseudo_huber": (f"({_P}-{_Y})/sqrt(1+({_P}-{_Y})*({_P}-{_Y}))", f"pow(1+({_P}-{_Y})*({_P}-{_Y}),-1.5)"),
    "log_loss": (f"{_S}-{_Y}", f"{_S}*(1-{_S})"),
    "quantile": (f"1/(1+exp(-({_P}-{_Y})))-0.5", f"greatest(1/(1+exp(-({_P}-{_Y})))*(1-1/(1+exp(-({_P}-{_Y})))),1e-7)"),
    "focal": (f"{_FW}*({_S}-{_Y})", f"greatest({_FW}*{_S}*(1-{_S}),1e-7)"),
    "quantile_90": (f"1/(1+exp(-({_P}-{_Y})))-0.9", f"greatest(1/(1+exp(-({_P}-{_Y})))*(1-1/(1+exp(-({_P}-{_Y})))),1e-7)"),
    "mape": _percentage(f"greatest(abs({_Y}),1e-3)"),
    "smape": _percentage(f"greatest((abs({_Y})+abs({_P}))/2,1e-3)"),
    "beta": (f"-10*(ln({_T}/(1-{_T}))-({_digamma(10 / (1 + math.exp(-0.3)))!r})+({_digamma(10 - 10 / (1 + math.exp(-0.3)))!r}))*{_S}*(1-{_S})", f"10*{_S}*(1-{_S})"),
    "tweedie": (f"exp(0.5*{_P})-{_Y}*exp(-0.5*{_P})", f"exp(0.5*{_P})"),
}
for _name, _loss in L.LOSSES.items():

    def _loss_query(spark, d, loss=_loss):
        g, h = loss.pair(F.col("l_quantity") / 50, F.lit(0.3))
        return with_columns(line(spark, d), KEYS, {"g": g, "h": h})

    _pair = _LOSS_SQL.get(_name)
    query(f"ls_{_name}", f"SELECT {LINE}, round({_pair[0]},6) AS g, round({_pair[1]},6) AS h FROM lineitem" if _pair else None)(_loss_query)


@query("ls05_multiclass", f"WITH p AS (SELECT *, exp(l_tax) a, exp(l_discount) b, exp(0.0) c FROM lineitem) SELECT {LINE}, round(a/(a+b+c)-CAST(l_returnflag='A' AS INT),6) AS g0, round(b/(a+b+c)-CAST(l_returnflag='N' AS INT),6) AS g1, round(c/(a+b+c)-CAST(l_returnflag='R' AS INT),6) AS g2 FROM p")
def ls05(spark, d):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pairs = L.multiclass(label, [F.col("l_tax"), F.col("l_discount"), F.lit(0.0)])
    return with_columns(line(spark, d), KEYS, {f"g{k}": g for k, (g, _) in enumerate(pairs)})


_Q = ", ".join(f"{i}/8.0" for i in range(1, 8))
_BINS = f"""WITH b AS (SELECT {', '.join(f"list_distinct(quantile_cont({f}, [{_Q}])) b{i}" for i, f in enumerate(FEATURES))}, avg({TARGET}) m FROM lineitem),
rows AS (SELECT m-({TARGET}) AS g, year(l_shipdate) AS era, {', '.join(f"len(list_filter(b{i}, lambda x: x <= {f})) f{i}" for i, f in enumerate(FEATURES))} FROM lineitem, b),
long AS ({' UNION ALL '.join(f"SELECT {i} AS feature, f{i} AS bin, g, era FROM rows" for i in range(3))})"""


def root(spark, d):
    df = rows(spark, d)
    bounds = boundaries(df, FEATURES, 8, exact=True)
    mean = df.agg(F.avg("y")).first()[0]
    return df, {f: binned(F.col(f), bounds[f]) for f in FEATURES}, F.lit(mean) - F.col("y")


@query("ag18_histogram", _BINS + " SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(sum(g),3) AS g, round(count(*)::DOUBLE,3) AS h, count(*) AS n FROM long GROUP BY 1,2")
def ag18(spark, d):
    df, bins, g = root(spark, d)
    return T.histogram(df, bins, g, F.lit(1.0)).select("feature", "bin", F.round("g", 3).alias("g"), F.round("h", 3).alias("h"), "n")


@query("ag21_era_histogram", _BINS + " SELECT CAST(era AS INT) AS era, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(sum(g),3) AS g, count(*) AS n FROM long GROUP BY 1,2,3")
def ag21(spark, d):
    df, bins, g = root(spark, d)
    return T.histogram(df, bins, g, F.lit(1.0), F.year("l_shipdate").alias("era")).select("era", "feature", "bin", F.round("g", 3).alias("g"), "n")


_GAINS = _BINS + """, h AS (SELECT feature, bin, sum(g) g, count(*) n FROM long GROUP BY 1,2),
s AS (SELECT feature, bin, sum(g) OVER r gl, sum(n) OVER r nl, sum(g) OVER p gt, sum(n) OVER p nt FROM h WINDOW p AS (PARTITION BY feature), r AS (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gains AS (SELECT feature, bin, nl, nt-nl nr, 0.5*(gl*gl/(nl+1)+(gt-gl)*(gt-gl)/(nt-nl+1)-gt*gt/(nt+1)) gain FROM s WHERE nl >= 1 AND nt-nl >= 1)"""


@query("tr01_split_gain", _GAINS + " SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right, round(gain,2) AS gain FROM gains")
def tr01(spark, d):
    df, bins, g = root(spark, d)
    return T.split_gains(T.histogram(df, bins, g, F.lit(1.0))).withColumn("gain", F.round("gain", 2))


@query("tr02_best_split", _GAINS + " SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right, round(gain,2) AS gain FROM gains ORDER BY gains.gain DESC, feature, bin LIMIT 1")
def tr02(spark, d):
    df, bins, g = root(spark, d)
    return T.best_splits(T.split_gains(T.histogram(df, bins, g, F.lit(1.0)))).withColumn("gain", F.round("gain", 2))


@query("tr05_era_split", _BINS + """, h AS (SELECT era, feature, bin, sum(g) g, count(*) n FROM long GROUP BY 1,2,3),
f AS (SELECT e.era, s.feature, s.bin, coalesce(g,0) g, coalesce(n,0) n FROM (SELECT DISTINCT era FROM h) e, (SELECT DISTINCT feature, bin FROM h) s LEFT JOIN h ON h.era = e.era AND h.feature = s.feature AND h.bin = s.bin),
c AS (SELECT era, feature, bin, sum(g) OVER r gl, sum(n) OVER r nl, sum(g) OVER p gt, sum(n) OVER p nt FROM f WINDOW p AS (PARTITION BY era, feature), r AS (PARTITION BY era, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT feature, bin, 0.5*(gl*gl/(nl+1)+(gt-gl)*(gt-gl)/(nt-nl+1)-gt*gt/(nt+1)) gain, sign((gt-gl)/(nt-nl+1)-gl/(nl+1)) up FROM c)
SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(avg(gain),2) AS gain, CAST(min(up) AS INT) AS direction FROM u GROUP BY 1,2 HAVING min(up) = max(up) AND min(up) <> 0""")
def tr05(spark, d):
    df, bins, g = root(spark, d)
    return T.era_splits(T.histogram(df, bins, g, F.lit(1.0), F.year("l_shipdate").alias("era"))).withColumn("gain", F.round("gain", 2))


SMALL = T.TreeConfig(rounds=5, rate=0.3, depth=4, leaves=12, bins=32)


@query("bo01_gbdt")
def bo01(spark, d):
    df = rows(spark, d)
    model = T.train_gbdt(df, FEATURES, "y", "key", SMALL)
    return model.predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])


def classed(spark, d):
    return rows(spark, d).withColumn("c", F.when(F.col("y") < 15, 0).when(F.col("y") < 30, 1).otherwise(2))


@query("bo02_multiclass")
def bo02(spark, d):
    """Twelve rounds of three classes: how often the most probable class is right, and the loss."""
    df = classed(spark, d)
    model = C.train_multiclass(df, FEATURES, "c", "key", 3, T.TreeConfig(rounds=12, rate=0.5, depth=3, leaves=8, bins=32))
    out = model.predict_class(df, proba="p")
    loss = E.multiclass_log_loss(F.col("c"), [F.col(f"p_{k}") for k in range(3)])
    return out.agg(r6(F.avg((F.col("predicted") == F.col("c")).cast("double"))).alias("accuracy"), r6(loss).alias("log_loss"))


@query("bo06_binary")
def bo06(spark, d):
    df = rows(spark, d).withColumn("b", (F.col("y") > 25).cast("double"))
    model = T.train_gbdt(df, FEATURES, "b", "key", T.TreeConfig(rounds=4, rate=0.5, depth=3, leaves=8, bins=32, loss="log_loss"))
    return model.predict(df).agg(*[r6(c).alias(n) for n, c in E.binary_metrics(F.col("b"), F.col("prediction")).items()])


@query("bo07_conformal")
def bo07(spark, d):
    df = rows(spark, d)
    cfg = T.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=32, calibration=0.3, quantile=0.9)
    out = T.train_gbdt(df, FEATURES, "y", "key", cfg).predict(df)
    return out.agg(r6(F.avg(F.col("y").between(F.col("prediction_low"), F.col("prediction_high")).cast("double"))).alias("coverage"))


@query("bo07_conformal_group_mean", """WITH m AS (SELECT o_orderkey, abs(o_totalprice-avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) r FROM orders), n AS (SELECT count(*) n FROM m)
SELECT round(r,4) AS q FROM (SELECT r, row_number() OVER (ORDER BY r)-1 k FROM m), n WHERE k = least(ceil(n*0.9), n-1)""")
def bo07b(spark, d):
    from pyspark.sql import Window

    df = table(spark, d, "orders").select(F.abs(F.col("o_totalprice") - F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority"))).alias("r"))
    return spark.createDataFrame([(round(T.conformal(df, F.col("r"), 0.9), 4),)], "q double")


@query("bo09_attributions")
def bo09(spark, d):
    df = rows(spark, d)
    out = T.train_gbdt(df, FEATURES, "y", "key", T.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=32)).attributions(df)
    return out.agg(*[r6(F.avg(F.abs(f"attr_{f}"))).alias(f"attr_{f}") for f in FEATURES])


@query("ag25_importance")
def ag25(spark, d):
    model = T.train_gbdt(rows(spark, d), FEATURES, "y", "key", T.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=32))
    return spark.createDataFrame([(f, round(g, 6), round(model.importance("hessian")[f], 6)) for f, g in model.importance().items()], "feature string, gain double, hessian double")


@query("so04_goss")
def so04(spark, d):
    cfg = T.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=32, goss=(0.2, 0.1))
    df = rows(spark, d)
    return T.train_gbdt(df, FEATURES, "y", "key", cfg).predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])


for _mode in ("trees", "linear_then_trees", "forest"):

    def _universal(spark, d, mode=_mode):
        df = rows(spark, d)
        model = M.train_universal(df, FEATURES, "y", "key", mode, T.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=32))
        return model.predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])

    query(f"un01_{_mode}")(_universal)


@query("un03_update")
def un03(spark, d):
    df = rows(spark, d)
    a, b = df.where("l_linenumber <= 3"), df.where("l_linenumber > 3")
    cfg = T.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=32)
    model = M.train_universal(a, FEATURES, "y", "key", "linear_then_trees", cfg).update(b, 2)
    return model.predict(df).agg(F.lit(len(model.trees.trees)).alias("trees"), r6(E.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).alias("r2"))


@query("ln01_ridge", "WITH s AS (SELECT regr_slope(y, l_quantity) b, regr_intercept(y, l_quantity) a FROM (SELECT *, 3*l_quantity + l_tax AS y FROM lineitem)) SELECT round(a,4) AS intercept, round(b,4) AS slope FROM s")
def ln01(spark, d):
    m = M.fit_linear(line(spark, d).withColumn("y", 3 * F.col("l_quantity") + F.col("l_tax")), ["l_quantity"], "y", lam=0.0)
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.weights[1], 4))], "intercept double, slope double")


@query("ln01_newton", f"""WITH r AS (SELECT CAST(l_discount > 0.05 AS INT) x, CAST({TARGET} > 22 AS INT) y FROM lineitem), p AS (SELECT avg(y) FILTER (WHERE x=0) p0, avg(y) FILTER (WHERE x=1) p1 FROM r)
SELECT round(ln(p0/(1-p0)),5) AS intercept, round(ln(p1/(1-p1))-ln(p0/(1-p0)),5) AS slope FROM p""")
def ln01c(spark, d):
    """A logistic fit of one 0/1 feature: the classes' log-odds."""
    df = rows(spark, d).select((F.col("l_discount") > 0.05).cast("double").alias("x"), (F.col("y") > 22).cast("double").alias("b"))
    m = M.fit_newton(df, ["x"], "b", lam=0.0)
    return spark.createDataFrame([(round(m.weights[0], 5), round(m.weights[1], 5))], "intercept double, slope double")


@query("ln01_newton_counts", f"""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INT) x, {TARGET} y FROM lineitem), p AS (SELECT avg(y) FILTER (WHERE x=0) p0, avg(y) FILTER (WHERE x=1) p1 FROM r) SELECT round(ln(p0),5) AS intercept, round(ln(p1/p0),5) AS slope FROM p""")
def ln01d(spark, d):
    """The same by the loss of non-negative amounts, whose link is the logarithm."""
    df = rows(spark, d).select((F.col("l_returnflag") == "R").cast("double").alias("x"), "y")
    m = M.fit_newton(df, ["x"], "y", loss="tweedie", lam=0.0)
    return spark.createDataFrame([(round(m.weights[0], 5), round(m.weights[1], 5))], "intercept double, slope double")


@query("ln01_elastic_net")
def ln01b(spark, d):
    m = M.fit_linear(rows(spark, d), FEATURES, "y", lam=1.0, l1_ratio=0.5, damping=0.1)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in zip(["", *FEATURES], m.weights)], "feature string, weight double")


@query("ln03_linear_tree")
def ln03(spark, d):
    df = rows(spark, d)
    return M.train_linear_tree(df, FEATURES, "y", "key", depth=3, leaves=6).predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])


@query("es02_hill_climb", f"""WITH r AS (SELECT {TARGET} y, l_quantity p1, 40*l_tax + 0.5*l_quantity + 12 p2 FROM lineitem), e AS (SELECT avg((y-p1)*(y-p1)) a, avg((y-p2)*(y-p2)) b, avg((y-(p1+p2)/2)*(y-(p1+p2)/2)) c FROM r)
SELECT unnest(CASE WHEN c < least(a,b) THEN ['p1','p2'] WHEN a <= b THEN ['p1'] ELSE ['p2'] END) AS chosen FROM e""")
def es02(spark, d):
    df = rows(spark, d).select("y", F.col("l_quantity").alias("p1"), (40 * F.col("l_tax") + 0.5 * F.col("l_quantity") + 12).alias("p2"))
    return spark.createDataFrame([(c,) for c in M.hill_climb(df, ["p1", "p2"], "y")], "chosen string")


_STACK = """WITH r AS (SELECT %s y, l_quantity p1, 10*l_tax p2 FROM lineitem), s AS (SELECT regr_sxx(y,p1)+1 a, regr_sxx(y,p2)+1 b, covar_pop(p1,p2)*count(*) c, covar_pop(p1,y)*count(*) u, covar_pop(p2,y)*count(*) v, avg(y) my, avg(p1) m1, avg(p2) m2 FROM r),
w AS (SELECT (b*u-c*v)/(a*b-c*c) w1, (a*v-c*u)/(a*b-c*c) w2, my, m1, m2 FROM s)
SELECT prediction, round(weight,6) AS weight FROM (SELECT '' AS prediction, my-w1*m1-w2*m2 AS weight FROM w UNION ALL SELECT 'p1', greatest(w1,0) FROM w UNION ALL SELECT 'p2', greatest(w2,0) FROM w)""" % TARGET


@query("es03_stack", _STACK)
def es03(spark, d):
    df = rows(spark, d).select("y", F.col("l_quantity").alias("p1"), (10 * F.col("l_tax")).alias("p2"))
    m = M.stack(df, ["p1", "p2"], "y")
    return spark.createDataFrame([(p, round(w, 6)) for p, w in zip(["", *m.features], m.weights)], "prediction string, weight double")


@query("sp01_holdout", "SELECT split, n FROM (SELECT count(*) c FROM orders), LATERAL (SELECT 'calibration' AS split, CAST(ceil(c*0.1) AS BIGINT) AS n UNION ALL SELECT 'validation', CAST(ceil((c-ceil(c*0.1))*0.2/0.9) AS BIGINT) UNION ALL SELECT 'train', CAST(c-ceil(c*0.1)-ceil((c-ceil(c*0.1))*0.2/0.9) AS BIGINT))")
def sp01(spark, d):
    return E.holdout(table(spark, d, "orders"), "o_orderkey", 0.2, 0.1).groupBy("split").agg(F.count("*").alias("n"))


@query("sp02_era_holdout", "WITH e AS (SELECT DISTINCT year(o_orderdate) e FROM orders), r AS (SELECT e, row_number() OVER (ORDER BY e) n, count(*) OVER () a FROM e) SELECT o_orderkey, CASE WHEN n > a - greatest(1, ceil(a*0.2)) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN r ON year(o_orderdate) = e")
def sp02(spark, d):
    return E.era_holdout(table(spark, d, "orders").withColumn("era", F.year("o_orderdate")), "era", 0.2).select("o_orderkey", "split")


@query("sp03_folds", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY (o_orderkey*7919)%1009, o_orderkey)-1 AS INT) AS fold FROM orders")
def sp03(spark, d):
    return E.folds(table(spark, d, "orders"), "o_orderkey", 5, F.col("o_orderkey") * 7919 % 1009).select("o_orderkey", F.col("fold").cast("int").alias("fold"))


@query("sp04_time_series", "WITH n AS (SELECT count(*) n FROM events), i AS (SELECT unnest([0,1,2]) i) SELECT i AS split, CAST(n//4 + i*((n-n//4)//3) AS BIGINT) AS train_end, CAST(CASE WHEN i=2 THEN n ELSE n//4+(i+1)*((n-n//4)//3) END AS BIGINT) AS test_end FROM n, i")
def sp04(spark, d):
    n = table(spark, d, "events").count()
    return spark.createDataFrame([(i, a, c) for i, (a, _, c) in enumerate(E.time_series_splits(n, 3))], "split int, train_end long, test_end long")


@query("sp05_stratified", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey*7919)%1009, o_orderkey)-1)%5 AS INT) AS fold FROM orders")
def sp05(spark, d):
    return E.stratified_folds(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", 5, F.col("o_orderkey") * 7919 % 1009).select("o_orderkey", F.col("fold").cast("int").alias("fold"))


@query("sp06_group", "WITH g AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, CAST((row_number() OVER (ORDER BY (user_id*7919)%101, user_id)-1)%4 AS INT) fold FROM g) SELECT event_id, fold FROM events JOIN f USING (user_id)")
def sp06(spark, d):
    return E.group_folds(table(spark, d, "events"), "user_id", 4, F.col("user_id") * 7919 % 101).select("event_id", F.col("fold").cast("int").alias("fold"))


@query("sp07_bootstrap")
def sp07(spark, d):
    return E.bootstrap(table(spark, d, "orders"), "o_orderkey", 1).select("o_orderkey", "weight")


_SC = "(SELECT o_orderkey, CAST(o_orderstatus='F' AS INT) y, (o_orderkey*7919%997)/1000.0 + CASE WHEN o_orderstatus='F' THEN 0.001 ELSE 0 END p, year(o_orderdate) era FROM orders)"


def scores(spark, d):
    p = (F.col("o_orderkey") * 7919 % 997) / 1000 + F.when(F.col("o_orderstatus") == "F", 0.001).otherwise(0.0)
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), p.alias("p"), F.year("o_orderdate").alias("era"))


@query("me01_regression", f"SELECT round(avg((p-y)*(p-y)),6) AS mse, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(avg(abs(p-y)),6) AS mae, round(1-sum((p-y)*(p-y))/(var_pop(y)*count(*)),6) AS r2 FROM {_SC}")
def me01(spark, d):
    return scores(spark, d).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("p")).items()])


@query("me01_binary", f"WITH s AS (SELECT *, least(greatest(p,1e-15),1-1e-15) q, CAST(p>=0.5 AS INT) h FROM {_SC}) SELECT round(avg(-(y*ln(q)+(1-y)*ln(1-q))),6) AS log_loss, round(avg(CAST(h=y AS INT)),6) AS accuracy, round(2*sum(h*y)/(sum(h)+sum(y)),6) AS f1 FROM s")
def me01b(spark, d):
    return scores(spark, d).agg(*[r6(c).alias(n) for n, c in E.binary_metrics(F.col("y"), F.col("p")).items()])


@query("me02_auc", f"WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0 k FROM {_SC}) SELECT round((sum(k) FILTER (WHERE y=1) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y))),6) AS auc FROM r")
def me02(spark, d):
    return E.auc(scores(spark, d), "y", "p").select(r6("auc").alias("auc"))


@query("me03_rank_ic", f"WITH r AS (SELECT era, rank() OVER (PARTITION BY era ORDER BY y) + (count(*) OVER (PARTITION BY era, y)-1)/2.0 a, rank() OVER (PARTITION BY era ORDER BY p) + (count(*) OVER (PARTITION BY era, p)-1)/2.0 b FROM {_SC}), c AS (SELECT era, corr(a,b) ic, count(*) n FROM r GROUP BY 1) SELECT round(avg(ic),6) AS rank_ic, count(*) AS eras FROM c WHERE n >= 2 AND NOT isnan(ic)")
def me03(spark, d):
    return E.rank_ic(scores(spark, d), "y", "p", "era").select(r6("rank_ic").alias("rank_ic"), "eras")


_F1 = "WITH t AS (SELECT unnest(generate_series(1,99))/100.0 t), f AS (SELECT t, 2*sum(CAST({p}>=t AS INT)*{y})/greatest(sum(CAST({p}>=t AS INT))+sum({y}),1) f1 FROM {table}, t GROUP BY t) SELECT {label}t AS threshold, round(f1,6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1"


@query("me04_threshold", _F1.format(p="p", y="y", table=_SC, label=""))
def me04(spark, d):
    return E.threshold_sweep(scores(spark, d), "y", "p").select("threshold", r6("f1").alias("f1"))


@query("me04_labels", " UNION ALL ".join(f"SELECT * FROM ({_F1.format(p=p, y=y, table=_SC.replace('year(o_orderdate) era', '1-CAST(o_orderstatus=' + chr(39) + 'F' + chr(39) + ' AS INT) z'), label=repr(y) + ' AS label, ')})" for y, p in (("y", "p"), ("z", "(1-p)"))))
def me04b(spark, d):
    df = scores(spark, d).withColumns({"z": 1 - F.col("y"), "q": 1 - F.col("p")})
    return E.label_thresholds(df, [("y", "p"), ("z", "q")]).withColumn("f1", r6("f1"))


@query("me01_multiclass", "WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END k, [1.0+o_orderkey%3, 2.0, 1.0+o_custkey%2] p FROM orders) SELECT round(avg(-ln(p[k]/list_sum(p))),6) AS log_loss FROM s")
def me01c(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").agg(r6(E.multiclass_log_loss(label, [1.0 + F.col("o_orderkey") % 3, F.lit(2.0), 1.0 + F.col("o_custkey") % 2])).alias("log_loss"))


_CUT = "timestamp '1995-06-17'"


def halves(spark, d):
    df = line(spark, d)
    return df.where(F.col("l_shipdate") < F.expr(_CUT)), df.where(F.col("l_shipdate") >= F.expr(_CUT))


def _shares(joint: bool) -> str:
    of = "true" if joint else "side = 0"
    return f"""WITH a AS (SELECT l_extendedprice x, CAST(l_shipdate >= {_CUT} AS INT) side FROM lineitem), s AS (SELECT min(x) lo, (max(x)-min(x))/10 w FROM a WHERE {of}),
c AS (SELECT CAST(greatest(0, least(9, floor((x-lo)/w))) AS INT) bin, sum(1-side) a, sum(side) b FROM a, s GROUP BY 1),
f AS (SELECT i bin, coalesce(a,0) a, coalesce(b,0) b FROM range(10) r(i) LEFT JOIN c ON i = bin), z AS (SELECT bin, a/sum(a) OVER () p, b/sum(b) OVER () q FROM f)"""


@query("mo01_psi", _shares(False) + " SELECT round(sum(least((greatest(q,1e-10)-greatest(p,1e-10))*ln(greatest(q,1e-10)/greatest(p,1e-10)),1.0)),6) AS psi FROM z")
def mo01(spark, d):
    return D.psi(*halves(spark, d), "l_extendedprice").select(r6("psi").alias("psi"))


@query("mo02_ks", f"WITH c AS (SELECT l_extendedprice x, sum(CAST(l_shipdate < {_CUT} AS INT)) a, sum(CAST(l_shipdate >= {_CUT} AS INT)) b FROM lineitem GROUP BY 1), g AS (SELECT abs(sum(a) OVER (ORDER BY x)/sum(a) OVER () - sum(b) OVER (ORDER BY x)/sum(b) OVER ()) g FROM c) SELECT round(max(g),6) AS ks FROM g")
def mo02(spark, d):
    return D.ks(*halves(spark, d), "l_extendedprice").select(r6("ks").alias("ks"))


@query("mo03_jsd", _shares(True) + " SELECT round(sum(CASE WHEN p>0 THEN p*ln(2*p/(p+q)) ELSE 0 END + CASE WHEN q>0 THEN q*ln(2*q/(p+q)) ELSE 0 END)/2,6) AS jsd FROM z")
def mo03(spark, d):
    return D.jsd(*halves(spark, d), "l_extendedprice").select(r6("jsd").alias("jsd"))


def _gate() -> str:
    levels = " UNION ALL ".join(f"SELECT '{f}' AS feature, (SELECT psi FROM ({_shares(False).replace('l_extendedprice', f)} SELECT sum(least((greatest(q,1e-10)-greatest(p,1e-10))*ln(greatest(q,1e-10)/greatest(p,1e-10)),1.0)) AS psi FROM z)) AS psi" for f in FEATURES)
    return f"""WITH l AS ({levels}), n AS (SELECT sqrt(count(*)*1.0/count(*) FILTER (WHERE l_shipdate >= {_CUT})) room FROM lineitem),
v AS (SELECT feature, CASE WHEN psi >= 0.25*room THEN 'critical' WHEN psi >= 0.1*room THEN 'warning' ELSE 'none' END AS level FROM l, n), s AS (SELECT avg(CAST(level = 'critical' AS INT)) s FROM v)
SELECT feature, level, CASE WHEN s >= 0.5 THEN 'retrain' WHEN s > 0.1 THEN 'update_with_care' ELSE 'update' END AS recommendation FROM v, s"""


@query("mo05_gate", _gate())
def mo05(spark, d):
    a, b = halves(spark, d)
    rule, n, m = D.DriftRule(), a.count(), b.count()
    levels = {f: rule.level(D.psi(a, b, f).first()[0], n, m) for f in FEATURES}
    return spark.createDataFrame([(f, v, rule.recommend(levels)) for f, v in levels.items()], "feature string, level string, recommendation string")


@query("mo06_trend", "WITH e AS (SELECT year(o_orderdate) AS x, avg(o_totalprice)/1e5 cv, avg(o_totalprice)/1e5 + 0.01*(year(o_orderdate)-1990) ho FROM orders GROUP BY 1) SELECT round(avg(ho-cv),6) AS gap, round(regr_slope(ho-cv, x),6) AS slope, 'worsening' AS trend FROM e")
def mo06(spark, d):
    by = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("x")).agg((F.avg("o_totalprice") / 1e5).alias("cv"))
    out = D.gap_trend(by.withColumn("ho", F.col("cv") + 0.01 * (F.col("x") - 1990)), "cv", "ho", "x")
    return out.select(r6("gap").alias("gap"), r6("slope").alias("slope"), "trend")


SPACE = [U.Parameter("rate", 0.1, 0.9), U.Parameter("depth", 2, 4, whole=True)]


def tuned_model(rounds: int = 2):
    return U.tree_model(FEATURES, "y", "key", T.TreeConfig(rounds=rounds, leaves=8, bins=16))


@query("tu03_zoom")
def tu03(spark, d):
    """Two rounds of trials, the second around the first's best, by holdout error."""
    df = rows(spark, d).select("key", "y", *FEATURES).cache()
    log = U.tune(df, "key", "y", tuned_model(), SPACE, U.TunerConfig(steps=2, points=2))
    df.unpersist()
    return log.frame(spark).withColumn("value", r6("value"))


@query("au01_auto")
def au01(spark, d):
    """Profile, plan, probe the three modes on a holdout, and score with the best."""
    df = rows(spark, d).select("key", "y", *FEATURES, "l_returnflag", "l_shipdate").cache()
    model = A.build(df, "y", "key", A.AutoConfig(tree=T.TreeConfig(rounds=3, rate=0.5, depth=3, leaves=8, bins=32)))
    out = model.predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])
    return out.withColumns({"mode": F.lit(model.model.mode), "task": F.lit(model.task), "derived": F.lit(len([f for f in model.encoding.features if f.name not in df.columns]))})
