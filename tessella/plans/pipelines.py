"""Frozen pipelines, streams, ensembles and what else works on whole tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tessella.operators import auto as A
from tessella.operators import cohorts as C
from tessella.operators import encoding as N
from tessella.operators import ensembles as B
from tessella.operators import evaluation as E
from tessella.operators import extend as X
from tessella.operators import linear as M
from tessella.operators import monitoring as D
from tessella.operators import pipeline as L
from tessella.operators import preprocess as P
from tessella.operators import profile as R
from tessella.operators import sketch as K
from tessella.operators import trees as T
from tessella.operators import tuning as U
from tessella.operators import windows as W
from tessella.operators.encoding import binned, boundaries
from tessella.plans.features import KEYS, LINE, line
from tessella.plans.models import _BINS, _CUT, _Q, FEATURES, TARGET, classed, rows
from tessella.plans.preparation import _KINDS
from tessella.plans.registry import query, r6
from tessella.sources import models as S
from tessella.sources.tables import csv, shared_folder, table
from tessella.streaming.incremental import IncrementalCounts, IncrementalScaler, run

CFG = T.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=32)


@query("io05_bins_at_inference", "WITH q AS (SELECT list_distinct(quantile_cont(p_retailprice,[1/8.0,2/8.0,3/8.0,4/8.0,5/8.0,6/8.0,7/8.0])) b FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, CAST(len(list_filter(b, lambda x: x <= p_retailprice)) AS INT) AS bin_p_retailprice FROM part, q WHERE p_partkey % 2 = 1")
def io05(spark, d):
    df = table(spark, d, "part").withColumn("y", F.col("p_size").cast("double"))
    p = L.Pipeline("y", L.PipelineConfig(bins=8, exact=True)).fit(df.where("p_partkey % 2 = 0"), ["p_retailprice"])
    return L.Pipeline.from_json(p.to_json()).transform(df.where("p_partkey % 2 = 1"), ["p_partkey"])


@query("io06_training_pipeline", "WITH m AS (SELECT avg(p_size) m FROM part), g AS (SELECT p_brand, count(*) n, sum(p_size) s FROM part GROUP BY 1) SELECT p_partkey, round((s+10*m)/(n+10),6) AS p_brand FROM part JOIN g USING (p_brand), m")
def io06(spark, d):
    df = table(spark, d, "part").withColumn("y", F.col("p_size").cast("double"))
    p = L.Pipeline("y", L.PipelineConfig(least_count=1)).fit(df, ["p_brand"])
    return p.encode(df, ["p_partkey"]).select("p_partkey", r6("p_brand").alias("p_brand"))


@query("io06_rare_and_missing", """WITH n AS (SELECT p_size, count(*) n FROM part GROUP BY 1), r AS (SELECT p_partkey, CASE WHEN n >= 40 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END c, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END x, p_retailprice y FROM part JOIN n USING (p_size)),
m AS (SELECT avg(y) m, quantile_disc(x, 0.5) h FROM r), g AS (SELECT c, count(*) n, sum(y) s FROM r GROUP BY 1) SELECT p_partkey, round((s+10*m)/(n+10),4) AS size, round(coalesce(x,h),4) AS price FROM r JOIN g USING (c), m""")
def io06b(spark, d):
    """Sizes of fewer than 40 parts are one category, and missing prices the median."""
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), F.col("p_retailprice").alias("y"))
    out = L.Pipeline("y", L.PipelineConfig(least_count=40)).fit(df, ["size", "price"]).encode(df, ["p_partkey"])
    return out.withColumns({"size": F.round("size", 4), "price": F.round("price", 4)})


@query("pp02_forget", "WITH a AS (SELECT avg(l_tax) m, var_pop(l_tax) v FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT avg(l_tax) m, var_pop(l_tax) v FROM lineitem WHERE l_linenumber > 3) SELECT round(0.7*a.m+0.3*b.m,6) AS mean, round(0.7*a.v+0.3*b.v,9) AS variance FROM a, b")
def pp02b(spark, d):
    """A scaler that moves three tenths of the way to a newer batch."""
    df = line(spark, d)
    old, new = (P.StandardScaler(["l_tax"]).fit(df.where(c)) for c in ("l_linenumber <= 3", "l_linenumber > 3"))
    p = old.forget(new, 0.3).params["l_tax"]
    return spark.createDataFrame([(round(p["mean"], 6), round(p["m2"] / p["n"], 9))], "mean double, variance double")


@query("io04_eras", "WITH e AS (SELECT year(o_orderdate) y, min(o_orderkey) a FROM orders GROUP BY 1) SELECT CAST(y AS INT) AS y, CAST(row_number() OVER (ORDER BY a)-1 AS INT) AS era FROM e")
def io04(spark, d):
    return L.eras(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "y", "o_orderkey").select("y", F.col("era").cast("int").alias("era"))


@query("io02_csv", "SELECT n_nationkey, n_name FROM nation")
def io02(spark, d):
    """The nations written as CSV to the shared folder and read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "nation").write.csv(path, header=True)
    return csv(spark, path).select("n_nationkey", "n_name")


@query("pr01_drop", "SELECT r_regionkey FROM region")
def pr01(spark, d):
    return L.drop_columns(table(spark, d, "region"), ["r_name", "no such column"])


@query("pr02_ordered_select", "SELECT n_regionkey, n_nationkey FROM nation")
def pr02(spark, d):
    return L.ordered_select(table(spark, d, "nation"), ["n_regionkey", "n_nationkey"])


_USEFUL = _KINDS.replace(" UNION ALL SELECT 'o_totalprice' AS c, count(*) n, count(DISTINCT o_totalprice) u, NULL l, True AS num FROM orders", "") + " UNION ALL SELECT 'same', count(*), 1, NULL, true FROM orders"


@query("pr04_useful_columns", f"SELECT c AS feature FROM ({_USEFUL}) WHERE u > 1 AND NOT (n > 10 AND u >= 0.85*n AND (c LIKE '%id' OR c LIKE '%key')) AND (num OR NOT ((u > 100 AND l > 20) OR (u > 0.9*n AND u > 50 AND l > 15)))")
def pr04(spark, d):
    df = table(spark, d, "orders").withColumn("same", F.lit(1))
    return spark.createDataFrame([(c,) for c in L.useful_columns(df, "o_totalprice")], "feature string")


@query("ag05_row_id", """WITH h AS (SELECT event_id-(SELECT min(event_id) FROM events)+1 AS row_id, user_id, value FROM events ORDER BY event_id LIMIT 1000), n AS (SELECT *, row_number() OVER (ORDER BY row_id) n FROM h),
d AS (SELECT unnest(['row_id','user_id','value']) AS c, unnest([row_id-n, user_id-n, value-n]) AS d FROM n)
SELECT c AS "column", min(d) = max(d) AND min(d) IN (-1, 0) AND count(d) > 10 AS is_row_id, c <> 'value' AS id_name FROM d GROUP BY c""")
def ag05(spark, d):
    """Of three numeric columns the one that counts rows, and those called like ids."""
    events = table(spark, d, "events")
    first = events.agg(F.min("event_id")).first()[0]
    return L.row_ids(events.select((F.col("event_id") - first + 1).alias("row_id"), "user_id", "value", "event_id"), ["row_id", "user_id", "value"], "event_id")


@query("ag11_monotonicity", """WITH p AS (SELECT sign(b.s_nationkey-a.s_nationkey) s FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal WHERE a.s_nationkey <> b.s_nationkey)
SELECT round(abs(sum(s))/count(*),6) AS monotonicity FROM p""")
def ag11(spark, d):
    """Over all pairs of suppliers."""
    return L.monotonicity(table(spark, d, "supplier"), "s_acctbal", "s_nationkey").select(r6("monotonicity").alias("monotonicity"))


@query("ag12_discrete_target", "SELECT count(DISTINCT floor(p_retailprice*1000)) <= 20 AS is_discrete, count(DISTINCT floor(p_retailprice*1000)) AS n FROM part")
def ag12(spark, d):
    return R.discrete_target(table(spark, d, "part"), "p_retailprice")


@query("sc14_target_transform", """SELECT 'l_discount' AS target, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 'logit' AS transform FROM lineitem HAVING min(l_discount) >= 0 AND max(l_discount) <= 1
UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal), 'none' FROM customer HAVING min(c_acctbal) < 0""")
def sc14b(spark, d):
    found = [R.target_transform(table(spark, d, t), c).select(F.lit(c).alias("target"), "low", "high", "transform") for t, c in (("lineitem", "l_discount"), ("customer", "c_acctbal"))]
    return found[0].unionByName(found[1])


@query("pp09_detect", "WITH q AS (SELECT quantile_cont(o_totalprice,0.25) a, quantile_cont(o_totalprice,0.75) b FROM orders) SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice AS value FROM orders, q WHERE o_totalprice < a-0.4*(b-a) OR o_totalprice > b+0.4*(b-a)")
def pp09(spark, d):
    df = table(spark, d, "orders")
    return P.Outliers(["o_totalprice"], threshold=0.4).fit(df).detect(df, "o_orderkey")


@query("en01_unknown", "WITH f AS (SELECT o_orderpriority p, count(*) n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) SELECT o_orderkey, coalesce(n, -1)::DOUBLE AS freq FROM orders LEFT JOIN f ON p = o_orderpriority")
def en01b(spark, d):
    df = table(spark, d, "orders")
    return N.frequency_encode(df, "o_orderpriority", N.frequency(df.where("o_orderpriority <> '1-URGENT'"), "o_orderpriority"), "freq", -1.0).select("o_orderkey", "freq")


@query("en07_label_index", "WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand)-1 AS i FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 5 AND p_brand <> 'Brand#11')) SELECT p_partkey, CAST(coalesce(i, (SELECT count(*) FROM k)) AS BIGINT) AS label FROM part LEFT JOIN k USING (p_brand)")
def en07(spark, d):
    df = table(spark, d, "part")
    common = df.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 5 and p_brand <> 'Brand#11'")
    return N.label_index(df, "p_brand", N.labels(common, "p_brand"), "label").select("p_partkey", "label")


@query("xs04_selective", "SELECT o_orderkey, round(CASE WHEN stddev_samp(o_totalprice) OVER w > 0 THEN (o_totalprice-avg(o_totalprice) OVER w)/stddev_samp(o_totalprice) OVER w ELSE 0 END,6) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def xs04(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return W.cross_sectional(df, "o_orderpriority", exclude=("o_orderkey", "o_custkey")).select("o_orderkey", r6("o_totalprice_zscore").alias("z"))


@query("ln01_ridge_penalised", "SELECT round(avg(y)-b*avg(l_quantity),4) AS intercept, round(b,4) AS slope FROM (SELECT 3*l_quantity+l_tax AS y, l_quantity FROM lineitem), (SELECT regr_slope(3*l_quantity+l_tax, l_quantity)/(1+5000.0/count(*)) b FROM lineitem) GROUP BY b")
def ln01_penalised(spark, d):
    m = M.fit_linear(line(spark, d).withColumn("y", 3 * F.col("l_quantity") + F.col("l_tax")), ["l_quantity"], "y", lam=5000.0)
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.weights[1], 4))], "intercept double, slope double")


@query("so02_top_features")
def so02(spark, d):
    df = rows(spark, d)
    return T.train_gbdt(df, FEATURES, "y", "key", CFG).top_features(df, 2).withColumn("attribution", r6("attribution"))


@query("tr05_noise_pruned")
def tr05_noise(spark, d):
    """Trees of one half of the years pruned by the other half."""
    df = rows(spark, d).withColumn("era", F.year("l_shipdate"))
    model = T.train_gbdt(df.where("era < 1995"), FEATURES, "y", "key", T.TreeConfig(rounds=2, rate=0.5, depth=5, leaves=31, bins=32))
    pruned = T.noise_pruned(model, df.where("era >= 1995"), "y")
    leaves = lambda m: sum(n.left < 0 for t in m.trees for n in t)
    return spark.createDataFrame([(leaves(model), sum(n.left >= 0 for t in pruned.trees for n in t))], "leaves long, splits_kept long")


@query("ag15_mode", "SELECT b AS value, n FROM (SELECT min(l_discount) b, count(*) n, round(l_discount,2) k FROM lineitem GROUP BY k ORDER BY n DESC, k LIMIT 1)")
def ag15(spark, d):
    return line(spark, d).groupBy(F.round("l_discount", 2).alias("k")).agg(F.min("l_discount").alias("value"), F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).drop("k")


@query("ag19_sibling", f"SELECT CAST(floor(l_quantity/10) AS INT) AS bin, count(*) FILTER (WHERE l_tax > 0.04) AS n FROM lineitem GROUP BY 1")
def ag19(spark, d):
    """What a parent's bins hold less a child's is the other child's, read nowhere."""
    df, node = line(spark, d), F.lit(1).alias("node")
    bins = {"l_quantity": F.floor(F.col("l_quantity") / 10).cast("int")}
    parent, child = (T.collected(T.histogram(part, bins, F.lit(1.0), F.lit(1.0), node).collect())[1] for part in (df, df.where("l_tax <= 0.04")))
    other = T.sibling(parent, child)[0]
    return spark.createDataFrame([(b, int(n)) for b, (_, _, n) in other.items()], "bin int, n long")


@query("ag20_vector_histogram", "SELECT CAST(l_linenumber AS INT) AS bin, count(*) AS n, round(sum(l_tax),4) AS g0, round(sum(l_discount),4) AS g1 FROM lineitem GROUP BY 1")
def ag20(spark, d):
    h = B.vector_histogram(line(spark, d), {"l_linenumber": F.col("l_linenumber")}, [F.col("l_tax"), F.col("l_discount")], [F.lit(1.0)] * 2, F.lit(0))
    return h.select("bin", "n", F.round("g0", 4).alias("g0"), F.round("g1", 4).alias("g1"))


_CM = K.CountMin(0.2, 0.9)


@query("ag24_count_sketch", f"""WITH v AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT o_custkey, r, ('0x'||substr(md5(r||':'||o_custkey),1,12))::BIGINT % {_CM.width} AS slot FROM v, range({_CM.depth}) t(r)),
n AS (SELECT s.r, s.slot, count(*) AS n FROM orders JOIN s USING (o_custkey) GROUP BY 1,2), h AS (SELECT r, slot, n + n//2 AS n FROM n) SELECT o_custkey, CAST(min(h.n) AS BIGINT) AS estimate FROM s JOIN h ON s.r = h.r AND s.slot = h.slot GROUP BY 1""")
def ag24(spark, d):
    """Estimates from a sketch merged with its own half."""
    df = table(spark, d, "orders")
    sketch = _CM.add(df, "o_custkey")
    return _CM.estimate(_CM.merge(sketch, _CM.halve(sketch)), df, "o_custkey")


@query("bo03_multilabel")
def bo03(spark, d):
    df = rows(spark, d).withColumns({"a": (F.col("y") > 20).cast("double"), "b": (F.col("l_tax") > 0.04).cast("double")})
    out = B.predict_multilabel(df, B.train_multilabel(df, FEATURES, ["a", "b"], CFG), ["a", "b"])
    return out.agg(*[r6(F.avg(((F.col(f"p_{y}") >= 0.5).cast("int") == F.col(y)).cast("double"))).alias(f"accuracy_{y}") for y in "ab"])


@query("bo05_early_stop")
def bo05(spark, d):
    """The held-out loss after each round, and whether the round was kept."""
    cfg = T.TreeConfig(rounds=6, rate=1.0, depth=3, leaves=8, bins=32, loss="log_loss", validation=0.2, patience=1)
    seen = []
    model = T.train_gbdt(rows(spark, d).withColumn("b", (F.col("y") > 25).cast("double")), FEATURES, "b", "key", cfg, on_round=lambda r, v: seen.append((r, v)))
    return spark.createDataFrame([(r, round(v, 6), r < len(model.trees)) for r, v in seen], "round int, loss double, kept boolean")


@query("bo04_external_validation")
def bo04(spark, d):
    """Trained on the earlier half by splits that hold in every year, stopped by the later half."""
    df = rows(spark, d).withColumn("era", F.year("l_shipdate"))
    cfg = T.TreeConfig(rounds=4, rate=0.5, depth=3, leaves=8, bins=16, patience=2)
    model = T.train_gbdt(df.where("era < 1995"), FEATURES, "y", "key", cfg, validation=df.where("era >= 1995"), era="era")
    out = model.predict(df.where("era >= 1995"))
    return out.agg(F.lit(len(model.trees)).alias("trees"), r6(E.regression_metrics(F.col("y"), F.col("prediction"))["r2"]).alias("r2"))


@query("un02_multilabel_linear")
def un02(spark, d):
    df = rows(spark, d).withColumns({"a": (F.col("y") > 20).cast("double"), "b": (F.col("l_tax") > 0.04).cast("double")})
    out = B.predict_multilabel_linear(df, B.train_multilabel_linear(df, FEATURES, ["a", "b"], CFG), ["a", "b"])
    return out.agg(*[r6(F.avg(((F.col(f"p_{y}") >= 0.5).cast("int") == F.col(y)).cast("double"))).alias(f"accuracy_{y}") for y in "ab"])


@query("bo08_conformal_level", """WITH r AS (SELECT abs(o_totalprice-150000) r FROM orders), n AS (SELECT count(*) n FROM r), q AS (SELECT r AS level FROM (SELECT r, row_number() OVER (ORDER BY r) k FROM r), n WHERE k = least(n, ceil(0.9*(n+1)-1e-9)))
SELECT round(level,4) AS level, round(avg(CAST(r <= level AS INT)),6) AS coverage FROM r, q GROUP BY level""")
def bo08(spark, d):
    r = F.abs(F.col("o_totalprice") - 150000)
    df = table(spark, d, "orders")
    level = U.conformal_level(df, r, 0.9)
    return df.agg(F.round(F.lit(level), 4).alias("level"), r6(F.avg((r <= level).cast("double"))).alias("coverage"))


@query("mo04_bin_detector", """WITH c AS (SELECT CAST(l_shipdate >= timestamp '1995-06-17' AS INT) side, unnest(['line','tens']) AS feature, unnest([l_linenumber, CAST(floor(l_quantity/10) AS INT)]) AS bin FROM lineitem),
k AS (SELECT feature, bin, count(*) FILTER (WHERE side=0) a, count(*) FILTER (WHERE side=1) b FROM c GROUP BY 1,2), p AS (SELECT feature, b, greatest(a/sum(a) OVER w, 1e-10) p, greatest(b/sum(b) OVER w, 1e-10) q, sum(a) OVER w n FROM k WINDOW w AS (PARTITION BY feature)),
s AS (SELECT feature, sum(least((q-p)*ln(q/p), 1.0)) psi, 0.1*sqrt((max(n)+sum(b))/sum(b)) AS lim FROM p GROUP BY 1) SELECT feature, round(psi,6) AS psi, round(lim,6) AS "limit", psi > lim AS shifted FROM s""")
def mo04(spark, d):
    df = line(spark, d).select("l_shipdate", F.col("l_linenumber").alias("line"), F.floor(F.col("l_quantity") / 10).cast("int").alias("tens"))
    detector = D.BinDetector.fit(df.where(F.col("l_shipdate") < F.expr(_CUT)), ["line", "tens"])
    out = detector.check(df.where(F.col("l_shipdate") >= F.expr(_CUT)))
    return out.withColumns({"psi": r6("psi"), "limit": r6("limit")})


@query("bo01_stump", _BINS.replace("quantile_cont", "quantile_disc") + """, h AS (SELECT feature, bin, sum(g) g, count(*) n FROM long GROUP BY 1,2),
s AS (SELECT feature, bin, sum(g) OVER r gl, sum(n) OVER r nl, sum(g) OVER p gt, sum(n) OVER p nt FROM h WINDOW p AS (PARTITION BY feature), r AS (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, 0.5*(gl*gl/(nl+1)+(gt-gl)*(gt-gl)/(nt-nl+1)-gt*gt/(nt+1)) gain FROM s WHERE nl >= 1 AND nt > nl)
SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(-gl/(nl+1)*0.5,6) AS left_value, round(-(gt-gl)/(nt-nl+1)*0.5,6) AS right_value, CAST(nl AS BIGINT) AS left_rows FROM x ORDER BY gain DESC, feature, bin LIMIT 1""")
def bo01_stump(spark, d):
    """A boosted round of one split."""
    model = T.train_gbdt(rows(spark, d), FEATURES, "y", "key", T.TreeConfig(rounds=1, rate=0.5, depth=1, leaves=2, bins=8))
    top, left, right = model.trees[0]
    return spark.createDataFrame([(top.feature, top.bin, round(left.value, 6), round(right.value, 6), left.rows)], "feature int, bin int, left_value double, right_value double, left_rows long")


STUMP = T.TreeConfig(rounds=1, rate=0.5, depth=1, leaves=2, bins=8)
#: Bin 0 may go either way: ``low`` is the first bin that goes left.
_BEST_STUMP = """h AS (SELECT k, feature, bin, sum(g) g, sum(h) h, count(*) n FROM long GROUP BY 1,2,3),
s AS (SELECT k, feature, bin, sum(g) OVER r gl, sum(h) OVER r hl, sum(n) OVER r nl, sum(g) OVER p gt, sum(h) OVER p ht, sum(n) OVER p nt, sum(CASE WHEN bin=0 THEN g ELSE 0 END) OVER p g0, sum(CASE WHEN bin=0 THEN h ELSE 0 END) OVER p h0, sum(CASE WHEN bin=0 THEN n ELSE 0 END) OVER p n0
FROM h WINDOW p AS (PARTITION BY k, feature), r AS (PARTITION BY k, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT k, feature, bin, 0 AS low, gl, hl, nl, gt, ht, nt FROM s UNION ALL SELECT k, feature, bin, 1, gl-g0, hl-h0, nl-n0, gt, ht, nt FROM s WHERE bin > 0 AND n0 > 0),
x AS (SELECT *, 0.5*(gl*gl/(hl+1)+(gt-gl)*(gt-gl)/(ht-hl+1)-gt*gt/(ht+1)) gain FROM d WHERE nl >= 1 AND nt > nl AND hl >= 1 AND ht-hl >= 1),
best AS (SELECT k, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, low, -gl/(hl+1)*0.5 lv, -(gt-gl)/(ht-hl+1)*0.5 rv, CAST(nl AS BIGINT) AS left_rows FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gain,7) DESC, feature, low, bin) = 1)"""
_STUMP_ROWS = f"""WITH b AS (SELECT {', '.join(f"list_distinct(quantile_disc({f}, [{_Q}])) b{i}" for i, f in enumerate(FEATURES))} FROM lineitem),
r AS (SELECT {TARGET} AS y, l_orderkey % 3 AS fold, year(l_shipdate) AS era, {', '.join(f"len(list_filter(b{i}, lambda x: x <= {f})) f{i}" for i, f in enumerate(FEATURES))} FROM lineitem, b)"""
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT k, {i} AS feature, f{i} AS bin, g, h FROM t" for i in range(3)) + ")"
_LEAF = "CASE WHEN (CASE feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) BETWEEN low AND bin THEN lv ELSE rv END"
_FOLD_STUMPS = f"""{_STUMP_ROWS}, m AS (SELECT k, avg(y) m FROM r, range(3) i(k) WHERE fold <> k GROUP BY k),
t AS (SELECT k, m-y AS g, 1.0 AS h, f0, f1, f2 FROM r JOIN m ON fold <> k), {_LONG}, {_BEST_STUMP},
e AS (SELECT k, sqrt(avg((y-m-{_LEAF})*(y-m-{_LEAF}))) AS rmse FROM r JOIN best ON fold = k JOIN m USING (k) GROUP BY k)"""


@query("tu04_fold_stumps", _FOLD_STUMPS + " SELECT CAST(k AS INT) AS fold, feature, bin, round(lv,6) AS left_value, round(rv,6) AS right_value, left_rows, round(rmse,6) AS rmse FROM best JOIN e USING (k)")
def tu04b(spark, d):
    """A stump for each of three folds from one pass over one binned table, and its error on the fold."""
    df = rows(spark, d)
    out, models = C.cross_validated(df, FEATURES, "y", "key", [STUMP], 3, F.col("l_orderkey") % 3)
    found = [(k, top.feature, top.bin, round(left.value, 6), round(right.value, 6), left.rows) for k, (top, left, right) in enumerate(m.trees[0] for m in models[0])]
    trees = spark.createDataFrame(found, "fold int, feature int, bin int, left_value double, right_value double, left_rows long")
    errors = out.groupBy("fold").agg(r6(E.regression_metrics(F.col("y"), F.col("p_0"))["rmse"]).alias("rmse"))
    return trees.join(errors, "fold")


@query("es01_stump_predictions", _FOLD_STUMPS + f" SELECT round(avg(y-m-{_LEAF}),6) AS bias, round(corr(y, m+{_LEAF}),6) AS correlation, count(*) AS n FROM r JOIN best ON fold = k JOIN m USING (k)")
def es01b(spark, d):
    """Out-of-fold predictions of one-split models, summed up."""
    out = B.out_of_fold(rows(spark, d), FEATURES, "y", "key", STUMP, [1], 3, F.col("l_orderkey") % 3, share=1.0)
    return out.agg(r6(F.avg(F.col("y") - F.col("oof_1"))).alias("bias"), r6(F.corr("y", "oof_1")).alias("correlation"), F.count("*").alias("n"))


_CLASS_STUMPS = f"""{_STUMP_ROWS}, c AS (SELECT *, CASE WHEN y < 15 THEN 0 WHEN y < 30 THEN 1 ELSE 2 END AS c FROM r),
m AS (SELECT k, avg(CAST(c = k AS INT)) p FROM c, range(3) i(k) GROUP BY k), t AS (SELECT k, p-CAST(c = k AS INT) AS g, p*(1-p) AS h, f0, f1, f2 FROM c, m), {_LONG}, {_BEST_STUMP}"""


@query("bo02_stumps", _CLASS_STUMPS + " SELECT CAST(k AS INT) AS class, feature, bin, round(lv,6) AS left_value, round(rv,6) AS right_value, left_rows FROM best")
def bo02b(spark, d):
    """One round of one split for each of three classes."""
    model = C.train_multiclass(classed(spark, d), FEATURES, "c", "key", 3, STUMP)
    found = [(k, top.feature, top.bin, round(left.value, 6), round(right.value, 6), left.rows) for k, (top, left, right) in enumerate(m.trees[0] for m in model.models)]
    return spark.createDataFrame(found, "class int, feature int, bin int, left_value double, right_value double, left_rows long")


@query("bo02_probabilities", _CLASS_STUMPS + f""",
v AS (SELECT c.c, list(ln(p)+{_LEAF} ORDER BY k) AS l FROM (SELECT *, row_number() OVER () AS id FROM c) c, m JOIN best USING (k) GROUP BY id, c.c)
SELECT round(avg(-(l[c+1] - ln(exp(l[1])+exp(l[2])+exp(l[3])))),6) AS log_loss, round(avg(CAST(list_position(l, list_max(l)) = c+1 AS INT)),6) AS accuracy FROM v""")
def bo02c(spark, d):
    """Loss and accuracy of the classes' probabilities after that round."""
    df = classed(spark, d)
    model = C.train_multiclass(df, FEATURES, "c", "key", 3, STUMP)
    out = model.predict_class(model.predict_proba(df))
    return out.agg(r6(E.multiclass_log_loss(F.col("c"), [F.col(f"p_{k}") for k in range(3)])).alias("log_loss"), r6(F.avg((F.col("predicted") == F.col("c")).cast("double"))).alias("accuracy"))


_BINARY_STUMP = f"""{_STUMP_ROWS}, c AS (SELECT *, CAST(y > 25 AS INT) c FROM r), m AS (SELECT 0 AS k, avg(c) p FROM c), t AS (SELECT k, p-c AS g, p*(1-p) AS h, f0, f1, f2 FROM c, m), {_LONG}, {_BEST_STUMP},
q AS (SELECT c, 1/(1+exp(-(ln(p/(1-p))+{_LEAF}))) AS q FROM c, m JOIN best USING (k))"""


@query("bo06_binary_stump", _BINARY_STUMP + " SELECT round(avg(-(c*ln(q)+(1-c)*ln(1-q))),6) AS log_loss, round(avg(CAST((q >= 0.5) = (c = 1) AS INT)),6) AS accuracy, round(coalesce(2.0*sum(CASE WHEN q >= 0.5 THEN c ELSE 0 END)/nullif(sum(CAST(q >= 0.5 AS INT))+sum(c),0),0),6) AS f1 FROM q")
def bo06b(spark, d):
    """One split of a two-class model by log-loss, and what its probabilities are worth."""
    df = rows(spark, d).withColumn("b", (F.col("y") > 25).cast("double"))
    out = T.train_gbdt(df, FEATURES, "b", "key", replace(STUMP, loss="log_loss")).predict(df)
    return out.agg(*[r6(c).alias(n) for n, c in E.binary_metrics(F.col("b"), F.col("prediction")).items()])


_SHARES = f"""{_STUMP_ROWS}, m AS (SELECT 0 AS k, avg(y) m FROM r), t AS (SELECT k, m-y AS g, 1.0 AS h, f0, f1, f2 FROM r, m), {_LONG}, {_BEST_STUMP},
w AS (SELECT feature, {_LEAF} AS v FROM r, best), a AS (SELECT feature, avg(abs(v-mean)) AS a FROM w, (SELECT avg(v) AS mean FROM w) GROUP BY feature)"""


@query("bo09_stump_attributions", _SHARES + " SELECT " + ", ".join(f"round(CASE WHEN feature = {i} THEN a ELSE 0 END,6) AS attr_{f}" for i, f in enumerate(FEATURES)) + " FROM a")
def bo09b(spark, d):
    """What each feature's split moves predictions by, on average."""
    df = rows(spark, d)
    out = T.train_gbdt(df, FEATURES, "y", "key", STUMP).attributions(df)
    return out.agg(*[r6(F.avg(F.abs(f"attr_{f}"))).alias(f"attr_{f}") for f in FEATURES])


@query("so02_stump_features", _SHARES + f" SELECT name AS feature, round(CASE WHEN feature = i THEN a ELSE 0 END,6) AS attribution FROM a, (VALUES {', '.join(f'({i}, {f!r})' for i, f in enumerate(FEATURES))}) n(i, name) ORDER BY 2 DESC, 1 LIMIT 2")
def so02b(spark, d):
    """The two features that move predictions most."""
    df = rows(spark, d)
    return T.train_gbdt(df, FEATURES, "y", "key", STUMP).top_features(df, 2).withColumn("attribution", r6("attribution"))


_LABEL_STUMP = f"""{_STUMP_ROWS}, m AS (SELECT 0 AS k, avg(CAST(y > 20 AS INT)) p FROM r UNION ALL SELECT 1, avg(CAST(f2 > 4 AND y < 30 AS INT)) FROM r),
t AS (SELECT k, p-CAST(CASE k WHEN 0 THEN y > 20 ELSE f2 > 4 AND y < 30 END AS INT) AS g, p*(1-p) AS h, f0, f1, f2 FROM r, m), {_LONG}, {_BEST_STUMP},
w AS (SELECT feature, bin, low FROM d WHERE nl >= 1 AND nt > nl GROUP BY 1,2,3 ORDER BY round(sum(gl*gl/(hl+1)+(gt-gl)*(gt-gl)/(ht-hl+1)-gt*gt/(ht+1)),7) DESC, feature, low, bin LIMIT 1)"""


@query("bo03_vector_stump", _LABEL_STUMP + " SELECT CAST(k AS INT) AS label, CAST(d.feature AS INT) AS feature, CAST(d.bin AS INT) AS bin, d.low = 0 AS missing_left, round(-gl/(hl+1)*0.5,6) AS left_value, round(-(gt-gl)/(ht-hl+1)*0.5,6) AS right_value FROM d JOIN w USING (feature, bin, low)")
def bo03b(spark, d):
    """One split of a tree for two labels, by the sum of their gains."""
    bounded = rows(spark, d)
    cut = boundaries(bounded, ["l_tax"], 8)["l_tax"]
    df = bounded.withColumns({"u": (F.col("y") > 20).cast("double"), "v": ((binned(F.col("l_tax"), cut) > 4) & (F.col("y") < 30)).cast("double")})
    (top, _), (_, left), (_, right) = B.train_multilabel(df, FEATURES, ["u", "v"], STUMP)[2][0]
    found = [(k, top.feature, top.bin, top.missing_left, round(left[k], 6), round(right[k], 6)) for k in (0, 1)]
    return spark.createDataFrame(found, "label int, feature int, bin int, missing_left boolean, left_value double, right_value double")


_TRIALS = f"""{_STUMP_ROWS}, n AS (SELECT era, row_number() OVER (ORDER BY era) i, count(*) OVER () a FROM (SELECT DISTINCT era FROM r)),
q AS (SELECT r.*, i > a - greatest(1, ceil(a*0.2)) AS held FROM r JOIN n USING (era)), m AS (SELECT 0 AS k, avg(y) m FROM q WHERE NOT held),
t AS (SELECT k, m-y AS g, 1.0 AS h, f0, f1, f2 FROM q, m WHERE NOT held), {_LONG}, {_BEST_STUMP},
trial AS (SELECT CAST(i AS INT) AS trial, exp(ln(0.01)+i/4.0*ln(50)) AS rate FROM range(5) o(i)),
e AS (SELECT trial, rate, sqrt(avg(pow(y-m-2*rate*{_LEAF}, 2))) AS value FROM q, best, m, trial WHERE held GROUP BY ALL)"""


def rated_stumps(spark, d):
    """A cartesian grid of a logarithmic range, each trial by the error on the last years."""
    df = rows(spark, d).withColumn("era", F.year("l_shipdate"))
    cfg = U.TunerConfig(steps=1, points=5, kind="cartesian", evaluation="eras", era="era")
    return U.tune(df, "key", "y", U.tree_model(FEATURES, "y", "key", STUMP), [U.TUNABLE["rate"]], cfg)


@query("tu01_grid", _TRIALS + " SELECT trial, round(rate,6) AS rate, round(value,6) AS value FROM e")
def tu01(spark, d):
    return spark.createDataFrame([(i, round(t.params["rate"], 6), round(t.value, 6)) for i, t in enumerate(rated_stumps(spark, d).trials)], "trial int, rate double, value double")


@query("tu04_folds")
def tu04(spark, d):
    """One setting by holdout, by folds and by conformal width, with the encoding fitted anew on each training part."""
    df = rows(spark, d).select("key", "y", "l_quantity", "l_tax", "l_returnflag").cache()
    model = U.realistic(lambda names: U.tree_model(names, "y", "key", T.TreeConfig(rounds=2, leaves=8, bins=16)), L.Pipeline("y", L.PipelineConfig(bins=16)), ["l_quantity", "l_tax", "l_returnflag"])
    out = [(k, {n: round(v, 6) for n, v in f(df, "key", "y", model, {"rate": 0.8, "depth": 3}).items()}) for k, f in U.EVALUATIONS.items() if k != "eras"]
    df.unpersist()
    return spark.createDataFrame([(k, v["value"], v.get("deviation"), v.get("coverage")) for k, v in out], "evaluation string, value double, deviation double, coverage double")


@query("tu05_linear_then_trees")
def tu05(spark, d):
    df = rows(spark, d).select("key", "y", *FEATURES).cache()
    _, log = U.tune_linear_then_trees(df, FEATURES, "y", "key", (0.1, 10.0), (1.0, 0.5), (0.3, 0.8), (0.0, 0.1), T.TreeConfig(rounds=1, depth=3, leaves=8, bins=16))
    df.unpersist()
    return log.frame(spark).withColumn("value", r6("value"))


@query("io14_trials", _TRIALS + " SELECT trial, 0 AS step, round(rate,6) AS rate, round(value,6) AS value, value = min(value) OVER () AS best FROM e")
def io14(spark, d):
    """The log of those trials, written and read again, with the best one of its summary."""
    path = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    rated_stumps(spark, d).write(spark, path)
    best = json.loads(spark.read.text(f"{path}/summary.json", wholetext=True).first()[0])["best"]["params"]["rate"]
    log = spark.read.csv(f"{path}/trials.csv", header=True, schema="trial int, step int, spread double, value double, seconds double, rate double")
    return log.select("trial", "step", r6("rate").alias("rate"), r6("value").alias("value"), (F.col("rate") == best).alias("best"))


@query("sc04_pairs", f"SELECT a, b FROM (SELECT 'l_quantity' a, 'l_extendedprice' b, corr(l_quantity, l_extendedprice) r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem) WHERE abs(r) >= 0.5")
def sc04(spark, d):
    return spark.createDataFrame(A.choose_pairs(line(spark, d), ["l_quantity", "l_extendedprice", "l_tax"], "correlated", 0.5), "a string, b string")


@query("au03_feature_plan")
def au03(spark, d):
    df = rows(spark, d).select("y", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate")
    plan = A.plan_features(df, ["l_quantity", "l_extendedprice", "l_tax"], "y", 0.1)
    return spark.createDataFrame([(n,) for n in plan.names(df)], "feature string")


@query("pr03_subset", "SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def pr03(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return X.Selection.by_index(df, [2, 0]).of(df, wanted, "o_orderkey")


@query("so06_by_importance", "SELECT r_name, r_regionkey FROM region")
def so06(spark, d):
    return X.Selection.by_importance({"r_regionkey": 0.2, "r_name": 0.7}).of(table(spark, d, "region"))


@query("pr05_linear_columns", "SELECT unnest(['ps_availqty']) AS feature WHERE false UNION ALL SELECT 'p_size' UNION ALL SELECT 'twice'")
def pr05(spark, d):
    """Of a target, an id, a constant, text and two numbers the numbers."""
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").withColumns({"same": F.lit(1.0), "twice": F.col("p_size") * 2.0})
    return spark.createDataFrame([(c,) for c in X.linear_columns(df, "p_retailprice")], "feature string")


@query("bn07_representative", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 10.0 WHEN p_size < 20 THEN 10.0 WHEN p_size < 30 THEN 20.0 ELSE 30.0 END::DOUBLE AS value FROM part")
def bn07(spark, d):
    bounds = [10.0, 20.0, 30.0]
    return table(spark, d, "part").select("p_partkey", N.representative(N.binned(F.col("p_size"), bounds), bounds).alias("value"))


@query("ud06_generator", "SELECT n_nationkey, n_nationkey * 2 AS doubled FROM nation")
def ud06(spark, d):
    X.register_generator("doubled")(lambda df, column: df.withColumn("doubled", F.col(column) * 2))
    return X.through(table(spark, d, "nation"), [lambda df: df.select("n_nationkey"), lambda df: X.generate(df, "doubled", column="n_nationkey")])


@query("tr04_monotone")
def tr04(spark, d):
    df = rows(spark, d)
    cfg = T.TreeConfig(rounds=2, rate=0.5, depth=3, leaves=8, bins=32, monotone={"l_quantity": 1, "l_discount": -1}, colsample=0.7, prune=0.001)
    return T.train_gbdt(df, FEATURES, "y", "key", cfg).predict(df).agg(*[r6(c).alias(n) for n, c in E.regression_metrics(F.col("y"), F.col("prediction")).items()])


@query("es01_out_of_fold")
def es01(spark, d):
    df = B.out_of_fold(rows(spark, d), FEATURES, "y", "key", T.TreeConfig(rounds=1, rate=1.0, depth=3, leaves=8, bins=16), [1, 2], 2)
    m = M.stack(df, ["oof_1", "oof_2"], "y")
    return df.agg(r6(E.regression_metrics(F.col("y"), m.column())["r2"]).alias("r2"), F.count("*").alias("n"))


@query("un05_gated", f"""WITH r AS (SELECT *, 0.5+4*l_discount AS p FROM lineitem), e AS (SELECT *, -(p*ln(p)+(1-p)*ln(1-p))/ln(2) AS doubt FROM r)
SELECT {LINE}, CASE WHEN doubt <= 0.8 THEN l_quantity ELSE l_tax END AS p, round(doubt,6) AS doubt FROM e""")
def un05(spark, d):
    """The first prediction where a two-class distribution is sure enough."""
    p = 0.5 + 4 * F.col("l_discount")
    doubt = B.uncertainty([p, 1 - p])
    return line(spark, d).select(*KEYS, B.gated(F.col("l_quantity"), F.col("l_tax"), doubt, 0.8).alias("p"), r6(doubt).alias("doubt"))


@query("io11_journal", _FOLD_STUMPS.replace("i(k) WHERE fold <> k", "i(k) WHERE k = 0").replace("ON fold <> k", "ON k = 0") + f" SELECT round(avg(m+{_LEAF}),6) AS prediction, round(stddev_pop(m+{_LEAF}),6) AS spread, 1 AS trees, 2 AS versions FROM r, best JOIN m USING (k) WHERE k = 0")
def io11(spark, d):
    """A model without trees, and the round that an update adds, from their journal."""
    df = rows(spark, d)
    model = C.train_many(df, FEATURES, "y", "key", [STUMP])[0]
    journal = S.ModelJournal(spark, f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}")
    journal.save(model.truncated(0), 0)
    journal.update(model, df.count())
    held = journal.load()
    out = held.predict(df).agg(r6(F.avg("prediction")).alias("prediction"), r6(F.stddev_pop("prediction")).alias("spread"))
    return out.withColumns({"trees": F.lit(len(held.trees)), "versions": F.lit(len(journal.versions()))})


@query("st02_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st02(spark, d):
    """Counts of a stream whose state is read back for each batch; the whole table comes again as a retried batch."""
    source = table(spark, d, "events")
    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    run(stream, lambda batch, i: IncrementalCounts("event_type", folder).update(batch, i), f"{folder}-stream").awaitTermination()
    counts = IncrementalCounts("event_type", folder)
    counts.update(source, 0)
    return counts.counts(spark)


@query("st01_stream_scaler", "SELECT count(*) AS n, round(avg(value),6) AS mean, round(var_pop(value),4) AS variance FROM events")
def st01(spark, d):
    """The events as a stream of files; each micro-batch merges its statistics."""
    scaler = IncrementalScaler(["value"])
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    run(stream, scaler.update, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").awaitTermination()
    p = scaler.state.params["value"]
    return spark.createDataFrame([(p["n"], round(p["mean"], 6), round(p["m2"] / p["n"], 4))], "n long, mean double, variance double")
