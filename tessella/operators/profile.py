"""Column profiles, panel detection, correlations, feature selection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tessella.operators.gram import pair_sums
from tessella.operators.ordering import numbered, tile


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def split_by_type(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and string columns."""
    return numeric_columns(df, exclude), [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in exclude]


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A row for each column from one pass: rows, null ratio, distinct values, constant, binary, least, largest, moments.

    Distinct values are counted exactly, which multiplies rows by columns, or else by sketches
    that are exact up to some thousands of values; then only columns whose estimate lies near
    a limit that decides on them are counted exactly, so that decisions are the same.
    """
    columns = columns or df.columns
    numeric = set(numeric_columns(df))
    counts = {} if exact else distinct_counts(df, columns)

    def distinct(c: str) -> Column:
        return F.count_distinct(c) if exact else F.lit(counts[c])

    stats: list[Column] = []
    for c in columns:
        d = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(c in numeric).alias("numeric"), F.count("*").alias("rows"), (F.count_if(F.col(c).isNull()) / F.greatest(F.count("*"), F.lit(1))).alias("null_ratio"),
                distinct(c).alias("n_unique"), F.min(d).alias("min"), F.max(d).alias("max"), F.skewness(d).alias("skewness"), F.kurtosis(d).alias("kurtosis"),
                (F.avg(F.length(c)) if c not in numeric else F.lit(None).cast("double")).alias("avg_length"),
            ).alias(c)
        )
    row = df.agg(*stats).select(F.explode(F.array(*columns)).alias("p")).select("p.*")
    return row.withColumns({"is_constant": F.col("n_unique") <= 1, "is_binary": F.col("n_unique") == 2, "has_negative": F.coalesce(F.col("min") < 0, F.lit(False)), "kind": inferred_kind()})


#: Nominal entries (as a power of two) of a column's distinct sketch, which is exact below them, and how far around a limit an estimate is in doubt.
ENTRIES, DOUBT = 12, 0.08
#: Shares of the rows at which distinct values decide: ids and text.
LIMITS = (0.85, 0.9)


def distinct_sketch(df: DataFrame, c: str) -> Column:
    """The distinct values of a column by a mergeable sketch; partial sketches are merged, rows aren't multiplied."""
    kind = dict(df.dtypes)[c]
    value = F.col(c) if kind in ("int", "bigint", "double", "string") else F.col(c).cast("double") if c in numeric_columns(df) else F.col(c).cast("string")
    return F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(value, ENTRIES)), F.lit(0)).cast("long")


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct non-NULL values by sketches, and exactly where an estimate is near a share of the rows that decides."""
    row = df.agg(F.count("*").alias("n"), *[distinct_sketch(df, c).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    found = {c: row[f"d{i}"] for i, c in enumerate(columns)}
    near = lambda n: n > 2**ENTRIES // 2 and any(abs(n - x * row.n) <= DOUBT * x * row.n for x in LIMITS)
    doubtful = [c for c in columns if near(found[c])]
    for c in doubtful:  # one after another: together they would multiply the rows
        found[c] = df.agg(F.count_distinct(c)).first()[0]
    return found


def inferred_kind() -> Column:
    """numeric, text or categorical, by distinct values and their mean length."""
    ratio = F.col("n_unique") / F.greatest(F.col("rows"), F.lit(1))
    text = ((F.col("n_unique") > 100) & (F.col("avg_length") > 20)) | ((ratio > 0.9) & (F.col("n_unique") > 50) & (F.col("avg_length") > 15))
    return F.when(F.col("numeric"), "numeric").when(text, "text").otherwise("categorical")


#: Names of row ids, and how names of ids begin and end.
ID_NAMES = ("id", "index", "idx", "row", "row_id", "rowid", "row_num", "row_number")
ID_BEGINS, ID_ENDS = ("id_",), ("_id", "id", "_index")


def id_like_name(name: str) -> bool:
    """Whether a column is called like an id, in letters of any case."""
    low = name.lower()
    return low in ID_NAMES or low.startswith(ID_BEGINS) or low.endswith(ID_ENDS)


def drop_reason(name: str, p: dict) -> str | None:
    """Why a column is of no use as a feature."""
    if p["is_constant"]:
        return "constant"
    # Distinct counts may be estimates.
    if p["rows"] > 10 and p["n_unique"] >= 0.85 * p["rows"] and (id_like_name(name) or name.endswith("key")):
        return "id"
    return "text" if p["kind"] == "text" else None


def task_of(df: DataFrame, y: str) -> str:
    """binary, multiclass or regression by the target's distinct rounded values."""
    v = F.col(y).cast("double")
    rounded = df.select(v.alias("v"), F.round(v).alias("r"))
    whole, n = rounded.agg(F.avg((F.abs(F.col("v") - F.col("r")) < 0.01).cast("int")), distinct_sketch(rounded, "r")).first()
    if (whole or 0) < 0.9:
        return "regression"
    return "binary" if n == 2 else "multiclass" if 3 <= n <= 20 else "regression"


def discrete_target(df: DataFrame, y: str, most: int = 20) -> DataFrame:
    """(is_discrete, n): whether the target has few distinct thousandths, over all rows."""
    n = F.count_distinct(F.floor(F.col(y).cast("double") * 1000))
    return df.agg((n <= most).alias("is_discrete"), n.alias("n"))


def target_transform(df: DataFrame, y: str) -> DataFrame:
    """(low, high, transform): the target's bounds, fixed at 0 and 1 for shares, and the transform that frees it from them."""
    v = F.col(y).cast("double")
    row = df.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.skewness(v).alias("s"))
    share = (F.col("a") >= 0) & (F.col("b") <= 1)
    kind = F.when(F.col("a").isNull(), "none").when(share & (F.col("a") < F.col("b")), "logit").when((F.col("a") >= 0) & (F.col("s") > 1), "log1p").otherwise("none")
    return row.select(F.when(share, 0.0).otherwise(F.col("a")).alias("low"), F.when(share, 1.0).otherwise(F.col("b")).alias("high"), kind.alias("transform"))


def panel_score(df: DataFrame, group: str) -> DataFrame:
    """How well a column works as a panel's group: counts by group in one score."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    s = g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"))
    score = 0.4 * F.sqrt(F.least(F.col("mean"), F.lit(100.0)) / 100) + 0.3 * F.col("low") / F.col("high") + 0.3 * (1 - F.col("groups") / F.col("rows"))
    return s.select("groups", "rows", F.col("low").alias("min_obs"), F.col("high").alias("max_obs"), score.alias("score"), (score > 0.3).alias("is_panel"))


def granularity(df: DataFrame, ts: str) -> DataFrame:
    """The upper median gap between distinct days, and its name.

    Distinct days are few whatever the rows, so one task may order them.
    """
    days = df.select(F.to_date(ts).alias("d")).where("d is not null").distinct()
    gaps = days.select(F.datediff("d", F.lag("d").over(Window.orderBy("d"))).alias("gap")).where("gap > 0")
    mid = gaps.agg(F.array_sort(F.collect_list("gap")).alias("g")).select(F.try_element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int")).alias("gap"))
    g = F.col("gap")
    return mid.select("gap", F.when(g.isNull(), "unknown").when(g <= 1, "daily").when(g <= 10, "weekly").when(g <= 45, "monthly").when(g <= 120, "quarterly").otherwise("yearly").alias("granularity"))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation of the rows that have both; NULL where one doesn't vary, which the built-in makes an error."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs' correlations, 0 where one doesn't vary, and the columns' variances: one pass over blocks, and one for the means."""
    sums = pair_sums(df, [F.col(c) for c in columns])
    return np.nan_to_num(sums.correlation()), sums.variance()


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns; NULL where one of them doesn't vary."""
    found = pair_sums(df, [F.col(c) for c in columns]).correlation()
    i, j = np.triu_indices(len(columns), 1)
    names = pa.array(columns, pa.string())
    pairs = pa.table({"a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "corr": pa.array(found[i, j], mask=np.isnan(found[i, j]))})
    return df.sparkSession.createDataFrame(pairs) if len(i) else df.sparkSession.createDataFrame([], "a string, b string, corr double")


def noise_floor(df: DataFrame, feature: str, target: str, tie: str, chunks: int = 20) -> DataFrame:
    """Mean variance of the target inside equal chunks along a feature, over its whole variance."""
    rows = df.select(F.col(target).alias("y"), F.col(feature).alias("x"), F.col(tie).alias("tie"))
    rows = numbered(rows, ["x", "tie"], "at").select("y", tile(F.col("at"), df.count(), chunks).alias("chunk"))
    inside = rows.groupBy("chunk").agg(F.var_pop("y").alias("v")).agg(F.avg("v").alias("inside"))
    return inside.crossJoin(rows.agg(F.var_pop("y").alias("whole"))).select((F.col("inside") / F.col("whole")).alias("noise_floor"))


def select_features(df: DataFrame, originals: list[str], candidates: list[str], target: str, least_variance: float = 0.01, most_corr: float = 0.95, top: int = 50) -> list[str]:
    """Candidates that vary, don't repeat an original, and correlate best with the target."""
    names = list(dict.fromkeys([*originals, *candidates, target]))
    corr, variance = correlation_matrix(df, names)
    at = {c: i for i, c in enumerate(names)}
    kept = [c for c in candidates if variance[at[c]] >= least_variance and all(abs(corr[at[c], at[o]]) < most_corr for o in originals)]
    return sorted(kept, key=lambda c: (-round(abs(corr[at[c], at[target]]), 12), c))[:top]


def drop_collinear(df: DataFrame, columns: list[str], target: str, limit: float = 0.99) -> list[str]:
    """Columns left when of each pair above the limit the one that tells less of the target goes."""
    names = list(dict.fromkeys([*columns, target]))
    corr, _ = correlation_matrix(df, names)
    at = {c: i for i, c in enumerate(names)}
    pairs = [(abs(corr[at[a], at[b]]), a, b) for a, b in combinations(columns, 2) if abs(corr[at[a], at[b]]) > limit]
    gone: set[str] = set()
    for _, a, b in sorted(pairs, key=lambda x: (-round(x[0], 12), x[1:])):
        if not gone & {a, b}:
            gone.add(a if abs(corr[at[a], at[target]]) < abs(corr[at[b], at[target]]) else b)
    return [c for c in columns if c not in gone]
