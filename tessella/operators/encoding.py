"""Category encoders, rare-category filter, quantile bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import at_or_below, clean
from tessella.operators.gram import products
from tessella.operators.ordering import before, numbered, quantiles

UNKNOWN = "unknown"
#: The column of a table of rows alike that tells how many rows each of its rows stands for.
COUNT = "__n"
#: Dictionaries of so many rows and bytes of keys at most are broadcast; larger ones are joined by a shuffle.
SMALL, SMALL_BYTES = 50_000, 8 << 20


def apply_dictionary(df: DataFrame, dictionary: DataFrame, key: str, value: str, out: str, default: Column) -> DataFrame:
    """Joins a fitted (key, value) dictionary; keys that it lacks, and NULLs, get the default."""
    rows, size = dictionary.limit(SMALL + 1).agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    small = rows <= SMALL and (size or 0) <= SMALL_BYTES
    side = dictionary.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    joined = df.join(F.broadcast(side) if small else side, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__value", default)).drop("__key", "__value")


def frequency(df: DataFrame, c: str, normalise: bool = False) -> DataFrame:
    """(c, freq): each category's count, or its share of the non-NULL rows."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    if not normalise:
        return counts.select(c, F.col("n").cast("double").alias("freq"))
    total = df.select(F.count(c)).first()[0]
    return counts.select(c, (F.col("n") / F.lit(max(1, total))).alias("freq"))


def frequency_encode(df: DataFrame, c: str, dictionary: DataFrame, out: str, unknown: float = 0.0, strict: bool = False) -> DataFrame:
    """Adds each category's fitted frequency; unknown ones get ``unknown``, or are an error if ``strict``."""
    known = apply_dictionary(df, dictionary, c, "freq", out, F.lit(None).cast("double"))
    problem = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("double")
    return known.withColumn(out, F.coalesce(out, problem if strict else F.lit(unknown)))


def labels(df: DataFrame, c: str) -> DataFrame:
    """(c, label): the rank from 0 of each category by its bytes."""
    return numbered(df.where(F.col(c).isNotNull()).select(c).distinct(), [c], "label")


def label_index(df: DataFrame, c: str, dictionary: DataFrame, out: str, unknown: int | None = None, strict: bool = False) -> DataFrame:
    """Adds each category's label; unknown ones get ``unknown`` (by default the number of labels), or are an error if ``strict``."""
    default = F.lit(dictionary.count() if unknown is None else unknown).cast("long")
    known = apply_dictionary(df, dictionary, c, "label", out, F.lit(-1).cast("long"))
    missing = F.col(out) < 0
    if strict:
        problem = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))))
        return known.withColumn(out, F.when(missing, problem.cast("long")).otherwise(F.col(out)))
    return known.withColumn(out, F.when(missing, default).otherwise(F.col(out)))


def label_inverse(df: DataFrame, label: str, dictionary: DataFrame, c: str, out: str) -> DataFrame:
    """Adds the category of each label; NULL for labels that there are not."""
    return apply_dictionary(df, dictionary, "label", c, out, F.lit(None).cast("string")) if label == "label" else apply_dictionary(df.withColumn("label", F.col(label)), dictionary, "label", c, out, F.lit(None).cast("string")).drop("label")


def first_seen(df: DataFrame, c: str, order: str) -> DataFrame:
    """(c, label): the rank from 0 of each category by the row in which it first appears."""
    first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("at"))
    return numbered(first, ["at", c], "label").select(c, "label")


def one_hot(df: DataFrame, c: str, categories: list[str], prefix: str | None = None, drop_first: bool = False, limit: int = 1000) -> DataFrame:
    """One column of 0 and 1 for each category in order; unknown ones are 0 in all."""
    if len(categories) > limit:
        raise ValueError(f"{c} has more than {limit} categories")
    kept = sorted(categories)[1 if drop_first else 0 :]
    return df.withColumns({f"{prefix or c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in kept})


def ordered_target(df: DataFrame, c: str, y: str, order: list[str], out: str, smoothing: float = 10.0) -> DataFrame:
    """Adds the target mean of the category's earlier rows, smoothed towards that of all earlier rows; 0 for the first row.

    The sums of all earlier rows, and of a category's, come from range totals, so neither the
    table nor a frequent category is sorted in one task.
    """
    v = F.col(y).cast("double")
    sums = {"__n": F.when(v.isNotNull(), F.lit(1)).otherwise(0), "__s": F.coalesce(v, F.lit(0.0))}
    rows = before(before(df, order, {"__an": sums["__n"], "__as": sums["__s"]}), order, {"__cn": sums["__n"], "__cs": sums["__s"]}, by=c)
    prior = F.coalesce(F.try_divide("__as", "__an"), F.lit(0.0))
    mean = F.when(F.col("__cn") > 0, (F.col("__cs") + F.lit(smoothing) * prior) / (F.col("__cn") + F.lit(smoothing))).otherwise(prior)
    return rows.withColumn(out, mean).drop("__an", "__as", "__cn", "__cs")


def target_means(df: DataFrame, c: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """(c, mean): each category's smoothed target mean."""
    overall = df.agg(F.avg(y)).first()[0] or 0.0
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    return g.select(c, ((F.col("s") + F.lit(smoothing * overall)) / (F.col("n") + F.lit(smoothing))).alias("mean"))


def rare_to_unknown(df: DataFrame, c: str, least: int = 5) -> DataFrame:
    """Categories of fewer rows than ``least`` become one, by exact counts."""
    common = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return apply_dictionary(df, common.select(c, F.col(c).alias("kept")), c, "kept", c, F.lit(UNKNOWN))


def boundaries(df: DataFrame, columns: list[str], bins: int = 255, exact: bool = False) -> dict[str, list[float]]:
    """Strictly increasing quantile boundaries at i / bins of the finite values of each column, in one pass; exact ones in three for each column.

    Of rows that stand for several, they are taken at the same ranks from counts of values.
    """
    q = [i / bins for i in range(1, bins)]
    finite = {c: F.when(F.abs(clean(F.col(c))) < float("inf"), F.col(c).cast("double")) for c in columns}
    if COUNT in df.columns:
        if exact:
            raise ValueError("boundaries between values need each row by itself")
        return counted_boundaries(df, finite, bins)
    if exact:
        return {c: sorted(set(quantiles(df, x, q) or [])) for c, x in finite.items()}
    got = df.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(x, q, 10_000))).alias(c) for c, x in finite.items()]).first()
    return {c: list(map(float, got[c] or [])) for c in columns}


def counted_boundaries(df: DataFrame, columns: dict[str, Column], bins: int) -> dict[str, list[float]]:
    """The values of rank ceil(i / bins * rows) in a table of rows alike: one job for all columns, which gives a few values of each."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(columns.values())]))
    cells = df.select(F.col(COUNT).alias("n"), each).where("x is not null").groupBy("i", "x").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("i")
    run = cells.withColumns({"to": F.sum("n").over(part.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum("n").over(part)})
    held = run.where(F.expr(f"to * {bins} div rows > (to - n) * {bins} div rows")).select("i", "x", "to", "rows").toArrow()
    out = {}
    for i, c in enumerate(columns):
        mine = sorted((to, x, n) for k, x, to, n in zip(*(held[k].to_pylist() for k in ("i", "x", "to", "rows"))) if k == i)
        ranks = [-(-k * mine[0][2] // bins) for k in range(1, bins)] if mine else []
        out[c] = sorted({next(x for to, x, _ in mine if to >= r) for r in ranks})
    return out


def lowered(c: Column) -> Column:
    """A value to compare with boundaries: minus infinity for missing and infinite ones."""
    x = clean(c)
    return F.when(F.abs(x) < float("inf"), x).otherwise(float("-inf"))


def binned(c: Column, bounds: list[float]) -> Column:
    """Bin 0 for missing and infinite values; else the number of boundaries at or below the value."""
    x = clean(c)
    return F.when(x.isNull() | (F.abs(x) == float("inf")), F.lit(0)).otherwise(at_or_below(list(map(float, bounds)), x))


def representative(bin_: Column, bounds: list[float]) -> Column:
    """The boundary at or below a bin, the first one for bin 0."""
    if not bounds:
        return F.lit(None).cast("double")
    return F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.greatest(F.lit(1), F.least(bin_, F.lit(len(bounds)))))


def concat_binned(a: DataFrame, b: DataFrame) -> DataFrame:
    """One table under the other; their columns and types must be the same."""
    if {f.name: f.dataType for f in a.schema} != {f.name: f.dataType for f in b.schema}:
        raise ValueError("the tables differ in columns or types")
    return a.unionByName(b)


def bundle(df: DataFrame, columns: list[str], bins: dict[str, int], conflict: float = 0.001, sparsity: float = 0.5, most: int = 255) -> list[list[str]]:
    """Columns that are almost never non-zero together, in groups of ``most`` bins at most."""
    d = len(columns)
    sums = products(df, [*((F.col(c) != 0).cast("double") for c in columns), *(F.col(c).isNotNull().cast("double") for c in columns)])
    both = sums[:d, :d] / np.maximum(1, sums[d:, d:])
    at = {c: i for i, c in enumerate(columns)}
    filled = {c: both[at[c], at[c]] for c in columns}
    groups: list[list[str]] = []
    for c in sorted(columns, key=lambda c: (-filled[c], c)):
        for g in groups if 1 - filled[c] >= sparsity else []:
            if all(both[at[a], at[c]] <= conflict for a in g) and sum(bins[x] for x in [*g, c]) <= most and all(1 - filled[x] >= sparsity for x in g):
                g.append(c)
                break
        else:
            groups.append([c])
    return groups
