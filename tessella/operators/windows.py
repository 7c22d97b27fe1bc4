"""Grouped time-series features and cross-sectional features, one window for each order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.operators.ordering import ranked
from tessella.operators.profile import numeric_columns

EPS = 1e-10


def lag(c: str, k: int, w: WindowSpec, fill: str | float | None = None) -> Column:
    """k rows back; before the start NULL, the group's first value ("first"), or a constant."""
    back = F.lag(c, k).over(w)
    if fill is None:
        return back
    return F.coalesce(back, F.first(c).over(w) if fill == "first" else F.lit(float(fill)))


def median_of(values: Column) -> Column:
    """Median of an array without NULLs; NULL if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, middle)


def rolling(c: str, stat: str, frame: WindowSpec, min_periods: int = 1) -> Column:
    """A statistic over the frame's non-NULL values, NULL if they are fewer than min_periods."""
    n = F.count(c).over(frame)
    value = {
        "mean": lambda: F.avg(c).over(frame), "std": lambda: F.stddev_samp(c).over(frame), "var": lambda: F.var_samp(c).over(frame), "min": lambda: F.min(c).over(frame),
        "max": lambda: F.max(c).over(frame), "sum": lambda: F.sum(c).over(frame), "count": lambda: n.cast("double"), "median": lambda: median_of(F.collect_list(c).over(frame)),
    }[stat]()
    return F.when(n >= min_periods, value)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def centred(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows // 2), rows // 2)


def with_ewma(df: DataFrame, out: str, c: str, alpha: float, group: str, order: list[str]) -> DataFrame:
    """Exponentially weighted mean e = alpha x + (1 - alpha) e, starting at the first value; a NULL keeps the last mean.

    The recurrence runs over as many of the last non-NULL values as leave a weight of 1e-18
    at most to older ones, so a group's length doesn't matter.
    """
    horizon = math.ceil(math.log(1e-18) / math.log1p(-alpha)) if alpha < 1 else 1
    own = Window.partitionBy(group, F.col(c).isNull()).orderBy(*order).rowsBetween(-(horizon - 1), 0)
    values = F.collect_list(c).over(own)
    mean = F.aggregate(F.slice(values, 2, horizon), F.try_element_at(values, F.lit(1)).cast("double"), lambda e, x: F.lit(alpha) * x + F.lit(1 - alpha) * e)
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, mean).withColumn(out, F.last(F.col(f"`{out}`"), ignorenulls=True).over(before))


def momentum(c: str, k: int, w: WindowSpec) -> Column:
    back = F.lag(c, k).over(w).cast("double")
    return F.when(F.abs(back) > EPS, F.try_divide(F.col(c) - back, back))


@dataclass(frozen=True)
class TimeSeriesConfig:
    lags: tuple[int, ...] = (1, 7)
    windows: tuple[int, ...] = (7,)
    stats: tuple[str, ...] = ("mean", "std")
    alphas: tuple[float, ...] = (0.1,)
    momenta: tuple[int, ...] = (1, 7)
    min_periods: int = 1


#: Presets by the data's rhythm.
PRESETS = {
    "minimal": TimeSeriesConfig((1,), (7,), ("mean",), (), (1,)),
    "daily": TimeSeriesConfig((1, 7, 14, 30), (7, 14, 30), ("mean", "std"), (0.1, 0.3), (1, 7)),
    "hourly": TimeSeriesConfig((1, 24, 168), (24, 168), ("mean", "std"), (0.1,), (1, 24)),
    "weekly": TimeSeriesConfig((1, 4, 52), (4, 12), ("mean", "std"), (0.3,), (1, 4)),
}


def grouped_time_series(df: DataFrame, group: str, order: list[str], columns: list[str], config: TimeSeriesConfig = TimeSeriesConfig()) -> DataFrame:
    """All features of each column, per group in the given total order, in one window but for weighted means."""
    w = Window.partitionBy(group).orderBy(*order)
    out: dict[str, Column] = {}
    means = df
    for c in columns:
        out |= {f"{c}_lag_{k}": lag(c, k, w) for k in config.lags}
        out |= {f"{c}_roll_{n}_{s}": rolling(c, s, trailing(w, n), config.min_periods) for n in config.windows for s in config.stats}
        for a in config.alphas:
            means = with_ewma(means, f"{c}_ewma_{a:.2f}", c, a, group, order)
            out[f"{c}_ewma_{a:.2f}"] = F.col(f"`{c}_ewma_{a:.2f}`")
        out |= {f"{c}_momentum_{k}": momentum(c, k, w) for k in config.momenta}
    return means.withColumns(out).select(*[f"`{c}`" for c in [*(c for c in df.columns if c not in out), *out]])


def zscore(c: str, by: WindowSpec) -> Column:
    sd = F.stddev_samp(c).over(by)
    return F.when(sd > 0, (F.col(c) - F.avg(c).over(by)) / sd).otherwise(F.lit(0.0))


def versus_median(c: str, by: WindowSpec) -> Column:
    return F.col(c) - F.percentile(c, F.lit(0.5)).over(by)


def unit_rank(c: str, *by: str) -> Column:
    """Average rank scaled to 0..1; one half in a group of one; NULL for NULL."""
    order = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
    n = F.count(c).over(Window.partitionBy(*by))
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    return F.when(F.col(c).isNotNull(), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.5)))


def whole_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds ``unit_rank`` over the whole table, by range totals in place of one sort."""
    n = df.select(F.count(c)).first()[0]
    share = (F.col(out) - 1) / F.lit(n - 1) if n > 1 else F.lit(0.5)
    return ranked(df, c, out).withColumn(out, F.when(F.col(out).isNotNull(), share))


def cross_sectional(df: DataFrame, by: str, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Adds each column's score, distance from the median and rank inside its group.

    Without a choice, all numeric columns but the group and those excluded.
    """
    chosen = [c for c in (columns if columns is not None else numeric_columns(df, (by,))) if c not in exclude]
    w = Window.partitionBy(by)
    out: dict[str, Column] = {}
    for c in chosen:
        out |= {f"{c}_zscore": zscore(c, w), f"{c}_vs_median": versus_median(c, w), f"{c}_rank": unit_rank(c, by)}
    return df.withColumns(out) if out else df
