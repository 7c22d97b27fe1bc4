"""Positions and running sums in an order over a whole table, from range totals.

A window without a partition sorts all rows in one task. Here the rows are split into
ranges of the order at sampled cut points that are fixed as plain numbers before use, each
range is ordered by itself, and a prefix sum over the few range totals links them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import at_or_below

#: Ranges of the order; the totals that one task sums are as many at most, for each group.
RANGES = 1024
#: Rows that one task orders without ranges.
FEW = 250_000
#: Of the sketch that tells where quantiles lie: ranks are off by one in so many at most.
ACCURACY = 10_000
#: Sampled strings for each range, and the characters by which strings are cut.
SAMPLED, KEY = 32, 256


def ranged(df: DataFrame, first: Column) -> DataFrame | None:
    """Adds __range, which never falls as ``first`` grows; NULLs come first. None for few rows, which need no ranges.

    Numbers and dates are cut at approximate quantiles, strings at every SAMPLED-th of a hashed
    sample of their values, by their first KEY characters.
    """
    kind = df.select(first.alias("x")).schema["x"].dataType.simpleString()
    if kind == "string":
        x = F.substring(first, 1, KEY)
        found = df.select(x.alias("x")).where("x is not null").distinct().orderBy(F.xxhash64("x")).limit(SAMPLED * RANGES).toArrow()["x"].to_pylist()
        found.sort(key=lambda v: v.encode())
        cuts = found[:: max(1, -(-len(found) // RANGES))][1:]
    elif kind in ("binary", "boolean") or kind.startswith(("array", "struct")):
        return df.withColumn("__range", F.lit(0))
    else:
        x = first.cast("timestamp").cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else first.cast("double")
        row = df.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 5_000).alias("c"), F.count("*").alias("n")).first()
        if row.n <= FEW:
            return None
        cuts = sorted(set(map(float, row.c or [])))
    return df.withColumn("__range", F.when(x.isNull(), F.lit(0)).otherwise(at_or_below(cuts, x) + 1))


def before(df: DataFrame, order: list, sums: dict[str, Column], by: str | None = None) -> DataFrame:
    """Adds for each name the sum of its column over the rows that come earlier in the order, of the same ``by`` if that is given.

    ``order`` must tell rows apart, or rows that tie are taken in any order. Its first
    column cuts the ranges: rows that share one value of it are ordered in one task. Up to
    FEW rows are one range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = ranged(df, order[0])
    if rows is None:
        ahead = Window.partitionBy(*([by] if by else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"__v_{k}": v for k, v in sums.items()}).select(*df.columns, *(F.coalesce(F.sum(f"__v_{k}").over(ahead), F.lit(0)).alias(k) for k in sums))
    rows = rows.withColumns({"__by": F.col(by) if by else F.lit(0)} | {f"__v_{k}": v for k, v in sums.items()})
    totals = rows.groupBy("__by", "__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    ahead = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__by").alias("__by2"), F.col("__range").alias("__range2"), *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__o_{k}") for k in sums])
    joined = rows.join(offsets if by else F.broadcast(offsets), F.col("__by").eqNullSafe(F.col("__by2")) & (F.col("__range") == F.col("__range2")))
    inside = Window.partitionBy("__by", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({k: F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order: list, out: str, by: str | None = None) -> DataFrame:
    """Adds each row's position from 0, in its group if ``by`` is given."""
    return before(df, order, {out: F.lit(1).cast("long")}, by)


def tile(position: Column, rows: int, k: int) -> Column:
    """The tile (0 to k - 1) of a position among ``rows``; the first tiles take the remainder."""
    size, rest = divmod(rows, k)
    head = rest * (size + 1)
    return F.when(position < head, F.floor(position / (size + 1))).otherwise(rest + F.floor((position - head) / max(1, size))).cast("int")


def ranked(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds the average rank from 1 of a column's values over the whole table; NULL for NULL.

    Ranks come from counts of distinct values, so ties, however many, stay together.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__x")).agg(F.count("*").alias("__n"))
    ranks = before(counts, ["__x"], {"__less": F.col("__n")}).select("__x", (F.col("__less") + (F.col("__n") + 1) / 2).alias("__rank"))
    return df.join(ranks, F.col(c) == F.col("__x"), "left").select(*df.columns, F.col("__rank").alias(out))


def quantiles(df: DataFrame, c: Column, shares: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation, None without values.

    A sketch tells two values between which each wanted position lies; rows below are counted,
    and only the few between are put in order. Should a position lie elsewhere, and for few
    rows, ``counted`` finds it.
    """
    rows = df.select(c.cast("double").alias("x")).where("x is not null")
    margin = 2 / ACCURACY
    asked = [min(1.0, max(0.0, q + e)) for q in shares for e in (-margin, margin)]
    n, near = rows.agg(F.count("*"), F.percentile_approx("x", asked, ACCURACY)).first()
    if not n:
        return None
    at = [q * (n - 1) for q in shares]
    wanted = sorted({k for p in at for k in (math.floor(p), math.ceil(p))})
    found = between(rows, list(zip(near[::2], near[1::2])), wanted) if n > FEW else {}
    value = found if len(found) == len(wanted) else counted(rows, wanted)
    return [value[math.floor(p)] + (p - math.floor(p)) * (value[math.ceil(p)] - value[math.floor(p)]) for p in at]


def between(rows: DataFrame, spans: list[tuple[float, float]], wanted: list[int]) -> dict[int, float]:
    """By wanted position the value of ``x``, as far as it lies within one of the spans."""
    apart: list[list[float]] = []
    for low, high in sorted(spans):
        if apart and low <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], high)
        else:
            apart.append([low, high])
    x = F.col("x")
    ahead = rows.agg(*[F.count_if(x < low) for low, _ in apart]).first()
    span = F.coalesce(*[F.when((x >= low) & (x <= high), F.lit(i)) for i, (low, high) in enumerate(apart)])
    counts = rows.select("x", span.alias("span")).where("span is not null").groupBy("span", "x").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("span").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    less = F.coalesce(run, F.lit(0)) + F.element_at(F.array(*[F.lit(int(k)) for k in ahead]), F.col("span") + 1)
    return at_positions(counts.withColumn("less", less), wanted)


def counted(rows: DataFrame, wanted: list[int]) -> dict[int, float]:
    """By wanted position the value of ``x``.

    Values are counted (rows alike by their number ``__n``), and the range totals of the counts tell which values hold the wanted
    positions: no task holds all distinct values.
    """
    counts = rows.groupBy("x").agg((F.sum("__n") if "__n" in rows.columns else F.count("*")).alias("n"))
    return at_positions(before(counts, ["x"], {"less": F.col("n")}), wanted)


def at_positions(counts: DataFrame, wanted: list[int]) -> dict[int, float]:
    """By wanted position the value that holds it, of values ``x`` with their number ``n`` and that of the rows ahead, ``less``."""
    holds = F.exists(F.array(*[F.lit(k).cast("long") for k in wanted]), lambda k: (k >= F.col("less")) & (k < F.col("less") + F.col("n")))
    return {k: r.x for r in counts.where(holds).collect() for k in wanted if r.less <= k < r.less + r.n}
