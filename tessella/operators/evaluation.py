"""Resampling by hashed keys, and metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import at_or_below
from tessella.operators.ordering import before, numbered, tile
from tessella.operators.trees import poisson, uniform


def holdout(df: DataFrame, key: str, validation: float, calibration: float = 0.0, seed: int = 42) -> DataFrame:
    """Exact shares in a hashed order: calibration rows first, then validation, the rest for training.

    Counts of hash ranges tell in which ranges the two cuts lie; only these ranges are put in
    order. A cut is then a hash and a key, so that no row is moved. Rows of one key that a cut
    goes through are told apart by a sort of each range.
    """
    hashed, range_ = F.xxhash64(key, F.lit(seed)), F.shiftright("__h", 52)
    rows = df.withColumn("__h", hashed)
    counts = {r["__r"]: r["count"] for r in rows.groupBy(range_.alias("__r")).count().collect()}
    n = sum(counts.values())
    c = math.ceil(n * calibration)
    v = math.ceil((n - c) * validation / (1 - calibration)) if calibration < 1 else 0
    starts, total = {}, 0
    for r in sorted(counts):
        starts[r], total = total, total + counts[r]
    ends = [min(c, n), min(c + v, n)]
    holding = {e: next((r for r in starts if starts[r] < e <= starts[r] + counts[r]), None) for e in ends}
    found: dict[int, tuple] = {}
    if hit := sorted({r for r in holding.values() if r is not None}):
        keys = rows.where(range_.isin(hit)).groupBy(range_.alias("__r"), "__h", F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
        ordered = Window.partitionBy("__r").orderBy("__h", "__k")
        run = keys.withColumn("__to", F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        within = [(F.col("__r") == r) & (F.col("__to") >= e - starts[r]) & (F.col("__to") - F.col("__n") < e - starts[r]) for e, r in holding.items() if r is not None]
        for row in run.where(reduce(lambda a, b: a | b, within)).collect():
            for e, r in holding.items():
                if r == row["__r"] and row["__to"] - row["__n"] < e - starts[r] <= row["__to"]:
                    found[e] = (row["__h"], row["__k"], row["__to"] == e - starts[r])
    if any(k is None or not whole for _, k, whole in found.values()):
        rows = rows.withColumn("__r", range_)
        offsets = df.sparkSession.createDataFrame(list(starts.items()), "__r long, __before long")
        at = F.col("__before") + F.row_number().over(Window.partitionBy("__r").orderBy("__h", key))
        rows = rows.join(F.broadcast(offsets), "__r").withColumn("__at", at)
        upto = lambda e: F.col("__at") <= e
    else:

        def upto(e: int) -> Column:
            if e not in found:
                return F.lit(False)
            h, k, _ = found[e]
            return (hashed < h) | (hashed == h) & F.coalesce(F.col(key) <= F.lit(k), F.lit(True))

    return rows.select(*df.columns, F.when(upto(ends[0]), "calibration").when(upto(ends[1]), "validation").otherwise("train").alias("split"))


def era_holdout(df: DataFrame, era: str, validation: float) -> DataFrame:
    """The last eras, one at least, are for validation. There are few eras, so one task ranks them."""
    eras = df.select(era).distinct().withColumns({"__n": F.row_number().over(Window.orderBy(era)), "__all": F.count("*").over(Window.partitionBy())})
    cut = F.greatest(F.lit(1), F.ceil(F.col("__all") * validation))
    marked = eras.select(era, F.when(F.col("__n") > F.col("__all") - cut, "validation").otherwise("train").alias("split"))
    return df.join(F.broadcast(marked), era)


def folds(df: DataFrame, key: str, k: int, order: Column) -> DataFrame:
    """Fold 0 to k - 1 by position in an order; the first folds take the remainder."""
    return numbered(df, [order, key], "fold").withColumn("fold", tile(F.col("fold"), df.count(), k))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, order: Column) -> DataFrame:
    """Round robin inside each class."""
    return numbered(df, [order, key], "fold", label).withColumn("fold", F.col("fold") % k)


def group_folds(df: DataFrame, group: str, k: int, order: Column) -> DataFrame:
    """All rows of a group in one fold."""
    groups = numbered(df.select(group).distinct(), [order, group], "fold").withColumn("fold", F.col("fold") % k)
    return df.join(groups, group)


def time_series_splits(n: int, splits: int, least: int | None = None) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) row numbers of expanding windows."""
    first = least if least is not None else n // (splits + 1)
    size = (n - first) // splits
    return [(first + i * size, first + i * size, first + (i + 1) * size if i < splits - 1 else n) for i in range(splits)]


def bootstrap(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with Poisson(1) counts of a resample."""
    return df.withColumn("weight", poisson(uniform(F.col(key), seed)))


def regression_metrics(y: Column, p: Column, n: Column | None = None) -> dict[str, Column]:
    """``n`` tells how many rows each row stands for."""
    e = p - y
    if n is not None:
        mean = lambda x: F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n)))
        return {"mse": mean(e * e), "rmse": F.sqrt(mean(e * e)), "mae": mean(F.abs(e))}
    return {"mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "r2": 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))}


def binary_metrics(y: Column, p: Column, cut: float = 0.5) -> dict[str, Column]:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = (p >= cut).cast("int")
    tp, fp, fn = F.sum(hit * y), F.sum(hit * (1 - y)), F.sum((1 - hit) * y)
    return {"log_loss": F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))), "accuracy": F.avg((hit == y).cast("double")), "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))}


def multiclass_log_loss(label: Column, probabilities: list[Column]) -> Column:
    """Mean of minus the logarithm of the label's probability, after scaling each row to a sum of one."""
    own = F.element_at(F.array(*probabilities), label.cast("int") + 1) / sum(probabilities[1:], probabilities[0])
    return F.avg(-F.ln(F.least(F.greatest(own, F.lit(1e-15)), F.lit(1 - 1e-15))))


def label_thresholds(df: DataFrame, pairs: list[tuple[str, str]], steps: int = 99) -> DataFrame:
    """(label, threshold, f1): the best threshold of each of several labels, given as (label, probability) columns."""
    found = [threshold_sweep(df, y, p, steps).select(F.lit(y).alias("label"), "threshold", "f1") for y, p in pairs]
    return reduce(DataFrame.unionByName, found)


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve with ties averaged, from counts by distinct score and their range totals."""
    by = df.groupBy(p).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    s = before(by, [p], {"below": F.col("neg")}).withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return s.agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def rank_ic(df: DataFrame, y: str, p: str, era: str) -> DataFrame:
    """Mean over eras of two rows or more of the rank correlation."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(era).orderBy(c)) + (F.count("*").over(Window.partitionBy(era, c)) - 1) / 2

    ranks = df.select(era, rank(y).alias("ry"), rank(p).alias("rp"))
    by = ranks.groupBy(era).agg(F.corr("ry", "rp").alias("ic"), F.count("*").alias("n")).where("n >= 2 and ic is not null and not isnan(ic)")
    return by.agg(F.avg("ic").alias("rank_ic"), F.count("*").alias("eras"))


def threshold_sweep(df: DataFrame, y: str, p: str, steps: int = 99) -> DataFrame:
    """(threshold, f1): the threshold of best F1 among steps equal ones, the lowest of equal ones.

    Rows are counted between the thresholds, so one pass serves all; the rest works on a row
    for each threshold.
    """
    cuts = [(i + 1) / (steps + 1) for i in range(steps)]
    counts = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(at_or_below(cuts, F.col(p)).alias("j")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    spine = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("j"))
    full = spine.join(F.broadcast(counts), "j", "left").fillna(0, ["pos", "neg"])
    above, total = Window.orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    tp, fp, all_pos = F.sum("pos").over(above), F.sum("neg").over(above), F.sum("pos").over(total)
    f1 = F.coalesce(F.try_divide(2 * tp, tp + fp + all_pos), F.lit(0.0))
    rows = full.select("j", f1.cast("double").alias("f1")).where("j > 0")
    at = F.element_at(F.array(*map(F.lit, cuts)), F.col("j"))
    return rows.orderBy(F.desc("f1"), "j").limit(1).select(at.alias("threshold"), "f1")
