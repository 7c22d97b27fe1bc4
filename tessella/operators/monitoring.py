"""Drift between a reference and a target, and rules for updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import before

EPS = 1e-10


def shares(ref: DataFrame, new: DataFrame, c: str, bins: int, joint: bool) -> DataFrame:
    """(bin, p, q): shares of equal-width bins of the reference's, or of both tables', range."""
    both = ref.select(F.col(c).cast("double").alias("x"), F.lit(0).alias("side")).unionByName(new.select(F.col(c).cast("double").alias("x"), F.lit(1).alias("side"))).where("x is not null")
    of = F.col("x") if joint else F.when(F.col("side") == 0, F.col("x"))
    low, high = both.agg(F.min(of), F.max(of)).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(width)))).cast("int")
    counts = both.groupBy(at.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    spine = ref.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(counts, "bin", "left").fillna(0, ["a", "b"])
    total = Window.partitionBy()  # a row for each bin
    return full.select("bin", F.coalesce(F.try_divide("a", F.sum("a").over(total)), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("b", F.sum("b").over(total)), F.lit(0.0)).alias("q"))


def psi(ref: DataFrame, new: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Population stability index; a bin adds 1 at most."""
    p, q = F.greatest("p", F.lit(EPS)), F.greatest("q", F.lit(EPS))
    term = F.least((q - p) * F.ln(q / p), F.lit(1.0))
    return shares(ref, new, c, bins, False).agg(F.sum(term).alias("psi"))


def jsd(ref: DataFrame, new: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence in nats."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return shares(ref, new, c, bins, True).agg((F.sum(part(p) + part(q)) / 2).alias("jsd"))


def ks(ref: DataFrame, new: DataFrame, c: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic with ties counted together, from counts by distinct value."""
    both = ref.select(F.col(c).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(F.col(c).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    counts = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, m = counts.agg(F.sum("a"), F.sum("b")).first()
    if not n or not m:
        return counts.agg(F.lit(0.0).alias("ks"))
    below = before(counts, ["x"], {"below_a": F.col("a"), "below_b": F.col("b")})
    gap = F.abs((F.col("below_a") + F.col("a")) / F.lit(n) - (F.col("below_b") + F.col("b")) / F.lit(m))
    return below.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


@dataclass
class DriftRule:
    """Warning and critical levels; small samples get more room."""

    warn: float = 0.1
    critical: float = 0.25
    history: list[float] = field(default_factory=list)

    def level(self, value: float, n_ref: int, n_new: int) -> str:
        room = ((n_ref + n_new) / max(1, n_new)) ** 0.5
        return "critical" if value >= self.critical * room else "warning" if value >= self.warn * room else "none"

    def recommend(self, levels: dict[str, str]) -> str:
        share = sum(v == "critical" for v in levels.values()) / max(1, len(levels))
        self.history.append(share)
        return "retrain" if share >= 0.5 else "update_with_care" if share > 0.1 else "update"

    def drift_rate(self) -> float:
        return self.history[-1] - self.history[0] if len(self.history) > 1 else 0.0


@dataclass
class BinDetector:
    """Shift of bin histograms: a reference table's counts of each feature's bins, and what a new table's differ by.

    Small tables differ by chance, so the limit grows with sqrt((reference + new) / new).
    """

    counts: dict[str, dict[int, int]]
    rows: int
    limit: float = 0.1

    @staticmethod
    def fit(df: DataFrame, bins: list[str], limit: float = 0.1) -> BinDetector:
        """From columns of bin numbers: one aggregation over all of them."""
        counts: dict[str, dict[int, int]] = {c: {} for c in bins}
        for r in bin_counts(df, bins).collect():
            counts[r.feature][r.bin] = r.n
        return BinDetector(counts, max((sum(v.values()) for v in counts.values()), default=0), limit)

    def check(self, df: DataFrame) -> DataFrame:
        """(feature, psi, limit, shifted) for each feature of the reference."""
        spark = df.sparkSession
        known = spark.createDataFrame([(f, b, n) for f, bins in self.counts.items() for b, n in bins.items()], "feature string, bin int, a long")
        new = bin_counts(df, list(self.counts)).withColumnRenamed("n", "b")
        both = known.join(new, ["feature", "bin"], "full").fillna(0, ["a", "b"])
        total = Window.partitionBy("feature")
        share = lambda c: F.greatest(F.coalesce(F.try_divide(c, F.sum(c).over(total)), F.lit(0.0)), F.lit(EPS))
        shares = both.select("feature", "b", share("a").alias("p"), share("b").alias("q"))
        room = F.sqrt((F.lit(self.rows) + F.sum("b")) / F.greatest(F.sum("b"), F.lit(1)))
        out = shares.groupBy("feature").agg(F.sum(F.least((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p")), F.lit(1.0))).alias("psi"), (room * self.limit).alias("limit"))
        return out.withColumn("shifted", F.col("psi") > F.col("limit"))


def bin_counts(df: DataFrame, bins: list[str]) -> DataFrame:
    """(feature, bin, n) of columns of bin numbers; missing bins count as bin 0."""
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("int"), F.lit(0)).alias("bin")) for c in bins]))
    return df.select(long).groupBy("feature", "bin").agg(F.count("*").alias("n"))


def gap_trend(df: DataFrame, cv: str, holdout: str, step: str) -> DataFrame:
    """Mean gap between cross-validation and holdout, and the trend of its slope."""
    rows = df.select(F.col(step).cast("double").alias("x"), (F.col(holdout) - F.col(cv)).alias("gap"))
    slope = F.regr_slope("gap", "x")
    return rows.agg(F.avg("gap").alias("gap"), slope.alias("slope"), F.when(slope > 0.001, "worsening").when(slope < -0.001, "improving").otherwise("stable").alias("trend"))
