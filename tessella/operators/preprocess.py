"""Fit by one aggregation, transform by one projection."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import yeo_johnson
from tessella.operators.ordering import quantiles

TINY = 1e-8


def one_row(df: DataFrame, stats: dict[str, Column]) -> dict:
    """All statistics in a single pass; the result is one row whatever the input."""
    return df.agg(*[v.alias(k) for k, v in stats.items()]).first().asDict() if stats else {}


def spread(df: DataFrame, columns: list[str], shares: list[float], exact: bool) -> dict[str, list[float] | None]:
    """Each column's quantiles: exact ones by ranks, or approximate ones of all columns in one pass."""
    if exact:
        return {c: quantiles(df, F.col(c), shares) for c in columns}
    return one_row(df, {c: F.percentile_approx(F.col(c).cast("double"), shares, 10_000) for c in columns})


@dataclass
class Stage:
    """A fitted step: per column its parameters, as plain numbers."""

    columns: list[str]
    params: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, **asdict(self)})


@dataclass
class StandardScaler(Stage):
    def fit(self, df: DataFrame) -> StandardScaler:
        got = one_row(df, {f"{s}_{c}": f(c) for c in self.columns for s, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))})
        self.params = {c: {"n": got[f"n_{c}"], "mean": got[f"m_{c}"] or 0.0, "m2": (got[f"v_{c}"] or 0.0) * got[f"n_{c}"]} for c in self.columns}
        return self

    def merge(self, other: StandardScaler) -> StandardScaler:
        """The statistics of both inputs together, by the pairwise update of mean and squared deviations."""
        out = {}
        for c in self.columns:
            a, b = self.params[c], other.params[c]
            n = a["n"] + b["n"]
            d = b["mean"] - a["mean"]
            out[c] = {"n": n, "mean": a["mean"] + d * b["n"] / n if n else 0.0, "m2": a["m2"] + b["m2"] + (d * d * a["n"] * b["n"] / n if n else 0.0)}
        return StandardScaler(self.columns, out)

    def forget(self, batch: StandardScaler, alpha: float) -> StandardScaler:
        """Exponential forgetting: mean and variance move towards the batch's by alpha."""
        out = {}
        for c in self.columns:
            a, b = self.params[c], batch.params[c]
            va, vb = a["m2"] / max(1, a["n"]), b["m2"] / max(1, b["n"])
            out[c] = {"n": b["n"], "mean": (1 - alpha) * a["mean"] + alpha * b["mean"], "m2": ((1 - alpha) * va + alpha * vb) * b["n"]}
        return StandardScaler(self.columns, out)

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            p = self.params[c]
            sd = (p["m2"] / p["n"]) ** 0.5 if p["n"] else 0.0
            return (F.col(c) - p["mean"]) / (sd if sd >= TINY else 1.0)

        return df.withColumns({c: scaled(c) for c in self.columns})


@dataclass
class MinMaxScaler(Stage):
    low: float = 0.0
    high: float = 1.0

    def fit(self, df: DataFrame) -> MinMaxScaler:
        got = one_row(df, {f"{s}_{c}": f(c) for c in self.columns for s, f in (("a", F.min), ("b", F.max))})
        for c in self.columns:
            a, b = float(got[f"a_{c}"] or 0.0), float(got[f"b_{c}"] or 0.0)
            self.params[c] = {"min": a, "max": b if b - a >= TINY else a + 1}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        place = lambda c, p: self.low + (F.col(c) - p["min"]) / (p["max"] - p["min"]) * (self.high - self.low)
        return df.withColumns({c: F.least(F.greatest(place(c, self.params[c]), F.lit(self.low)), F.lit(self.high)) for c in self.columns})


@dataclass
class RobustScaler(Stage):
    exact: bool = True

    def fit(self, df: DataFrame) -> RobustScaler:
        got = spread(df, self.columns, [0.25, 0.5, 0.75], self.exact)
        for c in self.columns:
            a, m, b = map(float, got[c] or (0.0, 0.0, 1.0))
            self.params[c] = {"median": m, "iqr": b - a if b - a >= TINY else 1.0}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.params[c]["median"]) / self.params[c]["iqr"] for c in self.columns})


@dataclass
class Imputer(Stage):
    strategy: str = "mean"
    constant: float = 0.0
    exact: bool = True

    def fit(self, df: DataFrame) -> Imputer:
        if self.strategy == "mode":
            for c in self.columns:  # values in hundredths; the smallest of the most frequent, and its smallest raw value
                top = df.where(F.col(c).isNotNull()).groupBy(F.round(c, 2).alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("v")).orderBy(F.desc("n"), "b").first()
                self.params[c] = float(top.v) if top else 0.0
            return self
        if self.strategy == "median":
            self.params = {c: float(v[0]) if v else 0.0 for c, v in spread(df, self.columns, [0.5], self.exact).items()}
            return self
        pick = {"mean": F.avg, "constant": lambda c: F.max(F.when(F.col(c).isNotNull(), F.lit(self.constant)))}[self.strategy]
        got = one_row(df, {c: pick(c) for c in self.columns})
        self.params = {c: float(got[c]) if got[c] is not None else 0.0 for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.params[c])) for c in self.columns})


@dataclass
class MissingIndicator(Stage):
    suffix: str = "_missing"
    every: bool = False

    def fit(self, df: DataFrame) -> MissingIndicator:
        got = one_row(df, {c: F.count_if(F.col(c).isNull()) for c in self.columns})
        self.params = {c: got[c] for c in self.columns if self.every or got[c]}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}{self.suffix}": F.col(c).isNull().cast("double") for c in self.params})


@dataclass
class Outliers(Stage):
    method: str = "iqr"
    threshold: float = 1.5
    exact: bool = True

    def fit(self, df: DataFrame) -> Outliers:
        if self.method == "iqr":
            got = one_row(df, {f"n_{c}": F.count(c) for c in self.columns}) | spread(df, self.columns, [0.25, 0.75], self.exact)
            for c in self.columns:
                if got[f"n_{c}"] < 4:
                    raise ValueError(f"{c}: four values at least are needed")
                a, b = got[c]
                self.params[c] = (a - self.threshold * (b - a), b + self.threshold * (b - a))
        else:
            got = one_row(df, {f"{s}_{c}": f(c) for c in self.columns for s, f in (("m", F.avg), ("s", F.stddev_pop))})
            for c in self.columns:
                m, s = got[f"m_{c}"], max(got[f"s_{c}"], 1e-10)
                self.params[c] = (m - self.threshold * s, m + self.threshold * s)
        return self

    def out(self, c: str) -> Column:
        low, high = self.params[c]
        return F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))

    def cap(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(self.params[c][0])), F.lit(self.params[c][1])) for c in self.columns})

    def flag(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_outlier": self.out(c).cast("double") for c in self.columns})

    def remove(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            df = df.where(~self.out(c))
        return df

    def detect(self, df: DataFrame, key: str) -> DataFrame:
        """(key, feature, value): every value that lies outside its column's bounds."""
        each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), self.out(c).alias("out")) for c in self.columns])
        return df.select(key, F.inline(F.filter(each, lambda x: x["out"]))).drop("out")

    def counts(self, df: DataFrame) -> DataFrame:
        return df.agg(*[F.count_if(self.out(c)).alias(c) for c in self.columns])


@dataclass
class YeoJohnson(Stage):
    def fit(self, df: DataFrame, steps: int = 21, passes: int = 4) -> YeoJohnson:
        """The lambda in [-5, 5] of largest likelihood: a grid for all columns in each pass, then a finer one around the best."""
        span = {c: (-5.0, 5.0) for c in self.columns}
        for _ in range(passes):
            grid = {c: [a + (b - a) * i / (steps - 1) for i in range(steps)] for c, (a, b) in span.items()}
            stats = {f"{c}_{i}": F.var_pop(yeo_johnson(F.col(c), lam)) for c in self.columns for i, lam in enumerate(grid[c])}
            stats |= {f"{c}_j": F.avg(F.signum(c) * F.log1p(F.abs(c))) for c in self.columns}
            got = one_row(df, stats)
            for c in self.columns:
                score = lambda i: -0.5 * math.log(max(got[f"{c}_{i}"] or 0.0, 1e-300)) + (grid[c][i] - 1) * (got[f"{c}_j"] or 0.0)  # noqa: B023, E731
                best = max(range(steps), key=score)
                step = grid[c][1] - grid[c][0]
                self.params[c] = grid[c][best]
                span[c] = (max(-5.0, grid[c][best] - step), min(5.0, grid[c][best] + step))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: yeo_johnson(F.col(c), self.params[c]) for c in self.columns})


class Chain:
    """Stages fitted and applied one after another."""

    def __init__(self, *stages):
        self.stages = list(stages)

    def fit(self, df: DataFrame) -> Chain:
        for s in self.stages:
            df = s.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df


def plan_preprocessing(profile: list[dict], linear: bool) -> list[dict]:
    """Rules over a profile: what to do with each column."""
    out = []
    for p in profile:
        if p["numeric"]:
            if p["null_ratio"] > 0:
                out.append({"column": p["column"], "step": "impute_median"})
            if linear and abs(p["skewness"] or 0.0) > 2 and not p["has_negative"]:
                out.append({"column": p["column"], "step": "yeo_johnson"})
            if linear:
                out.append({"column": p["column"], "step": "standard"})
        else:
            out.append({"column": p["column"], "step": "one_hot" if linear and p["n_unique"] <= 50 else "frequency"})
    return out
