"""Row-wise feature columns, transforms and their inverses, as Column builders."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10
#: Periods of the cyclic calendar features.
PERIODS = {"hour": 24, "dow": 7, "dom": 31, "doy": 366, "woy": 53, "month": 12, "quarter": 4}


def clean(c: Column) -> Column:
    """NULL for NaN: the engine has one marker for missing values."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def literals(values: list) -> Column:
    """An array of constants; finite doubles in one expression, since a call for each is slow."""
    if all(isinstance(v, float) and math.isfinite(v) for v in values):
        return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")
    return F.array(*map(F.lit, values))


def at_or_below(values: list, x: Column) -> Column:
    """How many of the sorted values are at or below x: a coarse and a fine search of some sqrt(n) steps each."""
    if not values:
        return F.lit(0)
    step = max(1, math.isqrt(len(values)))
    table = literals(values)
    if step < 4:
        return F.size(F.filter(table, lambda v: v <= x))
    coarse = F.size(F.filter(literals(values[step - 1 :: step]), lambda v: v <= x)) * step
    return coarse + F.size(F.filter(F.slice(table, coarse + 1, F.lit(step)), lambda v: v <= x))


def polynomial(name: str) -> dict[str, Column]:
    x = F.col(name).cast("double")
    return {f"{name}_sq": x * x, f"{name}_cb": x * x * x, f"{name}_sqrt": F.sqrt(F.abs(x)), f"{name}_log1p": F.log1p(F.abs(x))}


def ratio(a: str, b: str) -> dict[str, Column]:
    """a / (b + 1e-10); NULL where that denominator is 0."""
    return {f"{a}_div_{b}": F.try_divide(F.col(a).cast("double"), F.col(b) + F.lit(EPS))}


def interactions(a: str, b: str) -> dict[str, Column]:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return {f"{a}_mul_{b}": x * y, f"{a}_add_{b}": x + y, f"{a}_sub_{b}": F.abs(x - y), f"{a}_min_{b}": F.least(x, y), f"{a}_max_{b}": F.greatest(x, y)}


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-8 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-8 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).when(x < 0, neg)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    pos = F.exp(y) - 1 if abs(lam) < 1e-8 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    neg = 1 - F.exp(-y) if abs(lam - 2) < 1e-8 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, pos).when(y < 0, neg)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def calendar(ts: Column) -> dict[str, Column]:
    """Parts of a UTC timestamp; Monday is day 0, weeks are whole sevens of days of the year."""
    dow, doy = (F.dayofweek(ts) + 5) % 7, F.dayofyear(ts)
    return {
        "hour": F.hour(ts), "dow": dow, "dom": F.dayofmonth(ts), "doy": doy, "woy": F.least(F.floor(doy / 7).cast("int") + 1, F.lit(53)),
        "month": F.month(ts), "quarter": F.quarter(ts), "year": F.year(ts), "is_weekend": (dow >= 5).cast("int"),
    }


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def trigonometric(name: str, period: float) -> dict[str, Column]:
    s, c = cyclic(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), period)
    return {f"{name}_sin": s, f"{name}_cos": c}


def lookup(category: Column, table: Mapping[str, float], default: float) -> Column:
    """A number for each category of a small table; the default for all others."""
    if not table:
        return F.lit(float(default))
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(float(default)))


class Expr:
    """A feature formula: numbers in, NULL counts as 0, and no operation fails."""

    def __init__(self, column: Column):
        self.column = column

    @staticmethod
    def col(name: str) -> Expr:
        return Expr(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))

    @staticmethod
    def const(x: float) -> Expr:
        return Expr(F.lit(float(x)))

    @staticmethod
    def lut(name: str, table: Mapping[str, float], default: float = 0.0) -> Expr:
        return Expr(lookup(F.col(name), table, default))

    def __add__(self, other: Expr) -> Expr:
        return Expr(self.column + other.column)

    def __sub__(self, other: Expr) -> Expr:
        return Expr(self.column - other.column)

    def __mul__(self, other: Expr) -> Expr:
        return Expr(self.column * other.column)

    def __truediv__(self, other: Expr) -> Expr:
        return Expr(F.when(F.abs(other.column) < EPS, F.lit(0.0)).otherwise(F.try_divide(self.column, other.column)))

    def square(self) -> Expr:
        return Expr(self.column * self.column)

    def sqrt(self) -> Expr:
        return Expr(F.sqrt(F.greatest(self.column, F.lit(0.0))))

    def log1p(self) -> Expr:
        return Expr(F.log1p(self.column))

    def pow(self, p: float) -> Expr:
        return Expr(F.pow(self.column, F.lit(float(p))))

    def abs(self) -> Expr:
        return Expr(F.abs(self.column))

    def clamp(self, low: float, high: float) -> Expr:
        return Expr(F.least(F.greatest(self.column, F.lit(float(low))), F.lit(float(high))))

    def sin(self) -> Expr:
        return Expr(F.sin(self.column))

    def cos(self) -> Expr:
        return Expr(F.cos(self.column))


def formula(weights: Mapping[str, float], constant: float = 0.0, tables: Iterable[tuple[str, Mapping[str, float], float]] = ()) -> Column:
    """constant + sum of weight * column + looked-up terms."""
    total = Expr.const(constant)
    for name, w in weights.items():
        total = total + Expr.const(w) * Expr.col(name)
    for name, table, default in tables:
        total = total + Expr.lut(name, table, default)
    return total.column


def logit(y: Column, low: float, high: float, eps: float = 1e-6) -> Column:
    """Logit of y's place in [low, high]; a value outside is an error."""
    p = F.least(F.greatest((y - low) / (high - low), F.lit(eps)), F.lit(1 - eps))
    return F.when((y < low) | (y > high), F.raise_error(F.lit(f"target outside [{low}, {high}]")).cast("double")).otherwise(F.log(p / (1 - p)))


def logit_inverse(z: Column, low: float, high: float) -> Column:
    return F.lit(low) + sigmoid(z) * F.lit(high - low)


def clamp(y: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(y, F.lit(low)), F.lit(high))


def fill_engineered(df: DataFrame) -> DataFrame:
    """NULL and NaN in numeric columns become 0."""
    numeric = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) if c in numeric else F.col(c) for c in df.columns])
