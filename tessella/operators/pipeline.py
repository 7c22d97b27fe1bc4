"""Frozen training pipelines: what training learns about columns, and the same projection at inference."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import clean
from tessella.operators.encoding import COUNT, UNKNOWN, apply_dictionary, binned, boundaries, counted_boundaries
from tessella.operators.ordering import before, numbered
from tessella.operators.profile import drop_reason, id_like_name, profile, split_by_type


@dataclass
class FeatureInfo:
    """A fitted column: its boundaries, the median that stands for missing values, a category's target means."""

    name: str
    kind: str
    bounds: list[float] = field(default_factory=list)
    impute: float = 0.0
    means: dict[str, float] = field(default_factory=dict)
    default: float = 0.0

    @property
    def num_bins(self) -> int:
        return len(self.bounds) + 1


@dataclass
class PipelineConfig:
    bins: int = 255
    least_count: int = 5
    smoothing: float = 10.0
    exact: bool = False
    most_categories: int = 100_000
    #: Up to so many categories are looked up in a literal, more in a joined table.
    literal: int = 200


@dataclass
class Pipeline:
    """Rare categories to one, target means, medians, quantile bins: fitted once, then plain projections."""

    target: str
    config: PipelineConfig = field(default_factory=PipelineConfig)
    features: list[FeatureInfo] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str] | None = None, era: str | None = None) -> Pipeline:
        """``df`` may be a table of rows alike with their number ``__n``."""
        counted = COUNT in df.columns
        n = F.col(COUNT) if counted else F.lit(1)
        numeric, text = split_by_type(df, (self.target, COUNT, *([era] if era else [])))
        numeric, text = ([c for c in group if columns is None or c in columns] for group in (numeric, text))
        rows = df.where(F.col(self.target).isNotNull())
        overall = float(rows.agg(F.try_divide(F.sum(F.col(self.target) * n), F.sum(n)) if counted else F.avg(self.target)).first()[0] or 0.0)
        if counted:
            medians = {c: v[0] if v else None for c, v in counted_boundaries(rows, {c: clean(F.col(c)) for c in numeric}, 2).items()} if numeric else {}
        else:
            medians = rows.agg(*[F.percentile_approx(clean(F.col(c)), 0.5).alias(c) for c in numeric]).first() if numeric else {}
        self.features = [FeatureInfo(c, "numeric", impute=float(medians[c] or 0.0)) for c in numeric]
        c = self.config
        for name in text:
            by = rows.where(F.col(name).isNotNull()).groupBy(name).agg((F.sum(n) if counted else F.count("*")).alias("n"), F.sum(F.col(self.target) * n).alias("s"))
            kept = by.select(F.when(F.col("n") >= c.least_count, F.col(name)).otherwise(UNKNOWN).alias("k"), "n", "s").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            found = kept.limit(c.most_categories + 1).collect()
            if len(found) > c.most_categories:
                raise ValueError(f"{name} has more than {c.most_categories} frequent categories")
            means = {r.k: (r.s + c.smoothing * overall) / (r.n + c.smoothing) for r in found}
            self.features.append(FeatureInfo(name, "categorical", means=means, default=means.get(UNKNOWN, overall)))
        numbers = self.numbers(rows)
        bounds = boundaries(self.joined(rows).select(*[v.alias(k) for k, v in numbers.items()], *([COUNT] if counted else [])), list(numbers), c.bins, c.exact)
        for f in self.features:
            f.bounds = bounds[f.name]
        return self

    def numbers(self, df: DataFrame) -> dict[str, Column]:
        """Each feature as a number; missing columns are an error that names them."""
        missing = [f.name for f in self.features if f.name not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        out = {}
        for f in self.features:
            if f.kind == "numeric":
                out[f.name] = F.coalesce(clean(F.col(f.name)), F.lit(f.impute))
            elif len(f.means) > self.config.literal:
                out[f.name] = F.col(f"__mean_{f.name}")
            elif f.means:
                table = F.create_map(*[x for k, v in f.means.items() for x in (F.lit(k), F.lit(v))])
                out[f.name] = F.coalesce(F.try_element_at(table, F.col(f.name)), F.lit(f.default))
            else:
                out[f.name] = F.lit(f.default)
        return out

    def joined(self, df: DataFrame) -> DataFrame:
        """The table with a column of means for each feature of many categories, by a join with its dictionary."""
        for f in self.features:
            if len(f.means) > self.config.literal and f.name in df.columns:
                dictionary = df.sparkSession.createDataFrame(list(f.means.items()), "__k string, mean double")
                df = apply_dictionary(df.withColumn("__k", F.col(f.name).cast("string")), dictionary, "__k", "mean", f"__mean_{f.name}", F.lit(f.default)).drop("__k")
        return df

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The kept columns, and a bin for each feature in the fitted order; other columns go."""
        of = {f.name: f for f in self.features}
        return self.joined(df).select(*keep, *[binned(v, of[k].bounds).alias(f"bin_{k}") for k, v in self.numbers(df).items()])

    def encode(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The kept columns, and each feature as a number."""
        return self.joined(df).select(*keep, *[v.alias(k) for k, v in self.numbers(df).items()])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Pipeline:
        x = json.loads(text)
        return Pipeline(x["target"], PipelineConfig(**x["config"]), [FeatureInfo(**f) for f in x["features"]])


def binned_table(df: DataFrame, target: str, columns: list[str] | None = None, config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, Pipeline]:
    """The target and a bin for each feature, and the fitted pipeline; without a choice all useful columns are features."""
    chosen = columns or useful_columns(df, target)
    fitted = Pipeline(target, config).fit(df, chosen)
    return fitted.transform(df, [target]), fitted


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named columns; names that there are not change nothing."""
    return df.drop(*names)


def ordered_select(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns in a fitted order, an error if any is missing."""
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*order)


def useful_columns(df: DataFrame, target: str) -> list[str]:
    """Columns that aren't constant, ids or free text, from one profile."""
    found = profile(df.drop(target), exact=False).collect()
    return [r.column for r in found if drop_reason(r.column, r.asDict()) is None]


def eras(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, era): eras numbered by first appearance in an order; NULL is its own era 0 by convention of the caller."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__at"))
    return first.select(column, (F.row_number().over(Window.orderBy("__at")) - 1).alias("era"))


def row_id_like(df: DataFrame, column: str, order: str, rows: int = 1000) -> DataFrame:
    """Whether the first rows count up by one from 0 or 1: the test that finds row ids. NULLs are passed over; more than ten values must be there."""
    return row_ids(df, [column], order, rows).select("is_row_id")


def row_ids(df: DataFrame, columns: list[str], order: str, rows: int = 1000) -> DataFrame:
    """(column, is_row_id, id_name) of numeric columns: what their first values tell, and what their names do."""
    head = df.select(F.col(order).alias("__order"), *columns).orderBy("__order").limit(rows)
    head = head.withColumn("__n", F.row_number().over(Window.orderBy("__order")))
    away = lambda c: F.col(c).cast("double") - F.col("__n")
    steady = lambda c: F.coalesce((F.min(away(c)) == F.max(away(c))) & F.min(away(c)).isin(-1.0, 0.0) & (F.count(c) > 10), F.lit(False))
    found = head.agg(*[steady(c).alias(f"r{i}") for i, c in enumerate(columns)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("is_row_id"), F.lit(id_like_name(c)).alias("id_name")) for i, c in enumerate(columns)])))


def monotonicity(df: DataFrame, x: str, y: str, key: str | None = None, sample: int | None = None) -> DataFrame:
    """|concordant - discordant| share of the pairs that tie in neither column, over all rows or a hashed sample of them; 0.5 where there are none.

    No pair is laid out. Values of ``y`` are numbered; two that differ have a highest bit that
    differs, and agree above it. So for each bit the rows that agree above it are one group, and
    running counts in the order of ``x`` tell how many rows with and without the bit come before.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(key).alias("key")] if sample else [])).where("x is not null and y is not null")
    if sample:
        rows = rows.orderBy(F.xxhash64("key"), "key").limit(sample)
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    ranks = numbered(cells.select("y").distinct(), ["y"], "rank")
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    share = F.lit(0.5)
    if not bits:
        return df.sparkSession.range(1).select(share.alias("monotonicity"))
    bit = F.explode(F.array(*map(F.lit, range(bits)))).alias("bit")
    levels = cells.join(ranks, "y").select("x", "n", "rank", bit)
    has = F.expr("shiftright(rank, bit) % 2 = 1")
    sides = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("low", ~has), ("high", has))]
    groups = levels.groupBy(F.expr("struct(bit, shiftright(rank, bit + 1) AS above)").alias("of"), "x").agg(*sides)
    run = before(groups, ["x"], {"lows": F.col("low"), "highs": F.col("high")}, by="of")
    pairs = run.agg(F.sum(F.col("high") * F.col("lows")).alias("up"), F.sum(F.col("low") * F.col("highs")).alias("down"))
    return pairs.select(F.coalesce(F.try_divide(F.abs(F.col("up") - F.col("down")), F.col("up") + F.col("down")), share).alias("monotonicity"))
