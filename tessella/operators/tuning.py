"""Hyperparameter search: spaces, grids that zoom in, evaluation by folds, and the log of trials.

The trials of a step and their folds are trained together, in one pass over one binned table
(``cohorts``); models of other kinds run one trial after another. Only numbers come to the
driver.
"""

from __future__ import annotations

import csv
import io
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.losses import LOSSES
from tessella.operators import evaluation as E
from tessella.operators.cohorts import KINDS, Member, alike, boost, fold_of, keyed, train_many
from tessella.operators.encoding import COUNT
from tessella.operators.linear import Linear, fit_linear
from tessella.operators.ordering import counted, quantiles
from tessella.operators.pipeline import Pipeline
from tessella.operators.trees import GBDT, TreeConfig, train_gbdt
from tessella.sources.staging import Scratch


@dataclass(frozen=True)
class Parameter:
    """A tunable setting: a range, linear or logarithmic, whole or not, or a list of choices."""

    name: str
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    choices: tuple = ()

    def at(self, share: float, centre: float = 0.5, spread: float = 1.0):
        """The value at a share (0 to 1) of the range, shrunk by ``spread`` around ``centre``."""
        low, high = max(0.0, centre - spread / 2), min(1.0, centre + spread / 2)
        u = low + (high - low) * share
        if self.choices:
            return self.choices[min(len(self.choices) - 1, int(u * len(self.choices)))]
        v = math.exp(math.log(self.low) + u * math.log(self.high / self.low)) if self.log else self.low + u * (self.high - self.low)
        return round(v) if self.whole else v

    def share(self, value) -> float:
        """Where a value lies in the whole range, from 0 to 1."""
        if self.choices:
            return (self.choices.index(value) + 0.5) / len(self.choices)
        if self.high == self.low:
            return 0.5
        return math.log(value / self.low) / math.log(self.high / self.low) if self.log else (value - self.low) / (self.high - self.low)


#: The settings of TreeConfig that can be searched.
TUNABLE = {
    p.name: p
    for p in (
        Parameter("rate", 0.01, 0.5, log=True), Parameter("rounds", 10, 500, whole=True), Parameter("depth", 2, 10, whole=True), Parameter("leaves", 4, 128, log=True, whole=True),
        Parameter("least_rows", 1, 200, log=True, whole=True), Parameter("least_hessian", 0.1, 20.0, log=True), Parameter("least_gain", 0.0, 1.0), Parameter("lam", 0.01, 20.0, log=True),
        Parameter("bins", 16, 255, whole=True), Parameter("subsample", 0.5, 1.0), Parameter("colsample", 0.4, 1.0), Parameter("prune", 0.0, 1.0), Parameter("entropy", 0.0, 1.0),
        Parameter("loss", choices=("mse", "pseudo_huber")),
    )
}


def grid(space: list[Parameter], points: int, centre: dict[str, float], spread: float, seed: int, kind: str = "latin") -> list[dict]:
    """Trials around a centre (shares of the ranges): cartesian with ``points`` a dimension, Latin hypercube or random with ``points`` in all."""
    rng = random.Random(seed)
    at = lambda p, u: p.at(u, centre.get(p.name, 0.5), spread)
    if kind == "cartesian":
        out: list[dict] = [{}]
        for p in space:
            out = [o | {p.name: at(p, i / max(1, points - 1))} for o in out for i in range(points)]
        return list({json.dumps(o, sort_keys=True): o for o in out}.values())
    order = {p.name: rng.sample(range(points), points) for p in space}
    share = lambda p, i: (order[p.name][i] + 0.5) / points if kind == "latin" else rng.random()
    return [{p.name: at(p, share(p, i)) for p in space} for i in range(points)]


def constrained(space: list[Parameter], trials: list[Trial], top: float = 0.25, larger: bool = False) -> list[Parameter]:
    """The space cut to what the best share of earlier trials used."""
    good = sorted(trials, key=lambda t: -t.value if larger else t.value)[: max(1, math.ceil(top * len(trials)))]
    out = []
    for p in space:
        seen = [t.params[p.name] for t in good if p.name in t.params]
        if not seen:
            out.append(p)
        elif p.choices:
            out.append(replace(p, choices=tuple(c for c in p.choices if c in seen)))
        else:
            out.append(replace(p, low=min(seen), high=max(seen)))
    return out


@dataclass
class Trial:
    step: int
    params: dict
    value: float
    spread: float
    seconds: float = 0.0
    metrics: dict = field(default_factory=dict)


@dataclass
class History:
    """All trials in order; ``larger`` tells that larger values are better."""

    trials: list[Trial] = field(default_factory=list)
    larger: bool = False

    def best(self) -> Trial | None:
        """The trial of best value; of equal ones the first."""
        return min(self.trials, key=lambda t: -t.value if self.larger else t.value, default=None)

    def to_csv(self) -> str:
        out = io.StringIO()
        names = sorted({k for t in self.trials for k in t.params})
        metrics = sorted({k for t in self.trials for k in t.metrics})
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["trial", "step", "spread", "value", "seconds", *names, *metrics])
        for i, t in enumerate(self.trials):
            w.writerow([i, t.step, t.spread, t.value, round(t.seconds, 3), *(t.params.get(k, "") for k in names), *(t.metrics.get(k, "") for k in metrics)])
        return out.getvalue()

    def summary(self) -> str:
        best = self.best()
        return json.dumps({"trials": len(self.trials), "seconds": round(sum(t.seconds for t in self.trials), 3), "best": asdict(best) if best else None}, indent=1, sort_keys=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.step, json.dumps(t.params, sort_keys=True), float(t.value), float(t.spread)) for i, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, step int, params string, value double, spread double")

    def write(self, spark: SparkSession, path: str) -> None:
        """trials.csv and summary.json as folders of one part under ``path``."""
        for name, text in (("trials.csv", self.to_csv()), ("summary.json", self.summary())):
            spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


Model = Callable[[DataFrame, dict], Callable[[DataFrame], DataFrame]]


def known_settings(base: TreeConfig, params: dict) -> TreeConfig:
    names = {f.name for f in fields(TreeConfig)}
    return replace(base, **{k: v for k, v in params.items() if k in names})


@dataclass(frozen=True)
class Metric:
    """A number of predictions: an aggregate of target and prediction, or else a table's; and whether larger is better."""

    column: Callable[..., Column] | None = None
    table: Callable[[DataFrame, str, str, str | None], DataFrame] | None = None
    larger: bool = False


#: The metrics that take rows alike as one with their number.
COUNTED = ("mse", "rmse", "mae")
METRICS = {
    **{m: Metric(lambda y, p, n=None, m=m: E.regression_metrics(y, p, n)[m], larger=m == "r2") for m in ("mse", "rmse", "mae", "r2")},
    **{m: Metric(lambda y, p, m=m: E.binary_metrics(y, p)[m], larger=m != "log_loss") for m in ("log_loss", "accuracy", "f1")},
    "auc": Metric(table=lambda df, y, p, era: E.auc(df, y, p), larger=True),
    "rank_ic": Metric(table=lambda df, y, p, era: E.rank_ic(df, y, p, era), larger=True),
}


def measured(df: DataFrame, metric: str, y: str, ps: list[str], parts: list[Column], era: str | None = None) -> list[list[float]]:
    """A metric of each prediction on each part of the rows (a condition): one job where it is an aggregate."""
    of = METRICS[metric]
    if of.column:
        n = [F.col(COUNT)] if COUNT in df.columns else []
        cells = [of.column(F.when(part, F.col(y)), F.when(part, F.col(p)), *n).alias(f"m{i}_{k}") for i, p in enumerate(ps) for k, part in enumerate(parts)]
        row = df.agg(*cells).first()
        return [[row[i * len(parts) + k] or 0.0 for k in range(len(parts))] for i in range(len(ps))]
    return [[of.table(df.where(part), y, p, era).first()[0] or 0.0 for part in parts] for p in ps]


@dataclass
class TreeTrials:
    """GBDT trials: a trial's settings over a base. Called, it trains one; ``together`` evaluates many in one pass."""

    features: list[str]
    target: str
    key: str
    base: TreeConfig

    def __call__(self, train: DataFrame, params: dict) -> Callable[[DataFrame], DataFrame]:
        return train_gbdt(train, self.features, self.target, self.key, known_settings(self.base, params)).predict

    def together(self, df: DataFrame, trials: list[dict], evaluation: str, metric: str = "rmse", validation: float = 0.2, folds: int = 3, era: str | None = None) -> list[dict]:
        """Each trial's value on held-out rows, by ``holdout``, ``eras`` (the last ones) or ``folds`` (the mean, and how far folds differ).

        Trials with different numbers of bins are trained in as many passes.
        """
        if evaluation == "folds":
            rows, fold, held = df, fold_of(self.key, folds), range(folds)
        else:
            rows = E.era_holdout(df, era, validation) if evaluation == "eras" else E.holdout(df, self.key, validation)
            fold, held = F.when(F.col("split") == "validation", 0).otherwise(1), range(1)
        found: dict[int, dict] = {}
        configs = [known_settings(self.base, t) for t in trials]
        for bins in sorted({c.bins for c in configs}):
            own = [i for i, c in enumerate(configs) if c.bins == bins]
            cohort = boost(rows, self.features, self.key, [Member(configs[i], self.target, k) for i in own for k in held], fold=fold, also=[era] if era else [])
            p = {f"p_{i}": LOSSES[configs[i].loss].response(F.element_at(F.array(*(F.col(f"raw_{n * len(held) + k}") for k in held)), F.col("fold") + 1)) for n, i in enumerate(own)}
            scored = cohort.scored.where(F.col("fold") < len(held)).withColumns(p)
            for i, values in zip(own, measured(scored, metric, self.target, list(p), [F.col("fold") == k for k in held], era)):
                mean = sum(values) / len(values)
                found[i] = {"value": mean} | ({"deviation": math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))} if evaluation == "folds" else {})
        return [found[i] for i in range(len(trials))]


def tree_model(features: list[str], target: str, key: str, base: TreeConfig) -> TreeTrials:
    """Trains a GBDT with the trial's settings and returns its prediction."""
    return TreeTrials(features, target, key, base)


def realistic(model: Callable[[list[str]], Model], pipeline: Pipeline, columns: list[str]) -> Model:
    """Fits the encoding anew on each training part, so that no target leaks into the held-out part's features."""

    def fit(train: DataFrame, params: dict) -> Callable[[DataFrame], DataFrame]:
        own = Pipeline(pipeline.target, pipeline.config).fit(train, columns)
        keep = lambda df: [c for c in df.columns if c not in {f.name for f in own.features}]
        predict = model([f.name for f in own.features])(own.encode(train, keep(train)), params)
        return lambda df: predict(own.encode(df, keep(df)))

    def reads(params: dict) -> list[str] | None:
        """The columns that a trial learns from, where neither keys nor ranks between values tell rows apart."""
        of = model(columns)
        if not isinstance(of, TreeTrials) or pipeline.config.exact:
            return None
        return None if keyed(known_settings(of.base, params)) else columns

    fit.reads = reads
    return fit


@contextmanager
def gathered(df: DataFrame, marks: list[str], target: str, model: Model, params: dict, metric: Callable | None = None) -> Iterator[DataFrame]:
    """The rows by the marks, the target and what the model reads, alike ones as one with their number, where a sketch tells few kinds; else the rows.

    All trainings and their errors are then work on one small table.
    """
    reads = model.reads(params) if hasattr(model, "reads") and (metric is None or getattr(metric, "counts", False)) else None
    found = None if reads is None or COUNT in df.columns else alike(df, list(dict.fromkeys([*marks, target, *reads])), KINDS)
    if found is None:
        yield df
        return
    with Scratch(df.sparkSession, "trials") as scratch:
        yield scratch.put(found)


def metric_of(name: str, era: str | None = None) -> Callable[[DataFrame, str], float]:
    """A named metric of a table with the column ``prediction``."""
    of = lambda df, target: measured(df, name, target, ["prediction"], [F.lit(True)], era)[0][0]
    of.counts = name in COUNTED
    return of


rmse = metric_of("rmse")


def evaluate_holdout(df: DataFrame, key: str, target: str, model: Model, params: dict, validation: float = 0.2, metric=rmse) -> dict:
    with gathered(E.holdout(df, key, validation), ["split"], target, model, params, metric) as rows:
        predict = model(rows.where("split = 'train'").drop("split"), params)
        return {"value": metric(predict(rows.where("split = 'validation'").drop("split")), target)}


def evaluate_eras(df: DataFrame, key: str, target: str, model: Model, params: dict, era: str, validation: float = 0.2, metric=rmse) -> dict:
    """On the last eras, by what the others teach."""
    rows = E.era_holdout(df, era, validation)
    predict = model(rows.where("split = 'train'").drop("split"), params)
    return {"value": metric(predict(rows.where("split = 'validation'").drop("split")), target)}


def evaluate_folds(df: DataFrame, key: str, target: str, model: Model, params: dict, folds: int = 3, metric=rmse, seed: int = 99) -> dict:
    """The mean over folds by hashed keys, and how far the folds differ."""
    found = []
    with gathered(df.withColumn("__fold", fold_of(key, folds, seed)), ["__fold"], target, model, params, metric) as rows:
        for k in range(folds):
            part = lambda which: rows.where(which).drop("__fold")
            found.append(metric(model(part(F.col("__fold") != k), params)(part(F.col("__fold") == k)), target))
    mean = sum(found) / folds
    return {"value": mean, "deviation": math.sqrt(sum((x - mean) ** 2 for x in found) / folds)}


def evaluate_conformal(df: DataFrame, key: str, target: str, model: Model, params: dict, coverage: float = 0.9, **more) -> dict:
    """The mean width of intervals whose level is taken on one half of the held-out rows, and their coverage on the other."""
    with gathered(E.holdout(df, key, 0.25, 0.25), ["split"], target, model, params) as rows:
        out = model(rows.where("split = 'train'").drop("split"), params)(rows.where("split <> 'train'"))
        level = conformal_level(out.where("split = 'calibration'"), F.abs(F.col(target) - F.col("prediction")), coverage)
        n, hit = F.col(COUNT) if COUNT in out.columns else F.lit(1), F.abs(F.col(target) - F.col("prediction")) <= level
        inside = out.where("split = 'validation'").agg(F.try_divide(F.sum(hit.cast("double") * n), F.sum(F.when(hit.isNotNull(), n)))).first()[0]
    return {"value": 2 * level, "coverage": inside or 0.0}


def conformal_level(df: DataFrame, residual: Column, coverage: float) -> float:
    """The residual at the finite-sample level coverage * (1 + 1 / n): its rank is ceil(coverage * (n + 1)), n at most.

    """
    alike_ = COUNT in df.columns
    n = df.where(residual.isNotNull()).agg(F.sum(COUNT) if alike_ else F.count("*")).first()[0]
    if not n:
        return 0.0
    rank = min(n, math.ceil(coverage * (n + 1) - 1e-9))
    if alike_:
        return counted(df.select(residual.alias("x"), COUNT).where("x is not null"), [rank - 1])[rank - 1]
    return quantiles(df, residual, [(rank - 1) / max(1, n - 1)])[0]


EVALUATIONS = {"holdout": evaluate_holdout, "eras": evaluate_eras, "folds": evaluate_folds, "conformal": evaluate_conformal}


@dataclass
class TunerConfig:
    steps: int = 3
    points: int = 5
    kind: str = "latin"
    shrink: float = 0.5
    evaluation: str = "holdout"
    patience: int = 0
    seed: int = 7
    #: One of METRICS; ``conformal`` has its own.
    metric: str = "rmse"
    #: The era column of ``rank_ic`` and of the evaluation ``eras``.
    era: str | None = None


def tune(df: DataFrame, key: str, target: str, model: Model, space: list[Parameter], cfg: TunerConfig = TunerConfig(), on_trial: Callable[[Trial], bool | None] | None = None) -> History:
    """Rounds of trials, each around the best so far in a narrower range.

    With ``patience`` the search ends after so many rounds without a better trial; it also
    ends where ``on_trial`` returns False.
    """
    larger = cfg.evaluation != "conformal" and METRICS[cfg.metric].larger
    log, centre, spread, waited = History(larger=larger), {p.name: 0.5 for p in space}, 1.0, 0
    for step in range(cfg.steps):
        before = log.best()
        tried = [t.params for t in log.trials]
        found = grid(space, cfg.points, centre, spread, cfg.seed + step, cfg.kind)
        points = [p for i, p in enumerate(found) if p not in tried and p not in found[:i]]
        for params, got, seconds in evaluated(df, key, target, model, points, cfg):
            log.trials.append(Trial(step, params, got.pop("value"), spread, seconds, got))
            if on_trial and on_trial(log.trials[-1]) is False:
                return log
        best = log.best()
        waited = waited + 1 if best is before else 0
        if cfg.patience and waited >= cfg.patience:
            break
        centre, spread = {p.name: p.share(best.params[p.name]) for p in space}, spread * cfg.shrink
    return log


def evaluated(df: DataFrame, key: str, target: str, model: Model, points: list[dict], cfg: TunerConfig) -> Iterator[tuple[dict, dict, float]]:
    """Each trial's settings, numbers and seconds: together where the model can, else one by one."""
    if hasattr(model, "together") and cfg.evaluation != "conformal":
        start = time.time()
        found = model.together(df, points, cfg.evaluation, cfg.metric, era=cfg.era) if points else []
        yield from ((p, got, (time.time() - start) / len(points)) for p, got in zip(points, found))
        return
    for params in points:
        start = time.time()
        more = {} if cfg.evaluation == "conformal" else {"metric": metric_of(cfg.metric, cfg.era)} | ({"era": cfg.era} if cfg.evaluation == "eras" else {})
        got = EVALUATIONS[cfg.evaluation](df, key, target, model, params, **more)
        yield params, got, time.time() - start


@dataclass
class LinearThenTrees:
    linear: Linear
    shrinkage: float
    trees: GBDT

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        df = self.trees.predict(df, out)
        return df.withColumn(out, F.col(out) + F.lit(self.shrinkage) * self.linear.column())


def tune_linear_then_trees(df: DataFrame, features: list[str], target: str, key: str, lams=(0.1, 1.0, 10.0), shrinkages=(1.0, 0.7, 0.4), rates=(0.1, 0.3), dampings=(0.0, 0.1), cfg: TreeConfig = TreeConfig()) -> tuple[LinearThenTrees, History]:
    """Linear penalty, then the linear part's shrinkage, then the trees' rate, then the damping, each by the held-out error of what came before."""
    rows = E.holdout(df, key, 0.25)
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'validation'").drop("split")
    log = History()

    def tried(step: int, params: dict, p: Column | None, out: DataFrame | None = None) -> float:
        start = time.time()
        log.trials.append(Trial(step, params, rmse(test.withColumn("prediction", p) if out is None else out, target), 1.0, time.time() - start))
        return log.trials[-1].value

    linears = {lam: fit_linear(train, features, target, lam) for lam in lams}
    lam = min(lams, key=lambda x: tried(0, {"lam": x}, linears[x].column()))
    linear, mean = linears[lam], linears[lam].mean
    # A linear part that misleads is taken in part only, towards the mean.
    shrunk = lambda s: replace(linear, weights=[s * linear.weights[0] + (1 - s) * mean, *(s * w for w in linear.weights[1:])])
    share = min(shrinkages, key=lambda s: tried(1, {"lam": lam, "shrinkage": s}, shrunk(s).column()))
    linear = shrunk(share)
    left = train.withColumn("__y", F.col(target) - linear.column())
    models = {r: LinearThenTrees(linear, 1.0, m) for r, m in zip(rates, train_many(left, features, "__y", key, [replace(cfg, rate=r) for r in rates]))}
    rate = min(rates, key=lambda r: tried(2, {"lam": lam, "shrinkage": share, "rate": r}, None, models[r].predict(test)))
    damped = {d: replace(models[rate], linear=replace(linear, damping=d)) for d in dampings}
    damping = min(dampings, key=lambda d: tried(3, {"lam": lam, "shrinkage": share, "rate": rate, "damping": d}, None, damped[d].predict(test)))
    return damped[damping], log
