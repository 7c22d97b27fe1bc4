"""Automatic modelling by task and budget: a profile, a plan of features and preprocessing, probes of the modes, tuning, training, a report."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from tessella.functions import scalar as S
from tessella.functions.scalar import sigmoid
from tessella.functions.losses import LOSSES
from tessella.operators.cohorts import KINDS, Multiclass, alike, keyed, train_multiclass
from tessella.operators.encoding import COUNT
from tessella.operators.ensembles import predict_multilabel, predict_multilabel_linear, train_multilabel, train_multilabel_linear
from tessella.operators.evaluation import binary_metrics, holdout, label_thresholds, multiclass_log_loss, regression_metrics
from tessella.operators.linear import Universal, fit_linear, train_universal
from tessella.operators.pipeline import Pipeline, PipelineConfig
from tessella.operators.preprocess import Chain, Imputer, Stage, StandardScaler, YeoJohnson, plan_preprocessing
from tessella.operators.profile import correlation, correlations, drop_reason, numeric_columns, profile, select_features, split_by_type, target_transform, task_of
from tessella.operators.trees import TreeConfig
from tessella.operators.tuning import TUNABLE, History, TreeTrials, Trial, grid, known_settings
from tessella.operators.windows import TimeSeriesConfig, grouped_time_series
from tessella.sources.staging import Scratch


def choose_pairs(df: DataFrame, columns: list[str], how: str = "all", least: float = 0.3, most: int = 3, target: str | None = None, explicit: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Pairs of columns to combine: all, explicit ones, those correlated by ``least`` or more (``most`` for each column), or those whose product tells most of the target."""
    if how == "explicit":
        return [p for p in explicit if set(p) <= set(columns)]
    if how == "all":
        return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if len(columns) < 2:
        return []
    if how == "target":
        pairs = choose_pairs(df, columns)
        row = df.agg(*[correlation(F.col(a).cast("double") * F.col(b), target).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        ranked = sorted(((abs(row[i] or 0.0), p) for i, p in enumerate(pairs)), key=lambda x: (-x[0], x[1]))
    else:
        ranked = sorted(((abs(r["corr"] or 0.0), (r.a, r.b)) for r in correlations(df, columns).collect()), key=lambda x: (-x[0], x[1]))
    taken, used = [], dict.fromkeys(columns, 0)
    for r, (a, b) in ranked:
        if r >= least and used[a] < most and used[b] < most:
            taken.append((a, b))
            used[a] += 1
            used[b] += 1
    return taken


@dataclass
class FeaturePlan:
    """What to derive: powers of columns, ratios and interactions of pairs, parts of dates."""

    powers: list[str] = field(default_factory=list)
    ratios: list[tuple[str, str]] = field(default_factory=list)
    interactions: list[tuple[str, str]] = field(default_factory=list)
    calendars: list[str] = field(default_factory=list)
    #: group, time and columns of a panel, whose columns get time-series features.
    panel: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """The table and its derived columns, one projection; a plan's columns must be there."""
        new: dict = {}
        for c in self.powers:
            new |= S.polynomial(c)
        for a, b in self.ratios:
            new |= S.ratio(a, b)
        for a, b in self.interactions:
            new |= S.interactions(a, b)
        for c in self.calendars:
            new |= {f"{c}_{k}": v.cast("double") for k, v in S.calendar(F.col(c)).items()}
        df = df.withColumns(new) if new else df
        if self.panel:
            df = grouped_time_series(df, self.panel["group"], [self.panel["time"]], self.panel["columns"], TimeSeriesConfig((1,), (7,), ("mean",), (), (1,)))
        return df

    def names(self, df: DataFrame) -> list[str]:
        return [c for c in self.apply(df.limit(0)).columns if c not in df.columns]


def plan_features(df: DataFrame, columns: list[str], target: str, linear_r2: float, top: int = 5, ratio_corr: float = 0.5, weak_r2: float = 0.3) -> FeaturePlan:
    """Powers of the columns that correlate best with the target and hold nothing negative, ratios of pairs
    correlated by more than ``ratio_corr``, interactions where a linear fit explains less than ``weak_r2``, parts of dates."""
    numeric = [c for c in numeric_columns(df) if c in columns]
    plan = FeaturePlan(calendars=[f.name for f in df.schema if isinstance(f.dataType, (DateType, TimestampType)) and f.name != target])
    if numeric:
        row = df.agg(*[correlation(c, target).alias(f"c{i}") for i, c in enumerate(numeric)], *[F.min(c).alias(f"m{i}") for i, c in enumerate(numeric)]).first().asDict()
        tells = sorted((c for i, c in enumerate(numeric) if row[f"m{i}"] is not None and row[f"m{i}"] >= 0), key=lambda c: (-abs(row[f"c{numeric.index(c)}"] or 0.0), c))
        plan.powers = tells[:top]
        plan.ratios = choose_pairs(df, numeric, "correlated", ratio_corr)
        if linear_r2 < weak_r2:
            plan.interactions = choose_pairs(df, numeric, "target", 0.0, 2, target)
    return plan


def preprocessing(plan: list[dict]) -> list[Stage]:
    """The stages that a preprocessing plan names, in the order in which they apply."""
    of = lambda step: [p["column"] for p in plan if p["step"] == step]
    stages: list[Stage] = []
    if of("impute_median"):
        stages.append(Imputer(of("impute_median"), strategy="median"))
    if of("yeo_johnson"):
        stages.append(YeoJohnson(of("yeo_johnson")))
    if of("standard"):
        stages.append(StandardScaler(of("standard")))
    return stages


#: Trials of each level, and into how many stages of growing rounds they are halved.
LEVELS = {"none": (0, 0), "quick": (6, 2), "standard": (18, 3), "thorough": (54, 4)}
#: The metric of each task; all are errors, so that less is better.
ERRORS = {"regression": "rmse", "binary": "log_loss", "multiclass": "log_loss"}
LOSS = {"regression": "mse", "binary": "log_loss", "multiclass": "log_loss"}
SPACE = [replace(TUNABLE["rate"], low=0.03), replace(TUNABLE["depth"], low=3, high=8), replace(TUNABLE["leaves"], low=8), replace(TUNABLE["lam"], low=0.1), TUNABLE["subsample"], TUNABLE["colsample"]]
#: Of the time that is left, what a phase may plan to take.
SHARE = {"features": 0.25, "probes": 0.4, "tuning": 0.5, "train": 0.9}


@dataclass
class AutoConfig:
    validation: float = 0.2
    modes: tuple[str, ...] = ("trees", "linear_then_trees", "forest")
    tree: TreeConfig = field(default_factory=lambda: TreeConfig(rounds=10, rate=0.3, depth=5, leaves=16, bins=64))
    engineer: bool = True
    most_features: int = 50
    #: One of LEVELS.
    tuning: str = "none"
    #: Seconds that the build may take; phases are shortened or left out to keep to it.
    budget: float | None = None
    #: A loss in place of the task's.
    loss: str | None = None
    #: Models of different seeds whose predictions are averaged.
    seeds: int = 1
    #: Whether a regression target is freed from its bounds first, and predictions kept within them.
    transform: bool = False
    #: Columns of a panel's group and time: columns get their lags, rolling statistics and momenta inside a group.
    group: str | None = None
    time: str | None = None


class Budget:
    """The clock of a build: what each phase took, and whether a plan fits into what is left."""

    def __init__(self, seconds: float | None = None, on_phase: Callable[[str, float], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.limit, self.on_phase, self.clock = seconds, on_phase, clock
        self.start, self.seconds, self.notes = clock(), {}, []

    def left(self) -> float:
        return math.inf if self.limit is None else self.limit - (self.clock() - self.start)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        begun = self.clock()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - begun
        if self.on_phase:
            self.on_phase(name, self.seconds[name])

    def fits(self, name: str, estimate: float) -> bool:
        """Whether a phase's estimate is within its share of what is left; a note tells where it isn't."""
        if estimate <= SHARE[name] * self.left():
            return True
        self.notes.append(f"{name}: {estimate:.3g} s planned, {max(0.0, self.left()):.3g} s left")
        return False


@dataclass
class Answer:
    """What stands between a task's target and the numbers that models learn: classes, or a transform and bounds."""

    task: str
    classes: list = field(default_factory=list)
    transform: str = "none"
    low: float | None = None
    high: float | None = None

    @staticmethod
    def of(df: DataFrame, target: str, transform: bool) -> Answer:
        known = df.where(F.col(target).isNotNull())
        text = dict(df.dtypes)[target] == "string"
        found = "classes" if text else task_of(df, target)
        if found != "regression":
            value = F.col(target) if text else F.round(F.col(target).cast("double"))
            classes = sorted(r[0] for r in known.select(value.alias("c")).distinct().limit(21).collect())
            if text and not 2 <= len(classes) <= 20:
                raise ValueError(f"{target} has {'more than 20' if len(classes) > 20 else 'fewer than 2'} classes")
            return Answer("binary" if len(classes) == 2 else "multiclass", classes)
        if not transform:
            return Answer("regression")
        r = target_transform(known, target).first()
        return Answer("regression", [], r["transform"], r["low"], r["high"])

    def learnt(self, target: str) -> Column:
        """The target as models learn it."""
        if self.classes:
            text = isinstance(self.classes[0], str)
            value = F.col(target) if text else F.round(F.col(target).cast("double"))
            return F.nullif(F.array_position(F.array(*map(F.lit, self.classes)), value), F.lit(0)).cast("double") - 1
        y = F.col(target).cast("double")
        if self.transform == "log1p":
            return F.log1p(y)
        if self.transform == "logit":
            q = F.least(F.greatest(y, F.lit(1e-4)), F.lit(1 - 1e-4))
            return F.ln(q / (1 - q))
        return y

    def given(self, p: Column) -> Column:
        """A regression's prediction on the target's own scale, within its bounds."""
        p = {"log1p": F.expm1, "logit": sigmoid, "none": lambda x: x}[self.transform](p)
        return p if self.transform == "none" else F.least(F.greatest(p, F.lit(self.low)), F.lit(self.high))


@dataclass
class AutoModel:
    """A trained model with all that leads to it: the plan, the encoding, the stages and the probes."""

    target: str
    key: str
    task: str
    features: FeaturePlan
    encoding: Pipeline
    stages: Chain
    model: Universal | Multiclass
    probes: dict[str, float]
    dropped: dict[str, str]
    seconds: dict[str, float] = field(default_factory=dict)
    answer: Answer = field(default_factory=lambda: Answer("regression"))
    others: list[Universal] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    trials: History | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        own = df.withColumn(LEARNT, self.answer.learnt(self.target) if self.target in df.columns else F.lit(None).cast("double"))
        keep = [c for c in (self.key, self.target) if c in df.columns]
        return self.stages.transform(self.encoding.encode(self.features.apply(own), [*keep, LEARNT]))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The key, the encoded features and the prediction: a value, the second class's probability, or for more classes the most
        probable one after each one's probability ``p_0``, ``p_1``, ..."""
        rows = self.prepare(df).drop(LEARNT)
        if isinstance(self.model, Multiclass):
            rows = self.model.predict_class(self.model.predict_proba(rows), "__class")
            return rows.withColumn(out, F.element_at(F.array(*map(F.lit, self.answer.classes)), F.col("__class") + 1)).drop("__class")
        rows = self.model.predict(rows, out)
        for i, m in enumerate(self.others):
            rows = m.predict(rows, f"__other_{i}")
        if self.others:
            names = [out, *(f"__other_{i}" for i in range(len(self.others)))]
            rows = rows.withColumn(out, sum((F.col(c) for c in names[1:]), F.col(out)) / len(names)).drop(*names[1:])
        return rows.withColumn(out, self.answer.given(F.col(out))) if self.task == "regression" else rows

    def predict_class(self, df: DataFrame, threshold: float = 0.5, out: str = "predicted") -> DataFrame:
        """Adds the predicted class as it stands in the target; of two classes the second from the threshold on."""
        if self.task == "multiclass":
            return self.predict(df, out)
        first, second = map(F.lit, self.answer.classes)
        return self.predict(df).withColumn(out, F.when(F.col("prediction") >= threshold, second).otherwise(first))

    def trees(self) -> int:
        """Rounds of the model."""
        return len((self.model.models[0] if isinstance(self.model, Multiclass) else self.model.trees).trees)

    def update(self, df: DataFrame, rounds: int) -> AutoModel:
        """The model with ``rounds`` more trees from new rows; ``history`` tells what was added."""
        if isinstance(self.model, Multiclass):
            raise ValueError("a multiclass model grows its classes together and isn't updated")
        ready = self.prepare(df)
        return replace(self, model=self.model.update(ready, rounds), others=[m.update(ready, rounds) for m in self.others])

    def importance(self) -> dict[str, float]:
        return self.model.importance() if isinstance(self.model, Multiclass) else self.model.trees.importance()

    def report(self) -> str:
        """What was found and done, as text."""
        best = min(self.probes, key=self.probes.get)
        top = sorted(self.importance().items(), key=lambda x: (-x[1], x[0]))[:10]
        lines = [f"target {self.target} ({self.task})", "probes: " + ", ".join(f"{m} {e:.6g}" for m, e in self.probes.items()), f"mode {best}, {self.trees()} trees, {confidence(self.probes):.2f} better than the next"]
        lines += [f"transform {self.answer.transform}, within {self.answer.low:.6g} and {self.answer.high:.6g}"] if self.answer.transform != "none" else []
        lines += [f"trials {len(self.trials.trials)}, best {self.trials.best().value:.6g}"] if self.trials and self.trials.trials else []
        lines += [f"seconds: {sum(self.seconds.values()):.1f} (" + ", ".join(f"{k} {v:.1f}" for k, v in self.seconds.items()) + ")"]
        lines += [f"shortened: {n}" for n in self.notes]
        lines += [f"dropped {c}: {why}" for c, why in sorted(self.dropped.items())]
        lines += [f"derived: {k} {v}" for k, v in asdict(self.features).items() if v]
        lines += [f"{c}: {v:.4f}" for c, v in top]
        return "\n".join(lines)

    def config_json(self) -> str:
        part = self.model.models[0] if isinstance(self.model, Multiclass) else self.model.trees
        return json.dumps({"target": self.target, "task": self.task, "mode": getattr(self.model, "mode", "trees"), "tree": asdict(part.config), "features": asdict(self.features)}, sort_keys=True)


#: The column that holds the target as it is learnt.
LEARNT = "__learnt"


def confidence(probes: dict[str, float]) -> float:
    """By how much of its error the best mode beats the next; 0 without another."""
    ranked = sorted(probes.values())
    return 1 - ranked[0] / ranked[1] if len(ranked) > 1 and ranked[1] > 0 else 0.0


def linear_r2(df: DataFrame, columns: list[str], target: str) -> float:
    """How much of the target's variance a ridge over the columns explains, from one aggregation."""
    if not columns:
        return 0.0
    out = df.withColumn("__p", fit_linear(df, columns, target).column())
    return out.agg(regression_metrics(F.col(target).cast("double"), F.col("__p"))["r2"]).first()[0] or 0.0


def error_of(task: str, df: DataFrame, classes: int = 0) -> float:
    """The task's error of a table with the learnt target and ``prediction`` (or ``p_0``, ``p_1``, ...)."""
    y = F.col(LEARNT)
    if task == "multiclass":
        return df.agg(multiclass_log_loss(y, [F.col(f"p_{k}") for k in range(classes)])).first()[0] or 0.0
    metrics = regression_metrics if task == "regression" else binary_metrics
    return df.agg(metrics(y, F.col("prediction"))[ERRORS[task]]).first()[0] or 0.0


def halved(rows: DataFrame, features: list[str], key: str, task: str, classes: int, cfg: TreeConfig, level: str, budget: Budget, round_seconds: float, log: History, fraction: float = 0.2) -> TreeConfig:
    """The best of a level's trials: all are trained for few rounds, and each stage keeps the better third for three times as many.

    The trials of a stage are one cohort; of several classes each trial is one. A stage that
    doesn't fit into the budget isn't begun.
    """
    trials, stages = LEVELS[level]
    left = [known_settings(cfg, p) for p in grid(SPACE, trials, {}, 1.0, cfg.seed)] if trials else []
    params = {i: {p.name: getattr(c, p.name) for p in SPACE} for i, c in enumerate(left)}
    alive = list(range(len(left)))
    parts = holdout(rows, key, fraction)
    for stage in range(stages):
        rounds = max(1, round(cfg.rounds / 3 ** (stages - 1 - stage)))
        # One more member of a cohort costs part of a training, one more class model all of it.
        each = 1.0 if task == "multiclass" else 0.3
        if not budget.fits("tuning", round_seconds * rounds * (1 + each * (len(alive) - 1))):
            break
        configs = [replace(left[i], rounds=rounds, loss=cfg.loss) for i in alive]
        if task == "multiclass":
            values = []
            for c in configs:
                model = train_multiclass(parts.where("split = 'train'"), features, LEARNT, key, classes, c)
                values.append(error_of(task, model.predict_proba(parts.where("split = 'validation'")), classes))
        else:
            known = [asdict(c) for c in configs]
            values = [g["value"] for g in TreeTrials(features, LEARNT, key, cfg).together(rows, known, "holdout", ERRORS[task], fraction)]
        log.trials += [Trial(stage, params[i], v, 1.0) for i, v in zip(alive, values)]
        alive = [i for _, i in sorted(zip(values, alive))][: max(1, math.ceil(len(alive) / 3))]
        if len(alive) == 1:
            break
    return replace(left[alive[0]], rounds=cfg.rounds, loss=cfg.loss) if log.trials else cfg


def build(df: DataFrame, target: str, key: str, cfg: AutoConfig = AutoConfig(), mode: str | None = None, validation: DataFrame | None = None, on_phase: Callable[[str, float], None] | None = None, clock: Callable[[], float] = time.monotonic) -> AutoModel:
    """Profile, drop useless columns, plan and derive features, encode, preprocess, probe the modes on held-out rows, tune, train the best on all rows.

    Losses and metrics follow the task: a squared error for numbers, log-loss for two classes,
    the softmax of all for up to 20; targets of text are classes. With ``cfg.budget`` the time
    that each phase took tells what the next ones may do: features are left out, probes and
    stages of trials not begun, rounds shortened. ``validation`` is a table to probe on in
    place of a share of the rows. Encodings, and trainings that need no keys, work on rows alike
    with their number, where a sketch tells few kinds. After each phase ``on_phase(name, seconds)`` is called.
    """
    with Scratch(df.sparkSession, "auto") as scratch:
        return built(scratch, df, target, key, cfg, mode, validation, on_phase, clock)


def built(scratch: Scratch, df: DataFrame, target: str, key: str, cfg: AutoConfig, mode: str | None, validation: DataFrame | None, on_phase: Callable[[str, float], None] | None, clock: Callable[[], float]) -> AutoModel:
    budget = Budget(cfg.budget, on_phase, clock)
    with budget.phase("profile"):
        answer = Answer.of(df, target, cfg.transform)
        task, classes = answer.task, len(answer.classes)
        tree = replace(cfg.tree, loss=cfg.loss or (LOSS[task] if cfg.tree.loss == "mse" else cfg.tree.loss))
        df = df.withColumn(LEARNT, answer.learnt(target))
        found = {r.column: r.asDict() for r in profile(df.drop(target, key, LEARNT), exact=False).collect()}
        dropped = {c: why for c, p in found.items() if (why := drop_reason(c, p))}
        useful = [c for c in found if c not in dropped]
        numeric = [c for c in numeric_columns(df) if c in useful]
    plan, kept = FeaturePlan(), []
    with budget.phase("features"):
        if cfg.engineer and budget.fits("features", 3 * budget.seconds["profile"]):
            plan = plan_features(df.select(*useful, LEARNT), useful, LEARNT, linear_r2(df, numeric, LEARNT))
            if cfg.group and cfg.time:
                plan.panel = {"group": cfg.group, "time": cfg.time, "columns": [c for c in numeric if c not in (cfg.group, cfg.time)]}
            base = df.select(*dict.fromkeys([key, target, LEARNT, *useful, *[c for c in (cfg.group, cfg.time) if c]]))
            derived = plan.names(base)
            kept = select_features(plan.apply(base), numeric, [c for c in derived if c not in numeric], LEARNT, top=cfg.most_features) if derived else []
    strings = [c for c in useful if c not in numeric and c not in plan.calendars]
    columns = [*numeric, *strings, *kept]
    rows = df.where(F.col(LEARNT).isNotNull())
    if validation is None:
        rows = holdout(rows, key, cfg.validation)
        train, test = rows.where("split <> 'validation'").drop("split"), rows.where("split = 'validation'").drop("split")
        rows = rows.drop("split")
    else:
        train, test = rows, validation.withColumn(LEARNT, answer.learnt(target)).where(F.col(LEARNT).isNotNull())
    linear = "linear_then_trees" in ((mode,) if mode else cfg.modes)

    def fitted(part: DataFrame) -> tuple[Pipeline, Chain, DataFrame, DataFrame | None]:
        """The encoding and stages, the encoded rows, and these as rows alike, if there are few kinds."""
        whole = plan.apply(part)
        read = [c for kind in split_by_type(whole, (LEARNT,)) for c in kind if c in columns]
        few = alike(whole.select(LEARNT, *read), [LEARNT, *read], KINDS) if read else None
        few = None if few is None else scratch.put(few)
        encoding = Pipeline(LEARNT, PipelineConfig(bins=tree.bins)).fit(whole if few is None else few, columns)
        encoded = encoding.encode(whole, [key, target, LEARNT])
        names = [f.name for f in encoding.features]
        stages = Chain(*preprocessing(plan_preprocessing([r.asDict() for r in profile(encoded, names, exact=False).collect()], linear=linear)))
        stages.fit(encoded)
        return encoding, stages, stages.transform(encoded), None if few is None else stages.transform(encoding.encode(few, [LEARNT, COUNT]))

    def trained(m: str, part: DataFrame, few: DataFrame | None, names: list[str], config: TreeConfig, on_round=None) -> Universal | Multiclass:
        if task == "multiclass":
            return train_multiclass(part, names, LEARNT, key, classes, config, on_round=on_round)
        # Forests sample by keys, and so do Newton fits' trees, which start from each row's score.
        alone = few is None or m == "forest" or keyed(config) or (m == "linear_then_trees" and LOSSES[config.loss].link != "identity")
        return train_universal(part if alone else few, names, LEARNT, key, m, config, on_round)

    with budget.phase("encode"):
        encoding, stages, encoded, few = fitted(train)
        names = [f.name for f in encoding.features]
        ready = stages.transform(encoding.encode(plan.apply(test), [key, target, LEARNT]))
    short = replace(tree, rounds=min(3, tree.rounds))
    probes: dict[str, float] = {}
    round_seconds = 0.0
    with budget.phase("probes"):
        for m in (mode,) if mode else ("trees",) if task == "multiclass" else cfg.modes:
            if probes and not budget.fits("probes", round_seconds * short.rounds):
                continue
            begun = clock()
            model = trained(m, encoded, few, names, short)
            round_seconds = max(round_seconds, (clock() - begun) / short.rounds)
            probes[m] = error_of(task, model.predict_proba(ready) if task == "multiclass" else model.predict(ready), classes)
    best, log = min(probes, key=probes.get), History()
    if LEVELS[cfg.tuning][0]:
        with budget.phase("tuning"):
            tree = halved(encoded, names, key, task, classes, tree, cfg.tuning, budget, round_seconds, log, cfg.validation)
    with budget.phase("encode"):
        encoding, stages, encoded, few = fitted(rows)
    with budget.phase("train"):
        fit = max(1, min(tree.rounds, int(SHARE["train"] * budget.left() / round_seconds))) if round_seconds and cfg.budget is not None else tree.rounds
        if fit < tree.rounds:
            budget.notes.append(f"train: {fit} of {tree.rounds} rounds")
        tree = replace(tree, rounds=fit)
        in_time = None if cfg.budget is None else lambda r, v: budget.left() > round_seconds
        model = trained(best, encoded, few, names, tree, in_time)
        others = []
        for k in range(1, cfg.seeds if task != "multiclass" else 1):
            if budget.fits("train", round_seconds * tree.rounds):
                others.append(trained(best, encoded, few, names, replace(tree, seed=tree.seed + k, subsample=min(0.8, tree.subsample)), in_time))
    return AutoModel(target, key, task, plan, encoding, stages, model, probes, dropped, budget.seconds, answer, others, budget.notes, log)


def quick(df: DataFrame, target: str, key: str, **more) -> AutoModel:
    return build(df, target, key, AutoConfig(tuning="quick"), **more)


def standard(df: DataFrame, target: str, key: str, **more) -> AutoModel:
    return build(df, target, key, AutoConfig(tuning="standard", tree=TreeConfig(rounds=50, rate=0.1)), **more)


def thorough(df: DataFrame, target: str, key: str, **more) -> AutoModel:
    return build(df, target, key, AutoConfig(tuning="thorough", seeds=3, tree=TreeConfig(rounds=100, rate=0.1)), **more)


@dataclass
class LabelsModel:
    """Several 0/1 targets together: the mode that did best on held-out rows, and a threshold for each label."""

    labels: list[str]
    features: list[str]
    mode: str
    model: tuple
    thresholds: dict[str, float]
    probes: dict[str, float]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds each label's probability ``p_<label>`` and decision ``is_<label>``."""
        out = labels_predicted(df, self.mode, self.model, self.labels)
        return out.withColumns({f"is_{y}": (F.col(f"p_{y}") >= self.thresholds[y]).cast("int") for y in self.labels})


def labels_predicted(df: DataFrame, mode: str, model: tuple, labels: list[str]) -> DataFrame:
    return (predict_multilabel_linear if mode == "linear_then_trees" else predict_multilabel)(df, model, labels)


def build_labels(df: DataFrame, features: list[str], labels: list[str], key: str, cfg: AutoConfig = AutoConfig(), mode: str | None = None) -> LabelsModel:
    """Vector trees, by themselves or after a linear part, whichever has less log-loss on held-out rows; thresholds of best F1 there; then trained on all rows."""
    train = {"trees": train_multilabel, "linear_then_trees": train_multilabel_linear}
    rows = holdout(df, key, cfg.validation)
    part, test = rows.where("split <> 'validation'").drop("split"), rows.where("split = 'validation'").drop("split")
    probes, found = {}, {}
    for m in (mode,) if mode else [m for m in cfg.modes if m in train]:
        found[m] = labels_predicted(test, m, train[m](part, features, labels, cfg.tree), labels)
        losses = found[m].agg(*[binary_metrics(F.col(y), F.col(f"p_{y}"))["log_loss"].alias(y) for y in labels]).first()
        probes[m] = sum(v or 0.0 for v in losses) / len(labels)
    best = min(probes, key=probes.get)
    cuts = {r.label: r.threshold for r in label_thresholds(found[best], [(y, f"p_{y}") for y in labels]).collect()}
    return LabelsModel(labels, features, best, train[best](df, features, labels, cfg.tree), cuts, probes)
