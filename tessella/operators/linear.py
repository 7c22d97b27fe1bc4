"""Linear models from one Gram aggregation, linear-then-tree models, linear trees, stacking."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.losses import LOSSES
from tessella.operators.cohorts import Member, boost
from tessella.operators.encoding import COUNT
from tessella.operators.gram import products
from tessella.operators.trees import GBDT, Node, TreeConfig, train_gbdt, tree_value


def gram(df: DataFrame, columns: list[Column], y: Column, by: Column | None = None, weight: Column | None = None) -> dict:
    """n, X'X, X'y and y'y with an intercept, for all rows (0) or for each group: one pass, its result bounded by the columns.

    All rows are summed as blocks of a matrix, groups as expressions. With a weight, sums are weighted.
    """
    xs = [F.lit(1.0), *columns, y]
    if by is None:
        return {0: products(df, xs, weight)}
    terms = [F.sum(xs[i] * xs[j]).alias(f"s{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    out = {}
    for r in df.groupBy(by.alias("group")).agg(*terms).collect():
        m = np.zeros((len(xs), len(xs)))
        for i in range(len(xs)):
            for j in range(i, len(xs)):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r.group] = m
    return out


def solve(m: np.ndarray, lam: float = 1.0, l1_ratio: float = 0.0, most: float = 100.0, steps: int = 200, start: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """Intercept and weights of a ridge, lasso or elastic net on standardised columns, from a Gram matrix.

    ``start`` are weights (intercept first) that the descent begins from; ``scale`` are
    deviations to standardise by in place of the matrix's own.
    """
    k = len(m) - 2
    n = max(m[0, 0], 1.0)
    mean, my = m[0, 1 : k + 1] / n, m[0, -1] / n
    cov = m[1 : k + 1, 1 : k + 1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scale is None else scale
    sd = np.where(sd < 1e-8, 1.0, sd)
    a, b = cov / np.outer(sd, sd), (m[1 : k + 1, -1] / n - mean * my) / sd
    w = np.zeros(k) if start is None else np.asarray(start[1:]) * sd
    l1, l2 = lam * l1_ratio / n, lam * (1 - l1_ratio) / n
    for _ in range(steps):
        old = w.copy()
        for j in range(k):
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.clip(np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2 + 1e-12), -most, most)
        if np.abs(w - old).max(initial=0) < 1e-10:
            break
    w = w / sd
    return np.r_[my - w @ mean, w]


@dataclass
class Linear:
    features: list[str]
    weights: list[float]
    mean: float = 0.0
    damping: float = 0.0

    def column(self) -> Column:
        out = F.lit(float(self.weights[0]))
        for f, w in zip(self.features, self.weights[1:]):
            out = out + F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return (1 - self.damping) * out + F.lit(self.damping * self.mean)


def fit_linear(df: DataFrame, features: list[str], target: str, lam: float = 1.0, l1_ratio: float = 0.0, damping: float = 0.0, start: np.ndarray | None = None) -> Linear:
    m = gram(df, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.col(target).cast("double"), weight=F.col(COUNT) if COUNT in df.columns else None)
    m = m.get(0, np.zeros((len(features) + 2,) * 2))
    return Linear(features, solve(m, lam, l1_ratio, start=start).tolist(), float(m[0, -1] / max(m[0, 0], 1.0)), damping)


#: Parts of a Newton step that are tried, the first that lowers the penalised loss is taken.
HALVINGS = (1.0, 0.5, 0.25, 0.0625)


def fit_newton(df: DataFrame, features: list[str], target: str, loss: str = "log_loss", lam: float = 1.0, l1_ratio: float = 0.0, start: np.ndarray | None = None, steps: int = 25, tolerance: float = 1e-9) -> Linear:
    """Elastic net by the loss itself: each step solves a weighted least-squares problem on Newton's working response.

    A step is two passes: the Gram matrix weighted by the hessians, which descent starts on
    from the weights at hand, and the penalised loss at a few shares of the step. The
    prediction is on the loss's raw scale (log-odds for ``log_loss``). Columns are
    standardised by their deviations over all rows; the intercept isn't penalised. Rows
    without a target take no part; missing features count as 0.
    """
    of, y = LOSSES[loss], F.col(target).cast("double")
    df = df.where(y.isNotNull())
    xs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    plain = gram(df, xs, y)[0]
    n = max(plain[0, 0], 1.0)
    scale = np.sqrt(np.maximum(plain.diagonal()[1:-1] / n - (plain[0, 1:-1] / n) ** 2, 0))
    scale = np.where(scale < 1e-8, 1.0, scale)
    first = df.agg(of.start(y)).first()[0] if start is None and plain[0, 0] else None
    weights = np.r_[float(first or 0.0), np.zeros(len(features))] if start is None else np.asarray(start, float)

    def penalty(w: np.ndarray) -> float:
        v = w[1:] * scale
        return float(lam * (l1_ratio * np.abs(v).sum() + (1 - l1_ratio) * (v @ v) / 2))

    def losses(of_weights: list[np.ndarray]) -> list[float]:
        row = df.agg(*[F.sum(of.value(y, Linear(features, w.tolist()).column())).alias(f"v{i}") for i, w in enumerate(of_weights)]).first()
        return [float(v or 0.0) + penalty(w) for v, w in zip(row, of_weights)]

    best = losses([weights])[0]
    for _ in range(steps):
        eta = Linear(features, weights.tolist()).column()
        rows = df.withColumn("__eta", eta)
        g, h = of.pair(y, F.col("__eta"))
        step = solve(gram(rows, xs, F.col("__eta") - g / h, weight=h)[0], lam, l1_ratio, start=weights, scale=scale, most=np.inf)
        ways = [weights + s * (step - weights) for s in HALVINGS]
        found = losses(ways)
        # Near the minimum the loss no longer tells steps apart; how far they go does.
        k = next((i for i, v in enumerate(found) if v <= best + 1e-12 * max(1.0, abs(best))), None)
        if k is None:
            break
        moved = np.abs(ways[k] - weights).max()
        weights, best = ways[k], min(best, found[k])
        if moved <= tolerance * (1 + np.abs(weights).max()):
            break
    return Linear(features, weights.tolist(), float(plain[0, -1] / n))


@dataclass
class Universal:
    """Trees alone, linear then trees on what it leaves, or a forest."""

    mode: str
    linear: Linear | None
    trees: GBDT
    target: str = ""
    key: str = ""
    history: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        loss = LOSSES[self.trees.config.loss]
        if self.linear and loss.link != "identity":
            # Both parts are scores before the link.
            rows = self.trees.with_values(df)
            return rows.withColumn(out, loss.response(self.trees.raw_of_values() + self.linear.column())).drop(*[f"__x_{f}" for f in self.trees.features])
        df = self.trees.predict(df, out)
        if not self.linear:
            return df
        # The interval is around the whole prediction: its bounds move with the linear part.
        moved = [out, f"{out}_low", f"{out}_high"][: 1 if self.trees.interval is None else 3]
        return df.withColumns({c: F.col(c) + self.linear.column() for c in moved})

    def update(self, df: DataFrame, rounds: int, blend: float = 0.0) -> Universal:
        """Adds trees fitted to what the model leaves of a new batch.

        With ``blend`` the linear part first moves that share of the way to a fit of the
        batch's targets less the trees, which starts from the weights at hand.
        """
        linear, loss = self.linear, LOSSES[self.trees.config.loss]
        if linear and loss.link != "identity":
            if blend:
                fresh = fit_newton(df, linear.features, self.target, loss.name, start=np.array(linear.weights))
                linear = replace(linear, weights=((1 - blend) * np.array(linear.weights) + blend * np.array(fresh.weights)).tolist())
            rows, held = self.trees.with_bins(df), self.trees
            more = boost(rows, held.features, self.key, [Member(replace(held.config, rounds=rounds), self.target)], bounds=held.bounds, offset=held.raw() + linear.column()).models[0]
            return Universal(self.mode, linear, held.appended(more.trees), self.target, self.key, [*self.history, f"+{rounds}"])
        if linear and blend:
            rest = self.trees.predict(df, "__t").withColumn("__t", F.col(self.target) - F.col("__t"))
            fresh = fit_linear(rest, linear.features, "__t", start=np.array(linear.weights))
            mixed = ((1 - blend) * np.array(linear.weights) + blend * np.array(fresh.weights)).tolist()
            linear = Linear(linear.features, mixed, (1 - blend) * linear.mean + blend * fresh.mean, linear.damping)
        left = df.withColumn("__y", F.col(self.target) - linear.column()) if linear else df.withColumn("__y", F.col(self.target))
        trees = train_gbdt(left, self.trees.features, "__y", self.key, replace(self.trees.config, rounds=rounds), self.trees)
        return Universal(self.mode, linear, trees, self.target, self.key, [*self.history, f"+{rounds}"])


def train_universal(df: DataFrame, features: list[str], target: str, key: str, mode: str = "trees", cfg: TreeConfig = TreeConfig(), on_round=None) -> Universal:
    """One of the modes by the configuration's loss: with a link, the linear part is a Newton fit and the trees add to its scores."""
    if mode == "linear_then_trees" and LOSSES[cfg.loss].link != "identity":
        linear = fit_newton(df, features, target, cfg.loss)
        trees = boost(df, features, key, [Member(cfg, target)], offset=linear.column(), on_round=None if on_round is None else lambda r, v: on_round(r, v[0])).models[0]
        return Universal(mode, linear, trees, target, key)
    if mode == "linear_then_trees":
        linear = fit_linear(df, features, target)
        left = df.withColumn("__y", F.col(target) - linear.column())
        return Universal(mode, linear, train_gbdt(left, features, "__y", key, cfg, on_round=on_round), target, key)
    cfg = replace(cfg, forest=True, rate=1.0) if mode == "forest" else cfg
    return Universal(mode, None, train_gbdt(df, features, target, key, cfg, on_round=on_round), target, key)


@dataclass
class LinearTree:
    """A tree whose leaves hold ridge models."""

    base: GBDT
    leaves: dict[int, list[float]]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        df = self.base.with_bins(df).withColumn("__leaf", leaf_index(self.base))
        value = F.lit(self.base.base)
        for k, w in self.leaves.items():
            value = F.when(F.col("__leaf") == k, Linear(self.base.features, w).column()).otherwise(value)
        return df.withColumn(out, value).drop("__leaf", *[f"__b_{f}" for f in self.base.features])


def leaf_index(model: GBDT) -> Column:
    tree = [replace(n, value=float(i)) for i, n in enumerate(model.trees[0])]
    return tree_value(tree, {f: F.col(f"__b_{f}") for f in model.features}).cast("int")


def train_linear_tree(df: DataFrame, features: list[str], target: str, key: str, depth: int = 4, leaves: int = 15, least: int = 20) -> LinearTree:
    base = train_gbdt(df, features, target, key, TreeConfig(rounds=1, rate=1.0, depth=depth, leaves=leaves, least_rows=least))
    rows = base.with_bins(df)
    m = gram(rows, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.col(target).cast("double"), leaf_index(base))
    return LinearTree(base, {k: solve(v).tolist() for k, v in m.items()})


def stack(df: DataFrame, predictions: list[str], target: str, alpha: float = 1.0, least: float = 0.0) -> Linear:
    """Ridge weights of out-of-fold predictions; weights below ``least`` are clipped to it."""
    m = gram(df, [F.col(p).cast("double") for p in predictions], F.col(target).cast("double"))[0]
    a = m[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * len(predictions))
    w = np.linalg.solve(a, m[:-1, -1])
    return Linear(predictions, [float(w[0]), *np.maximum(w[1:], least).tolist()])


def hill_climb(df: DataFrame, predictions: list[str], target: str, most: int = 10) -> list[str]:
    """Greedy choice of predictions, each once, while the mean of the chosen lowers the squared error."""
    m = gram(df, [F.col(p).cast("double") for p in predictions], F.col(target).cast("double"))[0]
    n, chosen, best = max(m[0, 0], 1.0), [], np.inf

    def error(ids: list[int]) -> float:
        w = np.zeros(len(m))
        w[[i + 1 for i in ids]] = 1 / len(ids)
        w[-1] = -1
        return float(w @ m @ w) / n

    while len(chosen) < min(most, len(predictions)):
        e, i = min((error([*chosen, i]), i) for i in range(len(predictions)) if i not in chosen)
        if e >= best:
            break
        best, chosen = e, [*chosen, i]
    return [predictions[i] for i in chosen]


__all__ = ["Linear", "LinearTree", "Node", "Universal", "fit_linear", "gram", "hill_climb", "solve", "stack", "train_linear_tree", "train_universal"]
