"""Multi-label and multi-seed training, out-of-fold predictions, gated predictors."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.losses import LOSSES
from tessella.functions.scalar import sigmoid
from tessella.operators.cohorts import cross_validated
from tessella.operators.encoding import binned, boundaries
from tessella.operators.linear import Linear, fit_linear
from tessella.operators.trees import REFRESH, TIE, Node, TreeConfig
from tessella.sources.staging import Scratch


def vector_histogram(df: DataFrame, bins: dict[str, Column], g: list[Column], h: list[Column], node: Column) -> DataFrame:
    """(node, feature, bin, n, g0, h0, g1, h1, ...): all outputs' sums in one aggregation."""
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), b.alias("bin")) for i, b in enumerate(bins.values())])).alias("x")
    rows = df.select(node.alias("node"), *[c.alias(f"g{k}") for k, c in enumerate(g)], *[c.alias(f"h{k}") for k, c in enumerate(h)], long)
    sums = [F.sum(f"{s}{k}").alias(f"{s}{k}") for k in range(len(g)) for s in "gh"]
    return rows.groupBy("node", F.col("x.feature").alias("feature"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"), *sums)


def vector_tree(df: DataFrame, bins: dict[str, Column], g: list[Column], h: list[Column], cfg: TreeConfig) -> list[tuple[Node, list[float]]]:
    """One tree for all outputs: splits by the sum of their gains, a value for each output in every leaf.

    Missing values (bin 0) go to the side that gains more, to the left if there are none.
    """
    k, lam = len(g), cfg.lam
    tree: list[tuple[Node, list[float]]] = [(Node(), [0.0] * k)]
    open_nodes = {0}

    def place(at: int = 0) -> Column:
        n = tree[at][0]
        return F.lit(at) if n.left < 0 else F.when(goes_left(n, bins), place(n.left)).otherwise(place(n.right))

    for depth in range(cfg.depth + 1):
        rows = df.withColumn("__node", place()).where(F.col("__node").isin(sorted(open_nodes)))
        hist = vector_histogram(rows, bins, g, h, F.col("__node")).collect()
        by: dict[int, dict[int, dict[int, list[float]]]] = {}
        for r in hist:
            by.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = [r.n, *(r[f"{s}{i}"] for i in range(k) for s in "gh")]
        open_nodes = set()
        for at in sorted(by):
            total = [sum(c) for c in zip(*next(iter(by[at].values())).values())]
            n = tree[at][0]
            n.rows = int(total[0])
            tree[at][1][:] = [-total[1 + 2 * i] / (total[2 + 2 * i] + lam) * cfg.rate for i in range(k)]
            score = lambda v: sum(v[1 + 2 * i] ** 2 / (v[2 + 2 * i] + lam) for i in range(k))
            best = None
            for f in sorted(by[at]) if depth < cfg.depth else ():
                for missing_left in (True, False) if 0 in by[at][f] else (True,):
                    left = [0.0] * len(total)
                    for b in sorted(by[at][f]):
                        if not missing_left and b == 0:
                            continue
                        left = [x + y for x, y in zip(left, by[at][f][b])]
                        right = [x - y for x, y in zip(total, left)]
                        if min(left[0], right[0]) < max(1, cfg.least_rows):
                            continue
                        gain = 0.5 * (score(left) + score(right) - score(total))
                        if gain > max(cfg.least_gain, 1e-12) and (best is None or gain > best[0] * (1 + TIE)):
                            best = (gain, f, b, missing_left)
            if best:
                n.gain, n.feature, n.bin, n.missing_left = best
                n.left, n.right = len(tree), len(tree) + 1
                tree += [(Node(), [0.0] * k), (Node(), [0.0] * k)]
                open_nodes |= {n.left, n.right}
        if not open_nodes:
            break
    return tree


def goes_left(n: Node, bins: dict[str, Column]) -> Column:
    x = bins[list(bins)[n.feature]]
    return (x <= n.bin) if n.missing_left else (x <= n.bin) & (x > 0)


def vector_value(tree: list, bins: dict[str, Column], output: int, at: int = 0) -> Column:
    n, values = tree[at]
    if n.left < 0:
        return F.lit(float(values[output]))
    return F.when(goes_left(n, bins), vector_value(tree, bins, output, n.left)).otherwise(vector_value(tree, bins, output, n.right))


def train_multilabel(df: DataFrame, features: list[str], labels: list[str], cfg: TreeConfig, offsets: dict[str, Column] | None = None, loss: str = "log_loss") -> tuple[dict, list[float], list]:
    """(bounds, base log-odds, trees) of vector trees on every label's loss, ``log_loss`` or ``focal``.

    ``offsets`` are raw scores that the trees add to, in place of the labels' base rates. A
    row without one of the labels takes no part in that label. The binned rows and their raw
    scores are a written table, which ends the lineage every few rounds.
    """
    of = LOSSES[loss]
    bounds = boundaries(df, features, cfg.bins)
    means = df.agg(*[F.avg(y).alias(y) for y in labels]).first()
    base = [0.0 if offsets else math.log(min(max(means[y] or 0.0, 1e-6), 1 - 1e-6) / (1 - min(max(means[y] or 0.0, 1e-6), 1 - 1e-6))) for y in labels]
    start = [offsets[y] if offsets else F.lit(b) for y, b in zip(labels, base)]
    columns = [*[F.col(y).cast("double").alias(f"__y{k}") for k, y in enumerate(labels)], *[s.cast("double").alias(f"__r{k}") for k, s in enumerate(start)], *[binned(F.col(f), bounds[f]).cast("short").alias(f"__b_{f}") for f in features]]
    bins = {f: F.col(f"__b_{f}") for f in features}
    trees: list = []
    with Scratch(df.sparkSession, "labels") as scratch:
        scored = scratch.put(df.select(*columns))
        for r in range(cfg.rounds):
            pairs = [of.pair(F.col(f"__y{k}"), F.col(f"__r{k}")) for k in range(len(labels))]
            g, h = ([F.coalesce(p[i], F.lit(0.0)) for p in pairs] for i in (0, 1))
            h = [F.when(F.col(f"__y{k}").isNull(), 0.0).otherwise(x) for k, x in enumerate(h)]
            trees.append(vector_tree(scored, bins, g, h, cfg))
            scored = scored.withColumns({f"__r{k}": F.col(f"__r{k}") + vector_value(trees[-1], bins, k) for k in range(len(labels))})
            if (r + 1) % REFRESH == 0:
                scored = scratch.replace(scored)
    return bounds, base, trees


def train_multilabel_linear(df: DataFrame, features: list[str], labels: list[str], cfg: TreeConfig, lam: float = 1.0) -> tuple[dict[str, Linear], tuple]:
    """Linear then trees for several labels: a ridge for each on its labels as -2 and 2, then vector trees on what they leave."""
    linear = {y: fit_linear(df.withColumn("__t", 4 * F.col(y) - 2), features, "__t", lam) for y in labels}
    return linear, train_multilabel(df, features, labels, cfg, {y: m.column() for y, m in linear.items()})


def predict_multilabel_linear(df: DataFrame, model: tuple[dict[str, Linear], tuple], labels: list[str]) -> DataFrame:
    linear, (bounds, _, trees) = model
    bins = {f: binned(F.col(f), b) for f, b in bounds.items()}
    return df.withColumns({f"p_{y}": sigmoid(sum((vector_value(t, bins, k) for t in trees), linear[y].column())) for k, y in enumerate(labels)})


def predict_multilabel(df: DataFrame, model: tuple[dict, list[float], list], labels: list[str]) -> DataFrame:
    bounds, base, trees = model
    bins = {f: binned(F.col(f), b) for f, b in bounds.items()}
    return df.withColumns({f"p_{y}": sigmoid(sum((vector_value(t, bins, k) for t in trees), F.lit(b))) for k, (y, b) in enumerate(zip(labels, base))})


def out_of_fold(df: DataFrame, features: list[str], target: str, key: str, cfg: TreeConfig, seeds: list[int], folds: int = 3, fold: Column | None = None, share: float = 0.8) -> DataFrame:
    """key, target and a column of out-of-fold predictions for each seed, which draws its ``share`` of the rows for each tree; all seeds and folds are trained in one pass."""
    rows, _ = cross_validated(df, features, target, key, [replace(cfg, seed=s, subsample=share) for s in seeds], folds, fold)
    return rows.select(key, target, *(F.col(f"p_{i}").alias(f"oof_{s}") for i, s in enumerate(seeds)))


def uncertainty(probabilities: list[Column]) -> Column:
    """Entropy of a distribution over its largest possible value."""
    h = sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in probabilities), F.lit(0.0))
    return h / math.log(max(2, len(probabilities)))


def gated(first: Column, second: Column, doubt: Column, limit: float) -> Column:
    """The first prediction where it is sure enough, else the second."""
    return F.when(doubt <= limit, first).otherwise(second)
