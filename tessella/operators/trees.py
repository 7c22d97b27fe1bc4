"""Histogram gradient boosting: one aggregation for each level, split choice on the driver, scoring as expressions."""

from __future__ import annotations

import heapq
import json
import math
import random
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.losses import LOSSES, Loss, entropy2
from tessella.operators.encoding import COUNT, binned, boundaries, lowered
from tessella.operators.ordering import quantiles
from tessella.sources.staging import Scratch


def histogram(df: DataFrame, bins: dict[str, Column], g: Column, h: Column, *keys: Column) -> DataFrame:
    """(keys, feature, bin, g, h, n): gradient sums of every feature's bins in one aggregation, partial sums before the shuffle."""
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), b.alias("bin")) for i, b in enumerate(bins.values())])).alias("x")
    rows = df.select(*keys, g.alias("g"), h.alias("h"), long)
    return rows.groupBy(*rows.columns[: len(keys)], F.col("x.feature").alias("feature"), F.col("x.bin").alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def split_gains(hist: DataFrame, lam: float = 1.0, least_rows: int = 1, least_hessian: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The gain of every split "bin at most b goes left" by prefix sums along the bins."""
    part = Window.partitionBy(*keys, "feature")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.withColumns({f"{c}l": F.sum(c).over(run) for c in "ghn"} | {f"{c}t": F.sum(c).over(part) for c in "ghn"})
    score = lambda g, h: g * g / (h + F.lit(lam))
    gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(F.col("gt"), F.col("ht")))
    ok = (F.col("nl") >= least_rows) & (F.col("nt") - F.col("nl") >= least_rows) & (hl >= least_hessian) & (hr >= least_hessian)
    return s.where(ok).select(*keys, "feature", "bin", F.col("nl").alias("n_left"), (F.col("nt") - F.col("nl")).alias("n_right"), gain.alias("gain"))


def best_splits(gains: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each node's split of largest gain; ties go to the lowest feature, then the lowest bin."""
    order = Window.partitionBy(*keys).orderBy(F.desc("gain"), "feature", "bin")
    return gains.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def era_splits(hist: DataFrame, lam: float = 1.0) -> DataFrame:
    """Splits that send the same side up in every era, with the eras' mean gain; ``hist`` is keyed by era."""
    spine = hist.select("feature", "bin").distinct().crossJoin(hist.select("era").distinct())
    full = spine.join(hist, ["era", "feature", "bin"], "left").fillna(0, ["g", "h", "n"])
    part = Window.partitionBy("era", "feature")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = full.withColumns({f"{c}l": F.sum(c).over(run) for c in "gh"} | {f"{c}t": F.sum(c).over(part) for c in "gh"})
    gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - F.col("gt") * F.col("gt") / (F.col("ht") + lam))
    up = F.signum(-gl / (hl + lam) + gr / (hr + lam))
    agg = s.select("era", "feature", "bin", gain.alias("gain"), up.alias("up")).groupBy("feature", "bin").agg(F.avg("gain").alias("gain"), F.min("up").alias("a"), F.max("up").alias("b"))
    return agg.where("a = b and a <> 0").select("feature", "bin", "gain", F.col("a").cast("int").alias("direction"))


#: Gains that differ by less are equal, so that the order of sums doesn't choose a split.
TIE = 1e-9
#: Rounds after which predictions become data again.
REFRESH = 5
#: Rounds of a forest whose bootstrap weights are summed over rows alike in one pass.
BLOCK = 16


@dataclass
class Node:
    feature: int = -1
    bin: int = -1
    value: float = 0.0
    left: int = -1
    right: int = -1
    gain: float = 0.0
    hessian: float = 0.0
    rows: int = 0
    missing_left: bool = True


@dataclass
class TreeConfig:
    rounds: int = 20
    rate: float = 0.1
    depth: int = 6
    leaves: int = 31
    least_rows: int = 1
    least_hessian: float = 1.0
    least_gain: float = 0.0
    lam: float = 1.0
    bins: int = 255
    loss: str = "mse"
    subsample: float = 1.0
    colsample: float = 1.0
    goss: tuple[float, float] | None = None
    prune: float = 0.0
    monotone: dict[str, int] = field(default_factory=dict)
    #: Features that may meet on one path; none means any.
    groups: list[list[str]] = field(default_factory=list)
    #: Weight of a binary target's information gain beside the gradient gain.
    entropy: float = 0.0
    forest: bool = False
    seed: int = 42
    patience: int = 0
    validation: float = 0.0
    calibration: float = 0.0
    quantile: float = 0.9


#: What each preset changes in a configuration.
PRESETS: dict[str, dict] = {
    "standard": {},
    "speed": {"depth": 4, "goss": (0.2, 0.1)},
    "accuracy": {"depth": 10, "rate": 0.05, "rounds": 200, "subsample": 0.8, "colsample": 0.8},
    "small_data": {"subsample": 1.0, "colsample": 1.0, "goss": None},
    "large_data": {"subsample": 0.8, "goss": (0.2, 0.1)},
    "robust": {"subsample": 0.8, "colsample": 0.8, "goss": None},
    "conformal": {"calibration": 0.2, "quantile": 0.9},
}


def preset(name: str, base: TreeConfig | None = None) -> TreeConfig:
    """A configuration (by default 100 rounds at a rate of 0.1) with a preset's settings; unknown names are an error."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}: one of {', '.join(PRESETS)}")
    return replace(base or TreeConfig(rounds=100), **PRESETS[name])


def uniform(key: Column, seed: int, salt: int = 0) -> Column:
    """A number in [0, 1) from a row's key: the same on every run and after every retry."""
    return F.pmod(F.xxhash64(key, F.lit(seed * 1_000_003 + salt)), F.lit(1 << 30)) / float(1 << 30)


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform number: bootstrap weights."""
    out, p, total = F.lit(0.0), math.exp(-1), 0.0
    for k in range(8):
        total += p
        out = out + (u >= total).cast("double")
        p /= k + 1
    return out


Histogram = dict[int, dict[int, tuple[float, float, int]]]


def collected(rows: list) -> dict[int, Histogram]:
    """Histogram rows by node, feature and bin."""
    by: dict[int, Histogram] = {}
    for r in rows:
        by.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h, r.n)
    return by


def sibling(parent: Histogram, child: Histogram) -> Histogram:
    """What the parent holds and the child doesn't: the other child's histogram, without another pass."""
    out: Histogram = {}
    for f, bins in parent.items():
        own = child.get(f, {})
        out[f] = {b: tuple(x - y for x, y in zip(v, own.get(b, (0.0, 0.0, 0)))) for b, v in bins.items() if v[2] > own.get(b, (0, 0, 0))[2]}
    return out


def totals(feats: Histogram) -> tuple[float, float, int]:
    return tuple(sum(x[i] for x in next(iter(feats.values())).values()) for i in range(3))


def best_split(feats: Histogram, cfg: TreeConfig, features: list[str], allowed: set[int], only: set[tuple[int, int]] | None = None) -> tuple | None:
    """A node's best split: (gain, feature, bin, direction of missing values, left sums, right sums).

    With ``only``, splits (feature, bin) outside it are passed over, and missing values go left.
    """
    G, H, N = totals(feats)
    best = None
    for f in sorted(set(feats) & allowed):
        bins = feats[f]
        mg, mh, mn = bins.get(0, (0.0, 0.0, 0))
        for missing_left in (True, False) if mn and only is None else (True,):
            g, h, n = (mg, mh, mn) if missing_left else (0.0, 0.0, 0)
            for b in sorted(bins):
                if b:
                    g, h, n = g + bins[b][0], h + bins[b][1], n + bins[b][2]
                if (only is not None and (f, b) not in only) or (not missing_left and not b) or n < cfg.least_rows or N - n < cfg.least_rows or h < cfg.least_hessian or H - h < cfg.least_hessian:
                    continue
                wl, wr = -g / (h + cfg.lam), -(G - g) / (H - h + cfg.lam)
                if (wr - wl) * cfg.monotone.get(features[f], 0) < 0:
                    continue
                gain = 0.5 * (g * g / (h + cfg.lam) + (G - g) ** 2 / (H - h + cfg.lam) - G * G / (H + cfg.lam))
                if cfg.entropy and N:
                    gain += cfg.entropy * information(g, h, n, G, H, N)
                if gain >= cfg.least_gain and (best is None or gain > best[0] * (1 + TIE)) and gain > 0:
                    best = (gain, f, b, missing_left, (g, h, n), (G - g, H - h, N - n))
    return best


def information(g: float, h: float, n: int, G: float, H: float, N: int) -> float:
    """Bits that a split tells of a binary target, from the mean gradients' shares of the hessians' range."""
    share = lambda g, n: min(1.0, max(0.0, 0.5 - g / n / 2)) if n else 0.0
    return entropy2(share(G, N)) - n / N * entropy2(share(g, n)) - (N - n) / N * entropy2(share(G - g, N - n))


def consistent(rows: list, cfg: TreeConfig) -> dict[int, set[tuple[int, int]]]:
    """By node, the splits (feature, bin) that send the same side up in every era, from rows keyed by node and era."""
    by: dict[int, dict[int, dict[int, dict[int, tuple[float, float]]]]] = {}
    for r in rows:
        by.setdefault(r.node, {}).setdefault(r.feature, {}).setdefault(r.era, {})[r.bin] = (r.g, r.h)
    kept: dict[int, set[tuple[int, int]]] = {}
    for node, feats in by.items():
        for f, eras in feats.items():
            for b in sorted({b for x in eras.values() for b in x}):
                ways = set()
                for bins in eras.values():
                    G, H = (sum(v[i] for v in bins.values()) for i in (0, 1))
                    g, h = (sum(v[i] for k, v in bins.items() if k <= b) for i in (0, 1))
                    x = (G - g) / (H - h + cfg.lam) - g / (h + cfg.lam)
                    ways.add((x > 0) - (x < 0))
                if len(ways) == 1 and 0 not in ways:
                    kept.setdefault(node, set()).add((f, b))
    return kept


def grow(df: DataFrame, bins: dict[str, Column], g: Column, h: Column, cfg: TreeConfig, allowed: set[int], era: Column | None = None) -> list[Node]:
    """Best-first growth: levels are histogrammed one job each, then the frontier is replayed by gain.

    Of two children only the smaller one's rows are read; the other's histogram is what the
    parent's leaves. A row finds its node by nested conditions, one for each level. With an
    era column only splits that point the same way in every era are taken; then both
    children are read, since their histograms are kept by era. With ``cfg.groups`` a path
    may only split on features of one group together.
    """
    features = list(bins)
    group_sets = [{features.index(f) for f in group if f in bins} for group in cfg.groups]
    splits: dict[int, tuple] = {}
    sums: dict[int, tuple] = {}
    hists: dict[int, Histogram] = {}
    used: dict[int, frozenset[int]] = {1: frozenset()}

    def place(k: int = 1) -> Column:
        if k not in splits:
            return F.lit(k)
        _, f, b, missing_left, *_ = splits[k]
        x = bins[features[f]]
        goes = (x <= b) if missing_left else (x <= b) & (x > 0)
        return F.when(goes, place(2 * k)).otherwise(place(2 * k + 1))

    read, derived = [1], []
    for _ in range(cfg.depth):
        rows = df.withColumn("__node", place()).where(F.col("__node").isin(read))
        if era is None:
            found, only = collected(histogram(rows, bins, g, h, F.col("__node").alias("node")).collect()), None
        else:
            each = histogram(rows, bins, g, h, F.col("__node").alias("node"), era.alias("era")).collect()
            only = consistent(each, cfg)
            found = {}
            for r in each:
                x = found.setdefault(r.node, {}).setdefault(r.feature, {})
                a = x.get(r.bin, (0.0, 0.0, 0))
                x[r.bin] = (a[0] + r.g, a[1] + r.h, a[2] + r.n)
        hists |= found
        for k in derived:
            hists[k] = sibling(hists[k // 2], hists.get(k ^ 1, {}))
        read, derived, level = [], [], sorted([*found, *derived])
        for k in level:
            if not any(hists[k].values()):
                continue
            sums[k] = totals(hists[k])
            may = allowed
            if group_sets and used[k]:
                may = allowed & set().union(*[s for s in group_sets if used[k] <= s])
            best = best_split(hists[k], cfg, features, may, None if only is None else only.get(k, set()))
            if best:
                splits[k] = best
                used[2 * k] = used[2 * k + 1] = used[k] | {best[1]}
                small = 2 * k if best[4][2] <= best[5][2] else 2 * k + 1
                read.append(small)
                (derived if era is None else read).append(small ^ 1)
        hists = {k: v for k, v in hists.items() if 2 * k in used}
        if not read:
            break
    return replayed(splits, sums, cfg)


def replayed(splits: dict[int, tuple], sums: dict[int, tuple], cfg: TreeConfig) -> list[Node]:
    """The tree that best-first growth picks from all levels' splits and sums, by heap numbers from 1."""
    candidates = {k: (splits.get(k), s) for k, s in sums.items()}
    tree: list[Node] = []

    def leaf(stats: tuple) -> int:
        G, H, N = stats
        tree.append(Node(value=-G / (H + cfg.lam) * cfg.rate, hessian=H, rows=N))
        return len(tree) - 1

    if 1 not in candidates:
        return [Node()]
    frontier, leaves = [], 1
    at = {1: leaf(candidates[1][1])}
    if candidates[1][0]:
        heapq.heappush(frontier, (-candidates[1][0][0], 1))
    while frontier and leaves < cfg.leaves:
        _, k = heapq.heappop(frontier)
        gain, f, b, missing_left, ls, rs = candidates[k][0]
        n = tree[at[k]]
        n.feature, n.bin, n.gain, n.missing_left = f, b, gain, missing_left
        at[2 * k], at[2 * k + 1] = leaf(ls), leaf(rs)
        n.left, n.right = at[2 * k], at[2 * k + 1]
        leaves += 1
        for c in (2 * k, 2 * k + 1):
            if c in candidates and candidates[c][0]:
                heapq.heappush(frontier, (-candidates[c][0][0], c))
    return pruned(tree, cfg.prune)


def pruned(tree: list[Node], gamma: float) -> list[Node]:
    """Collapses splits of two leaves whose gain is below gamma, from the bottom."""
    if gamma > 0:
        for n in reversed(tree):
            if n.left >= 0 and tree[n.left].left < 0 and tree[n.right].left < 0 and n.gain < gamma:
                n.left = n.right = n.feature = -1
    return tree


def noise_pruned(model: GBDT, df: DataFrame, target: str) -> GBDT:
    """Collapses splits that don't lower the squared error of later rows, from the bottom; one aggregation for each tree.

    ``df`` is another era than the trees were grown on. Each tree is judged on what the pruned
    ones before it leave.
    """
    loss = LOSSES[model.config.loss]
    done = GBDT(model.features, model.bounds, model.base, [], model.config, model.interval)
    bins = {f: F.col(f"__b_{f}") for f in model.features}
    rows = done.with_bins(df.withColumn("__y", F.col(target).cast("double")).where("__y is not null"))
    for tree in model.trees:
        g, h = loss.pair(F.col("__y"), done.raw())
        leaf = tree_value([Node(n.feature, n.bin, float(i), n.left, n.right, missing_left=n.missing_left) for i, n in enumerate(tree)], bins).cast("int")
        sums = {r.leaf: (r.g or 0.0, r.h or 0.0) for r in rows.select(leaf.alias("leaf"), g.alias("g"), h.alias("h")).groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        kept = [Node(**asdict(n)) for n in tree]
        # The change of the loss when a node's rows take its value: g v + h v^2 / 2.
        change = lambda i, v: sums.get(i, (0.0, 0.0))[0] * v + sums.get(i, (0.0, 0.0))[1] * v * v / 2
        for i in reversed(range(len(kept))):
            n = kept[i]
            if n.left < 0:
                continue
            both = [sum(x) for x in zip(sums.get(n.left, (0.0, 0.0)), sums.get(n.right, (0.0, 0.0)))]
            leaves = kept[n.left].left < 0 and kept[n.right].left < 0
            if leaves and change(n.left, kept[n.left].value) + change(n.right, kept[n.right].value) >= both[0] * n.value + both[1] * n.value**2 / 2:
                n.left = n.right = n.feature = -1
            sums[i] = tuple(both)
        done = done.appended([kept])
    return done


def tree_value(tree: list[Node], bins: dict[str, Column], at: int = 0, bounds: dict[str, list[float]] | None = None) -> Column:
    """The leaf value of a row as nested conditions on its bins, or, with ``bounds``, on its ``lowered`` values, whose bins then needn't be found."""
    n = tree[at]
    if n.left < 0:
        return F.lit(float(n.value))
    name = list(bins)[n.feature]
    x = bins[name]
    if bounds is None:
        goes = (x <= n.bin) if n.missing_left else (x <= n.bin) & (x > 0)
    else:
        cuts = bounds[name]
        goes = x < cuts[n.bin] if n.bin < len(cuts) else F.lit(True)
        goes = goes if n.missing_left else goes & (x >= cuts[0] if cuts else F.lit(False))
    return F.when(goes, tree_value(tree, bins, n.left, bounds)).otherwise(tree_value(tree, bins, n.right, bounds))


def path_attribution(tree: list[Node], bins: dict[str, Column], feature: int, at: int = 0) -> Column:
    """What the splits on one feature add along a row's path: changes of the mean leaf value."""

    def mean(i: int) -> float:
        n = tree[i]
        return n.value if n.left < 0 else (mean(n.left) * tree[n.left].rows + mean(n.right) * tree[n.right].rows) / max(1, tree[n.left].rows + tree[n.right].rows)

    n = tree[at]
    if n.left < 0:
        return F.lit(0.0)
    x = bins[list(bins)[n.feature]]
    goes = (x <= n.bin) if n.missing_left else (x <= n.bin) & (x > 0)
    step = lambda child: (mean(child) - mean(at)) if n.feature == feature else 0.0
    return F.when(goes, path_attribution(tree, bins, feature, n.left) + step(n.left)).otherwise(path_attribution(tree, bins, feature, n.right) + step(n.right))


@dataclass
class GBDT:
    """A boosted (or bagged) ensemble for regression and binary targets."""

    features: list[str]
    bounds: dict[str, list[float]]
    base: float
    trees: list[list[Node]]
    config: TreeConfig
    interval: float | None = None

    def bins(self) -> dict[str, Column]:
        return {f: binned(F.col(f), self.bounds[f]) for f in self.features}

    def raw(self) -> Column:
        bins, out = {f: F.col(f"__b_{f}") for f in self.features}, F.lit(self.base)
        total = sum((tree_value(t, bins) for t in self.trees), F.lit(0.0))
        return out + (total / max(1, len(self.trees)) if self.config.forest else total)

    def with_bins(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"__b_{f}": b for f, b in self.bins().items()})

    def with_values(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"__x_{f}": lowered(F.col(f)) for f in self.features})

    def raw_of_values(self) -> Column:
        """``raw`` from the columns of ``with_values``."""
        values = {f: F.col(f"__x_{f}") for f in self.features}
        total = sum((tree_value(t, values, bounds=self.bounds) for t in self.trees), F.lit(0.0))
        return F.lit(self.base) + (total / max(1, len(self.trees)) if self.config.forest else total)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        loss = LOSSES[self.config.loss]
        df = self.with_values(df).withColumn(out, loss.response(self.raw_of_values()))
        if self.interval is not None:
            # Bounds stay within what the link can reach.
            low, high = F.col(out) - self.interval, F.col(out) + self.interval
            if loss.link != "identity":
                low = F.greatest(low, F.lit(0.0))
            df = df.withColumns({f"{out}_low": low, f"{out}_high": F.least(high, F.lit(1.0)) if loss.link == "logit" else high})
        return df.drop(*[f"__x_{f}" for f in self.features])

    def attributions(self, df: DataFrame) -> DataFrame:
        bins = {f: F.col(f"__b_{f}") for f in self.features}
        cols = {f"attr_{f}": sum((path_attribution(t, bins, i) for t in self.trees), F.lit(0.0)) for i, f in enumerate(self.features)}
        return self.with_bins(df).withColumns(cols).drop(*[f"__b_{f}" for f in self.features])

    def importance(self, by: str = "gain") -> dict[str, float]:
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for n in t:
                if n.left >= 0:
                    total[self.features[n.feature]] += n.gain if by == "gain" else n.hessian
        s = sum(total.values())
        return {f: v / s if s else 0.0 for f, v in total.items()}

    def predict_class(self, df: DataFrame, threshold: float = 0.5, out: str = "predicted") -> DataFrame:
        """Class 1 where the prediction reaches the threshold, else 0."""
        return self.predict(df, "__p").withColumn(out, (F.col("__p") >= threshold).cast("int")).drop("__p", "__p_low", "__p_high")

    def predict_raw(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """The score before the link."""
        return self.with_values(df).withColumn(out, self.raw_of_values()).drop(*[f"__x_{f}" for f in self.features])

    def residuals(self, df: DataFrame, target: str, out: str = "residual") -> DataFrame:
        """The target less the prediction."""
        return self.predict(df, "__p").withColumn(out, F.col(target).cast("double") - F.col("__p")).drop("__p", "__p_low", "__p_high")

    def top_features(self, df: DataFrame, k: int) -> DataFrame:
        """(feature, attribution): the k features of largest mean absolute attribution over the rows."""
        means = self.attributions(df).agg(*[F.avg(F.abs(f"attr_{f}")).alias(f) for f in self.features])
        long = means.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("attribution")) for f in self.features])))
        return long.orderBy(F.desc("attribution"), "feature").limit(k)

    def appended(self, trees: list[list[Node]]) -> GBDT:
        return GBDT(self.features, self.bounds, self.base, [*self.trees, *trees], self.config, self.interval)

    def truncated(self, rounds: int) -> GBDT:
        return GBDT(self.features, self.bounds, self.base, self.trees[:rounds], self.config, self.interval)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> GBDT:
        x = json.loads(text)
        return GBDT(x["features"], x["bounds"], x["base"], [[Node(**n) for n in t] for t in x["trees"]], TreeConfig(**x["config"]), x["interval"])


def goss_weight(g: Column, key: Column, cut: float, cfg: TreeConfig, salt: int) -> Column:
    """Rows of large gradients whole, a sample of the rest weighted up."""
    a, b = cfg.goss
    return F.when(F.abs(g) >= cut, F.lit(1.0)).otherwise(F.when(uniform(key, cfg.seed, salt) < b / (1 - a), F.lit((1 - a) / b)).otherwise(F.lit(0.0)))


def train_gbdt(df: DataFrame, features: list[str], target: str, key: str, cfg: TreeConfig = TreeConfig(), start: GBDT | None = None, validation: DataFrame | None = None, era: str | None = None, on_round=None) -> GBDT:
    """Trains on rows keyed by ``key``; ``start`` is a model to add trees to.

    ``validation`` is a table to stop early by, in place of a share of ``df``. With ``era``,
    splits must point the same way in every era. After each round ``on_round(round, loss on
    the validation rows or None)`` is called; training ends where it returns False.

    Rows alike in all values that a training reads are one row with their number, where a
    sketch tells few kinds; a forest's weights, which come from keys, are summed over them. The
    rest, boundaries and bins too, is then work on the kinds. ``df`` may be such a table (with
    ``__n``), which needs no key. Otherwise the binned table is persisted; each round's predictions are an expression of it, and are
    written every few rounds, which keeps plans short and ends the lineage. Rows that agree in
    all that a training reads are one row with their number, if that makes them fewer. Levels
    are summed in arrays (``cohorts``), but for eras and very deep trees.
    """
    from tessella.operators.cohorts import DEEPEST, KINDS, Growth, alike, level_cells  # which imports this module

    loss: Loss = LOSSES[cfg.loss]
    scratch = Scratch(df.sparkSession, "boosting")
    watched = bool(validation is not None or cfg.validation)
    by_key = cfg.goss or cfg.subsample < 1 or watched or era or cfg.depth > DEEPEST
    counted = [F.col(COUNT)] if COUNT in df.columns else []
    if counted and (by_key or cfg.forest or cfg.calibration):
        raise ValueError("rows alike have no keys to sample by")
    names, values = [f"__b_{f}" for f in features], [f"__x_{f}" for f in features]
    source = df.select(F.col(target).cast("double").alias("y"), *(counted or [F.col(key).alias("key")]), *[F.col(f).cast("double").alias(x) for f, x in zip(features, values)])
    source = source.withColumn("part", F.when(uniform(F.col("key"), cfg.seed, 7) < cfg.calibration, "calibration").otherwise("train") if cfg.calibration else F.lit("train"))

    def weights(r: int) -> dict[str, Column]:
        each = {k: poisson(uniform(F.col("key"), cfg.seed, k)) for k in range(r, min(r + BLOCK, cfg.rounds)) if cfg.forest}
        return {f"__w{k}": F.sum(w) for k, w in each.items()} | {f"__m{k}": F.count_if(w > 0) for k, w in each.items()}

    def grouped(kinds: DataFrame) -> DataFrame:
        more = [c for c in kinds.columns if c not in values]
        return kinds.where("y is not null").select(*more, F.lit(0).alias("key"), F.lit(0).alias("era"), *[binned(F.col(x), bounds[f]).cast("short").alias(b) for f, x, b in zip(features, values, names)])

    kinds = None if by_key else alike(source, ["part", "y", *values], KINDS, weights(0))
    if kinds is not None:
        kinds = scratch.put(kinds)
        bounds = start.bounds if start else boundaries(kinds.select(COUNT, *[F.col(x).alias(f) for f, x in zip(features, values)]), features, cfg.bins)
    else:
        bounds = start.bounds if start else boundaries(df, features, cfg.bins)
    known = lambda t: t.select(F.col(target).cast("double").alias("y"), F.col(key).alias("key"), (F.col(era) if era else F.lit(0)).alias("era"), *[binned(F.col(f), bounds[f]).cast("short").alias(f"__b_{f}") for f in features]).where("y is not null")
    u = uniform(F.col("key"), cfg.seed, 7)
    rows = grouped(kinds) if kinds is not None else known(df).withColumn("part", F.when(u < cfg.calibration, "calibration").when(u < cfg.calibration + (0 if validation is not None else cfg.validation), "validation").otherwise("train"))
    if validation is not None:
        rows = rows.unionByName(known(validation).withColumn("part", F.lit("validation")))
    if kinds is None:
        rows.persist()
    try:
        bins = {f: F.col(f"__b_{f}") for f in features}
        base = start.base if start else float(rows.where("part = 'train'").agg(loss.start(F.col("y"), *([] if kinds is None else [F.col(COUNT)]))).first()[0] or 0.0)
        model = GBDT(features, bounds, base, list(start.trees) if start else [], cfg)
        best, waited, kept = math.inf, 0, len(model.trees)
        groups = rows if kinds is not None else None if by_key or cfg.forest else alike(rows.where("part = 'train'"), ["y", *names])
        start_rows = rows if groups is None else scratch.put(groups if kinds is not None else groups.withColumns({"part": F.lit("train"), "key": F.lit(0), "era": F.lit(0)}))
        scored = start_rows.withColumn("pred", F.lit(base) if cfg.forest else model.raw())
        width = max(len(b) for b in bounds.values()) + 1
        for r in range(cfg.rounds):
            if kinds is not None and cfg.forest and r and r % BLOCK == 0:
                scored = scratch.replace(grouped(source.groupBy("part", "y", *values).agg(F.count("*").alias(COUNT), *[v.alias(k) for k, v in weights(r).items()]))).withColumn("pred", F.lit(base))
            now = scored.where("part = 'train'")
            g, h = loss.pair(F.col("y"), F.col("pred"))
            w, many = F.lit(1.0), F.lit(1).cast("long") if groups is None else F.col(COUNT)
            if cfg.forest and groups is not None:
                w, many = F.col(f"__w{r}"), F.col(f"__m{r}")
            elif cfg.forest:
                w = poisson(uniform(F.col("key"), cfg.seed, r))
            elif cfg.goss:
                cut = now.agg(F.percentile_approx(F.abs(g), F.lit(1 - cfg.goss[0]), 1000)).first()[0] or 0.0
                w = goss_weight(g, F.col("key"), cut, cfg, r)
            if cfg.subsample < 1:
                now = now.where(uniform(F.col("key"), cfg.seed, 1000 + r) < cfg.subsample)
            allowed = set(random.Random(cfg.seed * 31 + r).sample(range(len(features)), max(1, math.ceil(cfg.colsample * len(features)))))
            w = w if groups is None or cfg.forest else w * many
            now = now.select("key", "era", *names, (g * w).alias("__g"), (h * w).alias("__h"), many.alias("__n")).where("__h > 0")
            if era or cfg.depth > DEEPEST:
                tree = grow(now, bins, F.col("__g"), F.col("__h"), cfg, allowed, F.col("era") if era else None)
            else:
                growth = Growth(cfg, features, allowed)
                while growth.active():
                    growth.take(level_cells(now, names, {0: ("__g", "__h")}, {0: growth}, width)[0])
                tree = growth.tree()
            model.trees.append(tree)
            if not cfg.forest:
                scored = scored.withColumn("pred", F.col("pred") + tree_value(tree, bins))
                if (r + 1) % REFRESH == 0 and r + 1 < cfg.rounds:
                    scored = scratch.replace(scored)
            value = None
            if watched and (cfg.patience or on_round):
                now = rows.withColumn("pred", model.raw()) if cfg.forest else scored
                value = now.where("part = 'validation'").agg(F.avg(loss.value(F.col("y"), F.col("pred")))).first()[0]
            if watched and cfg.patience and value is not None:
                if value < best - 1e-12:
                    best, waited, kept = value, 0, len(model.trees)
                else:
                    waited += 1
            stop = on_round is not None and on_round(r, value) is False
            if stop or cfg.patience and waited >= cfg.patience:
                break
        if watched and cfg.patience and best < math.inf:
            model = model.truncated(kept)
        if cfg.calibration:
            if kinds is None:
                out = rows.where("part = 'calibration'").withColumn("pred", loss.response(model.raw()))
            else:
                held = df.where(F.col(target).cast("double").isNotNull() & (uniform(F.col(key), cfg.seed, 7) < cfg.calibration))
                out = model.with_values(held).select(F.col(target).cast("double").alias("y"), loss.response(model.raw_of_values()).alias("pred"))
            model.interval = conformal(out, F.abs(F.col("y") - F.col("pred")), cfg.quantile)
        return model
    finally:
        if kinds is None:
            rows.unpersist()
        scratch.close()


def conformal(df: DataFrame, residual: Column, q: float) -> float | None:
    """The residual of rank min(ceil(n q), n - 1) from 0, by a ranking that keeps one row."""
    n = df.where(residual.isNotNull()).count()
    return quantiles(df, residual, [min(math.ceil(n * q), n - 1) / max(1, n - 1)])[0] if n else None
