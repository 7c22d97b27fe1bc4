"""Many boosted models in one pass: folds, seeds, trials and classes share one binned table.

A cohort is a list of members, each a model with its own settings, target and held-out fold.
The table holds every row's bins and one score for each member. A level of a round is one
aggregation for all members: each task routes its rows through the trees grown so far and
sums gradients by (member, node, feature, bin) in arrays, one row for each filled cell leaves
the task, and cells are added up by key. So k folds cost the jobs of one training. Splits are
then chosen on the driver from cells whose number doesn't depend on the rows.

Scores are data. Every few rounds the table is written with what the new trees add, which
ends the lineage: plans stay short, rounds cost the same, and a lost executor costs no tree.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.losses import EPS, LOSSES
from tessella.functions.scalar import softmax
from tessella.operators.encoding import COUNT, binned, boundaries, lowered
from tessella.operators.trees import GBDT, REFRESH, TIE, Node, TreeConfig, goss_weight, information, poisson, replayed, tree_value, uniform
from tessella.sources.staging import Scratch

#: Deepest trees that heap numbers in arrays allow.
DEEPEST = 15
#: Rows for each distinct one, from which rows that agree are counted instead of kept.
ALIKE = 4
#: Kinds of rows up to which they are found by their values, before bins are; one task then orders the distinct values of a feature.
KINDS = 4_000_000
#: Cells (one for each combination of bins) up to which a task keeps all scores that it has found.
HELD = 1 << 20
#: Nodes above which scores come from arrays: nested conditions would be one method too long to be compiled.
COMPILED = 150
#: Nodes of new trees after which scores are written, so that a plan holds few conditions.
PENDING = 600
CELLS = "member int, node int, feature int, bin int, g double, h double, n long"


@dataclass
class Member:
    """One model of a cohort: its settings, the column of its target, and the fold that it doesn't learn from."""

    config: TreeConfig
    target: str
    fold: int | None = None


def best_dense(hist: np.ndarray, cfg: TreeConfig, features: list[str], allowed: set[int]) -> tuple | None:
    """``trees.best_split`` for one node's cells as an array (feature, bin, (g, h, n)): the same split and the same choice of ties."""
    G, H, N = hist[0].sum(axis=0)
    run = hist.cumsum(axis=1)
    best = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for f in sorted(allowed):
            ways = [(True, run[f])]
            if hist[f, 0, 2]:
                ways.append((False, run[f] - hist[f, 0]))
            for missing_left, left in ways:
                g, h, n = left.T
                ok = (hist[f, :, 2] > 0) & (n >= cfg.least_rows) & (N - n >= cfg.least_rows) & (h >= cfg.least_hessian) & (H - h >= cfg.least_hessian)
                ok &= missing_left | (np.arange(len(n)) > 0)
                if way := cfg.monotone.get(features[f], 0):
                    ok &= (-(G - g) / (H - h + cfg.lam) + g / (h + cfg.lam)) * way >= 0
                if not ok.any():
                    continue
                gain = 0.5 * (g * g / (h + cfg.lam) + (G - g) ** 2 / (H - h + cfg.lam) - G * G / (H + cfg.lam))
                if cfg.entropy and N:
                    gain = gain + cfg.entropy * np.array([information(*(float(x) for x in c), G, H, N) if good else 0.0 for c, good in zip(left, ok)])
                gain = np.where(ok & (gain >= cfg.least_gain) & (gain > 0), gain, -np.inf)
                b = int((gain >= gain.max() * (1 - TIE)).argmax()) if gain.max() > 0 else 0
                if gain[b] > 0 and (best is None or gain[b] > best[0] * (1 + TIE)):
                    best = (float(gain[b]), f, b, missing_left, (float(g[b]), float(h[b]), int(n[b])), (float(G - g[b]), float(H - h[b]), int(N - n[b])))
    return best


class Growth:
    """One tree of a member while its levels are read; ``trees.grow`` with arrays."""

    def __init__(self, cfg: TreeConfig, features: list[str], allowed: set[int]):
        if cfg.depth > DEEPEST:
            raise ValueError(f"trees of a cohort have {DEEPEST} levels at most")
        self.cfg, self.features, self.allowed = cfg, features, allowed
        self.groups = [{features.index(f) for f in group if f in features} for group in cfg.groups]
        self.splits: dict[int, tuple] = {}
        self.sums: dict[int, tuple] = {}
        self.hists: dict[int, np.ndarray] = {}
        self.used: dict[int, frozenset[int]] = {1: frozenset()}
        self.read, self.derived, self.level = [1], [], 0

    def active(self) -> bool:
        return bool(self.read) and self.level < self.cfg.depth

    def routes(self) -> tuple[np.ndarray, ...]:
        """Feature (-1: none), bin and direction of missing values by heap number, and the slot of each node to be read (-1: none)."""
        size = 2 ** (self.level + 1)
        feature, bin_, missing, slot = np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size, bool), np.full(size, -1, np.int32)
        for k, s in self.splits.items():
            feature[k], bin_[k], missing[k] = s[1], s[2], s[3]
        slot[self.read] = np.arange(len(self.read))
        return feature, bin_, missing, slot

    def take(self, found: dict[int, np.ndarray]) -> None:
        """Splits the nodes of a level; of two children the smaller one is read next, the other is what its parent leaves."""
        self.hists |= found
        for k in self.derived:
            other = self.hists.get(k ^ 1)
            self.hists[k] = self.hists[k // 2] if other is None else self.hists[k // 2] - other
        level = sorted([*found, *self.derived])
        self.read, self.derived = [], []
        for k in level:
            hist = self.hists[k]
            total = hist[0].sum(axis=0)
            if not total[2]:
                continue
            self.sums[k] = (float(total[0]), float(total[1]), int(total[2]))
            may = self.allowed
            if self.groups and self.used[k]:
                may = may & set().union(*[s for s in self.groups if self.used[k] <= s])
            if best := best_dense(hist, self.cfg, self.features, may):
                self.splits[k] = best
                self.used[2 * k] = self.used[2 * k + 1] = self.used[k] | {best[1]}
                small = 2 * k if best[4][2] <= best[5][2] else 2 * k + 1
                self.read.append(small)
                self.derived.append(small ^ 1)
        self.hists = {k: v for k, v in self.hists.items() if 2 * k in self.used}
        self.level += 1

    def tree(self) -> list[Node]:
        return replayed(self.splits, self.sums, self.cfg)


def keyed(cfg: TreeConfig) -> bool:
    """Whether a training samples or sets rows apart by their keys, or is too deep for arrays."""
    return bool(cfg.forest or cfg.goss or cfg.subsample < 1 or cfg.validation or cfg.calibration or cfg.depth > DEEPEST)


def alike(rows: DataFrame, columns: list[str], most: float = math.inf, sums: dict[str, Column] | None = None) -> DataFrame | None:
    """The distinct rows of the columns with their number ``__n``, and ``sums`` over them.

    None where, by a sketch, there are more than one for ALIKE rows, or more than ``most``.
    Rows that stand for several already are only added up.
    """
    more = [v.alias(k) for k, v in (sums or {}).items()]
    if COUNT in rows.columns:
        return rows.groupBy(*columns).agg(F.sum(COUNT).alias(COUNT), *more)
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    return rows.groupBy(*columns).agg(F.count("*").alias(COUNT), *more) if kinds * ALIKE <= n and kinds <= most else None


def cell_sums(features: int, bins: int, routes: dict[int, tuple[np.ndarray, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (bins of the features, g and h of each routed member, how many rows they stand for): the filled cells of all members' nodes in these rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: np.zeros((3, int(slot.max()) + 1, features, bins)) for m, (*_, slot) in routes.items()}
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in range(features)]).astype(np.int64)
            many = batch.column(batch.num_columns - 1).to_numpy()
            for at, (m, (feature, bin_, missing, slot)) in enumerate(routes.items()):
                g, h = (batch.column(features + 2 * at + k).to_numpy() for k in (0, 1))
                rows = np.flatnonzero(h > 0)
                own, node = x[:, rows], np.ones(len(rows), np.int64)
                for _ in range(len(slot).bit_length() - 2):
                    f = feature[node]
                    b = own[np.maximum(f, 0), np.arange(len(node))]
                    left = (b <= bin_[node]) & (missing[node] | (b > 0))
                    node = np.where(f >= 0, 2 * node + 1 - left, node)
                place = slot[node]
                keep = place >= 0
                rows, own, place = rows[keep], own[:, keep], place[keep].astype(np.int64) * bins
                shape = held[m].shape[1], bins
                for f in range(features):
                    cell = place + own[f]
                    for k, weights in enumerate((g[rows], h[rows], many[rows])):
                        held[m][k, :, f] += np.bincount(cell, weights, shape[0] * bins).reshape(shape)
        for m, (*_, slot) in routes.items():
            nodes = np.argsort(slot)[len(slot) - held[m].shape[1] :]
            s, f, b = np.nonzero(held[m][2])
            g, h, n = held[m][:, s, f, b]
            ints = [np.full(len(s), m, np.int32), nodes[s].astype(np.int32), f.astype(np.int32), b.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array(g), pa.array(h), pa.array(n.astype(np.int64))], ["member", "node", "feature", "bin", "g", "h", "n"])

    return sums


def level_cells(rows: DataFrame, bins: list[str], pairs: dict[int, tuple[str, str]], growths: dict[int, Growth], width: int) -> dict[int, dict[int, np.ndarray]]:
    """By member and node, the summed cells (feature, bin, (g, h, n)) that their growths ask for: one job for all."""
    routes = {m: growths[m].routes() for m in growths}
    columns = [*bins, *(c for m in growths for c in pairs[m]), *(["__n"] if "__n" in rows.columns else [F.lit(1).cast("long").alias("__n")])]
    cells = rows.select(*columns).mapInArrow(cell_sums(len(bins), width, routes), CELLS)
    got = cells.groupBy("member", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
    out: dict[int, dict[int, np.ndarray]] = {m: {} for m in growths}
    if got.num_rows:
        member, node, feature, bin_ = (got[c].to_numpy() for c in ("member", "node", "feature", "bin"))
        values = np.stack([got[c].to_numpy().astype(float) for c in "ghn"], axis=1)
        order = np.lexsort((node, member))
        member, node, feature, bin_, values = member[order], node[order], feature[order], bin_[order], values[order]
        starts = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (node[1:] != node[:-1])])
        for a, b in zip(starts, np.r_[starts[1:], len(node)]):
            cell = out[int(member[a])][int(node[a])] = np.zeros((len(bins), width, 3))
            cell[feature[a:b], bin_[a:b]] = values[a:b]
    return out


@dataclass
class Cohort:
    """Trained members, and the table of all their scores: key, fold, targets, ``raw_0``, ``raw_1``, ..."""

    models: list[GBDT]
    scored: DataFrame
    losses: list[list[float | None]] = field(default_factory=list)


def boost(
    df: DataFrame, features: list[str], key: str, members: list[Member], *, fold: Column | None = None, bounds: dict[str, list[float]] | None = None, bases: list[float] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, gradients: Callable[[list[Column]], list[tuple[Column, Column]]] | None = None, joint: Callable[[list[Column]], Column] | None = None, validation: Column | None = None, also: list[str] = (), offset: Column | None = None,
    on_round: Callable[[int, list[float | None]], bool | None] | None = None, scores: bool = True,
) -> Cohort:
    """Trains all members over one binned table.

    Rows without a target take no part in its members. ``bounds`` are bin boundaries in place
    of the table's own, ``bases`` start scores in place of the losses' constants; ``offset`` is a
    column of start scores, which the models then don't hold. By default
    a member's gradients are its loss's; ``gradients`` gives those of all members from all
    scores and from the columns that ``prepare`` adds to the table, and ``joint`` the loss of a row that they then stop by together. A member stops
    early by its settings' ``patience`` on its ``validation`` share of hashed keys, or on rows
    where the column ``validation`` holds. ``also`` columns are carried into the score table.
    After each round ``on_round(round, losses)`` is called; False ends the training.
    Where nothing tells rows apart by their keys, those with the same bins, targets and fold are
    learnt from together, if that makes them fewer: by their values where a sketch tells few
    kinds, so that the rest, boundaries and bins too, is work on the kinds. A table of rows
    alike (with ``__n``) needs no key. Without ``scores`` no score table is written.
    """
    spark = df.sparkSession
    most = max(m.config.bins for m in members)
    targets = list(dict.fromkeys(m.target for m in members))
    bins, b_of = [f"__b_{f}" for f in features], {f: F.col(f"__b_{f}") for f in features}
    raws = [F.col(f"raw_{i}") for i in range(len(members))]
    by_key = validation is not None or offset is not None or also or any(m.config.forest or m.config.goss or m.config.subsample < 1 or m.config.validation or m.config.calibration for m in members)
    marks = [(F.lit(-1) if fold is None else fold.cast("int")).alias("fold"), (F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))).alias("__outside")]
    marks += [F.col(y).cast("double").alias(f"__y_{y}") for y in targets]
    counted = [F.col(COUNT)] if COUNT in df.columns else []
    if counted and by_key:
        raise ValueError("rows alike have no keys to sample by")
    with Scratch(spark, "cohort") as scratch:
        kinds = None
        if not by_key:
            values = df.select(*marks, *[F.col(f).cast("double").alias(f"__x_{f}") for f in features], *counted)
            kinds = alike(values, [c for c in values.columns if c != COUNT], KINDS)
        if kinds is None:
            bounds = bounds or boundaries(df, features, most)
            columns = [F.col(key).alias("key"), *marks, *([] if offset is None else [offset.cast("double").alias("__offset")]), *map(F.col, also)]
            rows = scratch.put(df.select(*columns, *[binned(F.col(f), bounds[f]).cast("short").alias(f"__b_{f}") for f in features]))
        else:
            kinds = scratch.put(kinds)
            bounds = bounds or boundaries(kinds.select(COUNT, *[F.col(f"__x_{f}").alias(f) for f in features]), features, most)
            rows = scratch.put(kinds.select("fold", "__outside", *(f"__y_{y}" for y in targets), COUNT, *[binned(F.col(f"__x_{f}"), bounds[f]).cast("short").alias(f"__b_{f}") for f in features]))
        width = max(len(b) for b in bounds.values()) + 1

        def watched(m: Member) -> Column:
            if validation is not None:
                return F.col("__outside")
            if not m.config.validation:
                return F.lit(False)
            u = uniform(F.col("key"), m.config.seed, 7)
            return (u >= m.config.calibration) & (u < m.config.calibration + m.config.validation)

        def taught(m: Member) -> Column:
            """Rows that the member learns from."""
            out = F.col(f"__y_{m.target}").isNotNull() & ~watched(m)
            out = out & (uniform(F.col("key"), m.config.seed, 7) >= m.config.calibration) if m.config.calibration else out
            return out if m.fold is None else out & (F.col("fold") != m.fold)

        ys = [F.col(f"__y_{m.target}") for m in members]
        if offset is not None:
            bases = [0.0] * len(members)
        if bases is None:
            of = [] if kinds is None else [F.col(COUNT)]
            starts = [LOSSES[m.config.loss].start(F.when(taught(m), y), *of).alias(f"s{i}") for i, (m, y) in enumerate(zip(members, ys))]
            bases = [float(x or 0.0) for x in rows.agg(*starts).first()]
        groups = rows if kinds is not None else None if by_key else alike(rows, ["fold", "__outside", *(f"__y_{y}" for y in targets), *bins])
        scored = (rows if groups is None or groups is rows else scratch.put(groups)).withColumns({f"raw_{i}": F.lit(float(b)) if offset is None else F.col("__offset") for i, b in enumerate(bases)}).drop("__offset")
        models = [GBDT(features, bounds, b, [], m.config) for m, b in zip(members, bases)]
        best, waited, kept, done = [math.inf] * len(members), [0] * len(members), [0] * len(members), [False] * len(members)
        log: list[list[float | None]] = []
        pending = 0
        for r in range(max(m.config.rounds for m in members)):
            running = [i for i, m in enumerate(members) if not done[i] and r < m.config.rounds]
            if not running:
                break
            # A forest's trees learn from its start score, not from each other.
            current = [F.lit(bases[i]) if m.config.forest else raw for i, (m, raw) in enumerate(zip(members, raws))]
            found = gradients(current) if gradients else [LOSSES[m.config.loss].pair(y, p) for m, y, p in zip(members, ys, current)]
            now = prepare(scored) if prepare else scored
            cuts: dict[int, float] = {}
            if sampled := [i for i in running if members[i].config.goss]:
                share = lambda i: F.percentile_approx(F.when(taught(members[i]), F.abs(found[i][0])), F.lit(1 - members[i].config.goss[0]), 1000).alias(f"c{i}")
                cuts = dict(zip(sampled, now.agg(*map(share, sampled)).first()))
            new: dict[str, Column] = {}
            for i in running:
                cfg, (g, h) = members[i].config, found[i]
                w = F.lit(1.0)
                if cfg.forest:
                    w = poisson(uniform(F.col("key"), cfg.seed, r))
                elif cfg.goss:
                    w = goss_weight(g, F.col("key"), cuts[i] or 0.0, cfg, r)
                takes = taught(members[i])
                if cfg.subsample < 1:
                    takes = takes & (uniform(F.col("key"), cfg.seed, 1000 + r) < cfg.subsample)
                w = w if groups is None else w * F.col("__n")
                new |= {f"__g{i}": F.coalesce(F.when(takes, g * w), F.lit(0.0)), f"__h{i}": F.coalesce(F.when(takes, h * w), F.lit(0.0))}
            now = now.select(*bins, *(c.alias(n) for n, c in new.items()), *([] if groups is None else ["__n"]))
            growths = {}
            for i in running:
                cfg = members[i].config
                allowed = set(random.Random(cfg.seed * 31 + r).sample(range(len(features)), max(1, math.ceil(cfg.colsample * len(features)))))
                growths[i] = Growth(cfg, features, allowed)
            while growing := {i: x for i, x in growths.items() if x.active()}:
                for i, nodes in level_cells(now, bins, {i: (f"__g{i}", f"__h{i}") for i in growing}, growing, width).items():
                    growing[i].take(nodes)
            for i in running:
                models[i].trees.append(growths[i].tree())
            scored = scored.withColumns({f"raw_{i}": F.col(f"raw_{i}") + tree_value(models[i].trees[-1], b_of) for i in running})
            pending += sum(len(models[i].trees[-1]) for i in running)
            # Where each member's gradients read all scores, these are written each time.
            if gradients or pending > PENDING or (r + 1) % REFRESH == 0:
                scored, pending = scratch.replace(scored), 0
            losses: list[float | None] = [None] * len(members)
            stopping = [i for i in running if (validation is not None or members[i].config.validation) and (members[i].config.patience or on_round)]
            if stopping:

                def shown(i: int) -> Column:
                    """A member's prediction before the link; a forest's is a mean."""
                    return F.lit(bases[i]) + (raws[i] - F.lit(bases[i])) / (r + 1) if members[i].config.forest else raws[i]

                value = lambda i: joint([shown(k) for k in range(len(members))]) if joint else LOSSES[members[i].config.loss].value(ys[i], shown(i))
                held_out = lambda i: watched(members[i]) & (F.lit(True) if members[i].fold is None else F.col("fold") != members[i].fold)
                got = scored.agg(*[F.avg(F.when(held_out(i), value(i))).alias(f"v{i}") for i in (stopping[:1] if joint else stopping)]).first()
                for k, i in enumerate(stopping):
                    losses[i] = got[0 if joint else k]
                    if losses[i] is not None and members[i].config.patience:
                        if losses[i] < best[i] - 1e-12:
                            best[i], waited[i], kept[i] = losses[i], 0, len(models[i].trees)
                        else:
                            waited[i] += 1
                            done[i] = waited[i] >= members[i].config.patience
            log.append(losses)
            if on_round and on_round(r, losses) is False:
                break
        if not scores:
            return Cohort([m.truncated(k) if m.config.patience and b < math.inf else m for m, k, b in zip(models, kept, best)], scored.limit(0), log)
        if groups is not None:
            if kinds is None:
                value = lambda t: tree_value(t, b_of)
            else:
                rows = df.select(F.col(key).alias("key"), *marks, *[lowered(F.col(f)).alias(f"__x_{f}") for f in features])
                value = lambda t: tree_value(t, {f: F.col(f"__x_{f}") for f in features}, bounds=bounds)
            scored, pending = rows.withColumns({f"raw_{i}": F.lit(float(b)) for i, b in enumerate(bases)}), 0
            for r in range(max(len(m.trees) for m in models)):
                grown = [i for i, m in enumerate(models) if r < len(m.trees)]
                scored = scored.withColumns({f"raw_{i}": F.col(f"raw_{i}") + value(models[i].trees[r]) for i in grown})
                pending += sum(len(models[i].trees[r]) for i in grown)
                if pending > PENDING:
                    scored, pending = scratch.replace(scored), 0
        final = {}
        for i, m in enumerate(members):
            raw = raws[i]
            extra = models[i].trees[kept[i] :] if m.config.patience and best[i] < math.inf else []
            if extra:
                models[i] = models[i].truncated(kept[i])
                raw = raw - sum((tree_value(t, b_of) for t in extra), F.lit(0.0))
            if m.config.forest and models[i].trees:
                raw = F.lit(bases[i]) + (raw - F.lit(bases[i])) / len(models[i].trees)
            final[f"raw_{i}"] = raw
        keep = [c for c in scored.columns if c not in bins and c != "__outside" and not c.startswith(("raw_", "__x_"))]
        out = scored.select(*(F.col(c).alias(c.removeprefix("__y_")) for c in keep), *(c.alias(n) for n, c in final.items()))
        return Cohort(models, scratch.put(out, keep=True), log)


def train_many(df: DataFrame, features: list[str], target: str, key: str, configs: list[TreeConfig]) -> list[GBDT]:
    """A model for each configuration, all over one table and one set of bins (of the largest number asked for)."""
    return boost(df, features, key, [Member(c, target) for c in configs], scores=False).models


def fold_of(key: str, folds: int, seed: int = 99) -> Column:
    """0 to folds - 1 by the key's hash."""
    return F.floor(uniform(F.col(key), seed) * folds).cast("int")


def cross_validated(df: DataFrame, features: list[str], target: str, key: str, configs: list[TreeConfig], folds: int = 3, fold: Column | None = None) -> tuple[DataFrame, list[list[GBDT]]]:
    """Out-of-fold predictions (key, fold, target, ``p_0``, ``p_1``, ...) of each configuration, and its models by fold; one training's passes for all.

    ``fold`` is a column of numbers from 0; by default the key's hash tells the fold.
    """
    members = [Member(c, target, k) for c in configs for k in range(folds)]
    cohort = boost(df, features, key, members, fold=fold_of(key, folds) if fold is None else fold)

    def own(c: int) -> Column:
        out = F.lit(None).cast("double")
        for k in range(folds):
            out = F.when(F.col("fold") == k, F.col(f"raw_{c * folds + k}")).otherwise(out)
        return LOSSES[configs[c].loss].response(out)

    rows = cohort.scored.select(F.col("key").alias(key), "fold", target, *(own(c).alias(f"p_{c}") for c in range(len(configs))))
    return rows, [cohort.models[c * folds : (c + 1) * folds] for c in range(len(configs))]


def raw_scores(models: list[GBDT]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows' scores by all models from the ``lowered`` values of their features; what a combination of bins scores is found once by a task."""
    forms = []
    for m in models:
        trees = [[np.array([getattr(n, a) for n in t]) for a in ("feature", "bin", "left", "right", "missing_left", "value")] for t in m.trees]
        forms.append((m.base, trees, m.config.forest))
    cuts = [np.array(models[0].bounds[f], float) for f in models[0].features]
    shape = tuple(len(c) + 1 for c in cuts)
    cells = math.prod(shape)

    def found(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x[0]), len(forms)))
        every = np.arange(len(x[0]))
        for k, (base, trees, forest) in enumerate(forms):
            total = np.zeros(len(every))
            for feature, bin_, left, right, missing, value in trees:
                node = np.zeros(len(every), np.int64)
                while (inner := left[node] >= 0).any():
                    b = x[np.maximum(feature[node], 0), every]
                    goes = (b <= bin_[node]) & (missing[node] | (b > 0))
                    node = np.where(inner, np.where(goes, left[node], right[node]), node)
                total += value[node]
            out[:, k] = base + (total / max(1, len(trees)) if forest else total)
        return out

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        few = cells <= HELD
        held, there = np.empty((cells if few else 0, len(forms))), np.zeros(cells if few else 0, bool)
        for batch in batches:
            x = np.stack([c.searchsorted(batch.iloc[:, i].to_numpy(), side="right") for i, c in enumerate(cuts)])
            if few:
                at = np.ravel_multi_index(x, shape)
                if len(new := np.unique(at[~there[at]])):
                    held[new], there[new] = found(np.stack(np.unravel_index(new, shape))), True
                out = held[at]
            else:
                out = found(x)
            yield pd.DataFrame(out, columns=[f"raw_{k}" for k in range(len(forms))])

    return scores


@dataclass
class Multiclass:
    """One ensemble for each class, grown together; probabilities are the softmax of their scores."""

    models: list[GBDT]
    losses: list[float | None] = field(default_factory=list)

    def predict_proba(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Adds ``p_0``, ``p_1``, ..., one for each class."""
        # Scores are columns first: every probability reads all of them.
        many = sum(len(t) for m in self.models for t in m.trees) > COMPILED
        raws = {f"__raw_{k}": F.col("__raws").getField(f"raw_{k}") if many else m.raw_of_values() for k, m in enumerate(self.models)}
        rows = self.models[0].with_values(df)
        if many:
            form = ", ".join(f"raw_{k} double" for k in range(len(self.models)))
            rows = rows.withColumn("__raws", F.pandas_udf(raw_scores(self.models), form)(F.struct(*[f"__x_{f}" for f in self.models[0].features])))
        rows = rows.withColumns(raws)
        p = softmax([F.col(c) for c in raws])
        return rows.withColumns({f"{out}_{k}": c for k, c in enumerate(p)}).drop("__raws", *raws, *[f"__x_{f}" for f in self.models[0].features])

    def predict_class(self, df: DataFrame, out: str = "predicted", proba: str | None = None) -> DataFrame:
        """Adds the most probable class; of equal ones the lowest. With ``proba`` its probabilities by that name too."""
        names = [f"{proba or '__p'}_{k}" for k in range(len(self.models))]
        rows = self.predict_proba(df, proba or "__p")
        rows = rows.withColumn(out, (F.array_position(F.array(*names), F.greatest(*names)) - 1).cast("int"))
        return rows if proba else rows.drop(*names)

    def importance(self, by: str = "gain") -> dict[str, float]:
        """The classes' mean importance."""
        each = [m.importance(by) for m in self.models]
        return {f: sum(e[f] for e in each) / len(each) for f in self.models[0].features}

    def to_json(self) -> str:
        return json.dumps({"models": [m.to_json() for m in self.models], "losses": self.losses})

    @staticmethod
    def from_json(text: str) -> Multiclass:
        x = json.loads(text)
        return Multiclass([GBDT.from_json(m) for m in x["models"]], x["losses"])


def train_multiclass(df: DataFrame, features: list[str], target: str, key: str, classes: int, cfg: TreeConfig, validation: Column | None = None, on_round=None) -> Multiclass:
    """Classes 0 to classes - 1, grown together on the softmax of all: each level of a round is one aggregation for every class.

    Rows without a label, or with another one, take no part. Sampling, early stopping on a
    share or on the rows where ``validation`` holds, and ``on_round(round, loss)`` are those of
    a single ensemble; the loss is the mean of minus the logarithm of the label's probability.
    """
    label = F.col(target).cast("int")
    df = df.withColumn("__label", F.when((label >= 0) & (label < classes), label))
    counts = {r["__label"]: r["count"] for r in df.groupBy("__label").count().collect() if r["__label"] is not None}
    total = max(1, sum(counts.values()))
    y = F.col("__y___label")

    def joint(raws: list[Column]) -> Column:
        p = F.element_at(F.array(*softmax(raws)), y.cast("int") + 1)
        return -F.ln(F.greatest(p, F.lit(1e-15)))

    def with_probabilities(rows: DataFrame) -> DataFrame:
        """Step by step, so that no exponential is taken twice."""
        top = F.greatest(*(f"raw_{k}" for k in range(classes))) if classes > 1 else F.col("raw_0")
        rows = rows.withColumn("__top", top)
        rows = rows.withColumns({f"__e_{k}": F.exp(F.col(f"raw_{k}") - F.col("__top")) for k in range(classes)})
        total = sum((F.col(f"__e_{k}") for k in range(1, classes)), F.col("__e_0"))
        return rows.withColumn("__total", total).withColumns({f"__p_{k}": F.col(f"__e_{k}") / F.col("__total") for k in range(classes)})

    def gradients(_: list[Column]) -> list[tuple[Column, Column]]:
        ps = [F.col(f"__p_{k}") for k in range(classes)]
        return [(p - (y == k).cast("double"), F.greatest(p * (1 - p), F.lit(EPS))) for k, p in enumerate(ps)]

    # One configuration: in a round every class samples the same rows and features.
    cohort = boost(
        df.where("__label is not null"), features, key, [Member(cfg, "__label")] * classes, bases=[math.log(max(counts.get(k, 0) / total, 1e-6)) for k in range(classes)], prepare=with_probabilities, gradients=gradients, joint=joint, validation=validation, scores=False,
        on_round=None if on_round is None else lambda r, losses: on_round(r, losses[0]),
    )
    return Multiclass(cohort.models, [x[0] for x in cohort.losses])


