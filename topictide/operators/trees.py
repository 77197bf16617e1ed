"""Histogram trees for three or more classes: boosting with softmax gradients, and random
forests with a limit of leaves.

Trees grow level by level from histograms of binned features. Which leaves a limit keeps is
settled afterwards by a queue of gains: the best split is taken first, so the tree is the one
that best-first growth would give. Two ways lead to the same trees: fits whose rows a task can
hold are grown in tasks, many fits side by side; for larger ones the rows stay in blocks, each
level's histograms of all fits, trees and classes are summed in one job, and only the chosen
splits reach the driver."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.runtime import materialize

# The kernels travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_ROWS = 200_000  # of a fit that one task grows
BLOCK_ROWS = 50_000
WAVE_TREES = 16  # trees of a forest that grow in the same jobs
BINS = 64


@dataclass(frozen=True)
class Params:
    """``features`` of each node are tried (0: all); ``leaves`` 0 is no limit."""

    kind: str  # boosting or forest
    trees: int
    depth: int
    min_leaf: int
    leaves: int = 0
    rate: float = 0.05
    l2: float = 1.0
    features: int = 0
    seed: int = 42
    classes: int = 3


BOOSTING = Params("boosting", 200, 4, 10)
FOREST = Params("forest", 300, 10, 8, leaves=80, features=-1)


@dataclass
class Forest:
    """Trees as padded arrays of nodes, the root first; a leaf has feature -1. ``value`` is
    a score of the tree's class (boosting) or shares of the classes (forest)."""

    params: Params
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        node, row = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(x))[:, None]
        for _ in range(self.params.depth):
            f = self.feature[tree, node]
            if (f < 0).all():
                break
            step = np.where(x[row, np.maximum(f, 0)] <= self.cut[tree, node], self.left[tree, node], self.right[tree, node])
            node = np.where(f >= 0, step, node)
        return node

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return softmax(np.tile(self.start, (len(x), 1)))
        parts = []
        for i in range(0, len(x), 1_000):
            got = self.value[np.arange(len(self.feature))[None, :], self.leaves_of(x[i:i + 1_000])]
            if self.params.kind == "forest":
                parts.append(got.mean(axis=1))
            else:
                rounds = got[:, :, 0].reshape(len(got), -1, self.params.classes)
                parts.append(softmax(self.start + rounds.sum(axis=1)))
        return np.concatenate(parts) if parts else np.zeros((0, self.params.classes))

    def importances(self, n_features: int) -> np.ndarray:
        """Mean share of a tree's gain that each feature brings."""
        total = np.zeros(n_features)
        for f, g in zip(self.feature, self.gain):
            if (f >= 0).any():
                own = np.bincount(f[f >= 0], weights=g[f >= 0], minlength=n_features)
                total += own / max(own.sum(), 1e-300)
        return total / max(total.sum(), 1e-300)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mixed(*parts) -> np.ndarray:
    """A hash of numbers, element by element; what is drawn from it is the same on every machine."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(31))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(29))
    return out


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap sample: Poisson with mean 1."""
    u = (mixed(ids, tree, seed) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7])), u, side="right").astype(float)


def tried(params: Params, slot: int, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """The features each node may split on: a row per node."""
    k = n_features if params.features == 0 else max(1, int(np.sqrt(n_features))) if params.features < 0 else min(params.features, n_features)
    if k == n_features:
        return np.tile(np.arange(n_features), (len(nodes), 1))
    order = mixed(nodes[:, None], np.arange(n_features)[None, :], slot, params.seed)
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :k], axis=1)


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most bins - 1 cuts: between all values where they are few, else at quantiles."""
    known = np.unique(values)
    if len(known) > bins:
        known = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="lower"))
    return (known[:-1] + known[1:]) / 2


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def histograms(bins: np.ndarray, stats: np.ndarray, at: np.ndarray, features: np.ndarray) -> np.ndarray:
    """(statistic, node, feature tried, bin) sums of the rows that are at one of the nodes (``at`` >= 0)."""
    n, k = features.shape
    rows = np.flatnonzero(at >= 0)
    own = at[rows]
    cell = ((own[:, None] * k + np.arange(k)) * BINS + bins[rows[:, None], features[own]]).ravel()
    out = np.empty((stats.shape[1], n * k * BINS))
    for i, s in enumerate(stats.T):
        s = s[rows]
        out[i] = np.bincount(cell, None if (s == 1.0).all() else np.repeat(s, k), n * k * BINS)
    return out.reshape(-1, n, k, BINS)


def _worth(params: Params, sums: np.ndarray) -> np.ndarray:
    """What a leaf with these sums is worth; the last statistic counts rows."""
    if params.kind == "boosting":
        return sums[0] ** 2 / (sums[1] + params.l2)
    whole, squares = sums[0].copy(), sums[0] ** 2
    for s in sums[1:-1]:
        whole += s
        squares += s * s
    return squares / np.where(whole > 0, whole, 1.0)


def best_splits(params: Params, hist: np.ndarray, features: np.ndarray):
    """Per node (gain, feature, bin of the last value on the left, sums): gain 0 is no split."""
    below = hist.cumsum(axis=-1)
    whole = below[..., -1:]
    above = whole - below
    gain = _worth(params, below) + _worth(params, above) - _worth(params, whole)
    gain[(below[-1] < params.min_leaf) | (above[-1] < params.min_leaf) | (gain < 1e-9)] = 0.0
    flat = gain.reshape(len(gain), -1)
    # Sums differ in their last digits with the order of rows; the first of nearly equal gains counts.
    top = (flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
    every = np.arange(len(flat))
    return flat[every, top], features[every, top // BINS], top % BINS, whole[:, :, 0, 0].T


class Growing:
    """A tree by the places of its nodes: the children of i are 2 i + 1 and 2 i + 2."""

    def __init__(self, params: Params, slot: int):
        self.params, self.slot = params, slot
        self.split: dict[int, tuple] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.frontier = np.zeros(1, np.int64)
        self.level = 0

    def apply(self, gain, feature, cut, sums) -> None:
        """Takes the best splits of the frontier; the next frontier are their children."""
        nodes, children = self.frontier.tolist(), []
        for i, node in enumerate(nodes):
            self.sums[node] = sums[i]
            if gain[i] > 0 and self.level < self.params.depth:
                self.split[node] = (int(feature[i]), int(cut[i]), float(gain[i]))
                children += [2 * node + 1, 2 * node + 2]
        self.frontier = np.array(children, np.int64)
        self.level += 1

    def route(self, bins: np.ndarray, at: np.ndarray, level: int | None = None) -> np.ndarray:
        """Where rows at nodes go by the splits; rows at leaves stay."""
        for _ in range(self.params.depth if level is None else level):
            some = np.unique(at)
            inner = [n for n in some.tolist() if n in self.split]
            if not inner:
                break
            place = np.searchsorted(inner, at)
            place[place == len(inner)] = 0
            known = np.array(inner)[place] == at
            f, c = (np.array([self.split[n][k] for n in inner]) for k in (0, 1))
            right = bins[np.arange(len(at)), f[place]] > c[place]
            at = np.where(known, 2 * at + 1 + right, at)
        return at

    def limited(self) -> None:
        """Keeps the splits that a queue of gains takes until the tree has its leaves."""
        if not self.params.leaves:
            return
        queue, kept = [0] if 0 in self.split else [], {}
        while queue and len(kept) + 1 < self.params.leaves:
            node = max(queue, key=lambda n: (self.split[n][2], -n))
            queue.remove(node)
            kept[node] = self.split[node]
            queue += [c for c in (2 * node + 1, 2 * node + 2) if c in self.split]
        self.split = kept

    def nodes(self, edges: list[np.ndarray]) -> list[tuple]:
        """(feature, cut, left, right, value, gain) of the tree's nodes, the root first."""
        order = [0]
        for n in order:
            if n in self.split:
                order += [2 * n + 1, 2 * n + 2]
        at, out = {n: i for i, n in enumerate(order)}, []
        for n in order:
            s = self.sums[n]
            value = (-self.params.rate * s[:1] / (s[1] + self.params.l2) if self.params.kind == "boosting"
                     else s[:-1] / max(s[:-1].sum(), 1e-300))
            f, c, g = self.split.get(n, (-1, 0, 0.0))
            out.append((f, float(edges[f][c]) if f >= 0 else 0.0, at.get(2 * n + 1, 0) if f >= 0 else 0, at.get(2 * n + 2, 0) if f >= 0 else 0, value, g))
        return out


def assembled(params: Params, trees: list[list[tuple]], start: np.ndarray) -> Forest:
    width = max(map(len, trees), default=1)
    shape, out = (len(trees), width), []
    for k, kind in ((0, np.int64), (1, float), (2, np.int64), (3, np.int64), (5, float)):
        a = np.full(shape, -1 if k == 0 else 0, kind)
        for i, t in enumerate(trees):
            a[i, :len(t)] = [n[k] for n in t]
        out.append(a)
    value = np.zeros((*shape, 1 if params.kind == "boosting" else params.classes))
    for i, t in enumerate(trees):
        value[i, :len(t)] = [n[4] for n in t]
    return Forest(params, *out[:4], value, out[4], start)


def start_scores(params: Params, class_weights: np.ndarray) -> np.ndarray:
    """Boosting starts with equal shares; a class never seen stays out of reach."""
    return np.where(class_weights > 0, 0.0, -50.0)


def gradients(scores: np.ndarray, y: np.ndarray, w: np.ndarray, c: int) -> np.ndarray:
    """(first derivative, second derivative, 1) of the softmax loss for class c."""
    p = softmax(scores)[:, c]
    return np.column_stack([w * (p - (y == c)), w * p * (1 - p), np.ones(len(y))])


def forest_stats(params: Params, ids: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int) -> np.ndarray:
    n = drawn(ids, tree, params.seed)
    return np.column_stack([*((n * w * (y == c)) for c in range(params.classes)), n])


def fit_in_task(params: Params, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray] | None = None) -> Forest:
    """All trees of one fit from rows in memory."""
    edges = [bin_edges(x[:, f]) for f in range(x.shape[1])] if edges is None else edges
    bins = binned(x, edges)
    start = start_scores(params, np.array([w[y == c].sum() for c in range(params.classes)]))
    scores, trees = np.tile(start, (len(y), 1)), []
    if not len(y):
        return assembled(params, [], start)
    for t in range(params.trees):
        if params.kind == "boosting":
            made = [(t * params.classes + c, gradients(scores, y, w, c)) for c in range(params.classes)]
        else:
            made = [(t, forest_stats(params, ids, y, w, t))]
        for slot, stats in made:
            tree, at = Growing(params, slot), np.zeros(len(y), np.int64)
            if params.kind == "forest":
                at[stats[:, -1] == 0] = -1
            while len(tree.frontier):
                features = tried(params, slot, tree.frontier, x.shape[1])
                place = np.searchsorted(tree.frontier, at)
                place[place == len(tree.frontier)] = 0
                place = np.where(tree.frontier[place] == at, place, -1)
                tree.apply(*best_splits(params, histograms(bins, stats, place, features), features))
                at = tree.route(bins, at, 1)
            tree.limited()
            trees.append(tree.nodes(edges))
            if params.kind == "boosting":
                leaf = {n: -params.rate * s[0] / (s[1] + params.l2) for n, s in tree.sums.items()}
                known = np.array(sorted(leaf))
                scores[:, slot % params.classes] += np.array([leaf[n] for n in known.tolist()])[np.searchsorted(known, at)]
    return assembled(params, trees, start)


# --- rows in blocks ------------------------------------------------------------------

def _blocks(rows: DataFrame) -> DataFrame:
    """(fit, block, ids, x, y, w): rows packed into blocks of bounded size."""
    n = rows.groupBy("fit").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(n), "fit").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        return pd.DataFrame({"fit": [part.fit.iloc[0]], "block": [part.block.iloc[0]], "ids": [part.id.to_numpy("<i8").tobytes()],
                             "x": [np.stack(part.x).astype("<f8").tobytes()], "y": [part.y.to_numpy("<i8").tobytes()], "w": [part.w.to_numpy("<f8").tobytes()]})

    return materialize(dealt.select("fit", "block", "id", "x", "y", "w").groupBy("fit", "block").applyInPandas(
        pack, "fit long, block long, ids binary, x binary, y binary, w binary"))


def _unpacked(row: dict):
    y = np.frombuffer(row["y"], "<i8")
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["x"], "<f8").reshape(len(y), -1), y, np.frombuffer(row["w"], "<f8")


def _block_edges(rows: DataFrame, n_features: int) -> dict[int, list[np.ndarray]]:
    """Cuts of every fit and feature from one aggregate of approximate quantiles."""
    at = F.array(*[F.lit(i / (BINS - 1)) for i in range(BINS)])
    got = rows.groupBy("fit").agg(*[F.percentile_approx(F.get("x", F.lit(f)), at, 10_000).alias(f"q{f}") for f in range(n_features)]).collect()
    edges = {}
    for r in got:
        known = [np.unique(np.array(r[f"q{f}"], float)) for f in range(n_features)]
        edges[r.fit] = [(k[:-1] + k[1:]) / 2 for k in known]
    return edges


def fit_in_blocks(params: Params, rows: DataFrame, n_features: int, edges: dict[int, list[np.ndarray]] | None = None) -> dict[int, Forest]:
    """The same trees from (fit, id, x, y, w) rows of any number: for each level one job sums
    the histograms of all fits and trees that grow at once, and returns their best splits."""
    spark = rows.sparkSession
    edges = _block_edges(rows, n_features) if edges is None else edges
    blocks = _blocks(rows)
    weights = {fit: np.zeros(params.classes) for fit in edges}
    for r in rows.groupBy("fit", "y").agg(F.sum("w").alias("w")).collect():
        weights[r.fit][r.y] = r.w
    starts = {fit: start_scores(params, w) for fit, w in weights.items()}
    state, done = None, {fit: [] for fit in edges}
    wave = 1 if params.kind == "boosting" else WAVE_TREES
    for first in range(0, params.trees, wave):
        slots = ([first * params.classes + c for c in range(params.classes)] if params.kind == "boosting"
                 else list(range(first, min(first + wave, params.trees))))
        growing = {(fit, slot): Growing(params, slot) for fit in edges for slot in slots}
        while any(len(g.frontier) for g in growing.values()):
            sent = spark.sparkContext.broadcast((growing, edges, starts))
            for r in _level(params, blocks, state, sent, n_features).collect():
                growing[r.fit, r.slot].apply(*(np.frombuffer(v, k) for v, k in ((r.gain, "<f8"), (r.feature, "<i8"), (r.cut, "<i8"))),
                                             np.frombuffer(r.sums, "<f8").reshape(len(r.gain) // 8, -1))
        for (fit, slot), tree in growing.items():
            tree.limited()
            done[fit].append(tree.nodes(edges[fit]))
        if params.kind == "boosting":
            state = _next_scores(params, blocks, state, spark.sparkContext.broadcast((growing, edges, starts)))
    return {fit: assembled(params, trees, starts[fit]) for fit, trees in done.items()}


def _with_scores(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.withColumn("scores", F.lit(None).cast("binary"))
    return blocks.join(state, ["fit", "block"])


def _scores(row: dict, start: np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer(row["scores"], "<f8").reshape(n, -1).copy() if row["scores"] is not None else np.tile(start, (n, 1))


def _level(params: Params, blocks: DataFrame, state: DataFrame | None, sent, n_features: int) -> DataFrame:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, edges, starts = sent.value
        total: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                fit = row["fit"]
                ids, x, y, w = _unpacked(row)
                bins, scores = binned(x, edges[fit]), _scores(row, starts[fit], len(y))
                for (f, slot), tree in growing.items():
                    if f != fit or not len(tree.frontier):
                        continue
                    stats = gradients(scores, y, w, slot % params.classes) if params.kind == "boosting" else forest_stats(params, ids, y, w, slot)
                    at = tree.route(bins, np.zeros(len(y), np.int64))
                    place = np.searchsorted(tree.frontier, at)
                    place[place == len(tree.frontier)] = 0
                    place = np.where((tree.frontier[place] == at) & (stats[:, -1] > 0), place, -1)
                    hist = histograms(bins, stats, place, tried(params, slot, tree.frontier, n_features))
                    total[f, slot] = total[f, slot] + hist if (f, slot) in total else hist
        for (f, slot), hist in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([slot], pa.int64()), pa.array([hist.tobytes()], pa.binary())], ["fit", "slot", "hist"])

    def choose(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, total, fit, slot = sent.value[0], None, 0, 0
        for batch in group:
            for fit, slot, hist in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(hist, "<f8")
                total = own if total is None else total + own
        tree = growing[fit, slot]
        features = tried(params, slot, tree.frontier, n_features)
        found = best_splits(params, total.reshape(-1, *features.shape, BINS), features)
        yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int64()), pa.array([slot], pa.int64()), *(
            pa.array([np.ascontiguousarray(v, k).tobytes()], pa.binary()) for v, k in zip(found, ("<f8", "<i8", "<i8", "<f8")))],
            ["fit", "slot", "gain", "feature", "cut", "sums"])

    partial = _with_scores(blocks, state).mapInArrow(sums, "fit long, slot long, hist binary")
    return partial.groupBy("fit", "slot").applyInArrow(choose, "fit long, slot long, gain binary, feature binary, cut binary, sums binary")


def _next_scores(params: Params, blocks: DataFrame, state: DataFrame | None, sent) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, edges, starts = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                fit = row["fit"]
                _, x, y, _ = _unpacked(row)
                bins, scores = binned(x, edges[fit]), _scores(row, starts[fit], len(y))
                for (f, slot), tree in growing.items():
                    if f == fit:
                        at = tree.route(bins, np.zeros(len(y), np.int64))
                        for n in np.unique(at).tolist():
                            s = tree.sums[n]
                            scores[at == n, slot % params.classes] -= params.rate * s[0] / (s[1] + params.l2)
                yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([scores.tobytes()], pa.binary())],
                                                 ["fit", "block", "scores"])

    return materialize(_with_scores(blocks, state).mapInArrow(add, "fit long, block long, scores binary"))


# --- fits and scores ---------------------------------------------------------------------

def fit(params: Params, rows: DataFrame, n_features: int, task_rows: int = TASK_ROWS) -> dict[int, Forest]:
    """A forest for each ``fit`` of the rows (fit, id, x, y, w). What reaches the driver is
    bounded by the parameters: nodes of trees, not rows."""
    sizes = rows.groupBy("fit").count().collect()
    if any(r["count"] > task_rows for r in sizes):
        return fit_in_blocks(params, rows, n_features)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        f = _grown(params, part)
        arrays = [f.feature, f.cut, f.left, f.right, f.value, f.gain, f.start]
        return pd.DataFrame({"fit": [part.fit.iloc[0]], "trees": [len(f.feature)], "arrays": [[np.ascontiguousarray(a).tobytes() for a in arrays]]})

    out = {}
    spread = rows.repartition(3 * max(len(sizes), 1), "fit")
    for r in spread.groupBy("fit").applyInPandas(grow, "fit long, trees long, arrays array<binary>").collect():
        kinds = (np.int64, float, np.int64, np.int64, float, float, float)
        a = [np.frombuffer(v, k) for v, k in zip(r.arrays, kinds)]
        out[r.fit] = Forest(params, *(v.reshape(r.trees, -1) for v in a[:4]), a[4].reshape(r.trees, len(a[0]) // r.trees, -1), a[5].reshape(r.trees, -1), a[6])
    return out


def _grown(params: Params, part: pd.DataFrame) -> Forest:
    part = part.sort_values("id")
    return fit_in_task(params, part.id.to_numpy(), np.stack(part.x), part.y.to_numpy(), part.w.to_numpy(float))


def probabilities(forest: Forest, features: list[Column]) -> Column:
    """The classes' probabilities of a row as an array; the model travels with the job."""
    @F.pandas_udf("array<double>")
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series(list(forest.probabilities(np.stack(x).astype(float))))

    return predict(F.array(*[c.cast("double") for c in features]))


def table(forest: Forest, spark) -> DataFrame:
    """(tree, node, feature, cut, left, right, gain, value): a row for each node; a leaf has
    no feature. Its size is bounded by the parameters."""
    rows = []
    for t in range(len(forest.feature)):
        used = max(int(forest.left[t].max()), int(forest.right[t].max())) + 1
        for n in range(used):
            f = int(forest.feature[t, n])
            inner = f >= 0
            rows.append((t, n, f if inner else None, float(forest.cut[t, n]) if inner else None, int(forest.left[t, n]) if inner else None,
                         int(forest.right[t, n]) if inner else None, float(forest.gain[t, n]), forest.value[t, n].tolist()))
    return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, left int, right int, gain double, value array<double>")


def from_table(nodes: DataFrame, params: Params, start: list[float]) -> Forest:
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").collect():
        trees.setdefault(r.tree, []).append((-1 if r.feature is None else r.feature, r.cut or 0.0, r.left or 0, r.right or 0, np.array(r.value), r.gain))
    return assembled(params, [trees[t] for t in sorted(trees)], np.array(start))
