"""Density clustering (DBSCAN* and HDBSCAN*) on Spark.

Exact neighbourhoods without pairs of rows ever leaving a task:

1. equal vectors collapse to one weighted point;
2. a metric index deals the points to blocks and names the pairs of blocks that may hold
   neighbours (``metric_index``);
3. a task takes the pairs between two groups of blocks, compares them with numpy and returns,
   per point, its nearest distances of all these pairs, then only the minimum spanning forest
   of the mutual reachability distances. The union
   of these forests holds a minimum spanning forest of the whole graph, so all levels can be
   read from it (``merge_tree``).

A dense region is thus spread over many tasks of bounded memory.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.operators import merge_tree, metric_index
from topictide.operators.graph import connected_components
from topictide.operators.metric_index import BLOCK_ROWS, Block, Index, distances, meeting, unpack
from topictide.runtime import materialize
from topictide.schemas import NOISE_CLUSTER

# The block kernels travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_EDGES = 300_000  # that a task thins out at once


def unique_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(point, embedding, weight) and (row_id, point): equal vectors share a point."""
    digest = points.select("row_id", F.col("embedding").cast("array<double>").alias("embedding"))
    groups = materialize(digest.groupBy("embedding").agg(
        F.min("row_id").alias("point"), F.count(F.lit(1)).alias("weight")))
    members = digest.join(groups.select("embedding", "point"), "embedding").select("row_id", "point")
    return groups, members


def _numbers(packed: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(packed, kind)


def _reached(d: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Per row the distance within which others weigh ``k`` together; infinite where they don't."""
    order = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
    near = np.take_along_axis(d, order, axis=1)
    by_distance = np.argsort(near, axis=1, kind="stable")
    near, order = np.take_along_axis(near, by_distance, axis=1), np.take_along_axis(order, by_distance, axis=1)
    enough = np.cumsum(weights[order], axis=1) >= k
    return np.where(enough.any(axis=1), near[np.arange(len(d)), enough.argmax(axis=1)], np.inf)


def reach_bounds(index: Index, min_samples: int) -> DataFrame:
    """(block, reach, most, sure): for each point a distance within which it surely has its
    ``min_samples``-th neighbour, from its own block and the sampled centres; the largest of
    a block."""
    sent = index.blocks.sparkSession.sparkContext.broadcast((index.centres, index.centre_weights, np.array(index.centre_points)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, weights, names = sent.value
        for batch in batches:
            for block, points, own, vectors in zip(*(batch.column(c).to_pylist() for c in ("block", "points", "weights", "vectors"))):
                points, own = _numbers(points), _numbers(own)
                x = unpack(vectors, len(points))
                to_own, to_centres = distances(x, x), distances(x, centres)
                to_own[np.arange(len(x)), np.arange(len(x))] = 0.0
                to_centres[points[:, None] == names[None, :]] = np.inf  # the point itself is counted apart
                found = np.minimum(_reached(to_own, own, min_samples), _reached(
                    np.column_stack([np.zeros(len(x)), to_centres]), np.concatenate([[0], weights]), min_samples))
                found = np.where(own >= min_samples, 0.0, found)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found.tobytes()], pa.binary()), pa.array([float(found.max())])],
                                                 ["block", "reach", "most"])

    return materialize(index.blocks.select("block", "points", "weights", "vectors").mapInArrow(run, "block long, reach binary, most double"))


def nearest_distances(index: Index, min_samples: int, radius: float | None = None) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th neighbour, the point itself and
    its copies counted; null when fewer lie within the radius. Without a radius every point
    is looked at as far as its bound reaches."""
    spark = index.blocks.sparkSession
    if radius is None:
        bounds = reach_bounds(index, min_samples)
        most = np.zeros(index.n_blocks)
        for r in bounds.select("block", "most").collect():
            most[r.block] = r.most
        known = spark.sparkContext.broadcast(most)
        needed, extra = lambda a, b, least: least <= np.maximum(known.value[a], known.value[b]), bounds.select("block", "reach")
    else:
        needed, extra = lambda a, b, least: least <= radius, None

    def near(blocks: dict[int, Block], pairs: list[tuple[int, int]]) -> pa.Table:
        nearest = {name: (np.full((len(b.ids), min_samples), np.inf), np.zeros((len(b.ids), min_samples), np.int64)) for name, b in blocks.items()}
        limits = {name: np.full(len(b.ids), radius) if radius is not None else _numbers(b.extra["reach"].as_buffer(), "<f8") for name, b in blocks.items()}

        def taken(name: int, d: np.ndarray, weights: np.ndarray) -> None:
            """Puts what is nearer into the nearest ones of a block's points."""
            held, heavy = nearest[name]
            limit, least = limits[name] * (1 + 1e-12), d.min(axis=1)
            rows = np.flatnonzero((least <= limit) & (least < held[:, -1]))
            if not len(rows):
                return
            d, k = d[rows], min(min_samples, d.shape[1])
            order = np.argpartition(d, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(d, order, axis=1)
            top[top > limit[rows, None]] = np.inf
            both, weight = np.concatenate([held[rows], top], axis=1), np.concatenate([heavy[rows], weights[order]], axis=1)
            kept = np.argsort(both, axis=1, kind="stable")[:, :min_samples]
            held[rows], heavy[rows] = np.take_along_axis(both, kept, axis=1), np.take_along_axis(weight, kept, axis=1)

        for a, b in pairs:
            one, other = blocks[a], blocks[b]
            d = distances(one.vectors, other.vectors)
            if a == b:
                np.fill_diagonal(d, np.inf)
            else:
                taken(b, d.T, one.weights)
            taken(a, d, other.weights)
        out = []
        for name, (held, heavy) in nearest.items():
            rows, columns = np.nonzero(np.isfinite(held))
            out.append((blocks[name].ids[rows], held[rows, columns], heavy[rows, columns]))
        return pa.table(dict(zip(("id", "d", "w"), (np.concatenate(x) for x in zip(*out)))))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, weights in zip(batch.column("ids").to_pylist(), batch.column("weights").to_pylist()):
                ids, weights = _numbers(ids), _numbers(weights)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(len(ids))), pa.array(weights)], ["id", "d", "w"])

    kind = "id long, d double, w long"
    found = meeting(index, needed, near, kind, extra).unionByName(index.blocks.select("ids", "weights").mapInArrow(own, kind))
    by_d = W.partitionBy("id").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    ranked = found.withColumn("seen", F.sum("w").over(by_d))
    return ranked.groupBy("id").agg(F.min(F.when(F.col("seen") >= min_samples, F.col("d"))).alias("core"))


def packed_cores(index: Index, cores: DataFrame) -> DataFrame:
    """(block, cores, least, most): the cores of a block's points in its order, null as infinite."""
    place = F.col("id").bitwiseAND(F.lit((1 << 32) - 1))
    listed = cores.groupBy(F.shiftright("id", 32).alias("block")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(place.alias("at"), F.coalesce("core", F.lit(float("inf"))).alias("core")))), lambda s: s["core"]).alias("cores"))
    return materialize(listed.withColumns({"least": F.array_min("cores"), "most": F.array_max("cores")}))


def _spanning(reach: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest between the rows and columns of finite distances (of one
    set with itself, if ``same``), by Prim's rule with a vector step per point."""
    n, m = reach.shape
    full = reach if same else np.block([[np.full((n, n), np.inf), reach], [reach.T, np.full((m, m), np.inf)]])
    size = len(full)
    best, via, out = np.full(size, np.inf), np.zeros(size, int), np.ones(size, bool)
    a, b, w = [], [], []
    at = 0
    for _ in range(size - 1):
        out[at] = False
        best[at] = np.inf
        nearer = out & (full[at] < best)
        best[nearer], via[nearer] = full[at][nearer], at
        at = int(best.argmin())
        if best[at] == np.inf:  # a new tree
            at = int(out.argmax())
            continue
        a.append(via[at])
        b.append(at)
        w.append(best[at])
    a, b = np.array(a, int), np.array(b, int)
    return (a, b, np.array(w)) if same else (np.minimum(a, b), np.maximum(a, b) - n, np.array(w))


def spanning_edges(index: Index, cores: DataFrame, needed: Callable[[int, np.ndarray, np.ndarray], np.ndarray], radius: float | None = None) -> DataFrame:
    """(a, size_a, b, size_b, w): minimum spanning forests of the mutual reachability of the
    core points of the needed pairs of blocks, up to the radius. A task keeps one forest of all
    the pairs of two groups."""
    limit = np.inf if radius is None else radius

    def run(blocks: dict[int, Block], pairs: list[tuple[int, int]]) -> pa.Table:
        held, most, sides = [(*[np.empty(0, np.int64)] * 4, np.empty(0))], HELD_EDGES, {}
        for name, s in blocks.items():
            own = np.array(s.extra["cores"].as_py(), float)
            core = own <= (limit if np.isfinite(limit) else np.finfo(float).max)
            sides[name] = s.ids[core], s.weights[core], own[core], s.vectors[core]

        def thinned() -> tuple:
            a, size_a, b, size_b, w = (np.concatenate(x) for x in zip(*held))
            kept = merge_tree.forest(a, b, np.lexsort((b, a, w)))
            return a[kept], size_a[kept], b[kept], size_b[kept], w[kept]

        for a, b in pairs:
            (ids, size, core, x), (ids_b, size_b, core_b, y) = sides[a], sides[b]
            if not len(ids) or not len(ids_b):
                continue
            reach = np.maximum(distances(x, y), np.maximum(core[:, None], core_b[None, :]))
            reach[reach > limit] = np.inf
            if a == b:
                np.fill_diagonal(reach, np.inf)
            if radius is not None and np.count_nonzero(reach < np.inf) <= len(ids) + len(ids_b):
                p, q = np.nonzero(reach < np.inf)  # few, which are thinned with the others
                w = reach[p, q]
            else:
                p, q, w = _spanning(reach, a == b)
            held.append((ids[p], size[p], ids_b[q], size_b[q], w))
            if sum(len(h[0]) for h in held) > most:
                held[:] = [thinned()]
                most = max(HELD_EDGES, 2 * len(held[0][0]))
        return pa.table(dict(zip(("a", "size_a", "b", "size_b", "w"), thinned())))

    return materialize(meeting(index, needed, run, "a long, size_a long, b long, size_b long, w double", cores.select("block", "cores")))


def named_points(index: Index) -> DataFrame:
    """(id, point, weight) of all points of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in zip(*(batch.column(c).to_pylist() for c in ("ids", "points", "weights"))):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(p)) for p in packed], ["id", "point", "weight"])

    return index.blocks.select("ids", "points", "weights").mapInArrow(run, "id long, point long, weight long")


def _at_radius(index: Index, radius: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Cores and spanning edges of all points up to a radius, by point."""
    cores = materialize(nearest_distances(index, min_samples, radius))
    edges = spanning_edges(index, packed_cores(index, cores), lambda a, b, least: least <= radius, radius)
    names = materialize(named_points(index))
    own = names.select("id", "point")
    edges = edges.join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "w")
    return materialize(cores.join(own, "id").select("point", "core")), materialize(edges)


def flat_clusters(points: DataFrame, radius: float, min_samples: int = 8, min_cluster_size: int = 1,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """DBSCAN* at one radius: (row_id, cluster), a cluster named by its smallest row_id,
    -1 for noise. Core points have ``min_samples`` points, themselves included, within
    the radius; clusters are their connected components."""
    groups, members = unique_points(points)
    index = metric_index.build(groups, block_rows)
    if index is None:
        return members.select("row_id", F.lit(NOISE_CLUSTER).cast("long").alias("cluster"))
    cores, edges = _at_radius(index, radius, min_samples)
    linked = connected_components(edges.select("a", "b"))
    core_points = cores.where(F.col("core") <= radius).select("point")
    named = core_points.join(linked.withColumnRenamed("node", "point"), "point", "left").select(
        "point", F.coalesce("component", "point").alias("component"))
    return _label(members, named, min_cluster_size)


def _label(members: DataFrame, named: DataFrame, min_cluster_size: int) -> DataFrame:
    placed = members.join(named, "point", "left")
    big = placed.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cluster_size).select(
        "component", F.col("component").alias("cluster"))
    return placed.join(big, "component", "left").select(
        "row_id", F.coalesce("cluster", F.lit(NOISE_CLUSTER).cast("long")).alias("cluster"))


# --- all heights ------------------------------------------------------------------------

def spanning_tree(index: Index, min_samples: int) -> DataFrame:
    """(a, size_a, b, size_b, w): edges that hold a minimum spanning tree of the mutual
    reachability of all points.

    Every point has a way to every other over its centre: the edge to it, then the minimum
    spanning tree of the centres. Two blocks no nearer than the longest step on that way
    can't add an edge, so only the others are compared."""
    spark = index.blocks.sparkSession
    found = materialize(nearest_distances(index, min_samples))
    cores = packed_cores(index, found)
    own = {r.point: r.core for r in named_points(index).join(F.broadcast(
        spark.createDataFrame([(int(p),) for p in index.centre_points], "point long")), "point").join(found, "id").select("point", "core").collect()}
    core = np.array([own[p] if own[p] is not None else np.inf for p in index.centre_points])
    steps = np.maximum(distances(index.centres, index.centres), np.maximum(core[:, None], core[None, :]))
    worst = np.zeros_like(steps)  # the longest step between two centres
    reached = [0]
    np.fill_diagonal(steps, np.inf)
    for a, b, w in zip(*_spanning(steps, True)):
        worst[b, reached] = worst[reached, b] = np.maximum(worst[a, reached], w)
        reached.append(int(b))
    np.fill_diagonal(steps, core)
    known = {r.block: r for r in cores.select("block", "least", "most").collect()}
    least_core = np.array([known[b].least if b in known else np.inf for b in range(index.n_blocks)])
    most_core = np.array([known[b].most if b in known else 0.0 for b in range(index.n_blocks)])
    centre = index.summary.centre
    to_centre = np.maximum(np.maximum(index.summary.radius, most_core), core[centre])
    sent = spark.sparkContext.broadcast((worst, centre, to_centre * (1 + 1e-9), least_core))

    def needed(a: int, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        worst, centre, to_centre, cores = sent.value
        way = np.maximum(np.maximum(to_centre[a], to_centre[b]), worst[centre[a]][centre[b]])
        return (np.maximum(least, np.maximum(cores[a], cores[b])) <= way) | (b == a)

    compared = spanning_edges(index, cores, needed)
    return compared.unionByName(_ways(index, cores, core, worst))


def _ways(index: Index, cores: DataFrame, centre_cores: np.ndarray, worst: np.ndarray) -> DataFrame:
    """The edges that the ways over centres take: each point to the centre of its block, and
    the minimum spanning tree of the centres."""
    spark = index.blocks.sparkSession
    ids = {r.point: (r.id, r.weight) for r in named_points(index).join(F.broadcast(
        spark.createDataFrame([(int(p),) for p in index.centre_points], "point long")), "point").collect()}
    centre_ids = np.array([ids[p][0] for p in index.centre_points])
    centre_sizes = np.array([ids[p][1] for p in index.centre_points])
    sent = spark.sparkContext.broadcast((index.centres, centre_ids, centre_sizes, centre_cores, index.summary.centre))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, names, sizes, own_cores, centre = sent.value
        for batch in batches:
            for block, ids, weights, vectors, cores in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "weights", "vectors", "cores"))):
                ids, weights, c = _numbers(ids), _numbers(weights), centre[block]
                x = unpack(vectors, len(ids))
                w = np.maximum(np.maximum(distances(x, centres[c:c + 1])[:, 0], own_cores[c]), np.array(cores, float))
                some = (ids != names[c]) & np.isfinite(w)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(weights[some]), pa.array(np.full(some.sum(), names[c])),
                                                  pa.array(np.full(some.sum(), sizes[c])), pa.array(w[some])], ["a", "size_a", "b", "size_b", "w"])

    kind = "a long, size_a long, b long, size_b long, w double"
    out = index.blocks.join(cores.select("block", "cores"), "block").mapInArrow(links, kind)
    steps = np.maximum(distances(index.centres, index.centres), np.maximum(centre_cores[:, None], centre_cores[None, :]))
    np.fill_diagonal(steps, np.inf)
    tree = [(int(centre_ids[a]), int(centre_sizes[a]), int(centre_ids[b]), int(centre_sizes[b]), float(w)) for a, b, w in zip(*_spanning(steps, True))]
    return out.unionByName(spark.createDataFrame(tree, kind))


def merge_levels(points: DataFrame, min_samples: int = 8, block_rows: int = BLOCK_ROWS, task_edges: int = merge_tree.TASK_EDGES) -> DataFrame:
    """(height, smaller, larger): every merge of two groups of rows in the hierarchy, at all
    heights; copies of a vector are one from the start. No rows for less than two vectors, or
    less than ``min_samples`` rows."""
    index = metric_index.build(unique_points(points)[0], block_rows)
    if index is None:
        return points.sparkSession.createDataFrame([], "height double, smaller long, larger long")
    return merge_tree.merge_heights(spanning_tree(index, min_samples), task_edges)


def hierarchical_clusters(points: DataFrame, min_samples: int = 8, min_cluster_size: int = 35, block_rows: int = BLOCK_ROWS,
                          task_edges: int = merge_tree.TASK_EDGES) -> DataFrame:
    """Variable-density clusters from the merges at every height: (row_id, cluster), a
    cluster named by its smallest row_id, -1 for noise.

    Groups that reach ``min_cluster_size`` form a tree, and the most stable ones that don't
    overlap are chosen (excess of mass, the root excluded). Less than ``min_samples`` rows,
    or a tree that never splits, are all noise. Ties between merges go by place in the index."""
    groups, members = unique_points(points)
    index = metric_index.build(groups, block_rows)
    if index is None:
        return members.select("row_id", F.lit(NOISE_CLUSTER).cast("long").alias("cluster"))
    found, clusters = merge_tree.condensed_tree(spanning_tree(index, min_samples), min_cluster_size, task_edges)
    names = materialize(named_points(index))
    # Copies alone may be a cluster from the start.
    found = materialize(found.join(names, F.col("node") == F.col("id")).select(
        "point", "weight", "cluster", F.when(F.col("weight") >= min_cluster_size, F.lit(0.0)).otherwise(F.col("t")).alias("t")))
    picks = merge_tree.chosen_clusters(merge_tree.stabilities(found, clusters))
    named = found.where("t IS NOT NULL").join(picks.where("pick IS NOT NULL"), "cluster").select("point", F.col("pick").alias("component"))
    return _by_smallest_row(members.join(named, "point", "left"))


def _by_smallest_row(placed: DataFrame) -> DataFrame:
    names = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("row_id").alias("cluster"))
    return placed.join(names, "component", "left").select(
        "row_id", F.coalesce("cluster", F.lit(NOISE_CLUSTER).cast("long")).alias("cluster"))


# --- a grid of radii ----------------------------------------------------------------------

def density_clusters(points: DataFrame, radii: list[float], min_samples: int = 8,
                     min_cluster_size: int = 35, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Variable-density clusters from a grid of radii: (row_id, cluster), a cluster named by
    its smallest row_id, -1 for noise.

    The levels of the hierarchy are the given radii. Components that reach
    ``min_cluster_size`` form a tree; the most stable non-overlapping ones are chosen
    (excess of mass, the root excluded). The tree has at most rows / min_cluster_size
    nodes per level and is walked with joins, one level at a time."""
    levels = sorted({float(r) for r in radii}, reverse=True)
    groups, members = unique_points(points)
    index = metric_index.build(groups, block_rows)
    if index is None:
        return members.select("row_id", F.lit(NOISE_CLUSTER).cast("long").alias("cluster"))
    cores, edges = _at_radius(index, levels[0], min_samples)

    # Component of every point at every level that is dense enough, from fine to coarse.
    at_level = []
    for depth, r in enumerate(levels):
        linked = connected_components(edges.where(F.col("w") <= r).select("a", "b"))
        core_points = cores.where(F.col("core") <= r).select("point")
        comp = core_points.join(linked.withColumnRenamed("node", "point"), "point", "left").select(
            "point", F.coalesce("component", "point").alias("component"))
        placed = members.join(comp, "point")
        size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cluster_size)
        at_level.append(materialize(
            placed.join(size, "component").select("row_id", F.col("component").alias(f"c{depth}"))))

    # Rows with their chain of components; a branch keeps its identity until it splits.
    chain = at_level[0]
    for nxt in at_level[1:]:
        chain = chain.join(nxt, "row_id", "left")
    chain = materialize(chain)
    return _most_stable(chain, members, levels)


def _most_stable(chain: DataFrame, members: DataFrame, levels: list[float]) -> DataFrame:
    """Excess-of-mass choice over the nested components."""
    depth = len(levels)
    lam = [1.0 / r for r in levels]
    # branch{i}: name of the tree node that holds the component at level i.
    rows = chain.withColumn("branch0", F.when(F.col("c0").isNotNull(), F.concat(F.lit("0:"), F.col("c0"))))
    for i in range(1, depth):
        kids = (rows.where(F.col(f"c{i}").isNotNull()).groupBy(f"branch{i - 1}")
                .agg(F.countDistinct(f"c{i}").alias("_kids")))
        rows = rows.join(kids, f"branch{i - 1}", "left").withColumn(
            f"branch{i}",
            F.when(F.col(f"c{i}").isNull(), F.lit(None).cast("string"))
            .when(F.col("_kids") == 1, F.col(f"branch{i - 1}"))
            .otherwise(F.concat(F.lit(f"{i}:"), F.col(f"c{i}")))).drop("_kids")
    rows = materialize(rows)

    # Stability: sum over rows of (lambda where the row leaves the branch - lambda at birth).
    spans = None
    for i in range(depth):
        step = lam[i] - (lam[i - 1] if i else 0.0)
        part = rows.where(F.col(f"branch{i}").isNotNull()).groupBy(F.col(f"branch{i}").alias("branch")).agg(
            (F.count(F.lit(1)) * F.lit(step)).alias("s"), F.lit(i).alias("level"))
        spans = part if spans is None else spans.unionByName(part)
    born = F.split("branch", ":")[0].cast("int")
    stability = materialize(
        spans.groupBy("branch").agg(
            F.sum(F.when(F.col("level") == born, F.lit(0.0)).otherwise(F.col("s"))).alias("own")))
    links = None
    for i in range(1, depth):
        part = rows.where(F.col(f"branch{i}").isNotNull() & (F.col(f"branch{i}") != F.col(f"branch{i - 1}"))).select(
            F.col(f"branch{i - 1}").alias("parent"), F.col(f"branch{i}").alias("branch"), F.lit(i).alias("level")).distinct()
        links = part if links is None else links.unionByName(part)
    best = stability.withColumn("best", F.col("own")).withColumn("chosen", F.lit(True))
    if links is not None:
        links = materialize(links)
        for i in range(depth - 1, 0, -1):
            below = links.where(F.col("level") == i).join(best, "branch").groupBy("parent").agg(
                F.sum("best").alias("_below"))
            best = materialize(
                best.join(below.withColumnRenamed("parent", "branch"), "branch", "left").select(
                    "branch", "own",
                    F.greatest("best", F.coalesce("_below", F.lit(0.0))).alias("best"),
                    (F.col("chosen") & (F.coalesce("_below", F.lit(0.0)) <= F.col("best"))).alias("chosen")))
        # The root of a split tree is never a topic of its own.
        roots = links.where(F.col("level") >= 1).select(F.col("parent").alias("branch")).distinct()
        single_root = rows.select("branch0").distinct().count() == 1
        if single_root:
            top = rows.select(F.col("branch0").alias("branch")).distinct().join(roots, "branch", "left_semi")
            best = best.join(top.withColumn("_root", F.lit(True)), "branch", "left").withColumn(
                "chosen", F.col("chosen") & F.col("_root").isNull()).drop("_root")
    chosen = materialize(best.where("chosen").select("branch"))

    # A row belongs to the coarsest chosen branch on its path.
    out = rows
    for i in range(depth):
        pick = chosen.select(F.col("branch").alias(f"branch{i}"), F.col("branch").alias(f"pick{i}"))
        out = out.join(pick, f"branch{i}", "left")
    picked = out.select("row_id", F.coalesce(*[F.col(f"pick{i}") for i in range(depth)]).alias("branch"))
    names = picked.where(F.col("branch").isNotNull()).groupBy("branch").agg(F.min("row_id").alias("first_row"))
    joined = members.select("row_id").join(picked, "row_id", "left").join(names, "branch", "left")
    return joined.select("row_id", F.coalesce("first_row", F.lit(NOISE_CLUSTER).cast("long")).alias("cluster"))
