"""A metric index: points near the same sampled centre share blocks of bounded size, and the
triangle inequality tells which two blocks can't hold points within some distance.

Only the index's summary (a few numbers for each of at most ``MOST_BLOCKS`` blocks) and the
sampled centres reach the driver and are broadcast. Blocks are dealt to a few groups, and a task
takes the blocks of two groups, so a block moves once for each group that it has to meet and not
once for each block."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.runtime import materialize

# The kernels travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1_000
MOST_BLOCKS = 20_000  # blocks grow beyond BLOCK_ROWS instead
MOST_CENTRES = 1_000
GROUPS = 16  # of blocks; more where one would pass GROUP_BYTES
GROUP_BYTES = 128 << 20  # of vectors
PIVOTS = 8
RINGS = 64
SLACK = 1e-9  # of the distances compared, for what rounding may take off


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances; those lost to cancellation are recomputed from differences."""
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    sq = size - 2.0 * (a @ b.T)
    i, j = np.nonzero(sq <= 1e-6 * size)
    for k in range(0, len(i), 4096):
        x, y = i[k:k + 4096], j[k:k + 4096]
        sq[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return np.sqrt(np.maximum(sq, 0.0))


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the farthest from those before."""
    chosen = [0]
    far = distances(points, points[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1]:chosen[-1] + 1])[:, 0])
    return points[chosen]


@dataclass
class Summary:
    """Of each block: its centre, the largest distance to it, and the range of distances to each pivot."""

    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    between_centres: np.ndarray

    def least_distances(self, a: int) -> np.ndarray:
        """From block ``a`` to every block: no two of their points are nearer."""
        rings = np.maximum(self.low - self.high[a], self.low[a] - self.high).max(axis=1, initial=0.0)
        apart = self.between_centres[self.centre[a]][self.centre] - self.radius - self.radius[a]
        return np.maximum(0.0, np.maximum(rings, apart) - SLACK * (self.high.max(initial=0.0) + 1.0))


@dataclass
class Index:
    """``blocks`` has a row for each block: (block, ids, points, weights, vectors), packed."""

    blocks: DataFrame
    n_points: int
    n_blocks: int
    centres: np.ndarray
    centre_weights: np.ndarray
    centre_points: list[int]
    summary: Summary


def unpack(vectors: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(vectors, np.float64).reshape(n, -1)


def build(points: DataFrame, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The index of (point, embedding, weight); none without points. Points are numbered
    by block (upper half of the number) and place."""
    spark = points.sparkSession
    n = points.count()
    if not n:
        return None
    rows = max(block_rows, -(-n // (MOST_BLOCKS // 2)))
    wanted = min(n, MOST_CENTRES, max(16, -(-2 * n // rows)))
    key = F.pmod(F.xxhash64(F.lit(5), "point"), F.lit(2**30))
    sample = points.select("point", "embedding", "weight", key.alias("key")).where(
        F.col("key") <= int(min(1.0, (1.5 * wanted + 20) / n) * 2**30)).collect()
    sample = sorted(sample, key=lambda r: (r.key, r.point))[:wanted] or [points.orderBy("point").select(
        "point", "embedding", "weight", key.alias("key")).first()]
    centres = np.array([r.embedding for r in sample], float)
    sent = spark.sparkContext.broadcast((centres, spread_out(centres, PIVOTS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                x = np.array(batch.column("embedding").to_pylist(), float)
                d = distances(x, centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("point"), batch.column("weight"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array(cell), pa.array(d[np.arange(len(x)), cell])], ["point", "weight", "vector", "cell", "away"])

    placed = materialize(points.select("point", "weight", "embedding").mapInArrow(
        place, "point long, weight long, vector binary, cell long, away double"))
    cuts = placed.groupBy("cell").agg(
        F.percentile_approx("away", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), 1_000).alias("cuts"),
        F.least(F.ceil(F.count(F.lit(1)) / rows), F.lit(RINGS)).cast("int").alias("rings"))
    chosen = F.expr("transform(sequence(1, greatest(rings - 1, 1)), i -> cuts[cast(floor(i * {0} / rings) as int) - 1])".format(RINGS))
    cuts = cuts.select("cell", F.when(F.col("rings") > 1, chosen).otherwise(F.array().cast("array<double>")).alias("cuts"))
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", F.expr("size(filter(cuts, c -> c < away))")).drop("cuts", "away")
    # At most MOST_CENTRES * RINGS of them; a ring of equal distances is cut further by a hash.
    full = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts")).orderBy("cell", "ring").collect()
    first, numbered = 0, []
    for r in full:
        numbered.append((r.cell, r.ring, r.parts, first))
        first += r.parts
    sizes = spark.createDataFrame(numbered, "cell long, ring int, parts int, first int")
    part = F.pmod(F.xxhash64(F.lit(7), "point"), F.col("parts")).cast("int")
    dealt = ringed.join(F.broadcast(sizes), ["cell", "ring"]).select((F.col("first") + part).alias("block"), "cell", "point", "weight", "vector")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("point")
        centres, pivots = sent.value
        block, cell, size = table.column("block")[0].as_py(), table.column("cell")[0].as_py(), table.num_rows
        vectors = b"".join(table.column("vector").to_pylist())
        x = unpack(vectors, size)
        d = distances(x, pivots)
        packed = [(block << 32) + np.arange(size), table.column("point").to_numpy(), table.column("weight").to_numpy()]
        return pa.table({"block": pa.array([block], pa.int64()), "cell": pa.array([cell], pa.int64()),
                         **{k: pa.array([v.astype("<i8").tobytes()], pa.binary()) for k, v in zip(("ids", "points", "weights"), packed)},
                         "vectors": pa.array([vectors], pa.binary()), "radius": [float(distances(x, centres[cell:cell + 1]).max())],
                         "low": [d.min(axis=0).tolist()], "high": [d.max(axis=0).tolist()]})

    blocks = materialize(dealt.groupBy("block").applyInArrow(
        pack, "block long, cell long, ids binary, points binary, weights binary, vectors binary, radius double, low array<double>, high array<double>"))
    known = {r.block: r for r in blocks.select("block", "cell", "radius", "low", "high").collect()}
    # A hash may leave a part empty; its block is out of reach.
    width = len(next(iter(known.values())).low)
    get = lambda f, none: np.array([f(known[b]) if b in known else none for b in range(first)], float)
    return Index(blocks.select("block", "ids", "points", "weights", "vectors"), n, first, centres,
                 np.array([r.weight for r in sample]), [r.point for r in sample],
                 Summary(get(lambda r: r.cell, 0).astype(int), get(lambda r: r.radius, -np.inf),
                         get(lambda r: r.low, [np.inf] * width).reshape(first, width),
                         get(lambda r: r.high, [-np.inf] * width).reshape(first, width), distances(centres, centres)))


def block_pairs(index: Index, needed: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks for which ``needed`` (block, other blocks, least
    distances to them) says so. Listed by tasks, from the broadcast summary."""
    spark = index.blocks.sparkSession
    sent = spark.sparkContext.broadcast(index.summary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(sent.value.centre))
        for batch in batches:
            for a in batch.column(0).to_pylist():
                others = every[a:]
                b = others[needed(a, others, sent.value.least_distances(a)[a:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], ["a", "b"])

    own = index.blocks.select("block").repartition(min(index.n_blocks, 200))
    return own.mapInArrow(run, "a long, b long")


@dataclass
class Block:
    """A block as a task holds it. ``extra`` has the columns added to it, as Arrow scalars."""

    ids: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    extra: dict


def n_groups(index: Index) -> int:
    whole = index.n_points * index.centres.shape[1] * 8
    return max(1, min(index.n_blocks, max(GROUPS, -(-whole // GROUP_BYTES))))


def meeting(index: Index, needed: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
            kernel: Callable[[dict[int, Block], list[tuple[int, int]]], pa.Table], kind: str, extra: DataFrame | None = None) -> DataFrame:
    """What ``kernel`` returns, as ``kind``, for all pairs of blocks that ``block_pairs`` would
    list, a tile at a time: the pairs of two groups of blocks, with each of these blocks once.
    ``extra`` (block, ...) adds columns to the blocks."""
    spark = index.blocks.sparkSession
    sent, count = spark.sparkContext.broadcast(index.summary), n_groups(index)
    group = np.arange(index.n_blocks) * count // index.n_blocks

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(group))
        for batch in batches:
            for a in batch.column(0).to_pylist():
                others = every[a:]
                b = others[needed(a, others, sent.value.least_distances(a)[a:])]
                tiles = group[a] * count + group[b]
                own = np.unique(tiles)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, tiles])), pa.array(np.concatenate([np.full(len(own), a), b]))],
                                                 ["tile", "block"])

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        held = {}
        for i, block in enumerate(table.column("block").to_pylist()):
            of = {c: table.column(c)[i] for c in table.column_names}
            ids, weights = (np.frombuffer(of[c].as_buffer(), "<i8") for c in ("ids", "weights"))
            held[block] = Block(ids, weights, unpack(of["vectors"].as_buffer(), len(ids)), of)
        known = np.array(sorted(held))
        rows, columns = (known[group[known] == g] for g in divmod(tile, count))
        pairs = []
        for a in rows.tolist():
            others = columns[columns >= a]
            pairs += [(a, b) for b in others[needed(a, others, sent.value.least_distances(a)[others])].tolist()]
        return kernel(held, pairs)

    # At most as many rows as blocks times groups.
    dealt = index.blocks.select("block").repartition(min(index.n_blocks, 200)).mapInArrow(places, "tile long, block long").distinct()
    blocks = index.blocks.select("block", "ids", "weights", "vectors")
    blocks = blocks if extra is None else blocks.join(extra, "block")
    return blocks.join(F.broadcast(dealt), "block").groupBy("tile").applyInArrow(run, kind)
