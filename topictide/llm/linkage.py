"""All links inside groups of rows, whatever their size, without listing pairs.

What two rows need to be linked is decided by code that runs inside a task and sees a cell:
one or two blocks of rows. Rows it already knows to be connected need no decision, so only
a spanning forest of the links leaves a cell."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.operators.graph import connected_components
from topictide.runtime import materialize

BLOCK_ROWS = 1_000


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def link_groups(rows: DataFrame, payload: DataFrame, columns: list[str], make: Callable[[], Callable],
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) links, a spanning forest of those inside each group, for rows (group, node)
    with long nodes and what is known of a node in ``payload`` (node, *columns).

    ``make()`` gives a function (dict of the columns' lists, Forest, sides) that joins the
    positions it finds linked; ``sides`` tells the two blocks of a cell apart, or is None
    where all pairs count. Groups of up to ``block_rows`` rows are one cell. Larger ones are
    dealt into blocks by a hash of the node, which connects nearly all that belongs
    together; then the rows are laid anew, large components apart, and every two blocks
    that are not of one component make a cell. Work within a hot group of rows that are all
    linked so stays near its size. The payload only moves into the cells."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / block_rows))
    dealt = materialize(rows.select("group", "node").join(sizes, "group").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks"))))
    first = materialize(_cells(
        dealt.select(F.struct("group", "_block").alias("_cell"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_component"), "node"),
        payload, columns, make))
    large = dealt.where("_blocks > 1").select("group", "node")
    if large.isEmpty():
        return first
    parts = connected_components(first).withColumnRenamed("component", "_component")
    large = large.join(parts, "node", "left").withColumn("_component", F.coalesce("_component", "node"))
    held = large.groupBy("group", "_component").agg(F.count(F.lit(1)).alias("_size"))
    few = held.where(F.col("_size") < block_rows).groupBy("group").agg(F.sum("_size").alias("_few"))
    pure = F.col("_size") >= block_rows
    held = held.join(few, "group", "left").select(
        "group", "_component", pure.alias("_pure"),
        F.ceil(F.when(pure, F.col("_size")).otherwise(F.col("_few")) / block_rows).alias("_leaves"))
    leaf = F.struct(F.when(F.col("_pure"), F.col("_component")).alias("of"),
                    F.pmod(F.xxhash64(F.when(F.col("_pure"), F.col("node")).otherwise(F.col("_component"))), F.col("_leaves")).alias("k"))
    laid = materialize(large.join(held, ["group", "_component"]).select("group", "_component", "node", leaf.alias("leaf")))
    leaves = laid.select("group", "leaf").distinct()
    pairs = leaves.join(leaves.withColumnRenamed("leaf", "with"), "group").where(
        (F.col("leaf") <= F.col("with")) & ~F.coalesce(F.col("leaf.of") == F.col("with.of"), F.lit(False)))
    sides = pairs.select("group", "leaf", F.struct("leaf", "with").alias("_pair"), F.lit(0).alias("_side")).unionAll(
        pairs.where("leaf <> with").select("group", F.col("with").alias("leaf"), F.struct("leaf", "with").alias("_pair"), F.lit(1).alias("_side")))
    sides = sides.select(F.col("group").alias("_g"), F.col("leaf").alias("_l"), "_pair", "_side")
    cells = laid.join(sides, (F.col("group") == F.col("_g")) & F.col("leaf").eqNullSafe(F.col("_l"))).select(
        F.struct("group", "_pair").alias("_cell"), "_side", "_component", "node")
    return first.unionAll(_cells(cells, payload, columns, make))


def _cells(rows: DataFrame, payload: DataFrame, columns: list[str], make: Callable[[], Callable]) -> DataFrame:
    """The new links of each cell. Rows of one component count as linked; a cell of two
    sides looks across them only."""
    def run(cell: pa.Table) -> pa.Table:
        nodes, sides, components = (cell.column(c).to_pylist() for c in ("node", "_side", "_component"))
        forest = Forest(len(nodes))
        seen: dict = {}
        for i, c in enumerate(components):
            if c is not None:
                forest.join(seen.setdefault(c, i), i)
        found: list[tuple[int, int]] = []
        join = forest.join

        def noted(i: int, j: int) -> bool:
            if join(i, j):
                found.append((nodes[i], nodes[j]))
                return True
            return False

        forest.join = noted
        make()({c: cell.column(c).to_pylist() for c in columns}, forest, sides if len(set(sides)) > 1 else None)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = rows.join(payload.select("node", *columns), "node").select("_cell", "_side", "_component", "node", *columns)
    return full.groupBy("_cell").applyInArrow(run, "a long, b long")
