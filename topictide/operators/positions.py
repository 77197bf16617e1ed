"""Places of rows in the order of a key, by a distributed prefix sum.

Rows are sorted by range, so a key with very many rows lies in several neighbouring
partitions and no task sorts a key. Rows are counted per partition and key, the counts of a
key are summed over the partitions before, and a row's place in its partition is added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.runtime import materialize


def in_order(rows: DataFrame, by: list[str], range_rows: int | None = None) -> DataFrame:
    """Rows in the order of ``by``, from partition to partition. ``range_rows`` sets about how
    many rows a partition has."""
    dealt = rows.repartitionByRange(*by) if range_rows is None else rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), *by)
    return dealt.sortWithinPartitions(*by)


def in_ranges(rows: DataFrame, keys: list[str], order: str, range_rows: int | None = None) -> DataFrame:
    """Rows with ``_range``, the number of their range in the order of (keys, order), and
    ``_at``, which grows with the order. ``range_rows`` sets about how many rows a range has."""
    return materialize(in_order(rows, [*keys, order], range_rows).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def positioned(rows: DataFrame, keys: list[str], order: str, range_rows: int | None = None) -> DataFrame:
    """Rows with ``position``, from 0 in the order of each key. A null key is a key; rows of
    a key that are equal in ``order`` follow each other."""
    placed = in_ranges(rows, keys, order, range_rows)
    counts = placed.groupBy("_range", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # At most as many rows per key as there are ranges.
    ahead = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_range", *[F.col(k).alias(f"_{k}") for k in keys], "_first",
                           F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")).withColumnRenamed("_range", "_own")
    same = F.col("_range") == F.col("_own")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_ahead") + F.col("_at") - F.col("_first")).alias("position"))
