"""Exact order statistics per key without sorting a key in one task.

A key may hold a third of all rows and ``k`` may grow with the data, so neither a
per-key window nor a per-key top-k buffer is safe. Histogram passes narrow down where
the cutoff lies until few rows are left: approximate percentiles only choose the bin
edges, the counts that decide are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.runtime import materialize

BINS = 64
SORT_ROWS = 100_000  # of a key, that one task may sort at the end


def kth_smallest(df: DataFrame, key: str, value: str, tie: str, wanted: DataFrame, sort_rows: int = SORT_ROWS,
                 bins: int = BINS) -> DataFrame:
    """(key, cutoff, tie_cutoff): the ``k``-th smallest row per key in order of
    (value, tie) for a ``wanted`` table (key, k) of few keys that each have k rows at least.

    A pass bins the rows that are left of a key by value or, where all values are equal,
    by tie, and keeps the bin that holds the k-th. A value that is an edge has a bin of
    its own, so however many rows share it, it is isolated at once; every other bin has
    about 1 / bins of the rows. Passes go on until no key has more than ``sort_rows`` that differ."""
    left = df.select(key, value, tie).join(F.broadcast(wanted), key)
    steps = [i / bins for i in range(1, bins)]
    while True:
        spread = left.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), (F.min(value) < F.max(value)).alias("_by_value"),
            (F.min(tie) < F.max(tie)).alias("_by_tie"),
            F.percentile_approx(value, steps, 10_000).alias("_value_edges"), F.percentile_approx(tie, steps, 10_000).alias("_tie_edges"))
        spread = materialize(spread)
        if spread.where((F.col("_n") > sort_rows) & (F.col("_by_value") | F.col("_by_tie"))).isEmpty():
            break

        def place(edges: str, column: str):
            below = F.size(F.filter(edges, lambda e: e < F.col(column)))
            return 2 * below + F.array_contains(edges, F.col(column)).cast("int")

        binned = left.join(F.broadcast(spread), key).withColumn(
            "_bin", F.when(F.col("_n") <= sort_rows, F.lit(0)).when(F.col("_by_value"), place("_value_edges", value))
            .otherwise(place("_tie_edges", tie))).select(key, value, tie, "k", "_bin")
        upto = W.partitionBy(key).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
        counts = binned.groupBy(key, "_bin", "k").agg(F.count(F.lit(1)).alias("_c")).withColumn("_run", F.sum("_c").over(upto))
        edge = counts.where((F.col("_run") >= F.col("k")) & (F.col("_run") - F.col("_c") < F.col("k"))).select(
            key, "_bin", (F.col("k") - (F.col("_run") - F.col("_c"))).alias("_k"))
        left = materialize(binned.drop("k").join(F.broadcast(edge), [key, "_bin"]).select(key, value, tie, F.col("_k").alias("k")))
    upto = W.partitionBy(key).orderBy(value, tie).rowsBetween(W.unboundedPreceding, 0)
    ordered = left.groupBy(key, value, tie, "k").agg(F.count(F.lit(1)).alias("_c")).withColumn("_run", F.sum("_c").over(upto))
    return ordered.where((F.col("_run") >= F.col("k")) & (F.col("_run") - F.col("_c") < F.col("k"))).select(
        key, F.col(value).alias("cutoff"), F.col(tie).alias("tie_cutoff"))


def most_frequent(rows: DataFrame, count: str, name: str, most: int) -> DataFrame:
    """The ``most`` rows with the highest counts, ties at the last count in order of name.

    A histogram of exact counts tells the lowest count that still belongs to them, so only
    rows of that count are ordered; the histogram has one row per distinct count, and those
    are at most the square root of twice the sum of all counts."""
    sizes = rows.groupBy(count).agg(F.count(F.lit(1)).alias("_c"))
    upto = W.orderBy(F.desc("_from")).rowsBetween(W.unboundedPreceding, 0)
    # Counts in classes of a sixteenth of an octave: few rows, whatever the table.
    octave = F.floor(F.log2(F.col(count).cast("double")) * 16)
    classes = sizes.groupBy(octave.alias("_from")).agg(F.sum("_c").alias("_n")).withColumn("_run", F.sum("_n").over(upto))
    edge = classes.where(F.col("_run") - F.col("_n") < most).agg(F.min("_from").alias("_edge"), F.max("_run").alias("_all")).first()
    if edge["_edge"] is None:
        return rows
    if edge["_all"] <= most:
        return rows.where(octave >= edge["_edge"])
    # Within the last class the same by single counts, then by name among the last count.
    inner = sizes.where(octave == edge["_edge"]).orderBy(F.desc(count)).collect()
    above = rows.where(octave > edge["_edge"]).count()
    last = None
    for r in inner:
        last = r[count]
        if above + r["_c"] >= most:
            break
        above += r["_c"]
    tied = rows.where(F.col(count) == last).orderBy(name).limit(most - above)
    return rows.where(F.col(count) > last).unionByName(tied)
