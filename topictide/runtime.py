"""Session helpers: cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is set."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder. It survives the loss of executors
    and, being columnar, later steps read only the columns they need."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only where ``max_rows``, a bound known without running
    anything, is small; otherwise the planner chooses."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROW_LIMIT else df
