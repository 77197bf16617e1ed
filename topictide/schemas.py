"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("author", T.StringType()),
    T.StructField("likes", T.DoubleType()),
    T.StructField("reach", T.DoubleType()),
    T.StructField("shares", T.DoubleType()),
    T.StructField("comments", T.DoubleType()),
    T.StructField("sentiment", T.StringType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

THEME_TERMS = T.StructType([
    T.StructField("theme_id", T.IntegerType()),
    T.StructField("term", T.StringType()),
])

# Entries stay JSON text, so that one of another shape spoils no other.
RELEVANCE_REPLY = T.StructType([T.StructField("theme_relevance", T.ArrayType(T.StringType()))])

SNAPSHOT_COLUMNS = [
    "time_window", "cluster", "cluster_label", "post_count", "market_share",
    "volume_pct_change", "volume_volatility", "volume_lead", "lifecycle_state", "anomaly_score",
]

# Label order decides ties between equal class probabilities.
DIRECTIONS = ["down", "flat", "up"]
NOISE_CLUSTER = -1


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job starts when a required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"The table lacks {', '.join(missing)}")
    return df


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)
