"""Inputs with declared schemas and the checks that need no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from topictide.functions.numbers import number_or_zero
from topictide.schemas import EMBEDDINGS, first_present, require_columns

# Source columns accepted for each engagement measure, first match wins.
ENGAGEMENT_SOURCES = {
    "likes": ["likes", "Likes", "Facebook Likes", "X Likes"],
    "reach": ["reach", "Reach (new)"],
    "shares": ["shares", "Shares", "Facebook Shares", "Social Shares"],
    "comments": ["comments", "Comments", "Facebook Comments"],
}
# Columns of the clustered-posts table, in order.
CLUSTER_COLUMNS = ["row_id", "timestamp", "text", "cluster", "proj_x", "proj_y", "cluster_label", "cluster_size",
                   "likes", "reach", "shares", "comments", "author", "Author", "sentiment", "Sentiment"]


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Posts CSV. The schema names the file's columns and must hold ``row_id``, which joins
    posts to embeddings. Quoted texts over several lines need ``multi_line``, which makes a
    file one task; without it large files are split."""
    if "row_id" not in schema.fieldNames():
        raise ValueError("the CSV schema needs a row_id column")
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("enforceSchema", False).csv(path))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(path)


# What Spark calls a path that holds no parquet table.
NO_TABLE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def read_clusters(spark: SparkSession, parquet_path: str, csv_path: str | None = None,
                  csv_schema: T.StructType | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Clustered posts from parquet, or from the CSV where there is no parquet table. A
    declared ``schema`` saves reading footers; other errors are not hidden."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(parquet_path)
    except AnalysisException as e:
        if csv_path is None or e.getCondition() not in NO_TABLE:
            raise
        return read_posts_csv(spark, csv_path, csv_schema)


def align(posts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Posts with their vectors, joined by row_id. Extra vectors are ignored, as after
    cleaning; a post without a vector makes the job fail."""
    require_columns(posts, "row_id")
    require_columns(embeddings, "row_id", "embedding")
    joined = posts.join(embeddings.select("row_id", "embedding"), "row_id", "left")
    missing = F.concat(F.lit("No embedding for row "), F.col("row_id").cast("string"))
    return joined.withColumn(
        "embedding", F.when(F.col("embedding").isNull(), F.raise_error(missing)).otherwise(F.col("embedding")))


def unaligned(posts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Posts that have no vector."""
    return posts.join(embeddings.select("row_id"), "row_id", "left_anti")


def normalize_engagement(df: DataFrame) -> DataFrame:
    """likes / reach / shares / comments from the first source column present. A column
    that already has the target name is kept as it is; no source gives 0."""
    def measure(target: str) -> Column:
        found = first_present(df, ENGAGEMENT_SOURCES[target])
        if found is None:
            return F.lit(0.0)
        return F.col(found) if found == target else number_or_zero(F.col(f"`{found}`"))

    return df.withColumns({t: measure(t) for t in ENGAGEMENT_SOURCES})


def cluster_output(df: DataFrame) -> DataFrame:
    """Columns of the clustered table that exist, non-numeric ones as strings."""
    plain = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.col(c) if isinstance(kinds[c], plain) else F.col(c).cast("string").alias(c)
        for c in CLUSTER_COLUMNS if c in kinds])
