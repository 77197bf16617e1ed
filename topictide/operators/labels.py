"""Keyword labels for topics from TF-IDF over each topic's own posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.text import ENGLISH_STOP_WORDS, WORD_PATTERN, clean_label, content_tokens
from topictide.runtime import bounded_broadcast
from topictide.schemas import NOISE_CLUSTER, require_columns

NOISE_LABEL = "Uncategorized/Noise"
TASK_CHARS = 8 << 20  # of texts that one task counts


def cluster_term_weights(posts: DataFrame, text_col: str = "text", min_df: int = 2, max_df: float = 0.9,
                         max_features: int = 100, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(cluster, term, weight): mean L2-normalised TF-IDF weight per topic vocabulary term.

    Posts are spread by row_id once, over as many tasks as their texts fill; the tokens of a
    post then never move until they are counts per (cluster, term), so a topic with most of
    the rows stays spread out and a task's memory doesn't grow with the table.
    The number of topics is counted first: it bounds the vocabulary that is broadcast."""
    require_columns(posts, "row_id", "cluster", text_col)
    topics = posts.where(F.col("cluster") != NOISE_CLUSTER)
    sizes = topics.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"))
    chars = topics.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = max(posts.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    tf = (topics.select("row_id", "cluster", text_col).repartition(parts, "row_id")
          .select("row_id", "cluster", F.explode(content_tokens(F.col(text_col), stop_words, WORD_PATTERN)).alias("term"))
          .groupBy("row_id", "cluster", "term").agg(F.count(F.lit(1)).alias("tf")))

    by_freq = W.partitionBy("cluster").orderBy(F.col("total").desc(), F.col("term"))
    vocab = (tf.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
             .join(sizes, "cluster")
             .where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
             .withColumn("_rank", F.row_number().over(by_freq)).where(F.col("_rank") <= max_features)
             .select("cluster", "term", "n_docs",
                     (F.ln((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    vocab = bounded_broadcast(vocab, max_features * sizes.count())
    weighted = tf.join(vocab, ["cluster", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("row_id")))
    return (weighted.withColumn("unit", F.col("w") / norm)
            .groupBy("cluster", "term", "n_docs").agg(F.sum("unit").alias("_sum"))
            .select("cluster", "term", (F.col("_sum") / F.col("n_docs")).alias("weight")))


def cluster_labels(posts: DataFrame, text_col: str = "text", n_top: int = 3, **tfidf) -> DataFrame:
    """(cluster, cluster_label) for every topic, noise and empty vocabularies included."""
    order = W.partitionBy("cluster").orderBy(F.round("weight", 9).desc(), F.col("term"))
    top = (cluster_term_weights(posts, text_col, **tfidf)
           .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_top)
           .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_rank", "term"))).alias("_top"))
           .select("cluster", clean_label(F.col("_top.term"), n_top).alias("_label")))
    named = posts.select("cluster").distinct().join(top, "cluster", "left")
    return named.select(
        "cluster",
        F.when(F.col("cluster") == NOISE_CLUSTER, NOISE_LABEL)
        .otherwise(F.coalesce(F.col("_label"), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))))
        .alias("cluster_label"))


def attach_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    return posts.drop("cluster_label").join(labels, "cluster", "left")


def cluster_sizes(posts: DataFrame) -> DataFrame:
    """Posts per cluster and their share of all posts."""
    sizes = posts.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    total = sizes.agg(F.sum("cluster_size")).scalar()
    return sizes.withColumn("share", F.col("cluster_size") / total)


def clustering_summary(posts: DataFrame) -> DataFrame:
    """Number of topics, noise posts and noise share."""
    sizes = posts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == NOISE_CLUSTER, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count(F.when(F.col("cluster") != NOISE_CLUSTER, 1)).alias("n_clusters"),
        noise.alias("n_noise"), F.try_divide(noise, F.sum("n")).alias("noise_share"))
