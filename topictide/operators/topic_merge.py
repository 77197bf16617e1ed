"""Class-based term weights of topics, topics that say the same merged, and posts that stand
for a topic.

A topic is one long document: its terms are weighted by their share of the topic's words and
by how rare they are over all topics. Topics are compared as sparse unit vectors without
listing their pairs: of a vector's terms, rarest first, those suffice whose rest is still as
long as the wanted similarity, since the terms after them can't add up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.text import ENGLISH_STOP_WORDS, WORD_PATTERN, content_tokens
from topictide.operators.graph import connected_components
from topictide.operators.ranking import most_frequent
from topictide.runtime import materialize
from topictide.schemas import NOISE_CLUSTER, require_columns

MERGE_SIMILARITY = 0.85
PARTS = 64


def topic_term_counts(posts: DataFrame, text_col: str = "text", stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(cluster, term, tf) over all posts of each topic; noise is no topic."""
    require_columns(posts, "cluster", text_col)
    topics = posts.where(F.col("cluster") != NOISE_CLUSTER)
    return topics.select("cluster", F.explode(content_tokens(F.col(text_col), stop_words, WORD_PATTERN)).alias("term")).groupBy(
        "cluster", "term").agg(F.count(F.lit(1)).alias("tf"))


def class_weights(counts: DataFrame, max_features: int = 5_000) -> DataFrame:
    """(cluster, term, weight): unit vectors over the most frequent terms (ties by term). A
    term's weight is its share of the topic's words times ln(1 + mean words of a topic /
    frequency of the term)."""
    counts = materialize(counts)
    totals = materialize(counts.groupBy("term").agg(F.sum("tf").alias("total")))
    kept = counts.join(most_frequent(totals, "total", "term", max_features), "term")
    words = kept.groupBy("cluster").agg(F.sum("tf").alias("words"))
    mean = words.agg(F.avg("words")).scalar()
    raw = kept.join(words, "cluster").select("cluster", "term", (F.col("tf") / F.col("words") * F.ln(1.0 + mean / F.col("total"))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("cluster")))  # of at most max_features terms
    return raw.withColumn("weight", F.col("w") / norm).drop("w")


def similar_topics(weights: DataFrame, similarity: float = MERGE_SIMILARITY) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of topics at least that similar. Only pairs that
    share a term of the first one's leading terms are compared."""
    weights = materialize(weights)
    spread = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(
        W.partitionBy("cluster").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    # A little below the bound, for what rounding takes off.
    leading = weights.join(spread, "term").withColumn("_before", before).where(1.0 - F.col("_before") >= similarity * similarity - 1e-9)
    pairs = leading.select(F.col("cluster").alias("a"), "term").join(weights.select(F.col("cluster").alias("b"), "term"), "term").where("a < b")
    pairs = materialize(pairs.select("a", "b").distinct())
    x, y = weights.select(F.col("cluster").alias("a"), "term", F.col("weight").alias("x")), weights.select(F.col("cluster").alias("b"), "term", F.col("weight").alias("y"))
    met = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
    return met.where(F.col("similarity") >= similarity)


def merged_topics(weights: DataFrame, similarity: float = MERGE_SIMILARITY) -> DataFrame:
    """(cluster, topic): topics that similar pairs connect are one, named by the smallest."""
    linked = connected_components(similar_topics(weights, similarity).select("a", "b"))
    every = weights.select("cluster").distinct()
    kind = weights.schema["cluster"].dataType
    return every.join(linked.withColumnRenamed("node", "cluster"), "cluster", "left").select(
        "cluster", F.coalesce("component", "cluster").cast(kind).alias("topic"))


def top_terms(weights: DataFrame, n_top: int = 8, domain_stop_words: list[str] | None = None) -> DataFrame:
    """(cluster, position, term, weight): a topic's heaviest terms, ties by term."""
    kept = weights.where(~F.col("term").isin(list(domain_stop_words))) if domain_stop_words else weights
    order = W.partitionBy("cluster").orderBy(F.round("weight", 9).desc(), "term")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n_top)


def representative_posts(posts: DataFrame, weights: DataFrame, per_topic: int = 5, text_col: str = "text",
                         stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(cluster, position, row_id, similarity): the posts whose words are most like their
    topic's, by cosine over the vocabulary; ties by row_id. A post's words never leave its
    topic, and a topic is ranked in parts first."""
    require_columns(posts, "row_id", "cluster", text_col)
    tf = posts.select("row_id", "cluster", F.explode(content_tokens(F.col(text_col), stop_words, WORD_PATTERN)).alias("term")).groupBy(
        "row_id", "cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    met = tf.join(weights.select("cluster", "term", "weight"), ["cluster", "term"])
    like = met.groupBy("row_id", "cluster").agg(
        (F.sum(F.col("tf") * F.col("weight")) / F.sqrt(F.sum(F.col("tf") * F.col("tf")))).alias("similarity"))
    best = [F.round("similarity", 9).desc(), F.asc("row_id")]
    first = like.withColumn("_part", F.pmod(F.xxhash64("row_id"), F.lit(PARTS))).withColumn(
        "_place", F.row_number().over(W.partitionBy("cluster", "_part").orderBy(*best))).where(F.col("_place") <= per_topic)
    return first.withColumn("position", F.row_number().over(W.partitionBy("cluster").orderBy(*best))).where(
        F.col("position") <= per_topic).select("cluster", "position", "row_id", "similarity")
