"""Theme activation: TF-IDF scores of topic-window documents against a lexicon.

A document is all posts of one (cluster, window) in row order. The largest one may
hold a third of all posts, so the scoring never builds it: posts are dealt by ranges of
(document, row_id), terms are counted over runs of tokens of bounded length, and the word
pairs that span two runs are added from the runs' first and last tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.text import DOCUMENT_STOP_WORDS, content_tokens, normalized
from topictide.operators.positions import in_order, positioned
from topictide.operators.ranking import most_frequent
from topictide.operators.temporal import valid_timestamps, with_window
from topictide.operators.term_counts import BUCKET_BITS, dealt_counts, full_buckets, limited_counts, pair_run, run_counts, token_runs
from topictide.runtime import bounded_broadcast, materialize
from topictide.schemas import require_columns
from topictide.sources.lexicon import Lexicon

DOC = ["cluster", "time_window"]
PART_ROWS = 10_000
SLICES = (16, 64)  # buckets of tokens and of pairs, of which one is counted first
SEGMENTS, SEGMENT_TOKENS = 32, 1 << 21  # ranges of buckets: at least, and tokens of the text for each
SLICE_MARGIN = 1.15  # by which a slice may be off
GLOBAL_THRESHOLD = 0.03
REASONING = "Share of the theme's terms in the weighted terms of the topic's posts; active from the theme's threshold on."


def windowed_posts(posts: DataFrame, freq: str = "1M") -> DataFrame:
    require_columns(posts, "row_id", "text", "timestamp", "cluster")
    return with_window(valid_timestamps(posts), freq, per_cluster_anchor=False)


def documents(posts: DataFrame, freq: str = "1M", part_rows: int = PART_ROWS) -> DataFrame:
    """Post texts joined by spaces in row order, as numbered parts.

    A part has ``part_rows`` posts, the last one the rest, which bounds what one task
    collects; a document is its parts in order, joined by a space."""
    keyed = positioned(windowed_posts(posts, freq), DOC, "row_id").withColumn("part", F.floor(F.col("position") / part_rows))
    parts = keyed.groupBy(*DOC, "part").agg(
        F.sort_array(F.collect_list(F.struct("row_id", F.coalesce("text", F.lit("")).alias("t")))).alias("_posts"),
        F.count(F.lit(1)).alias("source_posts"))
    text = F.array_join(F.transform("_posts", lambda p: p["t"]), " ")
    out = parts.select(*DOC, "part", text.alias("document"), "source_posts")
    return out.join(document_labels(keyed), DOC, "left")


def document_labels(keyed: DataFrame) -> DataFrame:
    """First label in row order per document."""
    if "cluster_label" not in keyed.columns:
        return keyed.select(*DOC).distinct().withColumn("cluster_label", F.col("cluster").cast("string"))
    known = keyed.where(F.col("cluster_label").isNotNull())
    pairs = known.groupBy(*DOC, "cluster_label").agg(F.min("row_id").alias("_row"))
    return pairs.groupBy(*DOC).agg(F.min_by("cluster_label", "_row").alias("cluster_label"))


def document_sizes(posts: DataFrame, freq: str = "1M", stop_words=DOCUMENT_STOP_WORDS) -> DataFrame:
    """Posts and kept tokens per (cluster, window), without building the text."""
    return windowed_posts(posts, freq).groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("source_posts"),
        F.sum(F.size(content_tokens(F.col("text"), stop_words))).alias("document_token_count"))


def window_targets(posts: DataFrame, freq: str = "1M") -> DataFrame:
    """Fallback targets: the (cluster, window) pairs that have posts."""
    keyed = windowed_posts(posts, freq)
    counts = keyed.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("post_count"))
    return counts.join(document_labels(keyed), DOC, "left")


def resolve_targets(mode: str, stats: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Rows to score: all windows, or only the windows with an event."""
    if mode not in ("windows", "events"):
        raise ValueError(f"Targets come from windows or events, not from {mode!r}")
    chosen = stats if mode == "windows" else events
    return require_columns(chosen, *DOC).where(F.col("time_window").isNotNull())


def attach_documents(targets: DataFrame, posts: DataFrame, freq: str = "1M",
                     part_rows: int = PART_ROWS) -> DataFrame:
    """Targets with their document parts; a target without posts gets one empty part."""
    docs = documents(posts, freq, part_rows)
    if "cluster_label" in targets.columns:
        docs = docs.drop("cluster_label")
    joined = targets.join(docs, DOC, "left")
    return joined.withColumns({
        "part": F.coalesce("part", F.lit(0)),
        "document": F.coalesce("document", F.lit("")),
        "source_posts": F.coalesce("source_posts", F.lit(0)),
    }).withColumn("document_normalized", normalized(F.col("document")))


def post_runs(posts: DataFrame, freq: str = "1M", stop_words=DOCUMENT_STOP_WORDS, chunk_rows: int | None = None) -> DataFrame:
    """The tokens of each document in row order, as runs; written, as they are read several
    times. Texts lie by document, so that a run has one and a term is few entries."""
    rows = windowed_posts(posts, freq).select(*DOC, "row_id", "text")
    return materialize(token_runs(in_order(rows, [*DOC, "row_id"], chunk_rows), DOC, "text", stop_words))


def _with_borders(runs: DataFrame) -> DataFrame:
    """(cluster, time_window, n, vocabulary, ids): the runs, and every two tokens that meet between runs."""
    before = F.lag("last").over(W.partitionBy(*DOC).orderBy("at"))
    borders = runs.select(*DOC, "first", before.alias("_before")).where("_before IS NOT NULL")
    meet = borders.select(*DOC, *(c.alias(k) for k, c in pair_run(F.col("_before"), F.col("first")).items()))
    return runs.select(*DOC, "n", "vocabulary", "ids").unionByName(meet)


def document_terms(posts: DataFrame, freq: str = "1M", ngrams: tuple[int, int] = (1, 2),
                   stop_words=DOCUMENT_STOP_WORDS, chunk_rows: int | None = None) -> DataFrame:
    """(cluster, time_window, term, tf) of the 1- and 2-grams of each document."""
    if not (1 <= ngrams[0] <= ngrams[1] <= 2):
        raise ValueError("n-grams of one and two tokens are supported")
    runs = post_runs(posts, freq, stop_words, chunk_rows)
    return run_counts(runs if ngrams == (1, 1) else _with_borders(runs), DOC, ngrams)


def frequent_document_terms(posts: DataFrame, targets: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int, freq: str = "1M",
                            stop_words=DOCUMENT_STOP_WORDS, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``document_terms`` of the target documents, less terms that no vocabulary of
    ``max_features`` terms can hold, and those of their terms that lie within the df limits.

    Terms of every so many-th bucket of hashes (SLICES) are counted exactly and tell which total
    the last term of the vocabulary may have. All terms are then summed by bucket, and only those
    of a bucket that reaches this total, which hold every term as frequent, are counted by document.
    Where fewer terms than the vocabulary holds have that total and lie within the df limits,
    it was too high, and half of it is taken."""
    lone = post_runs(posts, freq, stop_words, chunk_rows)
    runs = _with_borders(lone)
    segments = max(SEGMENTS, (lone.agg(F.sum("n")).first()[0] or 0) // SEGMENT_TOKENS)

    limits = min_df, n_docs * max_df

    def totals(terms: DataFrame) -> DataFrame:
        return terms.where("df IS NOT NULL").select("term", "df", "total", F.lit(n_docs).alias("_n"))

    least = 0
    if max_features:
        some = materialize(dealt_counts(runs, DOC, [np.arange(1 << BUCKET_BITS) % n == 0 for n in SLICES], segments, summed=True))
        times = F.when(F.contains(F.col("term"), F.lit(" ")), SLICES[1]).otherwise(SLICES[0])
        least = _last_total(totals(limited_counts(some, DOC, targets, 0, limits, by_document=False)).withColumn("_times", times), max_features)
    while least > min_df:
        full = full_buckets(some, least)
        terms = materialize(limited_counts(dealt_counts(runs, DOC, [full, full], segments), DOC, targets, least, limits))
        kept = totals(terms)
        if kept.count() >= max_features:
            return terms.select(*DOC, "term", "tf"), kept
        least //= 2
    terms = materialize(run_counts(runs, DOC).join(targets, DOC, "left_semi"))
    return terms, _within_limits(terms, F.lit(n_docs), min_df, max_df)


def _last_total(terms: DataFrame, most: int) -> int:
    """A total that somewhat more than ``most`` terms have at least, each taken ``_times``; 0
    where there are not so many."""
    octave = F.floor(F.log2(F.col("total").cast("double")) * 16)
    upto = 0
    for r in terms.groupBy(octave.alias("o")).agg(F.sum("_times").alias("n")).orderBy(F.desc("o")).collect():
        upto += r["n"]
        if upto >= SLICE_MARGIN * most:
            return int(2 ** (r["o"] / 16))
    return 0


def _within_limits(terms: DataFrame, n_docs, min_df: int, max_df: float) -> DataFrame:
    """(term, df, total, _n) of the terms within the df limits."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return materialize(counts.withColumn("_n", n_docs).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df)))


def vocabulary(terms: DataFrame, n_docs, min_df: int = 2, max_df: float = 0.9,
               max_features: int = 50_000) -> DataFrame:
    """(term, df, total, idf) of the most frequent terms within the df limits. Ties at the
    last count go by term."""
    return _most_frequent_terms(_within_limits(terms, n_docs, min_df, max_df), max_features)


def _most_frequent_terms(kept: DataFrame, max_features: int) -> DataFrame:
    return most_frequent(kept, "total", "term", max_features).select(
        "term", "df", "total", (F.ln((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


class Tfidf:
    """L2-normalised TF-IDF of the target documents, kept as aggregates.

    The counts of the terms that the vocabulary may hold are read three times (vocabulary,
    norms, scores) and the vocabulary twice, so both are written once, as are the targets."""

    def __init__(self, posts: DataFrame, targets: DataFrame, freq: str = "1M", min_df: int = 2,
                 max_df: float = 0.9, max_features: int = 50_000, ngrams: tuple[int, int] = (1, 2), **terms):
        rows = materialize(targets.select(*DOC))
        self.targets = rows.distinct()
        n_docs = rows.count()
        if ngrams == (1, 2):
            self.terms, kept = frequent_document_terms(posts, self.targets, n_docs, min_df, max_df, max_features, freq, **terms)
        else:
            self.terms = materialize(document_terms(posts, freq, ngrams, **terms).join(self.targets, DOC, "left_semi"))
            kept = _within_limits(self.terms, F.lit(n_docs), min_df, max_df)
        self.vocabulary = materialize(_most_frequent_terms(kept, max_features))
        vocab = bounded_broadcast(self.vocabulary.select("term", "idf"), max_features)
        self.raw = self.terms.join(vocab, "term").select(*DOC, "term", (F.col("tf") * F.col("idf")).alias("w"))

    def norms(self) -> DataFrame:
        return self.raw.groupBy(*DOC).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def weights(self) -> DataFrame:
        """(cluster, time_window, term, weight); the norms are shared by (cluster, window)."""
        return self.raw.join(self.norms(), DOC).select(*DOC, "term", (F.col("w") / F.col("norm")).alias("weight"))

    def theme_scores(self, lexicon: Lexicon) -> DataFrame:
        """(cluster, time_window, theme_id, score) for every target and theme, 0 where
        nothing matches. Only matched terms leave the map side."""
        terms = F.broadcast(lexicon.terms(self.raw.sparkSession))
        hits = self.raw.join(terms, "term").groupBy(*DOC, "theme_id").agg(F.sum("w").alias("_hit"))
        scored = hits.join(self.norms(), DOC).select(*DOC, "theme_id", (F.col("_hit") / F.col("norm")).alias("score"))
        zeros = self.targets.select(*DOC, F.explode(lexicon.ids_array()).alias("theme_id"), F.lit(0.0).alias("score"))
        return scored.unionByName(zeros).groupBy(*DOC, "theme_id").agg(F.sum("score").alias("score"))


def thresholds_column(lexicon: Lexicon, per_theme: dict | None = None, default: float = GLOBAL_THRESHOLD):
    """Threshold expression over ``theme_id``; per-theme values win over the default."""
    per_theme = {int(k): float(v) for k, v in (per_theme or {}).items()}
    expr = F.lit(float(default))
    for tid in [t for t in lexicon.ids if t in per_theme]:
        expr = F.when(F.col("theme_id") == tid, F.lit(per_theme[tid])).otherwise(expr)
    return expr


def activate(scores: DataFrame, lexicon: Lexicon, per_theme: dict | None = None,
             default: float = GLOBAL_THRESHOLD) -> DataFrame:
    """Add ``threshold`` and the 0/1 flag ``active``."""
    return scores.withColumn("threshold", thresholds_column(lexicon, per_theme, default)).withColumn(
        "active", (F.col("score") >= F.col("threshold")).cast("int"))


def wide(activations: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document with theme_{id}_score and theme_{id} columns."""
    pivoted = activations.groupBy(*DOC).pivot("theme_id", lexicon.ids).agg(
        F.first("score").alias("score"), F.first("active").alias("active"))
    renamed = [c for i in lexicon.ids for c in
               (F.col(f"`{i}_score`").alias(f"theme_{i}_score"), F.col(f"`{i}_active`").alias(f"theme_{i}"))]
    return pivoted.select(*DOC, *renamed)


def explain(tfidf: Tfidf, lexicon: Lexicon, per_theme: dict | None = None,
            default: float = GLOBAL_THRESHOLD) -> DataFrame:
    """Matched vocabulary terms, their number and the threshold per theme."""
    spark = tfidf.raw.sparkSession
    terms = lexicon.terms(spark)
    matched = (tfidf.vocabulary.select("term").join(F.broadcast(terms), "term").groupBy("theme_id")
               .agg(F.sort_array(F.collect_set("term")).alias("matched_terms")))
    named = lexicon.names(spark).join(matched, "theme_id", "left")
    found = F.coalesce("matched_terms", F.array().cast("array<string>"))
    return named.select(
        "theme_id", found.alias("matched_terms"), F.size(found).alias("matched_feature_count"),
        thresholds_column(lexicon, per_theme, default).alias("threshold"))


def explain_json(explained: DataFrame) -> DataFrame:
    """One row: the explanation of all themes as a JSON object."""
    entry = F.struct(F.concat(F.lit("theme_"), F.col("theme_id")).alias("key"),
                     F.struct("matched_terms", "matched_feature_count", "threshold").alias("value"))
    return explained.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("activation_explain"),
                         F.lit(REASONING).alias("activation_reasoning"))


def average_active(activations: DataFrame) -> DataFrame:
    per_doc = activations.groupBy(*DOC).agg(F.sum("active").alias("n"))
    return per_doc.agg(F.count(F.lit(1)).alias("units"), F.avg("n").alias("avg_active_themes"))


# --- themes and topics --------------------------------------------------------

def theme_cluster_map(labelled_scores: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Topic with the highest positive mean score per theme; unmatched themes keep a
    null topic and 0.0. Input: (cluster, cluster_label, theme_id, score)."""
    means = labelled_scores.groupBy("theme_id", "cluster", "cluster_label").agg(F.avg("score").alias("avg_score"))
    order = W.partitionBy("theme_id").orderBy(F.round("avg_score", 9).desc(), "cluster", "cluster_label")
    best = (means.where(F.col("avg_score") > 0).withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") == 1)
            .select("theme_id", F.col("cluster").alias("cluster_id"), "cluster_label", "avg_score"))
    names = lexicon.names(labelled_scores.sparkSession)
    return names.join(best, "theme_id", "left").select(
        "theme_id", "theme_name", "cluster_id", "cluster_label",
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), "theme_order")


def unmatched_themes(mapping: DataFrame) -> DataFrame:
    return mapping.where(F.col("cluster_id").isNull()).select(
        "theme_id", F.concat(F.lit("Theme "), F.col("theme_id"), F.lit(" has no cluster match")).alias("warning"))


def cluster_theme_names(mapping: DataFrame) -> DataFrame:
    """Inverse map (cluster, theme_name); the last theme in file order wins."""
    return mapping.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("cluster")).agg(
        F.max_by("theme_name", "theme_order").alias("theme_name"))
