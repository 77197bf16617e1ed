"""Exact deduplication and author capping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.functions.numbers import number_or_zero, total
from topictide.operators.ranking import kth_smallest
from topictide.runtime import materialize
from topictide.schemas import first_present, require_columns

# Engagement columns looked at when none are named.
ENGAGEMENT_COLUMNS = ["X Likes", "X Reposts", "likes", "shares"]
MAX_AUTHOR_SHARE = 0.05


def engagement_score(df: DataFrame, columns: list[str] | None = None) -> Column:
    present = [c for c in (columns or ENGAGEMENT_COLUMNS) if c in df.columns]
    return total([number_or_zero(F.col(f"`{c}`")) for c in present])


def author_column(df: DataFrame, text_col: str = "text") -> str:
    """Without an author column posts are deduplicated by text alone."""
    return first_present(df, ["Author", "author"]) or text_col


def deduplicate_exact(df: DataFrame, text_col: str = "text", author_col: str = "author",
                      engagement_columns: list[str] | None = None) -> DataFrame:
    """Best row per (text, author): highest engagement, then lowest row_id. Copies
    collapse before the shuffle; null authors are equal to each other."""
    require_columns(df, "row_id", text_col, author_col)
    keys = list(dict.fromkeys([text_col, author_col]))
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(engagement_score(df, engagement_columns), -F.col("row_id"))
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_best")
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`") for c in df.columns])


def cap_authors(df: DataFrame, author_col: str = "author", max_share: float = MAX_AUTHOR_SHARE,
                engagement_columns: list[str] | None = None) -> DataFrame:
    """Keep at most ``max(1, int(rows * max_share))`` posts per author, best engagement
    first, then lowest row_id. Rows without an author are dropped.

    Only authors over the cap are ranked, and they by exact cutoffs rather than by a
    sort of the author's rows. Fewer than 2 / max_share authors can be over it, which
    bounds what is broadcast."""
    require_columns(df, "row_id", author_col)
    author, neg = F.col(f"`{author_col}`"), -engagement_score(df, engagement_columns)
    narrow = df.select(author.alias("_author"), "row_id", neg.alias("_neg"))
    counts = materialize(narrow.groupBy("_author").agg(F.count(F.lit(1)).alias("_n")))
    cap = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("_n") * F.lit(max_share))).cast("long"))
    over = counts.where(F.col("_author").isNotNull()).withColumn("k", cap.scalar()).where(
        F.col("_n") > F.col("k")).select("_author", "k")
    limits = kth_smallest(narrow, "_author", "_neg", "row_id", over).select(
        "_author", F.col("cutoff").alias("_score"), F.col("tie_cutoff").alias("_row"))
    joined = df.where(author.isNotNull()).withColumns({"_author": author, "_neg": neg}).join(F.broadcast(limits), "_author", "left")
    within = (F.col("_score").isNull() | (F.col("_neg") < F.col("_score"))
              | ((F.col("_neg") == F.col("_score")) & (F.col("row_id") <= F.col("_row"))))
    return joined.where(within).select(*[F.col(f"`{c}`") for c in df.columns])


def clean_posts(df: DataFrame, text_col: str = "text", author_col: str = "author",
                max_share: float = MAX_AUTHOR_SHARE,
                engagement_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplicate, then cap authors; returns the kept posts and a one-row report."""
    deduped = materialize(deduplicate_exact(df, text_col, author_col, engagement_columns))
    kept = cap_authors(deduped, author_col, max_share, engagement_columns)
    n_rows = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    counted = n_rows(df, "rows_input").select(
        "rows_input",
        n_rows(kept, "n").scalar().alias("rows_output"),
        n_rows(deduped, "n").scalar().alias("_deduped"))
    report = counted.select(
        "rows_input", "rows_output",
        (F.col("rows_input") - F.col("_deduped")).alias("exact_duplicates_removed"),
        (F.col("_deduped") - F.col("rows_output")).alias("author_cap_removed"),
        (F.col("rows_input") - F.col("rows_output")).alias("total_removed"),
        F.round(100.0 * (F.col("rows_input") - F.col("rows_output"))
                / F.greatest(F.col("rows_input"), F.lit(1)), 2).alias("removal_pct"),
        F.lit(float(max_share)).alias("author_cap_share"))
    return kept, report


def kept_row_ids(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("row_id")
