"""Features and target of the direction model, one row per (cluster, window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import direction, entropy, finite_or, top_two
from topictide.schemas import require_columns

KEYS = ["cluster", "time_window"]
# The names of the model's features, in its order.
LAGGED = ["volume_pct_change", "volume_lead"]
BASE_FEATURES = [
    "volume_lead", "volume_volatility", "market_share", "anomaly_score",
    "rolling_post_mean_3", "rolling_post_mean_6", "trend_slope_4",
    "theme_active_count", "theme_top1_score", "theme_top2_score", "theme_entropy",
    "volume_lead_x_volatility", "volume_acceleration", "volume_lead_acceleration", "theme_entropy_change",
]

def _by_time():
    return W.partitionBy("cluster").orderBy("time_window")


def theme_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("theme_") and c.endswith("_score")
                  and c not in ("theme_top1_score", "theme_top2_score"))


def lag_features(df: DataFrame, max_lag: int = 4) -> DataFrame:
    """Lags 1..max_lag of growth and volume_lead, 0 before a cluster's first window."""
    return df.withColumns({
        f"{c}_lag{k}": F.coalesce(F.lag(F.col(c), k).over(_by_time()), F.lit(0.0))
        for c in LAGGED for k in range(1, max_lag + 1)})


def anomaly_fallback(df: DataFrame) -> DataFrame:
    """z-score of the post count per cluster where the column is missing."""
    if "anomaly_score" in df.columns:
        return df
    whole = W.partitionBy("cluster")
    n = F.col("post_count").cast("double")
    std = F.stddev_samp(n).over(whole)
    z = (n - F.avg(n).over(whole)) / F.when(std > 0, std)
    return df.withColumn("anomaly_score", F.coalesce(z, F.lit(0.0)))


def rolling_features(df: DataFrame) -> DataFrame:
    """Rolling means of 3 and 6 windows and the least-squares slope of the last 4."""
    n = F.coalesce(F.col("post_count").cast("double"), F.lit(0.0))
    idx = F.row_number().over(_by_time()).cast("double")
    slope = F.regr_slope(n, F.col("_idx")).over(_by_time().rowsBetween(-3, 0))
    return df.withColumns({
        "rolling_post_mean_3": F.avg(n).over(_by_time().rowsBetween(-2, 0)),
        "rolling_post_mean_6": F.avg(n).over(_by_time().rowsBetween(-5, 0)),
        "_idx": idx,
    }).withColumn("trend_slope_4", F.coalesce(slope, F.lit(0.0))).drop("_idx")


def theme_features(df: DataFrame, theme_scores: DataFrame | None = None) -> DataFrame:
    """Join wide theme scores and summarise them per row."""
    if theme_scores is not None:
        cols = theme_columns(theme_scores)
        df = df.join(theme_scores.select(*KEYS, *cols), KEYS, "left")
    cols = theme_columns(df)
    if not cols:
        zero = F.lit(0.0)
        return df.withColumns({"theme_active_count": zero, "theme_top1_score": zero,
                               "theme_top2_score": zero, "theme_entropy": zero})
    scores = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    top1, top2 = top_two(F.col("_scores"))
    return df.withColumn("_scores", scores).withColumns({
        "theme_active_count": F.size(F.filter("_scores", lambda v: v > 0)).cast("double"),
        "theme_top1_score": top1, "theme_top2_score": top2, "theme_entropy": entropy(F.col("_scores")),
    }).drop("_scores")


def interaction_features(df: DataFrame) -> DataFrame:
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.withColumns({
        "volume_lead_x_volatility": num("volume_lead") * num("volume_volatility"),
        "volume_acceleration": num("volume_pct_change_lag1") - num("volume_pct_change_lag2"),
        "volume_lead_acceleration": num("volume_lead_lag1") - num("volume_lead_lag2"),
        "theme_entropy_change": F.coalesce(
            F.col("theme_entropy") - F.lag("theme_entropy").over(_by_time()), F.lit(0.0)),
    })


def feature_columns(df: DataFrame, max_lag: int = 4) -> list[str]:
    return [*theme_columns(df), *BASE_FEATURES,
            *[f"{c}_lag{k}" for c in LAGGED for k in range(1, max_lag + 1)]]


def feature_frame(stats: DataFrame, theme_scores: DataFrame | None = None, max_lag: int = 4) -> DataFrame:
    """All features, sanitised: null, NaN and infinities become 0. The raw growth is
    kept for the target, which alone depends on epsilon."""
    df = require_columns(stats, *KEYS).where(F.col("time_window").isNotNull())
    for c in ["post_count", *LAGGED]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    df = df.withColumns({
        "next_volume_pct_change": finite_or(F.lead("volume_pct_change").over(_by_time()), None)})
    df = rolling_features(anomaly_fallback(lag_features(df, max_lag)))
    df = interaction_features(theme_features(df, theme_scores))
    clean = {c: finite_or(F.col(c), 0.0) if c in df.columns else F.lit(0.0) for c in feature_columns(df, max_lag)}
    return df.withColumns(clean)


def with_target(features: DataFrame, epsilon: float) -> DataFrame:
    """Label the next window's growth; rows without a finite next growth are dropped."""
    return features.where(F.col("next_volume_pct_change").isNotNull()).withColumn(
        "target", direction(F.col("next_volume_pct_change"), epsilon))


def training_frame(stats: DataFrame, theme_scores: DataFrame | None, epsilon: float, max_lag: int = 4) -> DataFrame:
    return with_target(feature_frame(stats, theme_scores, max_lag), epsilon)


def heuristic_direction(epsilon) -> Column:
    """Baseline forecast from current growth and volume_lead."""
    n = F.greatest(F.coalesce(F.col("post_count").cast("double"), F.lit(1.0)), F.lit(1.0))
    score = 0.7 * F.col("volume_pct_change") + 0.3 * (F.col("volume_lead") / n)
    return direction(score, epsilon)
