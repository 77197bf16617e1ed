"""One state row per topic, summarising its recent windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import direction
from topictide.schemas import require_columns

# Fixed values of the direction score.
GROWTH_WEIGHT, LEAD_WEIGHT, SLOPE_WEIGHT, FLAT_BAND = 0.5, 0.3, 0.2, 0.05
LAGS = 4


def cluster_profiles(stats: DataFrame, lookback: int = 3) -> DataFrame:
    """Means, recent means, last values, trend slope and direction per cluster.
    Columns absent from ``stats`` count as 0."""
    require_columns(stats, "cluster", "time_window")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in stats.columns else F.lit(0.0)
    rows = stats.where(F.col("time_window").isNotNull()).select(
        "cluster", "time_window",
        value("post_count").alias("n"), value("volume_volatility").alias("vol"),
        value("market_share").alias("share"), value("volume_pct_change").alias("growth"),
        value("volume_lead").alias("lead"), value("anomaly_score").alias("anom"))
    ranked = rows.withColumns({
        "idx": F.row_number().over(W.partitionBy("cluster").orderBy("time_window")) - 1,
        "back": F.row_number().over(W.partitionBy("cluster").orderBy(F.col("time_window").desc())),
    })

    last = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    tail_mean = lambda c, k: F.avg(F.when(F.col("back") <= k, F.col(c)))

    def lagged(c: str, k: int) -> Column:
        return F.coalesce(*[last(c, i) for i in range(k, 0, -1)])

    agg = ranked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("n").alias("avg_post_count"), F.avg("vol").alias("avg_volatility"),
        F.avg("share").alias("avg_market_share"),
        tail_mean("growth", lookback).alias("recent_growth"),
        tail_mean("lead", lookback).alias("recent_volume_lead"),
        *[lagged("growth", k).alias(f"recent_growth_lag{k}") for k in range(1, LAGS + 1)],
        *[lagged("lead", k).alias(f"recent_volume_lead_lag{k}") for k in range(1, LAGS + 1)],
        tail_mean("n", 3).alias("rolling_post_mean_3"), tail_mean("n", 6).alias("rolling_post_mean_6"),
        last("anom", 1).alias("recent_anomaly_score"),
        F.coalesce(F.regr_slope("n", "idx"), F.lit(0.0)).alias("trend_slope"))
    base = F.greatest(F.col("avg_post_count"), F.lit(1.0))
    score = (GROWTH_WEIGHT * F.col("recent_growth") + LEAD_WEIGHT * (F.col("recent_volume_lead") / base)
             + SLOPE_WEIGHT * (F.col("trend_slope") / base))
    return agg.withColumn("direction_score", score).withColumn(
        "direction_label", direction(F.col("direction_score"), FLAT_BAND))
