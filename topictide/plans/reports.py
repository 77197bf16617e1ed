"""Queries behind the dashboard and charts, on snapshot and stats tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import finite_or
from topictide.operators.ranking import kth_smallest
from topictide.operators.temporal import without_noise
from topictide.runtime import materialize

MIN_CLUSTERS = 5


def best_window(snapshots: DataFrame, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """One row: the latest window with enough clusters, else the latest window."""
    counts = snapshots.groupBy("time_window").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(
        F.max(F.when(F.col("n") >= min_clusters, F.col("time_window"))), F.max("time_window")).alias("latest_window"))


def at_best_window(snapshots: DataFrame, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    topics = materialize(without_noise(snapshots))  # read for the window and for its rows
    return topics.where(F.col("time_window") == best_window(topics, min_clusters).scalar())


def _named(df: DataFrame, theme_names: DataFrame | None) -> DataFrame:
    if theme_names is None:
        return df.withColumn("theme_name", F.lit(""))
    return df.join(theme_names, "cluster", "left").withColumn("theme_name", F.coalesce("theme_name", F.lit("")))


def cluster_table(snapshots: DataFrame, theme_names: DataFrame | None = None) -> DataFrame:
    """Topics at the best window, shares and growth in percent."""
    return _named(at_best_window(snapshots), theme_names).select(
        F.concat(F.lit("cluster-"), F.col("cluster")).alias("id"), "cluster", "cluster_label", "theme_name",
        F.col("post_count").alias("size"), (F.col("market_share") * 100).alias("market_share"),
        (F.col("volume_pct_change") * 100).alias("volume_pct_change"), "volume_volatility", "volume_lead",
        F.initcap("lifecycle_state").alias("lifecycle"), "anomaly_score", F.col("time_window").alias("latest_window"))


def _series(df: DataFrame) -> list[Column]:
    return [F.concat(F.lit("cluster-"), F.col("cluster")).alias("cluster_id"), F.col("cluster_label"),
            F.col("time_window"), F.col("post_count"), (F.col("market_share") * 100).alias("market_share"),
            F.col("volume_lead"), F.col("volume_volatility").alias("volatility")]


def monthly_snapshots(snapshots: DataFrame) -> DataFrame:
    return without_noise(snapshots).select(*_series(snapshots))


def weekly_recent(weekly: DataFrame, theme_names: DataFrame | None = None) -> DataFrame:
    return _named(weekly, theme_names).select(*_series(weekly), "theme_name", "window_type")


def anomaly_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """First events in (cluster, window) order."""
    return events.orderBy("cluster", "time_window").limit(limit).select(
        F.col("time_window").alias("date"), "cluster", "cluster_label", "event_type",
        F.col("anomaly_score").alias("sigma"))


def _of_best_window(counts: DataFrame, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """Of rows per window and topic count ``_n``, those of the best window. Only the few
    aggregated rows meet, so the snapshots behind them are read once."""
    rank = F.struct(F.col("_n") >= min_clusters, "time_window")
    return counts.withColumn("_best", F.max(rank).over(W.partitionBy(F.lit(0)))).where(rank == F.col("_best")).drop("_best")


def lifecycle_distribution(snapshots: DataFrame) -> DataFrame:
    states = without_noise(snapshots).groupBy("time_window", F.initcap("lifecycle_state").alias("state")).agg(
        F.count(F.lit(1)).alias("count"))
    sized = states.withColumn("_n", F.sum("count").over(W.partitionBy("time_window")))
    return _of_best_window(sized).select("state", "count")


def kpis(snapshots: DataFrame) -> DataFrame:
    """The figures of the best window; one row of zeros without topics."""
    by_window = without_noise(snapshots).groupBy("time_window").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("lifecycle_state") == "emerging", 1)).alias("emerging_count"),
        F.count(F.when(F.col("lifecycle_state") == "declining", 1)).alias("declining_count"),
        F.round(F.avg("volume_volatility"), 3).alias("avg_volatility"),
        F.count(F.when(F.abs("anomaly_score") > 2, 1)).alias("event_spikes"))
    none = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    return _of_best_window(by_window).withColumnRenamed("_n", "active_clusters").agg(
        none("active_clusters"), none("emerging_count"), none("declining_count"), F.max("avg_volatility").alias("avg_volatility"),
        none("event_spikes"))


def cluster_trends(activated: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Trend points of the topics behind each event's activated themes."""
    topics = activated.select("event_id", F.col("mapped_cluster_id").alias("cluster")).distinct()
    points = snapshots.select("cluster", "cluster_label", "time_window", "post_count",
                              (F.col("market_share") * 100).alias("market_share"), "volume_lead",
                              F.col("volume_volatility").alias("volatility"))
    return topics.join(points, "cluster").select("event_id", *points.columns)


def trend_arrays(trends: DataFrame) -> DataFrame:
    """Trend points of an (event, topic) as one array ordered by window."""
    point = F.struct("time_window", "post_count", "market_share", "volume_lead", "volatility")
    return trends.groupBy("event_id", "cluster", "cluster_label").agg(
        F.sort_array(F.collect_list(point)).alias("data"))


def health(theme_names: DataFrame, profiles: DataFrame, weekly: DataFrame) -> DataFrame:
    themes = theme_names.agg(F.countDistinct("theme_id")).scalar()
    dense = weekly.agg(F.countDistinct("cluster")).scalar()
    return profiles.agg(F.count(F.lit(1)).alias("clusters")).select(
        themes.alias("themes"), "clusters", dense.alias("weekly_dense_clusters"))


def sanitized(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    return df.select(*[finite_or(F.col(c), None).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def top_anomalous(clusters: DataFrame, n: int = 5) -> DataFrame:
    return clusters.orderBy(F.abs("anomaly_score").desc(), "cluster").limit(n)


def metric_matrix(snapshots: DataFrame, clusters: list[int], metric: str, monthly: bool = True, of_all_windows: bool = False) -> DataFrame:
    """Rows are windows of the chosen clusters, or of all, columns the chosen ones."""
    label = F.date_format("time_window", "yyyy-MM") if monthly else F.col("time_window").cast("string")
    chosen = snapshots if of_all_windows else snapshots.where(F.col("cluster").isin(clusters))
    grid = chosen.groupBy("time_window").pivot("cluster", clusters).agg(F.first(metric))
    return grid.select(label.alias("time_window"), *[F.col(f"`{c}`").alias(f"cluster_{c}") for c in clusters])


def ranked_by(clusters: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """Topics ordered by the size of a metric, with their position."""
    key = F.abs(F.coalesce(F.col(metric), F.lit(0)))
    return clusters.orderBy(key.desc() if descending else key.asc(), "cluster")


def drill_down(snapshots: DataFrame, cluster: int) -> DataFrame:
    return monthly_snapshots(snapshots.where(F.col("cluster") == cluster)).withColumn(
        "time_window", F.date_format("time_window", "yyyy-MM")).orderBy("time_window")


def compare_topics(snapshots: DataFrame, clusters: list[int]) -> DataFrame:
    """Posts of up to three topics side by side, a row for every window of any topic; null
    where a topic has none."""
    if not 1 <= len(clusters) <= 3:
        raise ValueError("one to three topics can be compared")
    return metric_matrix(without_noise(snapshots), clusters, "post_count", of_all_windows=True)


def scenario_volumes(trends: DataFrame) -> DataFrame:
    """Posts of all activated topics per scenario and window."""
    return trends.groupBy("event_id", "time_window").agg(F.sum("post_count").alias("post_count"))


def scenario_comparison(trends: DataFrame, scenarios: list[int]) -> DataFrame:
    """Chosen scenarios side by side, one row per window; missing ones are 0."""
    chosen = scenario_volumes(trends.where(F.col("event_id").isin(scenarios)))
    grid = chosen.groupBy("time_window").pivot("event_id", scenarios).agg(F.first("post_count"))
    return grid.select("time_window", *[
        F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(f"scenario_{s}") for s in scenarios])


def scenario_export(predictions: DataFrame) -> DataFrame:
    four = lambda c: F.format_string("%.4f", F.col(c))
    return predictions.select(
        "event_text", "predicted_direction", four("confidence").alias("confidence"),
        four("predicted_volatility").alias("predicted_volatility"), "risk_band", "method",
        F.col("activated_theme_count").alias("activated_themes"))


def last_state(snapshots: DataFrame) -> DataFrame:
    """Volume lead and volatility of each topic's last window."""
    return snapshots.groupBy("cluster").agg(
        F.max_by("volume_lead", "time_window").alias("volume_lead"),
        F.max_by("volume_volatility", "time_window").alias("volatility"))


def sparkline(snapshots: DataFrame, points: int = 12) -> DataFrame:
    back = W.partitionBy("cluster").orderBy(F.col("time_window").desc())
    return (snapshots.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= points)
            .select("cluster", F.date_format("time_window", "yyyy-MM").alias("time_window"), "post_count"))


def lifecycle_share(snapshots: DataFrame) -> DataFrame:
    total = F.sum("count").over(W.partitionBy(F.lit(0)))  # of the few states
    return lifecycle_distribution(snapshots).withColumn("share", F.col("count") / total)


# --- chart data ---------------------------------------------------------------

def map_sample(points: DataFrame, limit: int = 20_000, seed: int = 42) -> DataFrame:
    """All points when they fit, else a seeded sample of ``limit`` of them: those with the
    smallest hashes, up to a cutoff that histogram passes find, so nothing is sorted whole."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("row_id"), F.lit(seed))), 1, 15), 16, 10).cast("long")
    places = materialize(points.select("row_id", hashed.alias("_place"), F.lit(0).alias("_all")))
    if places.count() <= limit:
        return points
    last = kth_smallest(places, "_all", "_place", "row_id", points.sparkSession.createDataFrame([(0, limit)], "_all int, k int")).first()
    return points.where((hashed < last.cutoff) | ((hashed == last.cutoff) & (F.col("row_id") <= last.tie_cutoff)))


def activity_cells(stats: DataFrame) -> DataFrame:
    """Mean posts per (label, window): the non-empty cells of the heatmap."""
    return stats.groupBy("cluster_label", "time_window").agg(F.avg("post_count").alias("post_count"))


def activity_heatmap(stats: DataFrame, windows: list) -> DataFrame:
    """Label x window matrix over the given windows, empty cells 0."""
    grid = stats.groupBy("cluster_label").pivot("time_window", windows).agg(F.avg("post_count"))
    return grid.select("cluster_label", *[
        F.coalesce(F.col(f"`{w}`"), F.lit(0.0)).alias(str(w)) for w in windows])


def label_lifecycle(stats: DataFrame) -> DataFrame:
    """Lifecycle badge of a label: that of its first cluster and window."""
    return stats.groupBy("cluster_label").agg(
        F.min_by("lifecycle_state", F.struct("cluster", "time_window")).alias("lifecycle_state"))


def event_timeline(stats: DataFrame, events: DataFrame, top: int = 15) -> DataFrame:
    """Series of the clusters with most posts, spikes marked."""
    volume = stats.groupBy("cluster").agg(F.sum("post_count").alias("volume"))
    busiest = volume.orderBy(F.col("volume").desc(), "cluster").limit(top).select("cluster")
    spikes = events.where(F.col("event_type") == "spike").select("cluster", "time_window", F.lit(True).alias("is_spike"))
    return (stats.join(F.broadcast(busiest), "cluster", "left_semi")
            .join(spikes, ["cluster", "time_window"], "left")
            .select("cluster", "cluster_label", "time_window", "post_count",
                    F.coalesce("is_spike", F.lit(False)).alias("is_spike")))


def volatility_summary(stats: DataFrame, top: int = 20) -> DataFrame:
    """Mean volatility, growth, share and most common lifecycle per label."""
    modes = stats.groupBy("cluster_label", "lifecycle_state").agg(F.count(F.lit(1)).alias("n"))
    first = W.partitionBy("cluster_label").orderBy(F.col("n").desc(), "lifecycle_state")
    mode = (modes.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1)
            .select("cluster_label", F.col("lifecycle_state").alias("lifecycle")))
    means = stats.groupBy("cluster_label").agg(
        F.avg("volume_volatility").alias("avg_volatility"), F.avg("volume_pct_change").alias("avg_growth"),
        F.avg("market_share").alias("avg_market_share"))
    return means.join(mode, "cluster_label").orderBy(F.col("avg_volatility").desc(), "cluster_label").limit(top)


def top_themes(activated: DataFrame, n: int = 10) -> DataFrame:
    order = W.partitionBy("event_id").orderBy(F.round("score", 9).desc(), "theme_id")
    return (activated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .select("event_id", "rank", "theme_id", "theme_name", "score", "weight", "direction_label"))

