"""Per-topic metrics over calendar windows.

Posts are reduced once to (cluster, window) rows; everything after that works on
this small table, in window functions that share one shuffle by cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import relative_change, total
from topictide.functions.windows import QUARTER, window_label, window_name, windows_until
from topictide.runtime import materialize
from topictide.schemas import NOISE_CLUSTER, SNAPSHOT_COLUMNS, require_columns

ENGAGEMENT = ["likes", "reach", "shares", "comments"]

# Fixed values of the lifecycle and event rules.
RECENT_WINDOWS = 3
DORMANT_SHARE, EMERGING_GROWTH, TRENDING_GROWTH, DECLINING_GROWTH = 0.2, 0.5, 0.1, -0.3
SPIKE_THRESHOLD = 2.0


def valid_timestamps(posts: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Parse string timestamps leniently and drop rows without one."""
    require_columns(posts, ts_col)
    if dict(posts.dtypes)[ts_col] == "string":
        posts = posts.withColumn(ts_col, F.expr(f"try_cast(`{ts_col}` AS timestamp_ntz)"))
    return posts.where(F.col(ts_col).isNotNull())


def without_noise(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster") != NOISE_CLUSTER)


def first_labels(posts: DataFrame) -> DataFrame:
    """(cluster, cluster_label): the label of the cluster's first row.

    The distinct (cluster, label) pairs are found with a hash aggregate, so a hot
    cluster collapses before the shuffle."""
    if "cluster_label" not in posts.columns:
        return posts.select("cluster").distinct().withColumn("cluster_label", F.col("cluster").cast("string"))
    pairs = posts.groupBy("cluster", "cluster_label").agg(F.min("row_id").alias("first_row"))
    return pairs.groupBy("cluster").agg(F.min_by("cluster_label", "first_row").alias("cluster_label"))


def with_window(posts: DataFrame, freq: str, per_cluster_anchor: bool = True) -> DataFrame:
    """Add ``time_window``. Three-month bins start at each cluster's first month,
    or with ``per_cluster_anchor=False`` at the first month of all posts."""
    if window_name(freq) != QUARTER:
        return posts.withColumn("time_window", window_label(F.col("timestamp"), freq))
    if per_cluster_anchor:
        anchors = posts.groupBy("cluster").agg(F.min("timestamp").alias("_anchor"))
        anchored = posts.join(anchors, "cluster")
    else:
        anchored = posts.withColumn("_anchor", posts.agg(F.min("timestamp")).scalar())
    return anchored.withColumn(
        "time_window", window_label(F.col("timestamp"), freq, F.col("_anchor"))).drop("_anchor")


def window_aggregates(posts: DataFrame) -> DataFrame:
    """Counts and sums per observed (cluster, window). A missing author column
    counts posts instead; missing engagement columns count as 0."""
    authors = F.countDistinct("author") if "author" in posts.columns else F.count(F.lit(1))
    sums = [
        (F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in posts.columns
         else F.lit(0.0)).alias(f"total_{c}")
        for c in ENGAGEMENT
    ]
    return posts.groupBy("cluster", "time_window").agg(
        F.count(F.lit(1)).alias("post_count"), authors.alias("unique_authors"), *sums)


def quarter_aggregates(posts: DataFrame) -> DataFrame:
    """``window_aggregates`` for three-month bins from each cluster's first month. Posts are
    reduced to (cluster, month, author) once; anchors and bins come from that table."""
    by = ["cluster", "_month", *(["author"] if "author" in posts.columns else [])]
    present = [c for c in ENGAGEMENT if c in posts.columns]
    months = materialize(posts.withColumn("_month", window_label(F.col("timestamp"), "1M")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"total_{c}") for c in present]))
    anchors = months.groupBy("cluster").agg(F.min("_month").alias("_anchor"))
    placed = months.join(anchors, "cluster").withColumn("time_window", window_label(F.col("_month"), QUARTER, F.col("_anchor")))
    authors = F.countDistinct("author") if "author" in posts.columns else F.sum("_n")
    return placed.groupBy("cluster", "time_window").agg(
        F.sum("_n").alias("post_count"), authors.alias("unique_authors"),
        *[(F.sum(f"total_{c}") if c in present else F.lit(0.0)).alias(f"total_{c}") for c in ENGAGEMENT])


def fill_gaps(agg: DataFrame, freq: str) -> DataFrame:
    """One row per window from a cluster's first to its last; added rows hold 0.

    Each row fans out to the windows before the cluster's next row, so no second
    scan and no join is needed."""
    measures = [c for c in agg.columns if c not in ("cluster", "time_window")]
    by_time = W.partitionBy("cluster").orderBy("time_window")
    spread = agg.withColumn("_next", F.lead("time_window").over(by_time)).select(
        "cluster", *measures,
        F.posexplode(windows_until(F.col("time_window"), F.col("_next"), freq)).alias("_pos", "time_window"))
    zero = {c: F.lit(0).cast(t) for c, t in agg.dtypes if c in measures}
    return spread.select(
        "cluster", "time_window",
        *[F.when(F.col("_pos") == 0, F.col(c)).otherwise(zero[c]).alias(c) for c in measures])


def lifecycle(growth: Column, recent: Column, overall: Column) -> Column:
    return (
        F.when((overall == 0) | (recent < overall * F.lit(DORMANT_SHARE)), "dormant")
        .when(growth > EMERGING_GROWTH, "emerging")
        .when(growth > TRENDING_GROWTH, "trending")
        .when(growth < DECLINING_GROWTH, "declining")
        .otherwise("stable")
    )


def trend_metrics(series: DataFrame, growth_limit: float | None = None, engagement: bool = True,
                  single_window_stable: bool = True) -> DataFrame:
    """Growth, volatility, volume_lead, anomaly score and lifecycle per cluster."""
    by_time = W.partitionBy("cluster").orderBy("time_window")
    last3 = by_time.rowsBetween(-2, 0)
    whole = W.partitionBy("cluster")
    n = F.col("post_count").cast("double")

    growth = relative_change(n, F.lag(n).over(by_time))
    if growth_limit is not None:
        growth = F.greatest(F.least(growth, F.lit(growth_limit)), F.lit(-growth_limit))
    out = series.withColumns({
        "volume_pct_change": growth,
        "volume_volatility": F.coalesce(F.stddev_samp(n).over(last3), F.lit(0.0)),
        "volume_lead": n - F.avg(n).over(last3),
        "_rank": F.row_number().over(by_time),
    })
    if engagement:
        act = F.col("total_likes") + F.col("total_shares")
        out = out.withColumns({
            "avg_likes": F.try_divide(F.col("total_likes"), n),
            "avg_reach": F.try_divide(F.col("total_reach"), n),
            "engagement_growth": relative_change(act, F.lag(act).over(by_time)),
        })
    out = out.withColumns({
        "_windows": F.count(F.lit(1)).over(whole),
        "_mean": F.avg(n).over(whole),
        "_std": F.stddev_samp(n).over(whole),
    })
    is_recent = F.col("_rank") > F.col("_windows") - RECENT_WINDOWS
    out = out.withColumns({
        "_recent_growth": F.avg(F.when(is_recent, F.col("volume_pct_change"))).over(whole),
        "_recent_volume": F.avg(F.when(is_recent, n)).over(whole),
    })
    state = lifecycle(F.col("_recent_growth"), F.col("_recent_volume"), F.col("_mean"))
    if single_window_stable:
        state = F.when(F.col("_windows") < 2, "stable").otherwise(state)
    spread = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
    return out.withColumns({
        "anomaly_score": (n - F.col("_mean")) / spread,
        "lifecycle_state": state,
    }).drop("_rank", "_windows", "_mean", "_std", "_recent_growth", "_recent_volume")


def with_market_share(stats: DataFrame, when_empty: float | None = None) -> DataFrame:
    """Share of the window's posts over all clusters in ``stats``."""
    n = F.col("post_count").cast("double")
    share = F.try_divide(n, F.sum(n).over(W.partitionBy("time_window")))
    if when_empty is not None:
        share = F.coalesce(share, F.lit(when_empty))
    return stats.withColumn("market_share", share)


def temporal_stats(posts: DataFrame, freq: str = "1M", per_cluster_anchor: bool = True) -> DataFrame:
    """The full per-cluster, per-window table, noise cluster included."""
    posts = valid_timestamps(require_columns(posts, "cluster"))
    by_cluster = window_name(freq) == QUARTER and per_cluster_anchor
    observed = quarter_aggregates(posts) if by_cluster else window_aggregates(with_window(posts, freq, per_cluster_anchor))
    series = fill_gaps(observed, freq)
    labelled = trend_metrics(series).join(first_labels(posts), "cluster")
    return with_market_share(labelled).select(
        "cluster", "cluster_label", "time_window", "post_count", "unique_authors",
        *[f"total_{c}" for c in ENGAGEMENT], "avg_likes", "avg_reach", "volume_pct_change",
        "engagement_growth", "volume_volatility", "volume_lead", "anomaly_score", "market_share",
        "lifecycle_state")


def minimal_stats(posts: DataFrame, freq: str = "1M") -> DataFrame:
    """Fallback table straight from clustered posts: no noise, volume metrics only."""
    posts = without_noise(valid_timestamps(require_columns(posts, "cluster")))
    counts = with_window(posts, freq).groupBy("cluster", "time_window").agg(F.count(F.lit(1)).alias("post_count"))
    stats = trend_metrics(fill_gaps(counts, freq), engagement=False)
    return with_market_share(stats, when_empty=0.0).select(
        "time_window", "cluster", "post_count", "volume_pct_change", "volume_volatility",
        "volume_lead", "market_share")


def detect_events(stats: DataFrame, spike_threshold: float = SPIKE_THRESHOLD) -> DataFrame:
    return stats.where(F.abs("anomaly_score") > spike_threshold).withColumn(
        "event_type", F.when(F.col("anomaly_score") > 0, "spike").otherwise("drop"))


def sample_posts(events: DataFrame, posts: DataFrame, freq: str = "1M", per_event: int = 10, parts: int = 64) -> DataFrame:
    """The most engaging posts of each event, ``per_event`` at most: (cluster, time_window,
    event_type, position, row_id, engagement). Ties go by row_id.

    Posts outside the events' windows leave first. The rest is ranked in ``parts`` of a
    (cluster, window) by row, where a limit per part applies before anything moves, then over
    what the parts keep: no task sees all posts of a hot topic."""
    keys = ["cluster", "time_window"]
    keyed = with_window(valid_timestamps(require_columns(posts, "row_id", "cluster")), freq)
    value = total([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("likes", "shares", "comments") if c in posts.columns] or [F.lit(0.0)])
    rows = keyed.join(events.select(*keys, "event_type"), keys).select(
        *keys, "event_type", "row_id", value.alias("engagement"), F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("_part"))
    best = [F.desc("engagement"), F.asc("row_id")]
    first = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*best))).where(F.col("_place") <= per_event)
    return first.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).where(
        F.col("position") <= per_event).drop("_part", "_place")


def sentiment_distribution(posts: DataFrame, freq: str = "1M", sentiment_col: str = "sentiment") -> DataFrame:
    """Shares of positive / neutral / negative among rows that carry a sentiment."""
    keyed = with_window(valid_timestamps(posts), freq)
    names = ["positive", "neutral", "negative"]
    if sentiment_col not in posts.columns:
        return keyed.select("cluster", "time_window").distinct().select(
            "cluster", "time_window", *[F.lit(None).cast("double").alias(x) for x in names])
    s = F.lower(F.col(sentiment_col))
    known = F.col(sentiment_col).isNotNull()
    ratio = lambda x: F.round(F.coalesce(F.avg(F.when(known, (s == x).cast("double"))), F.lit(0.0)), 4).alias(x)
    return keyed.groupBy("cluster", "time_window").agg(*[ratio(x) for x in names])


def snapshots(stats: DataFrame) -> DataFrame:
    """The ten columns a dashboard reads; absent ones are null."""
    cols = [F.col(c) if c in stats.columns else F.lit(None).cast("double").alias(c) for c in SNAPSHOT_COLUMNS]
    return stats.where(F.col("time_window").isNotNull()).select(*cols)


def lifecycle_counts(stats: DataFrame) -> DataFrame:
    """One vote per cluster; the state is the same on all rows of a cluster."""
    votes = stats.groupBy("cluster").agg(F.max("lifecycle_state").alias("lifecycle_state"))
    return votes.groupBy("lifecycle_state").agg(F.count(F.lit(1)).alias("clusters"))


# --- recent weekly view -------------------------------------------------------

def recent_posts(posts: DataFrame, months: int = 12) -> DataFrame:
    """Posts no older than ``months`` before the newest one, time of day kept."""
    posts = valid_timestamps(posts)
    newest = posts.agg((F.max("timestamp") - F.make_ym_interval(F.lit(0), F.lit(months))).alias("cutoff"))
    return posts.where(F.col("timestamp") >= newest.scalar())


def weekly_counts(posts: DataFrame) -> DataFrame:
    weekly = with_window(valid_timestamps(posts), "1W")
    return fill_gaps(
        weekly.groupBy("cluster", "time_window").agg(F.count(F.lit(1)).alias("post_count")), "1W")


def weekly_density(weekly: DataFrame, min_posts: int = 3, min_density: float = 0.5) -> DataFrame:
    """Share of a cluster's weeks, first to last, that reach ``min_posts``."""
    hit = F.when(F.col("post_count") >= min_posts, 1.0).otherwise(0.0)
    return weekly.groupBy("cluster").agg(F.avg(hit).alias("density")).withColumn(
        "is_dense", F.col("density") >= min_density)


def weekly_snapshots(posts: DataFrame, months: int = 12, min_posts: int = 3,
                     min_density: float = 0.5) -> DataFrame:
    """Weekly metrics of the recent months for densely posted clusters only. The posts are
    reduced to (cluster, week, label) once; counts, density and labels come from that table."""
    recent = with_window(without_noise(recent_posts(posts, months)), "1W")
    label = F.col("cluster_label") if "cluster_label" in posts.columns else F.col("cluster").cast("string")
    weeks = materialize(recent.groupBy("cluster", "time_window", label.alias("cluster_label")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("row_id" if "row_id" in posts.columns else F.lit(0)).alias("row_id")))
    weekly = fill_gaps(weeks.groupBy("cluster", "time_window").agg(F.sum("_n").alias("post_count")), "1W")
    dense = weekly_density(weekly, min_posts, min_density).where("is_dense")
    kept = weekly.join(dense, "cluster", "left_semi")
    metrics = trend_metrics(kept, growth_limit=10.0, engagement=False, single_window_stable=False)
    labelled = metrics.join(first_labels(weeks), "cluster")
    return with_market_share(labelled).select(
        "time_window", "cluster", "cluster_label", "post_count", "market_share", "volume_pct_change",
        "volume_volatility", "volume_lead", "lifecycle_state", "anomaly_score", F.lit("1W").alias("window_type"))
