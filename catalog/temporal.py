"""Windows, per-topic metrics, events, recency: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import (
    DOCS, EVENTS, NATION, ORDERS, posts_docs, posts_events, posts_nation, posts_orders, r6, register, table, with_)
from topictide.operators import temporal as T

LABEL = {"1M": "last_day(CAST({t} AS DATE))", "1W": "CAST(date_trunc('week', {t}) AS DATE) + 6", "1D": "CAST({t} AS DATE)"}
LABEL3 = ("last_day(CAST(date_trunc('month', {a}) AS DATE) + to_months(CAST(3 * ceil(("
          "(year({t}) - year({a})) * 12 + month({t}) - month({a})) / 3.0) AS INTEGER)))")


def keyed_sql(freq: str, source: str = "posts", global_anchor: bool = False) -> list:
    if freq != "3M":
        return [("keyed", f"SELECT *, CAST({LABEL[freq].format(t='timestamp')} AS DATE) AS time_window FROM {source} "
                          "WHERE timestamp IS NOT NULL")]
    part = "" if global_anchor else "PARTITION BY cluster"
    return [("anchored", f"SELECT *, min(timestamp) OVER ({part}) AS anchor FROM {source} WHERE timestamp IS NOT NULL"),
            ("keyed", f"SELECT *, CAST({LABEL3.format(t='timestamp', a='anchor')} AS DATE) AS time_window FROM anchored")]


def grid_sql(freq: str) -> list:
    if freq in ("1M", "3M"):
        step = 1 if freq == "1M" else 3
        gen = (f"last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), "
               f"INTERVAL {step} MONTH)) AS DATE))")
    else:
        gen = f"CAST(unnest(generate_series(lo, hi, INTERVAL {7 if freq == '1W' else 1} DAY)) AS DATE)"
    return [("ends", "SELECT cluster, min(time_window) AS lo, max(time_window) AS hi FROM keyed GROUP BY 1"),
            ("grid", f"SELECT cluster, {gen} AS time_window FROM ends")]


def change(cur: str, prev: str) -> str:
    return (f"CASE WHEN {prev} IS NULL THEN 0.0 WHEN {prev} <> 0 THEN {cur} / {prev} - 1 "
            f"WHEN {cur} > 0 THEN 'Infinity'::DOUBLE WHEN {cur} < 0 THEN '-Infinity'::DOUBLE ELSE 0.0 END")


def stats_sql(posts: list, freq: str = "1M", measures: dict | None = None, authors: str = "count(DISTINCT author)") -> list:
    """CTEs ending in ``stats``; ``measures`` maps likes/reach/shares/comments to columns."""
    m = {**dict.fromkeys(("likes", "reach", "shares", "comments"), "0.0::DOUBLE"), **(measures or {})}
    sums = ", ".join(f"sum(coalesce({c}, 0.0::DOUBLE)) AS total_{k}" for k, c in m.items())
    zeros = ", ".join(f"coalesce(total_{k}, 0.0::DOUBLE) AS total_{k}" for k in m)
    return [
        *posts, *keyed_sql(freq),
        ("agg", f"SELECT cluster, time_window, count(*) AS post_count, {authors} AS unique_authors, {sums} FROM keyed GROUP BY 1, 2"),
        *grid_sql(freq),
        ("series", f"""SELECT g.cluster, g.time_window, CAST(coalesce(post_count, 0) AS BIGINT) AS post_count,
            CAST(coalesce(unique_authors, 0) AS BIGINT) AS unique_authors, {zeros},
            CAST(coalesce(post_count, 0) AS DOUBLE) AS n
            FROM grid g LEFT JOIN agg a ON g.cluster = a.cluster AND g.time_window = a.time_window"""),
        ("lagged", """SELECT *, lag(n) OVER w AS prev_n, lag(total_likes + total_shares) OVER w AS prev_e,
            stddev_samp(n) OVER w3 AS sd3, avg(n) OVER w3 AS avg3, row_number() OVER (PARTITION BY cluster ORDER BY time_window DESC) AS back,
            count(*) OVER c AS windows, avg(n) OVER c AS mean_n, stddev_samp(n) OVER c AS sd_n FROM series
            WINDOW w AS (PARTITION BY cluster ORDER BY time_window), c AS (PARTITION BY cluster),
                   w3 AS (PARTITION BY cluster ORDER BY time_window ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
        ("grown", f"""SELECT *, {change('n', 'prev_n')} AS volume_pct_change,
            {change('(total_likes + total_shares)', 'prev_e')} AS engagement_growth FROM lagged"""),
        ("recent", """SELECT cluster, avg(volume_pct_change) AS rg, avg(n) AS rv FROM grown WHERE back <= 3 GROUP BY 1"""),
        ("labels_first", """SELECT cluster, arg_min(cluster_label, row_id) AS cluster_label FROM keyed GROUP BY 1"""),
        ("stats", """SELECT g.cluster, l.cluster_label, g.time_window, post_count, unique_authors,
            total_likes, total_reach, total_shares, total_comments,
            CASE WHEN n > 0 THEN total_likes / n END AS avg_likes, CASE WHEN n > 0 THEN total_reach / n END AS avg_reach,
            volume_pct_change, engagement_growth, coalesce(sd3, 0.0) AS volume_volatility, n - avg3 AS volume_lead,
            (n - mean_n) / CASE WHEN sd_n > 0 THEN sd_n ELSE 1.0 END AS anomaly_score,
            CASE WHEN sum(n) OVER (PARTITION BY g.time_window) > 0 THEN n / sum(n) OVER (PARTITION BY g.time_window) END AS market_share,
            CASE WHEN windows < 2 THEN 'stable' WHEN mean_n = 0 OR rv < mean_n * 0.2 THEN 'dormant' WHEN rg > 0.5 THEN 'emerging'
                 WHEN rg > 0.1 THEN 'trending' WHEN rg < -0.3 THEN 'declining' ELSE 'stable' END AS lifecycle_state
            FROM grown g JOIN recent r ON g.cluster = r.cluster JOIN labels_first l ON g.cluster = l.cluster"""),
    ]


FULL = {"likes": "likes", "reach": "reach", "shares": "shares"}
DOUBLES = ["total_likes", "total_reach", "total_shares", "total_comments", "avg_likes", "avg_reach", "volume_pct_change",
           "engagement_growth", "volume_volatility", "volume_lead", "anomaly_score", "market_share"]
STATS_OUT = "cluster, cluster_label, time_window, post_count, unique_authors, lifecycle_state, " + r6(*DOUBLES)
NATION_STATS = stats_sql(NATION, "1M", FULL)
ORDER_STATS = stats_sql(ORDERS, "1M", FULL)


def nation_stats(spark, sf):
    return T.temporal_stats(posts_nation(spark, sf))


def order_stats(spark, sf):
    return T.temporal_stats(posts_orders(spark, sf))


# --- windows --------------------------------------------------------------------

for _name, _freq in (("daily", "1D"), ("weekly", "1W"), ("monthly", "1M"), ("quarterly", "3M")):
    @register(f"T02_windows_{_name}", with_(EVENTS if _freq != "3M" else DOCS, keyed_sql(_freq), final=(
        "SELECT cluster, time_window, CAST(count(*) AS BIGINT) AS posts FROM keyed GROUP BY 1, 2")))
    def _windows(spark, sf, freq=_freq):
        posts = posts_docs(spark, sf) if freq == "3M" else posts_events(spark, sf)
        return T.with_window(posts, freq).groupBy("cluster", "time_window").agg(F.count(F.lit(1)).alias("posts"))


@register("T03_gap_filled_counts", with_(NATION, keyed_sql("1M"), grid_sql("1M"), final="""
SELECT g.cluster, g.time_window, CAST(count(k.row_id) AS BIGINT) AS post_count FROM grid g
LEFT JOIN keyed k ON g.cluster = k.cluster AND g.time_window = k.time_window GROUP BY 1, 2"""))
def _gaps(spark, sf):
    agg = T.with_window(posts_nation(spark, sf), "1M").groupBy("cluster", "time_window").agg(
        F.count(F.lit(1)).alias("post_count"))
    return T.fill_gaps(agg, "1M")


@register("T04_window_aggregates", with_(ORDERS, keyed_sql("1M"), final=f"""
SELECT cluster, time_window, CAST(count(*) AS BIGINT) AS post_count, CAST(count(DISTINCT author) AS BIGINT) AS unique_authors,
{r6('sum(likes) AS total_likes', 'sum(reach) AS total_reach', 'sum(shares) AS total_shares')}, 0.0::DOUBLE AS total_comments
FROM keyed GROUP BY 1, 2"""))
def _aggregates(spark, sf):
    return T.window_aggregates(T.with_window(posts_orders(spark, sf), "1M"))


def _metric(name: str, *columns: str):
    @register(name, with_(NATION_STATS, final=f"SELECT cluster, time_window, {r6(*columns)} FROM stats"))
    def _q(spark, sf):
        return nation_stats(spark, sf).select("cluster", "time_window", *columns)


_metric("T05_average_engagement", "avg_likes", "avg_reach")
_metric("T06_relative_changes", "volume_pct_change", "engagement_growth")
_metric("T07_volume_volatility", "volume_volatility")
_metric("T08_volume_lead", "volume_lead")
_metric("T09_anomaly_score", "anomaly_score")


@register("T10_market_share", with_(ORDER_STATS, final=f"SELECT cluster, time_window, {r6('market_share')} FROM stats"))
def _share(spark, sf):
    return order_stats(spark, sf).select("cluster", "time_window", "market_share")


@register("T11_lifecycle_state", with_(NATION_STATS, final="SELECT DISTINCT cluster, lifecycle_state FROM stats"))
def _lifecycle(spark, sf):
    return nation_stats(spark, sf).select("cluster", "lifecycle_state").distinct()


@register("T12_events", with_(NATION_STATS, final=f"""SELECT {STATS_OUT},
CASE WHEN anomaly_score > 0 THEN 'spike' ELSE 'drop' END AS event_type FROM stats WHERE abs(anomaly_score) > 2.0"""))
def _events(spark, sf):
    return T.detect_events(nation_stats(spark, sf))


@register("T19_sample_posts", with_(NATION_STATS, keyed_sql("1M"), final="""
SELECT cluster, time_window, event_type, CAST(position AS INTEGER) AS position, row_id, round(engagement + 1e-9, 6) + 0.0 AS engagement FROM (
  SELECT k.cluster, k.time_window, CASE WHEN s.anomaly_score > 0 THEN 'spike' ELSE 'drop' END AS event_type, k.row_id,
         coalesce(k.likes, 0) + coalesce(k.shares, 0) AS engagement,
         row_number() OVER (PARTITION BY k.cluster, k.time_window ORDER BY coalesce(k.likes, 0) + coalesce(k.shares, 0) DESC, k.row_id) AS position
  FROM keyed k JOIN stats s ON s.cluster = k.cluster AND s.time_window = k.time_window WHERE abs(s.anomaly_score) > 2.0) WHERE position <= 10"""))
def _samples(spark, sf):
    return T.sample_posts(T.detect_events(nation_stats(spark, sf)), posts_nation(spark, sf))


_R4 = "round(coalesce(avg(CASE WHEN sentiment IS NULL THEN NULL WHEN lower(sentiment) = '{0}' THEN 1.0 ELSE 0.0 END), 0.0), 4) + 0.0 AS {0}"


@register("T13_sentiment_distribution", with_(ORDERS, keyed_sql("1M"), final=(
    f"SELECT cluster, time_window, {_R4.format('positive')}, {_R4.format('neutral')}, {_R4.format('negative')} FROM keyed GROUP BY 1, 2")))
def _sentiment(spark, sf):
    return T.sentiment_distribution(posts_orders(spark, sf))


for _name, _freq, _posts, _cte, _measures in (
    ("monthly_topics", "1M", posts_orders, ORDERS, FULL), ("monthly_nations", "1M", posts_nation, NATION, FULL),
    ("weekly", "1W", posts_events, EVENTS, {"likes": "likes"}), ("daily", "1D", posts_events, EVENTS, {"likes": "likes"}),
    ("quarterly", "3M", posts_orders, ORDERS, FULL), ("weekly_long", "1W", posts_nation, NATION, FULL),
):
    @register(f"T14_temporal_stats_{_name}", with_(stats_sql(_cte, _freq, _measures), final=f"SELECT {STATS_OUT} FROM stats"))
    def _stats(spark, sf, posts=_posts, freq=_freq):
        return T.temporal_stats(posts(spark, sf), freq)


SNAP_DOUBLES = ["market_share", "volume_pct_change", "volume_volatility", "volume_lead", "anomaly_score"]
SNAP_OUT = "time_window, cluster, cluster_label, post_count, lifecycle_state, " + r6(*SNAP_DOUBLES)


@register("T15_monthly_snapshots", with_(ORDER_STATS, final=f"SELECT {SNAP_OUT} FROM stats"))
def _snapshots(spark, sf):
    return T.snapshots(order_stats(spark, sf)).orderBy("time_window", "cluster")


@register("T16_lifecycle_counts", with_(NATION_STATS, final="""
SELECT lifecycle_state, CAST(count(DISTINCT cluster) AS BIGINT) AS clusters FROM stats GROUP BY 1"""))
def _lifecycle_counts(spark, sf):
    return T.lifecycle_counts(nation_stats(spark, sf))


# --- recent weekly view -----------------------------------------------------------

def weekly_sql(posts: list) -> list:
    return [
        *posts,
        ("recent_posts", """SELECT * FROM posts WHERE timestamp >= (SELECT max(timestamp) - INTERVAL 12 MONTH FROM posts)"""),
        ("source", "SELECT * FROM recent_posts WHERE cluster <> -1"),
        *keyed_sql("1W", "source"), *grid_sql("1W"),
        ("wcount", """SELECT g.cluster, g.time_window, CAST(count(k.row_id) AS DOUBLE) AS n FROM grid g LEFT JOIN keyed k
            ON g.cluster = k.cluster AND g.time_window = k.time_window GROUP BY 1, 2"""),
        ("density", "SELECT cluster, avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END) AS density FROM wcount GROUP BY 1"),
        ("wl", """SELECT w.*, lag(n) OVER w AS prev_n, stddev_samp(n) OVER w3 AS sd3, avg(n) OVER w3 AS avg3,
            row_number() OVER (PARTITION BY w.cluster ORDER BY w.time_window DESC) AS back, avg(n) OVER c AS mean_n, stddev_samp(n) OVER c AS sd_n
            FROM wcount w JOIN density d ON w.cluster = d.cluster AND density >= 0.5
            WINDOW w AS (PARTITION BY w.cluster ORDER BY w.time_window), c AS (PARTITION BY w.cluster),
                   w3 AS (PARTITION BY w.cluster ORDER BY w.time_window ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
        ("wg", f"SELECT *, greatest(least({change('n', 'prev_n')}, 10.0), -10.0) AS volume_pct_change FROM wl"),
        ("wr", "SELECT cluster, avg(volume_pct_change) AS rg, avg(n) AS rv FROM wg WHERE back <= 3 GROUP BY 1"),
        ("wlabels", "SELECT cluster, arg_min(cluster_label, row_id) AS cluster_label FROM keyed GROUP BY 1"),
        ("weekly", """SELECT g.time_window, g.cluster, l.cluster_label, CAST(n AS BIGINT) AS post_count,
            n / nullif(sum(n) OVER (PARTITION BY g.time_window), 0) AS market_share, volume_pct_change, coalesce(sd3, 0.0) AS volume_volatility,
            n - avg3 AS volume_lead, CASE WHEN mean_n = 0 OR rv < mean_n * 0.2 THEN 'dormant' WHEN rg > 0.5 THEN 'emerging'
                 WHEN rg > 0.1 THEN 'trending' WHEN rg < -0.3 THEN 'declining' ELSE 'stable' END AS lifecycle_state,
            (n - mean_n) / CASE WHEN sd_n > 0 THEN sd_n ELSE 1.0 END AS anomaly_score, '1W' AS window_type
            FROM wg g JOIN wr r ON g.cluster = r.cluster JOIN wlabels l ON g.cluster = l.cluster"""),
    ]


ORDER_WEEKLY = weekly_sql(ORDERS)


def order_weekly(spark, sf):
    return T.weekly_snapshots(posts_orders(spark, sf))


@register("T17_weekly_density_gate", with_(ORDER_WEEKLY, final=f"""
SELECT cluster, {r6('density')}, density >= 0.5 AS is_dense FROM density"""))
def _density(spark, sf):
    recent = T.without_noise(T.recent_posts(posts_orders(spark, sf)))
    return T.weekly_density(T.weekly_counts(recent))


@register("T18_weekly_snapshots", with_(ORDER_WEEKLY, final=f"SELECT {SNAP_OUT}, window_type FROM weekly"))
def _weekly(spark, sf):
    return order_weekly(spark, sf)


@register("T18_weekly_snapshots_events", with_(weekly_sql(EVENTS), final=f"SELECT {SNAP_OUT}, window_type FROM weekly"))
def _weekly_events(spark, sf):
    return T.weekly_snapshots(posts_events(spark, sf))


@register("S11_minimal_stats", with_([*ORDERS[:1], ("kept", "SELECT * FROM posts WHERE cluster <> -1")], keyed_sql("1M", "kept"),
    grid_sql("1M"), [
        ("c", """SELECT g.cluster, g.time_window, CAST(count(k.row_id) AS DOUBLE) AS n FROM grid g LEFT JOIN keyed k
            ON g.cluster = k.cluster AND g.time_window = k.time_window GROUP BY 1, 2"""),
        ("l", """SELECT *, lag(n) OVER w AS prev_n, stddev_samp(n) OVER w3 AS sd3, avg(n) OVER w3 AS avg3 FROM c
            WINDOW w AS (PARTITION BY cluster ORDER BY time_window),
                   w3 AS (PARTITION BY cluster ORDER BY time_window ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")],
    final=f"""SELECT time_window, cluster, CAST(n AS BIGINT) AS post_count,
{r6(change('n', 'prev_n') + ' AS volume_pct_change', 'coalesce(sd3, 0.0) AS volume_volatility', 'n - avg3 AS volume_lead',
    'coalesce(n / nullif(sum(n) OVER (PARTITION BY time_window), 0), 0.0) AS market_share')} FROM l"""))
def _minimal(spark, sf):
    return T.minimal_stats(posts_orders(spark, sf))


@register("P07_valid_timestamps", """
WITH raw AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'not a date' WHEN user_id % 13 = 0 THEN NULL
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS valid, min(CAST(TRY_CAST(stamp AS TIMESTAMP) AS DATE)) AS first_day
FROM raw WHERE TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL GROUP BY 1""")
def _valid(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "not a date")
        .when(F.col("user_id") % 13 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    return T.valid_timestamps(e).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("valid"), F.min(F.col("timestamp").cast("date")).alias("first_day"))


@register("P08_without_noise", with_(ORDERS, final="""
SELECT cluster, CAST(count(*) AS BIGINT) AS posts FROM posts WHERE cluster <> -1 GROUP BY 1"""))
def _noise(spark, sf):
    return T.without_noise(posts_orders(spark, sf)).groupBy("cluster").agg(F.count(F.lit(1)).alias("posts"))


@register("P09_recent_posts", with_(ORDERS, final="""
SELECT row_id, CAST(timestamp AS DATE) AS day, cluster FROM posts
WHERE timestamp >= (SELECT max(timestamp) - INTERVAL 12 MONTH FROM posts)"""))
def _recent(spark, sf):
    return T.recent_posts(posts_orders(spark, sf)).select("row_id", F.col("timestamp").cast("date").alias("day"), "cluster")


