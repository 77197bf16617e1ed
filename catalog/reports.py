"""Dashboard and chart queries with their checks."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.events import MAPPED, activated, risk_sql
from catalog.temporal import (
    NATION_STATS, ORDER_STATS, ORDER_WEEKLY, STATS_OUT, nation_stats, order_stats, order_weekly)
from catalog.themes import DOC_STATS, THEME_MAP, doc_stats, theme_map
from catalog.views import DOCS, EVENT_THRESHOLDS, LEXICON, event_texts, posts_docs, posts_orders, r6, register, with_
from topictide.operators import events as E
from topictide.operators import temporal as T
from topictide.operators import themes as H
from topictide.operators.profiles import cluster_profiles
from topictide.plans import reports as R
from topictide.runtime import materialize


def best_sql(stats: str = "stats") -> list:
    return [("topics", f"SELECT * FROM {stats} WHERE cluster <> -1"),
            ("wcounts", "SELECT time_window, count(*) AS c FROM topics GROUP BY 1"),
            ("best_w", "SELECT coalesce(max(CASE WHEN c >= 5 THEN time_window END), max(time_window)) AS latest_window FROM wcounts"),
            ("latest", "SELECT t.* FROM topics t, best_w b WHERE t.time_window = b.latest_window")]


ORDER_BEST = [*ORDER_STATS, *best_sql()]
NATION_BEST = [*NATION_STATS, *best_sql()]
DOC_BEST = [*THEME_MAP, *best_sql()]


@register("Q01_best_window", with_(ORDER_BEST, final="SELECT latest_window FROM best_w"))
def _best(spark, sf):
    return R.best_window(T.without_noise(T.snapshots(order_stats(spark, sf))))


@register("Q02_topic_table", with_(DOC_BEST, final=f"""
SELECT 'cluster-' || l.cluster AS id, l.cluster, cluster_label, coalesce(theme_name, '') AS theme_name, post_count AS size,
{r6('market_share * 100 AS market_share', 'volume_pct_change * 100 AS volume_pct_change', 'volume_volatility', 'volume_lead', 'anomaly_score')},
upper(lifecycle_state[1:1]) || lifecycle_state[2:] AS lifecycle, time_window AS latest_window
FROM latest l LEFT JOIN theme_names n ON n.cluster = l.cluster"""))
def _table(spark, sf):
    stats = materialize(doc_stats(spark, sf))
    return R.cluster_table(T.snapshots(stats), H.cluster_theme_names(theme_map(spark, sf, stats)))


SERIES = f"'cluster-' || cluster AS cluster_id, cluster_label, time_window, post_count, {r6('market_share * 100 AS market_share', 'volume_lead', 'volume_volatility AS volatility')}"


@register("Q03_monthly_snapshots", with_(ORDER_STATS, final=f"SELECT {SERIES} FROM stats WHERE cluster <> -1"))
def _monthly(spark, sf):
    return R.monthly_snapshots(T.snapshots(order_stats(spark, sf)))


@register("Q04_weekly_recent", with_(ORDER_WEEKLY, [("names_by_topic", "SELECT cluster, min(cluster_label) || '!' AS theme_name FROM posts WHERE cluster > 1 GROUP BY 1")],
    final=f"SELECT {SERIES.replace('|| cluster AS', '|| w.cluster AS')}, coalesce(theme_name, '') AS theme_name, window_type FROM weekly w LEFT JOIN names_by_topic n ON n.cluster = w.cluster"))
def _weekly(spark, sf):
    names = posts_orders(spark, sf).where(F.col("cluster") > 1).groupBy("cluster").agg(
        F.concat(F.min("cluster_label"), F.lit("!")).alias("theme_name"))
    return R.weekly_recent(order_weekly(spark, sf), names)


@register("Q05_first_events", with_(NATION_STATS, final=f"""
SELECT time_window AS date, cluster, cluster_label, CASE WHEN anomaly_score > 0 THEN 'spike' ELSE 'drop' END AS event_type,
{r6('anomaly_score AS sigma')} FROM stats WHERE abs(anomaly_score) > 2.0 ORDER BY cluster, time_window LIMIT 50"""))
def _first_events(spark, sf):
    return R.anomaly_events(T.detect_events(nation_stats(spark, sf)))


CAP = "upper(lifecycle_state[1:1]) || lifecycle_state[2:]"


@register("Q06_lifecycle_distribution", with_(NATION_BEST, final=f"SELECT {CAP} AS state, CAST(count(*) AS BIGINT) AS count FROM latest GROUP BY 1"))
def _distribution(spark, sf):
    return R.lifecycle_distribution(T.snapshots(nation_stats(spark, sf)))


@register("Q07_kpis", with_(NATION_BEST, final="""
SELECT CAST(count(*) AS BIGINT) AS active_clusters, CAST(count(CASE WHEN lifecycle_state = 'emerging' THEN 1 END) AS BIGINT) AS emerging_count,
CAST(count(CASE WHEN lifecycle_state = 'declining' THEN 1 END) AS BIGINT) AS declining_count, round(avg(volume_volatility), 3) + 0.0 AS avg_volatility,
CAST(count(CASE WHEN abs(anomaly_score) > 2 THEN 1 END) AS BIGINT) AS event_spikes FROM latest"""))
def _kpis(spark, sf):
    return R.kpis(T.snapshots(nation_stats(spark, sf)))


TRENDS = [*MAPPED, ("trends", """SELECT a.event_id, s.cluster, s.cluster_label, s.time_window, s.post_count, s.market_share * 100 AS market_share, s.volume_lead,
    s.volume_volatility AS volatility FROM (SELECT DISTINCT event_id, mapped_cluster_id FROM activated) a JOIN stats s ON s.cluster = a.mapped_cluster_id""")]


def trends(spark, sf):
    stats = materialize(doc_stats(spark, sf))
    return R.cluster_trends(activated(spark, sf, stats=stats), T.snapshots(stats))


@register("Q09_event_trends", with_(TRENDS, final=f"""
SELECT event_id, cluster, cluster_label, time_window, post_count, {r6('market_share', 'volume_lead', 'volatility')} FROM trends"""))
def _trends(spark, sf):
    return trends(spark, sf)


@register("Q09_event_trend_arrays", with_(TRENDS, final=f"""
SELECT event_id, cluster, cluster_label, string_agg(post_count, ',' ORDER BY time_window) AS series FROM trends GROUP BY 1, 2, 3"""))
def _arrays(spark, sf):
    return R.trend_arrays(trends(spark, sf)).select(
        "event_id", "cluster", "cluster_label",
        F.array_join(F.transform("data", lambda p: p["post_count"].cast("string")), ",").alias("series"))


@register("Q10_health", with_(ORDER_WEEKLY, final=f"""
SELECT CAST({len(LEXICON.themes)} AS BIGINT) AS themes, CAST((SELECT count(DISTINCT cluster) FROM posts) AS BIGINT) AS clusters,
CAST((SELECT count(DISTINCT cluster) FROM weekly) AS BIGINT) AS weekly_dense_clusters"""))
def _health(spark, sf):
    return R.health(LEXICON.names(spark), cluster_profiles(order_stats(spark, sf)), order_weekly(spark, sf))


@register("Q11_sanitised_stats", with_(NATION_STATS, final="SELECT " + STATS_OUT + " FROM (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END AS {c}" for c in ("volume_pct_change", "engagement_growth")) + ") FROM stats)"))
def _sanitised(spark, sf):
    return R.sanitized(nation_stats(spark, sf))


@register("Q13_top_anomalous", with_(NATION_BEST, final=f"""
SELECT cluster, cluster_label, {r6('anomaly_score')} FROM latest ORDER BY abs(anomaly_score) DESC, cluster LIMIT 5"""))
def _anomalous(spark, sf):
    return R.top_anomalous(R.cluster_table(T.snapshots(nation_stats(spark, sf)))).select("cluster", "cluster_label", "anomaly_score")


TOPICS = [-1, 0, 1, 2, 3, 4]
for _metric in ("post_count", "market_share", "volume_lead", "volume_volatility"):
    @register(f"Q14_trend_matrix_{_metric}", with_(ORDER_STATS, final="SELECT strftime(time_window, '%Y-%m') AS time_window, " + (
        ", ".join(f"max(CASE WHEN cluster = {c} THEN {_metric} END) AS \"cluster_{c}\"" for c in TOPICS) if _metric == "post_count" else
        r6(*[f"max(CASE WHEN cluster = {c} THEN {_metric} END) AS \"cluster_{c}\"" for c in TOPICS])) + " FROM stats GROUP BY 1"))
    def _matrix(spark, sf, metric=_metric):
        return R.metric_matrix(T.snapshots(order_stats(spark, sf)), TOPICS, metric)


@register("Q15_topics_by_metric", with_(NATION_BEST, final=f"""
SELECT cluster, CAST(row_number() OVER (ORDER BY abs(volume_lead) DESC, cluster) AS INTEGER) AS position, {r6('volume_lead')} FROM latest"""))
def _ranked(spark, sf):
    table = R.ranked_by(R.cluster_table(T.snapshots(nation_stats(spark, sf))), "volume_lead")
    # One row per topic of one window; the position shows the order in the check.
    order = W.partitionBy("latest_window").orderBy(F.abs("volume_lead").desc(), "cluster")
    return table.select("cluster", F.row_number().over(order).alias("position"), "volume_lead")


@register("Q15_drill_down", with_(NATION_STATS, final=f"""
SELECT 'cluster-' || cluster AS cluster_id, cluster_label, strftime(time_window, '%Y-%m') AS time_window, post_count,
{r6('market_share * 100 AS market_share', 'volume_lead', 'volume_volatility AS volatility')} FROM stats WHERE cluster = 3"""))
def _drill(spark, sf):
    return R.drill_down(T.snapshots(nation_stats(spark, sf)), 3)


@register("Q15_topic_comparison", with_(NATION_STATS, final="""
SELECT strftime(time_window, '%Y-%m') AS time_window, max(post_count) FILTER (cluster = 2) AS cluster_2, max(post_count) FILTER (cluster = 7) AS cluster_7,
       max(post_count) FILTER (cluster = 11) AS cluster_11 FROM stats GROUP BY stats.time_window"""))
def _comparison(spark, sf):
    return R.compare_topics(T.snapshots(nation_stats(spark, sf)), [2, 7, 11])


@register("Q16_scenario_comparison", with_(TRENDS, final="""
SELECT time_window, CAST(coalesce(sum(post_count) FILTER (event_id = 2), 0) AS BIGINT) AS scenario_2,
       CAST(coalesce(sum(post_count) FILTER (event_id = 12), 0) AS BIGINT) AS scenario_12,
       CAST(coalesce(sum(post_count) FILTER (event_id = 26), 0) AS BIGINT) AS scenario_26 FROM trends WHERE event_id IN (2, 12, 26) GROUP BY 1"""))
def _side_by_side(spark, sf):
    return R.scenario_comparison(trends(spark, sf), [2, 12, 26])


@register("Q16_scenario_volumes", with_(TRENDS, final="""
SELECT event_id, time_window, CAST(sum(post_count) AS BIGINT) AS post_count FROM trends GROUP BY 1, 2"""))
def _scenarios(spark, sf):
    return R.scenario_volumes(trends(spark, sf))


@register("Q17_scenario_export", with_(MAPPED, risk_sql(), final="""
SELECT md5(event_text) AS event_text, predicted_direction, format('{:.4f}', least(1.0, abs(predicted_direction_score))) AS confidence,
format('{:.4f}', predicted_volatility) AS predicted_volatility,
CASE WHEN predicted_volatility <= low_q THEN 'low' WHEN predicted_volatility >= high_q THEN 'high' ELSE 'medium' END AS risk_band,
'heuristic' AS method, activated_theme_count AS activated_themes FROM forecast f JOIN event_texts e ON e.event_id = f.event_id CROSS JOIN risk"""))
def _export(spark, sf):
    stats = materialize(doc_stats(spark, sf))
    out = E.heuristic_forecast(event_texts(spark, sf), LEXICON, cluster_profiles(stats), stats, theme_map(spark, sf, stats), per_theme=EVENT_THRESHOLDS)
    return R.scenario_export(out).withColumn("event_text", F.md5("event_text"))


@register("Q18_last_state", with_(NATION_STATS, final=f"""
SELECT cluster, {r6('arg_max(volume_lead, time_window) AS volume_lead', 'arg_max(volume_volatility, time_window) AS volatility')} FROM stats GROUP BY 1"""))
def _last(spark, sf):
    return R.last_state(T.snapshots(nation_stats(spark, sf)))


@register("Q18_sparkline", with_(NATION_STATS, final="""
SELECT cluster, strftime(time_window, '%Y-%m') AS time_window, post_count FROM stats
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY time_window DESC) <= 12"""))
def _spark(spark, sf):
    return R.sparkline(T.snapshots(nation_stats(spark, sf)))


@register("Q19_lifecycle_share", with_(NATION_BEST, final=f"""
SELECT {CAP} AS state, CAST(count(*) AS BIGINT) AS count, {r6('count(*) / (SELECT count(*) FROM latest)::DOUBLE AS share')} FROM latest GROUP BY 1"""))
def _lifecycle_share(spark, sf):
    return R.lifecycle_share(T.snapshots(nation_stats(spark, sf)))


# --- chart data ---------------------------------------------------------------------

@register("V01_map_sample", with_(DOCS, final="SELECT row_id, cluster FROM posts ORDER BY md5(row_id || ':42'), row_id LIMIT 20000"))
def _sample(spark, sf):
    return R.map_sample(posts_docs(spark, sf)).select("row_id", "cluster")


@register("V02_activity_cells", with_(NATION_STATS, final=f"SELECT cluster_label, time_window, {r6('avg(post_count) AS post_count')} FROM stats GROUP BY 1, 2"))
def _cells(spark, sf):
    return R.activity_cells(nation_stats(spark, sf))


# The documents' 18 months.
MONTHS = [datetime.date(y, m, calendar.monthrange(y, m)[1]) for y, m in [(2023, m) for m in range(1, 13)] + [(2024, m) for m in range(1, 7)]]


@register("V02_activity_heatmap", with_(DOC_STATS, final="SELECT cluster_label, " + r6(*[
    f"coalesce(avg(CASE WHEN time_window = DATE '{d}' THEN post_count END), 0.0) AS \"{d}\"" for d in MONTHS]) + " FROM stats GROUP BY 1"))
def _heatmap(spark, sf):
    return R.activity_heatmap(doc_stats(spark, sf), MONTHS)


@register("V02_label_lifecycle", with_(NATION_STATS, final="SELECT DISTINCT cluster_label, lifecycle_state FROM stats"))
def _badges(spark, sf):
    return R.label_lifecycle(nation_stats(spark, sf))


@register("V03_event_timeline", with_(NATION_STATS, [
    ("busy", "SELECT cluster FROM stats GROUP BY 1 ORDER BY sum(post_count) DESC, cluster LIMIT 15")], final="""
SELECT cluster, cluster_label, time_window, post_count, anomaly_score > 2.0 AS is_spike FROM stats WHERE cluster IN (SELECT cluster FROM busy)"""))
def _timeline(spark, sf):
    stats = nation_stats(spark, sf)
    return R.event_timeline(stats, T.detect_events(stats))


@register("V04_volatility_summary", with_(NATION_STATS, [
    ("modes", """SELECT cluster_label, lifecycle_state FROM stats GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, lifecycle_state) = 1""")], final=f"""
SELECT s.cluster_label, any_value(m.lifecycle_state) AS lifecycle, {r6('avg(volume_volatility) AS avg_volatility', 'avg(volume_pct_change) AS avg_growth', 'avg(market_share) AS avg_market_share')}
FROM stats s JOIN modes m ON m.cluster_label = s.cluster_label GROUP BY 1 ORDER BY avg(volume_volatility) DESC, 1 LIMIT 20"""))
def _volatility(spark, sf):
    return R.volatility_summary(nation_stats(spark, sf))


@register("V05_lifecycle_counts", with_(ORDER_STATS, final="SELECT lifecycle_state, CAST(count(DISTINCT cluster) AS BIGINT) AS clusters FROM stats GROUP BY 1"))
def _counts(spark, sf):
    return T.lifecycle_counts(order_stats(spark, sf))


@register("V06_top_themes", with_(MAPPED, final=f"""
SELECT event_id, CAST(rank AS INTEGER) AS rank, theme_id, theme_name, direction_label, {r6('score', 'weight')} FROM (
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, theme_id) AS rank FROM activated) WHERE rank <= 10"""))
def _top(spark, sf):
    return R.top_themes(activated(spark, sf))
