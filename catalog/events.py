"""Event scoring, profiles and the heuristic forecast: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.temporal import NATION_STATS, nation_stats
from catalog.themes import DOC_STATS, THEME_MAP, doc_stats, theme_map, theme_terms_sql
from catalog.views import (
    EVENT_TEXTS, EVENT_THRESHOLDS, LEXICON, event_texts, names_sql, r6, register, tokens_sql, with_)
from topictide.functions.text import EVENT_STOP_WORDS
from topictide.operators import events as E
from topictide.operators.profiles import cluster_profiles
from topictide.runtime import materialize

# --- profiles ---------------------------------------------------------------------


def profiles_sql(stats: list) -> list:
    last = lambda c, k: f"max(CASE WHEN back = {k} THEN {c} END)"
    lag = lambda c, k: "coalesce(" + ", ".join(last(c, i) for i in range(k, 0, -1)) + ")"
    lags = ", ".join(f"{lag(c, k)} AS recent_{n}_lag{k}" for c, n in (("growth", "growth"), ("mom", "volume_lead")) for k in range(1, 5))
    return [
        *stats,
        ("ranked", """SELECT cluster, time_window, CAST(post_count AS DOUBLE) AS n, coalesce(volume_volatility, 0) AS vol,
            coalesce(market_share, 0) AS share, coalesce(volume_pct_change, 0) AS growth, coalesce(volume_lead, 0) AS mom, coalesce(anomaly_score, 0) AS anom,
            row_number() OVER (PARTITION BY cluster ORDER BY time_window) - 1 AS idx,
            row_number() OVER (PARTITION BY cluster ORDER BY time_window DESC) AS back FROM stats"""),
        ("prof", f"""SELECT cluster, CAST(count(*) AS BIGINT) AS n_windows, avg(n) AS avg_post_count, avg(vol) AS avg_volatility, avg(share) AS avg_market_share,
            avg(CASE WHEN back <= 3 THEN growth END) AS recent_growth, avg(CASE WHEN back <= 3 THEN mom END) AS recent_volume_lead, {lags},
            avg(CASE WHEN back <= 3 THEN n END) AS rolling_post_mean_3, avg(CASE WHEN back <= 6 THEN n END) AS rolling_post_mean_6,
            {last('anom', 1)} AS recent_anomaly_score, CASE WHEN count(*) > 1 THEN regr_slope(n, idx) ELSE 0.0 END AS trend_slope
            FROM ranked GROUP BY 1"""),
        ("scored_prof", """SELECT *, 0.5 * recent_growth + 0.3 * (recent_volume_lead / greatest(avg_post_count, 1.0))
            + 0.2 * (trend_slope / greatest(avg_post_count, 1.0)) AS direction_score FROM prof"""),
        ("profiles", """SELECT *, CASE WHEN direction_score > 0.05 THEN 'up' WHEN direction_score < -0.05 THEN 'down' ELSE 'flat' END AS direction_label
            FROM scored_prof"""),
    ]


PROFILE_DOUBLES = ["avg_post_count", "avg_volatility", "avg_market_share", "recent_growth", "recent_volume_lead",
                   *[f"recent_{n}_lag{k}" for n in ("growth", "volume_lead") for k in range(1, 5)], "rolling_post_mean_3",
                   "rolling_post_mean_6", "recent_anomaly_score", "trend_slope", "direction_score"]


@register("E05_topic_profiles", with_(profiles_sql(NATION_STATS), final=(
    f"SELECT cluster, n_windows, direction_label, {r6(*PROFILE_DOUBLES)} FROM profiles")))
def _profiles(spark, sf):
    return cluster_profiles(nation_stats(spark, sf))


# --- lexicon score ------------------------------------------------------------------

EVENT_SCORES = [
    *EVENT_TEXTS,
    *[("event_raw_terms" if n == "raw_terms" else "event_theme_terms", q.replace("raw_terms", "event_raw_terms"))
      for n, q in theme_terms_sql(EVENT_STOP_WORDS)],
    ("event_names", names_sql()),
    ("theme_tokens", "SELECT DISTINCT theme_id, unnest(string_split(term, ' ')) AS token FROM event_theme_terms"),
    ("token_idf", f"SELECT token, ln((1.0 + {len(LEXICON.themes)}) / (1.0 + count(*))) + 1.0 AS idf FROM theme_tokens GROUP BY 1"),
    ("event_tokens", f"SELECT event_id, {tokens_sql('event_text', EVENT_STOP_WORDS)} AS toks FROM event_texts"),
    ("token_hits", """SELECT event_id, theme_id, sum(idf) AS s FROM (SELECT event_id, unnest(toks) AS token FROM event_tokens) e
        JOIN theme_tokens t ON e.token = t.token JOIN token_idf i ON i.token = t.token GROUP BY 1, 2"""),
    ("phrase_hits", """SELECT event_id, theme_id, 0.5 * count(*) AS s FROM (SELECT event_id, array_to_string(toks, ' ') AS norm FROM event_tokens) e
        JOIN event_theme_terms t ON contains(t.term, ' ') AND contains(e.norm, t.term) GROUP BY 1, 2"""),
    ("event_scores", """SELECT e.event_id, n.theme_id, CAST(coalesce(a.s, 0) + coalesce(b.s, 0) AS DOUBLE) AS score FROM event_texts e CROSS JOIN event_names n
        LEFT JOIN token_hits a ON a.event_id = e.event_id AND a.theme_id = n.theme_id
        LEFT JOIN phrase_hits b ON b.event_id = e.event_id AND b.theme_id = n.theme_id"""),
]


def event_scores(spark, sf):
    return E.score_events(event_texts(spark, sf), LEXICON)


@register("E01_lexicon_scores", with_(EVENT_SCORES, final=f"SELECT event_id, theme_id, {r6('score')} FROM event_scores"))
def _lexicon(spark, sf):
    return event_scores(spark, sf)


def replies(spark, sf):
    """A JSON reply per event in the shapes a remote model produces, broken ones included."""
    e, i = event_texts(spark, sf), F.col("event_id")
    rel = ((i % 17) / F.lit(10.0) - F.lit(0.3))
    shape = i.cast("long") % 4  # the id as a whole number, a float, text, or text that is none
    name = (i % 6).cast("string")
    own = F.when(shape == 1, F.concat(name, F.lit(".0"))).when(shape == 2, F.concat(F.lit('"'), name, F.lit('"'))).when(
        shape == 3, F.concat(F.lit('"'), name, F.lit('.0"'))).otherwise(name)
    body = F.concat(F.lit('{"theme_relevance": ["oops", {"theme_id": '), own, F.lit(', "relevance": '),
                    rel.cast("string"), F.lit(', "reason": "r"}, {"theme_id": "x", "relevance": 1}, {"relevance": 0.5}, 7, '
                                              '{"theme_id": 9, "relevance": "NaN"}]}'))
    return e.select("event_id", F.when(i % 5 == 0, body).when(i % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                    .when(i % 5 == 2, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone.")))
                    .when(i % 5 == 3, F.lit("{not json}")).otherwise(F.lit("")).alias("reply"))


RELEVANCE = [("relevance", """SELECT doc_id AS event_id, CAST(doc_id % 6 AS INTEGER) AS theme_id,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (doc_id % 17) / 10.0::DOUBLE - 0.3::DOUBLE)) AS relevance FROM documents
    WHERE doc_id % 5 < 3 AND doc_id % 4 < 3
    UNION ALL SELECT doc_id, 9, 0.0::DOUBLE FROM documents WHERE doc_id % 5 < 3""")]


@register("E02_relevance_replies", with_(RELEVANCE, final=f"SELECT event_id, theme_id, {r6('relevance')} FROM relevance"))
def _relevance(spark, sf):
    return E.parse_relevance(replies(spark, sf))


@register("E03_rerank_candidates", with_(EVENT_SCORES, final=f"""
SELECT event_id, theme_id, {r6('score')}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, theme_id) AS rank FROM event_scores) WHERE rank <= 3"""))
def _candidates(spark, sf):
    return E.rerank_candidates(event_scores(spark, sf), 3)


@register("E04_blended_scores", with_(EVENT_SCORES, RELEVANCE, [
    ("topped", "SELECT *, greatest(max(score) OVER (PARTITION BY event_id), 1.0) AS top FROM event_scores")], final=f"""
SELECT t.event_id, t.theme_id, {r6('score + 0.35 * coalesce(relevance, 0) * top AS score')} FROM topped t
LEFT JOIN relevance r ON r.event_id = t.event_id AND r.theme_id = t.theme_id"""))
def _blended(spark, sf):
    return E.blend_relevance(event_scores(spark, sf), E.parse_relevance(replies(spark, sf)))


# --- activation and forecast ----------------------------------------------------------

_T = "CASE s.theme_id " + " ".join(f"WHEN {k} THEN {v}" for k, v in EVENT_THRESHOLDS.items()) + " ELSE 4.0 END"
DOC_PROFILES = profiles_sql(DOC_STATS)


def activated_sql(mapped: bool) -> list:
    topic = "CASE WHEN m.theme_id IS NOT NULL THEN m.cluster_id ELSE s.theme_id END" if mapped else "s.theme_id"
    join = "LEFT JOIN theme_map m ON m.theme_id = s.theme_id" if mapped else ""
    return [
        *(THEME_MAP if mapped else DOC_STATS), *DOC_PROFILES, *EVENT_SCORES,
        ("hot", f"""SELECT s.event_id, s.theme_id, n.theme_name, {topic} AS mapped_cluster_id, s.score, CAST({_T} AS DOUBLE) AS threshold
            FROM event_scores s JOIN event_names n ON n.theme_id = s.theme_id {join} WHERE s.score >= {_T}"""),
        ("activated", """SELECT h.*, h.score / CASE WHEN sum(h.score) OVER (PARTITION BY event_id) <> 0 THEN sum(h.score) OVER (PARTITION BY event_id)
            ELSE 1.0 END AS weight, p.direction_label, p.direction_score, p.avg_volatility, p.avg_market_share, p.recent_volume_lead,
            p.recent_growth_lag1, p.recent_growth_lag2, p.recent_growth_lag3, p.recent_growth_lag4, p.recent_volume_lead_lag1, p.recent_volume_lead_lag2,
            p.recent_volume_lead_lag3, p.recent_volume_lead_lag4, p.rolling_post_mean_3, p.rolling_post_mean_6, p.recent_anomaly_score
            FROM hot h JOIN profiles p ON p.cluster = h.mapped_cluster_id"""),
        ("estimate", """SELECT event_id, sum(weight * direction_score) AS ds, sum(weight * avg_volatility) AS vol, count(*) AS n,
            string_agg(theme_id, ',' ORDER BY score DESC, theme_id) AS themes FROM activated GROUP BY 1"""),
        ("forecast", """SELECT e.event_id, coalesce(ds, 0.0) AS predicted_direction_score,
            coalesce(vol, (SELECT coalesce(avg(avg_volatility), 0.0) FROM profiles)) AS predicted_volatility,
            CAST(coalesce(n, 0) AS BIGINT) AS activated_theme_count, coalesce(themes, '') AS activated_themes,
            CASE WHEN isnan(coalesce(ds, 0.0)) THEN 'flat' WHEN coalesce(ds, 0.0) > 0.05 THEN 'up' WHEN coalesce(ds, 0.0) < -0.05 THEN 'down' ELSE 'flat' END
              AS predicted_direction FROM event_texts e LEFT JOIN estimate a ON a.event_id = e.event_id"""),
    ]


def activated(spark, sf, mapped: bool = True, stats=None):
    stats = materialize(doc_stats(spark, sf)) if stats is None else stats
    return E.activated_themes(event_scores(spark, sf), cluster_profiles(stats), LEXICON,
                              theme_map(spark, sf, stats) if mapped else None, per_theme=EVENT_THRESHOLDS)


ACTIVE_OUT = "event_id, theme_id, theme_name, CAST(mapped_cluster_id AS INTEGER) AS mapped_cluster_id, direction_label, " + r6("score", "threshold", "direction_score")
for _mapped in (True, False):
    @register("E06_activated_themes_" + ("mapped" if _mapped else "by_theme_id"), with_(activated_sql(_mapped), final=f"SELECT {ACTIVE_OUT} FROM activated"))
    def _activated(spark, sf, mapped=_mapped):
        return activated(spark, sf, mapped).select(
            "event_id", "theme_id", "theme_name", "mapped_cluster_id", "direction_label", "score", "threshold", "direction_score")

MAPPED = activated_sql(True)


@register("E07_activation_weights", with_(MAPPED, final=f"SELECT event_id, theme_id, {r6('weight')} FROM activated"))
def _weights(spark, sf):
    return activated(spark, sf).select("event_id", "theme_id", "weight")


def estimates(spark, sf):
    stats = materialize(doc_stats(spark, sf))
    est = E.estimate_direction(event_texts(spark, sf), activated(spark, sf, stats=stats), cluster_profiles(stats))
    return est.withColumn("activated_themes", F.array_join(F.transform("activated_themes", lambda t: t["theme_id"].cast("string")), ","))


@register("E08_event_directions", with_(MAPPED, final=f"""
SELECT event_id, predicted_direction, activated_theme_count, activated_themes, {r6('predicted_direction_score', 'predicted_volatility')} FROM forecast"""))
def _estimates(spark, sf):
    return estimates(spark, sf).select("event_id", "predicted_direction", "activated_theme_count", "activated_themes",
                                       "predicted_direction_score", "predicted_volatility")


@register("E09_heuristic_confidence", with_(MAPPED, final=f"""
SELECT event_id, {r6('least(1.0, abs(predicted_direction_score)) AS confidence')} FROM forecast"""))
def _confidence(spark, sf):
    return estimates(spark, sf).select("event_id", E.heuristic_confidence(F.col("predicted_direction_score")).alias("confidence"))


def risk_sql(stats: str = "stats") -> list:
    return [("risk", f"SELECT quantile_cont(coalesce(volume_volatility, 0), 0.33) AS low_q, quantile_cont(coalesce(volume_volatility, 0), 0.66) AS high_q FROM {stats}")]


@register("E10_risk_thresholds", with_(NATION_STATS, risk_sql(), final=f"SELECT {r6('low_q', 'high_q')} FROM risk"))
def _risk(spark, sf):
    return E.risk_thresholds(nation_stats(spark, sf))


@register("E10_risk_bands", with_(NATION_STATS, risk_sql(), final="""
SELECT cluster, time_window, CASE WHEN volume_volatility <= low_q THEN 'low' WHEN volume_volatility >= high_q THEN 'high' ELSE 'medium' END AS risk_band
FROM stats, risk"""))
def _bands(spark, sf):
    stats = nation_stats(spark, sf)
    q = E.risk_thresholds(stats)
    band = E.risk_band(F.col("volume_volatility"), q.select("low_q").scalar(), q.select("high_q").scalar())
    return stats.select("cluster", "time_window", band.alias("risk_band"))


@register("E11_event_profile_features", with_(MAPPED, [("pf", "SELECT event_id, " + ", ".join(
    f"sum(weight * {src}) AS {dst}" for dst, src in E.PROFILE_FEATURES.items()) + " FROM activated GROUP BY 1")],
    final="SELECT e.event_id, " + r6(*[f"coalesce(p.{d}, 0.0) AS {d}" for d in E.PROFILE_FEATURES]) +
          ", 0.0::DOUBLE AS trend_slope_4 FROM event_texts e LEFT JOIN pf p ON p.event_id = e.event_id"))
def _profile_features(spark, sf):
    return E.profile_features(event_texts(spark, sf), activated(spark, sf))


@register("E12_event_theme_summary", with_(EVENT_SCORES, [
    ("tot", "SELECT event_id, sum(score) AS t FROM event_scores GROUP BY 1"),
    ("ranked_scores", "SELECT s.*, t, row_number() OVER (PARTITION BY s.event_id ORDER BY score DESC) AS rn FROM event_scores s JOIN tot ON tot.event_id = s.event_id")],
    final=f"""SELECT event_id, {r6('CAST(count(CASE WHEN score > 0 THEN 1 END) AS DOUBLE) AS theme_active_count',
    'max(CASE WHEN rn = 1 THEN score END) AS theme_top1_score', 'max(CASE WHEN rn = 2 THEN score END) AS theme_top2_score',
    'coalesce(sum(CASE WHEN t > 0 THEN -(score / t) * ln(score / t + 1e-12) ELSE 0 END), 0) AS theme_entropy')} FROM ranked_scores GROUP BY 1"""))
def _theme_summary(spark, sf):
    return E.theme_summary(event_scores(spark, sf))


@register("E14_heuristic_forecast", with_(MAPPED, risk_sql(), final=f"""
SELECT f.event_id, predicted_direction, predicted_direction AS heuristic_predicted_direction, activated_theme_count, 'heuristic' AS method,
{r6('predicted_direction_score', 'predicted_volatility', 'least(1.0, abs(predicted_direction_score)) AS confidence', 'low_q AS risk_low', 'high_q AS risk_high')},
4.0::DOUBLE AS activation_threshold,
CASE WHEN predicted_volatility <= low_q THEN 'low' WHEN predicted_volatility >= high_q THEN 'high' ELSE 'medium' END AS risk_band,
ts.best_theme FROM forecast f CROSS JOIN risk JOIN (SELECT event_id AS eid, CAST(arg_max(theme_id, score * 1000 - theme_id / 1000.0) AS INTEGER) AS best_theme FROM event_scores GROUP BY 1) ts ON ts.eid = f.event_id"""))
def _forecast(spark, sf):
    stats = materialize(doc_stats(spark, sf))  # read by profiles, risk bands, targets and labels
    out = E.heuristic_forecast(event_texts(spark, sf), LEXICON, cluster_profiles(stats), stats, theme_map(spark, sf, stats), per_theme=EVENT_THRESHOLDS)
    best = F.array_max(F.transform(F.map_entries("theme_scores"), lambda e: F.struct(
        (e["value"] * 1000 - e["key"].cast("int") / F.lit(1000.0)).alias("s"), e["key"].cast("int").alias("k"))))
    return out.select("event_id", "predicted_direction", "heuristic_predicted_direction", "activated_theme_count", "method",
                      "predicted_direction_score", "predicted_volatility", "confidence", "risk_low", "risk_high",
                      "activation_threshold", "risk_band", best["k"].alias("best_theme"))
