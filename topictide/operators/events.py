"""Scoring of incoming event texts against the lexicon, and the heuristic forecast.

All steps take a table of events. Themes are a bounded configuration table, so an event
is scored against all of them in place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import direction, entropy, number_or_zero, top_two
from topictide.functions.text import EVENT_STOP_WORDS, content_tokens
from topictide.operators.ranking import kth_smallest
from topictide.operators.themes import thresholds_column
from topictide.runtime import materialize
from topictide.schemas import RELEVANCE_REPLY, require_columns
from topictide.sources.lexicon import Lexicon

# Fixed values of the event scorer.
PHRASE_BONUS = 0.5
RERANK_TOP_K, BLEND_ALPHA = 10, 0.35
ACTIVATION_THRESHOLD = 4.0
FLAT_BAND = 0.05

PROFILE_FEATURES = {
    "volume_volatility": "avg_volatility",
    "market_share": "avg_market_share",
    "volume_lead": "recent_volume_lead",
    **{f"volume_pct_change_lag{k}": f"recent_growth_lag{k}" for k in range(1, 5)},
    **{f"volume_lead_lag{k}": f"recent_volume_lead_lag{k}" for k in range(1, 5)},
    "rolling_post_mean_3": "rolling_post_mean_3",
    "rolling_post_mean_6": "rolling_post_mean_6",
    "anomaly_score": "recent_anomaly_score",
}


def score_events(events: DataFrame, lexicon: Lexicon, stop_words=EVENT_STOP_WORDS) -> DataFrame:
    """(event_id, theme_id, score) for every event and theme: sum of tf * idf over the
    theme's tokens plus a bonus per multi-word term found inside the normalised text.

    An event is tokenised once and scored where it lies; nothing is shuffled."""
    spark = events.sparkSession
    require_columns(events, "event_id", "event_text")
    # The lexicon is configuration of checked size, so its terms may pass the driver.
    terms = [tuple(r) for r in lexicon.terms(spark, stop_words).orderBy("theme_id", "term").collect()]
    weights: dict[int, dict[str, float]] = {}
    for r in lexicon.tokens(spark, stop_words).orderBy("theme_id", "token").collect():
        weights.setdefault(r.theme_id, {})[r.token] = r.idf
    ids = [r.theme_id for r in lexicon.names(spark).select("theme_id").distinct().orderBy("theme_id").collect()]
    known = sorted({w for own in weights.values() for w in own})

    matched = F.filter("tokens", lambda t: t.isin(known)) if known else F.array().cast("array<string>")
    rows = events.select("event_id", content_tokens(F.col("event_text"), stop_words).alias("tokens")).select(
        "event_id", matched.alias("matched"), F.array_join("tokens", " ").alias("norm"))

    def score(theme: int) -> Column:
        total = F.lit(0.0)
        own = weights.get(theme, {})
        if own:
            idf = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
            total = F.aggregate("matched", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(idf, t), F.lit(0.0)))
        for phrase in [p for t, p in terms if t == theme and " " in p]:
            total = total + F.when(F.contains(F.col("norm"), F.lit(phrase)), PHRASE_BONUS).otherwise(0.0)
        return total

    per_theme = F.array(*[F.struct(F.lit(t).alias("theme_id"), score(t).alias("score")) for t in ids])
    return rows.select("event_id", F.explode(per_theme).alias("s")).select("event_id", "s.theme_id", "s.score")


def parse_relevance(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """(event_id, theme_id, relevance) from JSON replies. Code fences are stripped; if
    the rest is not JSON the outermost braces are tried. Entries are read one by one: an
    entry that is no object or lacks a number is skipped alone. A number as theme id loses
    its fraction, text has to be a whole number."""
    body = F.trim(F.regexp_replace(F.trim(F.col(reply_col)), r"^```[a-zA-Z]*|\s*```$", ""))
    braces = F.regexp_extract(F.col(reply_col), r"(?s)\{.*\}", 0)
    whole = F.from_json(body, RELEVANCE_REPLY, {"mode": "PERMISSIVE"})
    inner = F.from_json(braces, RELEVANCE_REPLY, {"mode": "PERMISSIVE"})
    items = F.coalesce(whole["theme_relevance"], inner["theme_relevance"])
    rows = replies.select("event_id", F.posexplode(items).alias("pos", "item")).select(
        "event_id", "pos", F.get_json_object("item", "$.theme_id").alias("id"),
        F.get_json_object("item", "$.relevance").alias("relevance"),
        F.col("item").rlike(r'"theme_id"\s*:\s*"').alias("is_text"))
    whole_number = F.when(F.col("id").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.expr("try_cast(trim(id) AS int)"))
    any_number = F.expr("try_cast(try_cast(id AS double) AS int)")
    flag = F.when(F.col("id") == "true", 1).when(F.col("id") == "false", 0)
    valid = rows.select(
        "event_id", "pos", F.when(F.col("is_text"), whole_number).otherwise(F.coalesce(flag, any_number)).alias("theme_id"),
        F.expr("CASE relevance WHEN 'true' THEN 1.0D WHEN 'false' THEN 0.0D ELSE try_cast(trim(relevance) AS double) END").alias("relevance"))
    valid = valid.where(F.col("theme_id").isNotNull() & F.col("relevance").isNotNull())
    return valid.groupBy("event_id", "theme_id").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.max_by("relevance", "pos"), F.lit(0.0)))).alias("relevance"))


def rerank_candidates(scores: DataFrame, top_k: int = RERANK_TOP_K) -> DataFrame:
    order = W.partitionBy("event_id").orderBy(F.round("score", 9).desc(), "theme_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def blend_relevance(scores: DataFrame, relevance: DataFrame, alpha: float = BLEND_ALPHA) -> DataFrame:
    """base + alpha * relevance * max(largest base score of the event, 1)."""
    top = F.greatest(F.max("score").over(W.partitionBy("event_id")), F.lit(1.0))
    joined = scores.withColumn("_top", top).join(relevance, ["event_id", "theme_id"], "left")
    blended = F.col("score") + F.lit(alpha) * F.coalesce("relevance", F.lit(0.0)) * F.col("_top")
    return joined.select("event_id", "theme_id", blended.alias("score"))


def activated_themes(scores: DataFrame, profiles: DataFrame, lexicon: Lexicon,
                     mapping: DataFrame | None = None, default: float = ACTIVATION_THRESHOLD,
                     per_theme: dict | None = None) -> DataFrame:
    """Themes at or over their threshold whose topic has a profile, with their weight
    within the event. Without a map entry the theme id names the topic; an entry with
    no topic drops the theme."""
    hot = scores.withColumn("threshold", thresholds_column(lexicon, per_theme, default)).where(
        F.col("score") >= F.col("threshold"))
    named = hot.join(F.broadcast(lexicon.names(scores.sparkSession)), "theme_id")
    topic = F.col("theme_id")
    if mapping is not None:
        known = mapping.select("theme_id", F.col("cluster_id").alias("_mapped"), F.lit(True).alias("_known"))
        named = named.join(F.broadcast(known), "theme_id", "left")
        topic = F.when(F.col("_known"), F.col("_mapped")).otherwise(F.col("theme_id"))
    topics = named.withColumn("mapped_cluster_id", topic.cast("int"))
    wanted = sorted({*PROFILE_FEATURES.values(), "direction_score"} & set(profiles.columns))
    joined = topics.join(
        profiles.select(F.col("cluster").cast("int").alias("mapped_cluster_id"), "direction_label", *wanted),
        "mapped_cluster_id")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in wanted else F.lit(0.0)
              for c in {*PROFILE_FEATURES.values(), "direction_score"}}
    sum_score = F.sum("score").over(W.partitionBy("event_id"))
    return joined.withColumns(filled).withColumn(
        "weight", F.col("score") / F.when(sum_score != 0, sum_score).otherwise(F.lit(1.0))
    ).select("event_id", "theme_id", "theme_name", "mapped_cluster_id", "score", "threshold", "weight",
             "direction_label", "direction_score", *dict.fromkeys(PROFILE_FEATURES.values()))


def estimate_direction(events: DataFrame, activated: DataFrame, profiles: DataFrame) -> DataFrame:
    """Weighted direction and volatility per event; an event without activation is flat
    with the mean volatility of all topics (0 without topics)."""
    entry = F.struct((-F.col("score")).alias("o"), "theme_id", "theme_name", "mapped_cluster_id", "score",
                     "weight", "direction_label", "direction_score")
    per_event = activated.groupBy("event_id").agg(
        F.sum(F.col("weight") * F.col("direction_score")).alias("_score"),
        F.sum(F.col("weight") * F.col("avg_volatility")).alias("_vol"),
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(entry)).alias("_themes"))
    overall = profiles.agg(F.coalesce(F.avg("avg_volatility"), F.lit(0.0))).scalar()
    joined = events.join(per_event, "event_id", "left")
    none = F.array().cast(per_event.schema["_themes"].dataType)
    return joined.withColumns({
        "predicted_direction_score": F.coalesce("_score", F.lit(0.0)),
        "predicted_volatility": F.coalesce("_vol", overall),
        "activated_theme_count": F.coalesce("_n", F.lit(0)),
        "activated_themes": F.transform(F.coalesce("_themes", none), lambda t: t.dropFields("o")),
    }).withColumn("predicted_direction", direction(F.col("predicted_direction_score"), FLAT_BAND)).drop(
        "_score", "_vol", "_n", "_themes")


def heuristic_confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(score))


def risk_thresholds(stats: DataFrame, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """One row (low_q, high_q): exact linear quantiles of the window volatilities; null
    without windows. The values around them are found by histogram passes (``kth_smallest``),
    so no task holds all values."""
    spark = stats.sparkSession
    vol = number_or_zero(F.col("volume_volatility")) if "volume_volatility" in stats.columns else F.lit(0.0)
    values = materialize(stats.select(vol.alias("v")))
    n, schema = values.count(), "low_q double, high_q double"
    if not n:
        return spark.createDataFrame([(None, None)], schema)
    at = [q * (n - 1) for q in (low, high)]
    places = sorted({int(f(p)) + 1 for p in at for f in (math.floor, math.ceil)})
    # A copy of the values for each of at most four places.
    copies = values.select(F.explode(F.array(*[F.lit(k) for k in places])).alias("k_"), "v", F.lit(0).alias("_tie"))
    wanted = spark.createDataFrame([(k, k) for k in places], "k_ int, k int")
    found = {r["k_"]: r["cutoff"] for r in kth_smallest(copies, "k_", "v", "_tie", wanted).collect()}
    below, above = ([found[int(f(p)) + 1] for p in at] for f in (math.floor, math.ceil))
    return spark.createDataFrame([tuple(float(a + (b - a) * (p - math.floor(p))) for a, b, p in zip(below, above, at))], schema)


def risk_band(volatility: Column, low_q: Column, high_q: Column) -> Column:
    v = F.coalesce(F.nanvl(volatility, F.lit(0.0)), F.lit(0.0))
    return F.when(v <= low_q, "low").when(v >= high_q, "high").otherwise("medium")


def theme_score_map(scores: DataFrame) -> DataFrame:
    """(event_id, theme_scores): all themes of an event as a map keyed by id."""
    entry = F.struct(F.col("theme_id").cast("string").alias("key"), F.col("score").alias("value"))
    return scores.groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("theme_scores"))


def profile_features(events: DataFrame, activated: DataFrame) -> DataFrame:
    """Weight-averaged topic state per event, all 0 without activation. The slope
    feature stays 0 because activated themes carry no slope."""
    sums = [F.sum(F.col("weight") * F.col(src)).alias(dst) for dst, src in PROFILE_FEATURES.items()]
    agg = activated.groupBy("event_id").agg(*sums)
    cols = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in PROFILE_FEATURES]
    return events.select("event_id").join(agg, "event_id", "left").select(
        "event_id", *cols, F.lit(0.0).alias("trend_slope_4"))


def theme_summary(scores: DataFrame) -> DataFrame:
    """Active count, two best scores and entropy over an event's theme scores."""
    per_event = scores.groupBy("event_id").agg(F.sort_array(F.collect_list(
        F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))).alias("_s"))
    top1, top2 = top_two(F.col("_s"))
    return per_event.select(
        "event_id",
        F.size(F.filter("_s", lambda v: v > 0)).cast("double").alias("theme_active_count"),
        top1.alias("theme_top1_score"), top2.alias("theme_top2_score"), entropy(F.col("_s")).alias("theme_entropy"))


def heuristic_forecast(events: DataFrame, lexicon: Lexicon, profiles: DataFrame, stats: DataFrame,
                       mapping: DataFrame | None = None, default: float = ACTIVATION_THRESHOLD,
                       per_theme: dict | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The complete heuristic prediction row per event. The scores, far smaller than the
    texts and read several times, are written once, unless they are given."""
    scores = materialize(score_events(events, lexicon)) if scores is None else scores
    risk = risk_thresholds(stats).select(F.struct("low_q", "high_q").alias("q")).scalar()
    active = activated_themes(scores, profiles, lexicon, mapping, default, per_theme)
    estimate = estimate_direction(events, active, profiles).join(theme_score_map(scores), "event_id", "left")
    return estimate.withColumn("_risk", risk).withColumns({
        "heuristic_predicted_direction": F.col("predicted_direction"),
        "heuristic_predicted_direction_score": F.col("predicted_direction_score"),
        "method": F.lit("heuristic"),
        "confidence": heuristic_confidence(F.col("predicted_direction_score")),
        "activation_threshold": F.lit(float(default)),
        "risk_low": F.col("_risk.low_q"),
        "risk_high": F.col("_risk.high_q"),
    }).withColumn("risk_band", risk_band(F.col("predicted_volatility"), F.col("risk_low"), F.col("risk_high"))).drop("_risk")
