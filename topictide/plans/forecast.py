"""Forecasts for a table of events, heuristic and trained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.operators.evaluation import PROBS, confidence
from topictide.operators.events import (
    ACTIVATION_THRESHOLD, activated_themes, heuristic_forecast, profile_features, risk_band, score_events,
    theme_summary)
from topictide.plans.training import Bundle
from topictide.runtime import materialize
from topictide.schemas import DIRECTIONS
from topictide.sources.lexicon import Lexicon


def event_features(events: DataFrame, scores: DataFrame, activated: DataFrame, features: list[str]) -> DataFrame:
    """Model input per event in the model's column order; features an event cannot have
    (a change since the previous window) are 0."""
    ids = [f[len("theme_"):-len("_score")] for f in features
           if f.startswith("theme_") and f.endswith("_score") and f not in ("theme_top1_score", "theme_top2_score")]
    table = profile_features(events, activated).join(theme_summary(scores), "event_id", "left")
    if ids:
        wide = scores.groupBy("event_id").pivot("theme_id", [int(i) for i in ids]).agg(F.first("score"))
        table = table.join(wide.select("event_id", *[F.col(f"`{i}`").alias(f"theme_{i}_score") for i in ids]),
                           "event_id", "left")
    table = table.withColumns({
        "volume_lead_x_volatility": F.col("volume_lead") * F.col("volume_volatility"),
        "volume_acceleration": F.col("volume_pct_change_lag1") - F.col("volume_pct_change_lag2"),
        "volume_lead_acceleration": F.col("volume_lead_lag1") - F.col("volume_lead_lag2"),
    })
    value = lambda f: F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)) if f in table.columns else F.lit(0.0)
    return table.select("event_id", *[value(f).alias(f) for f in features])


def trained_forecast(events: DataFrame, lexicon: Lexicon, profiles: DataFrame, stats: DataFrame, bundle: Bundle,
                     mapping: DataFrame | None = None, default: float = ACTIVATION_THRESHOLD,
                     per_theme: dict | None = None) -> DataFrame:
    """Heuristic row with direction, confidence and class probabilities of the model."""
    scores = materialize(score_events(events, lexicon))
    active = activated_themes(scores, profiles, lexicon, mapping, default, per_theme)
    served = bundle.predict(event_features(events, scores, active, bundle.features)).select(
        "event_id", F.col("prediction").alias("_direction"), confidence().alias("_confidence"),
        F.map_from_arrays(F.array(*[F.lit(d) for d in DIRECTIONS]), F.array(*PROBS)).alias("class_probabilities"))
    base = heuristic_forecast(events, lexicon, profiles, stats, mapping, default, per_theme, scores)
    low, high = F.lit(bundle.risk_bands["low"]), F.lit(bundle.risk_bands["high"])
    return base.join(served, "event_id").withColumns({
        "predicted_direction": F.col("_direction"),
        "method": F.lit("trained"),
        "confidence": F.col("_confidence"),
        "model_name": F.lit(bundle.model_name),
        "risk_low": low,
        "risk_high": high,
        "risk_band": risk_band(F.col("predicted_volatility"), low, high),
    }).drop("_direction", "_confidence")
