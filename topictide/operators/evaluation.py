"""Splits, probability adjustment, metrics and model comparison as aggregates.

Predictions are long tables with ``target`` and ``prediction``; probabilities are the
three columns p_down, p_flat, p_up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topictide.functions.numbers import total
from topictide.schemas import DIRECTIONS

PROBS = [f"p_{d}" for d in DIRECTIONS]

# Class multipliers tried when none are configured.
THRESHOLD_CANDIDATES = [
    {"down": 1.0, "flat": 1.0, "up": 1.0},
    {"down": 1.05, "flat": 1.0, "up": 1.0},
    {"down": 1.0, "flat": 1.05, "up": 1.0},
    {"down": 1.0, "flat": 1.0, "up": 1.05},
    {"down": 0.95, "flat": 1.0, "up": 1.0},
    {"down": 1.0, "flat": 1.0, "up": 0.95},
]


# --- time splits --------------------------------------------------------------

def _times(frame: DataFrame) -> DataFrame:
    """One row: the sorted distinct windows. Its size is bounded by the calendar."""
    return frame.select("time_window").distinct().agg(F.sort_array(F.collect_list("time_window")).alias("times"))


def holdout_split(frame: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Add ``split``: train up to the cutoff window, test after it."""
    n = F.size("times")
    idx = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(1.0 - test_fraction)).cast("int")))
    cutoff = _times(frame).select(F.get("times", idx - 1).alias("cutoff"))
    return frame.withColumn("cutoff", cutoff.scalar()).withColumn(
        "split", F.when(F.col("time_window") <= F.col("cutoff"), "train").otherwise("test"))


def walk_forward_folds(frame: DataFrame, n_splits: int, min_train: int, purge_gap: int = 1) -> DataFrame:
    """(fold, time_window, role): expanding train windows, a purge gap, then test windows."""
    splits = max(1, int(n_splits))
    n = F.size("times")
    step = F.greatest(F.lit(1), F.floor((n - min_train) / splits).cast("int"))
    folds = (_times(frame).where(n > min_train)
             .select("times", step.alias("step"), n.alias("n"),
                     F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold"))
             .withColumn("train_end", F.lit(min_train) + F.col("fold") * (F.col("step") + purge_gap))
             .withColumn("test_start", F.col("train_end") + purge_gap)
             .where(F.col("test_start") < F.col("n")))
    placed = folds.select("fold", "train_end", "test_start", "step", F.posexplode("times").alias("pos", "time_window"))
    role = (F.when(F.col("pos") < F.col("train_end"), "train")
            .when((F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_start") + F.col("step")), "test"))
    return placed.select("fold", "time_window", role.alias("role")).where(F.col("role").isNotNull())


def stacking_folds(frame: DataFrame, n_folds: int = 3, purge_gap: int = 1) -> DataFrame:
    """(fold, time_window, role) of the out-of-fold scheme: equal slices, gap of one."""
    n = F.size("times")
    size = F.greatest(F.lit(1), F.floor(n / (n_folds + 1)).cast("int"))
    folds = (_times(frame).where(n >= n_folds + 1)
             .select("times", size.alias("step"), n.alias("n"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
             .withColumn("train_end", F.col("step") * (F.col("fold") + 1))
             .withColumn("test_start", F.col("train_end") + purge_gap)
             .where(F.col("test_start") < F.col("n")))
    placed = folds.select("fold", "train_end", "test_start", "step", F.posexplode("times").alias("pos", "time_window"))
    role = (F.when(F.col("pos") < F.col("train_end"), "train")
            .when((F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_start") + F.col("step")), "test"))
    return placed.select("fold", "time_window", role.alias("role")).where(F.col("role").isNotNull())


# --- probabilities ------------------------------------------------------------

def adjusted_probabilities(df: DataFrame, multipliers: dict | None = None) -> DataFrame:
    """Multiply each class by its multiplier (number or column) and renormalise."""
    multipliers = multipliers or {}
    as_col = lambda m: m if isinstance(m, Column) else F.lit(float(m))
    raw = {f"_a_{d}": F.coalesce(F.col(f"p_{d}"), F.lit(0.0)) * as_col(multipliers.get(d, 1.0)) for d in DIRECTIONS}
    df = df.withColumns(raw).withColumn("_sum", total([F.col(c) for c in raw]))
    norm = {f"p_{d}": F.when(F.col("_sum") > 0, F.col(f"_a_{d}") / F.col("_sum")).otherwise(F.col(f"_a_{d}"))
            for d in DIRECTIONS}
    return df.withColumns(norm).drop(*raw, "_sum")


def picked_label() -> Column:
    """Most likely class; ties go to the first of down, flat, up."""
    best = F.greatest(*[F.col(c) for c in PROBS])
    out = None
    for d in DIRECTIONS[:-1]:
        hit = F.col(f"p_{d}") == best
        out = F.when(hit, d) if out is None else out.when(hit, d)
    return out.otherwise(DIRECTIONS[-1])


def confidence() -> Column:
    """Lead of the most likely class over the second."""
    ranked = F.sort_array(F.array(*[F.col(c) for c in PROBS]), asc=False)
    return F.greatest(F.lit(0.0), F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)))


def soft_vote(member_probs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the members' probabilities per row."""
    return member_probs.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in PROBS])


# --- metrics ------------------------------------------------------------------

def evaluate(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro F1, per-class precision/recall/F1 and confusion counts per
    group, all from one aggregate. A class with no cases scores 0."""
    t, p = F.col("target"), F.col("prediction")
    counts = [F.sum(F.when((t == a) & (p == b), 1).otherwise(0)).alias(f"cm_{a}_{b}")
              for a in DIRECTIONS for b in DIRECTIONS]
    agg = predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    cell = lambda a, b: F.col(f"cm_{a}_{b}").cast("double")
    ratio = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).otherwise(F.lit(0.0))
    scores = {}
    for d in DIRECTIONS:
        hit = cell(d, d)
        said, was = total([cell(a, d) for a in DIRECTIONS]), total([cell(d, b) for b in DIRECTIONS])
        scores[f"precision_{d}"] = ratio(hit, said)
        scores[f"recall_{d}"] = ratio(hit, was)
        scores[f"f1_{d}"] = ratio(2.0 * hit, said + was)
    agg = agg.withColumns(scores)
    return agg.withColumns({
        "accuracy": total([cell(d, d) for d in DIRECTIONS]) / F.col("n"),
        "macro_f1": total([F.col(f"f1_{d}") for d in DIRECTIONS]) / F.lit(3.0),
    })


def tune_thresholds(probs: DataFrame, by: list[str], candidates: list[dict] | None = None) -> DataFrame:
    """Best candidate per group by macro F1, then accuracy, then list order."""
    cands = F.array(*[
        F.struct(F.lit(i).alias("candidate"), *[F.lit(float(c.get(d, 1.0))).alias(f"m_{d}") for d in DIRECTIONS])
        for i, c in enumerate(candidates or THRESHOLD_CANDIDATES)])
    tried = probs.withColumn("_c", F.explode(cands)).select("*", "_c.*").drop("_c")
    adjusted = adjusted_probabilities(tried, {d: F.col(f"m_{d}") for d in DIRECTIONS})
    keys = [*by, "candidate", *[f"m_{d}" for d in DIRECTIONS]]
    scored = evaluate(adjusted.withColumn("prediction", picked_label()), keys)
    order = W.partitionBy(*by).orderBy(
        F.round("macro_f1", 9).desc(), F.round("accuracy", 9).desc(), "candidate")
    return scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def rank_models(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best model per group by (macro F1, accuracy); the heuristic does not compete."""
    rivals = metrics.where(F.col("model") != "heuristic")
    order = [F.round("macro_f1", 9).desc(), F.round("accuracy", 9).desc(), "model"]
    if not by:
        return rivals.orderBy(*order).limit(1)
    w = W.partitionBy(*by).orderBy(*order)
    return rivals.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def best_epsilon(cv_metrics: DataFrame) -> DataFrame:
    """Epsilon whose best model has the highest mean fold macro F1; ties take the smaller."""
    best = rank_models(cv_metrics, by=["epsilon"])
    return best.orderBy(F.round("macro_f1", 9).desc(), "epsilon").limit(1).select(
        "epsilon", F.col("model").alias("best_model"), F.col("macro_f1").alias("best_macro_f1"))


def compare_with_heuristic(metrics: DataFrame) -> DataFrame:
    """Deltas of every model against the heuristic row and the acceptance flag."""
    base = metrics.where(F.col("model") == "heuristic")
    acc, f1 = base.agg(F.first("accuracy")).scalar(), base.agg(F.first("macro_f1")).scalar()
    out = metrics.where(F.col("model") != "heuristic").select(
        "model", (F.col("accuracy") - acc).alias("accuracy_delta"), (F.col("macro_f1") - f1).alias("macro_f1_delta"))
    return out.withColumn("meets_acceptance", (F.col("accuracy_delta") >= 0) | (F.col("macro_f1_delta") >= 0))


def overfit_verdict(metrics: DataFrame) -> DataFrame:
    """Verdict per model from train_f1, test_f1, cv_f1 (null where not computed)."""
    ensemble = F.col("model").isin("soft_voting_ensemble", "stacking_ensemble")
    gap, cv_gap = F.col("test_gap"), F.col("holdout_cv_gap")
    verdict = (
        F.when(gap > 0.15, "likely_overfitting")
        .when(gap > 0.08, "mild_overfitting")
        .when(gap.isNotNull(), "no_significant_overfitting")
        .when(ensemble & (cv_gap > 0.10), "ensemble_unstable_vs_cv")
        .when(ensemble & cv_gap.isNotNull(), "ensemble_stable_vs_cv")
        .when(ensemble, "ensemble_no_cv_compare"))
    stability = F.when(cv_gap > 0.10, "unstable").when(cv_gap.isNotNull(), "stable")
    return metrics.withColumns({
        "test_gap": F.when(~ensemble, F.col("train_f1") - F.col("test_f1")),
        "holdout_cv_gap": F.col("test_f1") - F.col("cv_f1"),
    }).withColumns({"verdict": verdict, "temporal_stability": stability})


def with_kept(importances: DataFrame, drop_fraction: float = 0.25) -> DataFrame:
    """Adds ``kept`` to (feature, importance, position): false for the least important
    share of the features, one at least, unless there is only one. Equal importances
    go in order of position. Features are few."""
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy("importance", "position"))
    n = F.count(F.lit(1)).over(every)
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(drop_fraction)))
    return importances.withColumn("kept", (place > cut) | (n == 1))


def pruning_outcome(comparison: DataFrame, force: bool = False, max_drop: float = 0.0) -> DataFrame:
    """Adds ``accepted`` to (full_f1, pruned_f1): the smaller model may not lose, or only
    ``max_drop`` if forced."""
    lost = F.col("full_f1") - F.col("pruned_f1")
    return comparison.withColumn("accepted", lost <= (max(max_drop, 0.0) if force else 0.0))
