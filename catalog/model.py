"""Features, splits, metrics and training: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.temporal import NATION_STATS, nation_stats
from catalog.themes import SCORES, activations, doc_stats, theme_map, theme_scores
from catalog.views import EVENT_THRESHOLDS, LEXICON, PER_THEME, event_texts, r6, register, with_
from topictide.operators import evaluation as V
from topictide.operators import features as X
from topictide.operators import themes as H
from topictide.operators import trees as forests
from topictide.operators.profiles import cluster_profiles
from topictide.plans import forecast, training
from topictide.runtime import materialize, scratch_path

# --- features -----------------------------------------------------------------------

_W = "(PARTITION BY s.cluster ORDER BY s.time_window)"
_LAGS = ", ".join(f"coalesce(lag({c}, {k}) OVER w, 0.0) AS {c}_lag{k}" for c in X.LAGGED for k in range(1, 5))


def clean(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END"


def features_sql(stats: list, wide: str | None = None) -> list:
    """CTEs ending in ``feats`` (sanitised); ``wide`` names a CTE with theme columns."""
    ids = LEXICON.ids if wide else []
    theme = "".join(f", coalesce(t.theme_{i}_score, 0.0) AS theme_{i}_score" for i in ids)
    join = f"LEFT JOIN {wide} t ON t.cluster = s.cluster AND t.time_window = s.time_window" if wide else ""
    arr = "[" + ", ".join(f"theme_{i}_score" for i in ids) + "]"
    share = "(x / list_sum(ts))"
    summary = (f"""CAST(len(list_filter(ts, lambda x: x > 0)) AS DOUBLE) AS theme_active_count, list_sort(ts, 'DESC')[1] AS theme_top1_score,
        list_sort(ts, 'DESC')[2] AS theme_top2_score, CASE WHEN list_sum(ts) > 0 THEN
        list_sum(list_transform(ts, lambda x: -{share} * ln({share} + 1e-12))) ELSE 0.0 END AS theme_entropy""" if wide else
        "0.0::DOUBLE AS theme_active_count, 0.0::DOUBLE AS theme_top1_score, 0.0::DOUBLE AS theme_top2_score, 0.0::DOUBLE AS theme_entropy")
    cols = [*[f"theme_{i}_score" for i in sorted(ids)], *X.BASE_FEATURES, *[f"{c}_lag{k}" for c in X.LAGGED for k in range(1, 5)]]
    return [
        *stats,
        ("base", f"""SELECT s.*, CAST(post_count AS DOUBLE) AS n, row_number() OVER w AS idx, {_LAGS}, lead(volume_pct_change) OVER w AS nxt{theme}
            FROM stats s {join} WINDOW w AS {_W}"""),
        ("rolled", """SELECT *, avg(n) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_post_mean_3,
            avg(n) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_post_mean_6,
            CASE WHEN idx = 1 THEN 0.0 ELSE regr_slope(n, idx) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS trend_slope_4
            FROM base WINDOW w AS (PARTITION BY cluster ORDER BY time_window)"""),
        ("arrayed", f"SELECT *, {arr if wide else '[0.0]'} AS ts FROM rolled"),
        ("themed", f"SELECT *, {summary} FROM arrayed"),
        ("crossed", """SELECT *, volume_lead * volume_volatility AS volume_lead_x_volatility, volume_pct_change_lag1 - volume_pct_change_lag2 AS volume_acceleration,
            volume_lead_lag1 - volume_lead_lag2 AS volume_lead_acceleration,
            coalesce(theme_entropy - lag(theme_entropy) OVER (PARTITION BY cluster ORDER BY time_window), 0.0) AS theme_entropy_change FROM themed"""),
        ("feats", "SELECT cluster, time_window, post_count, volume_pct_change, CASE WHEN isinf(nxt) THEN NULL ELSE nxt END AS next_volume_pct_change, "
                  + ", ".join(f"{clean(c)} AS {c}" for c in cols) + " FROM crossed"),
    ]


def target_sql(eps: float) -> str:
    return (f"CASE WHEN next_volume_pct_change > {eps} THEN 'up' WHEN next_volume_pct_change < -{eps} THEN 'down' ELSE 'flat' END")


FEATS = features_sql(NATION_STATS)
FRAME = [*FEATS, ("frame", f"SELECT *, {target_sql(0.05)} AS target FROM feats WHERE next_volume_pct_change IS NOT NULL")]


def feats(spark, sf):
    return X.feature_frame(nation_stats(spark, sf))


def frame(spark, sf, eps: float = 0.05):
    return X.with_target(feats(spark, sf), eps)


def _columns(name: str, *cols: str):
    @register(name, with_(FEATS, final=f"SELECT cluster, time_window, {r6(*cols)} FROM feats"))
    def _q(spark, sf):
        return feats(spark, sf).select("cluster", "time_window", *cols)


_columns("F01_lag_features", *[f"{c}_lag{k}" for c in X.LAGGED for k in range(1, 5)])
_columns("F03_rolling_means", "rolling_post_mean_3", "rolling_post_mean_6")
_columns("F04_trend_slope", "trend_slope_4")
_columns("F07_interactions", "volume_lead_x_volatility", "volume_acceleration", "volume_lead_acceleration")
_columns("F09_sanitised_features", "volume_lead", "volume_volatility", "market_share", "anomaly_score")


@register("F02_anomaly_fallback", with_(NATION_STATS, final=f"SELECT cluster, time_window, {r6('anomaly_score')} FROM stats"))
def _fallback(spark, sf):
    return X.anomaly_fallback(nation_stats(spark, sf).drop("anomaly_score")).select("cluster", "time_window", "anomaly_score")


WIDE = [("wide", "SELECT cluster, time_window, " + ", ".join(
    f"max(CASE WHEN theme_id = {i} THEN score END) AS theme_{i}_score" for i in LEXICON.ids) + " FROM scores GROUP BY 1, 2")]
DOC_FEATS = features_sql([*SCORES, *WIDE], "wide")


def doc_feats(spark, sf):
    return X.feature_frame(doc_stats(spark, sf), H.wide(activations(spark, sf), LEXICON))


for _name, _cols in (("F05_joined_theme_scores", [f"theme_{i}_score" for i in LEXICON.ids]),
                     ("F06_theme_summary", ["theme_active_count", "theme_top1_score", "theme_top2_score", "theme_entropy"]),
                     ("F08_theme_entropy_change", ["theme_entropy_change"])):
    @register(_name, with_(DOC_FEATS, final=f"SELECT cluster, time_window, {r6(*_cols)} FROM feats"))
    def _themed(spark, sf, cols=tuple(_cols)):
        return doc_feats(spark, sf).select("cluster", "time_window", *cols)


FEATURES_OUT = [*X.BASE_FEATURES, *[f"{c}_lag{k}" for c in X.LAGGED for k in range(1, 5)]]


@register("F10_training_frame", with_(FRAME, final=f"""
SELECT cluster, time_window, target, {r6('next_volume_pct_change', *FEATURES_OUT)} FROM frame"""))
def _frame(spark, sf):
    return X.training_frame(nation_stats(spark, sf), None, 0.05).select(
        "cluster", "time_window", "target", "next_volume_pct_change", *FEATURES_OUT)


@register("F11_direction_labels", with_(FEATS, final=" UNION ALL ".join(f"""
SELECT {e}::DOUBLE AS epsilon, {target_sql(e)} AS target, CAST(count(*) AS BIGINT) AS n FROM feats WHERE next_volume_pct_change IS NOT NULL GROUP BY 1, 2"""
    for e in (0.03, 0.05, 0.08))))
def _labels(spark, sf):
    base, out = feats(spark, sf), None
    for e in (0.03, 0.05, 0.08):
        part = X.with_target(base, e).groupBy(F.lit(e).alias("epsilon"), "target").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


HEUR = """CASE WHEN 0.7 * volume_pct_change + 0.3 * (volume_lead / greatest(post_count, 1)) > 0.05 THEN 'up'
WHEN 0.7 * volume_pct_change + 0.3 * (volume_lead / greatest(post_count, 1)) < -0.05 THEN 'down' ELSE 'flat' END"""


@register("F12_heuristic_baseline", with_(FRAME, final=f"SELECT cluster, time_window, target, {HEUR} AS prediction FROM frame"))
def _heuristic(spark, sf):
    return frame(spark, sf).select("cluster", "time_window", "target", X.heuristic_direction(0.05).alias("prediction"))


# --- splits -------------------------------------------------------------------------

TIMES = [("times", "SELECT list(DISTINCT time_window ORDER BY time_window) AS ts FROM frame")]
SPLIT = [*FRAME, *TIMES,
         ("cut", "SELECT ts[greatest(1, least(len(ts) - 1, CAST(floor(len(ts) * (1.0 - 0.2)) AS INTEGER)))] AS cutoff FROM times"),
         ("split_frame", "SELECT f.*, cutoff, CASE WHEN time_window <= cutoff THEN 'train' ELSE 'test' END AS split FROM frame f, cut")]


@register("M01_holdout_split", with_(SPLIT, final="SELECT cluster, time_window, cutoff, split FROM split_frame"))
def _split(spark, sf):
    return V.holdout_split(frame(spark, sf)).select("cluster", "time_window", "cutoff", "split")


def folds_sql(k: int, train_end: str, step: str, gap: int = 1) -> str:
    return f"""WITH b AS (SELECT ts, len(ts) AS n, unnest(range(0, {k})) AS fold FROM times),
f AS (SELECT *, {step} AS step FROM b), g AS (SELECT *, {train_end} AS train_end FROM f),
p AS (SELECT fold, step, train_end, unnest(range(0, n)) AS pos, n, ts FROM g WHERE train_end + {gap} < n)
SELECT CAST(fold AS INTEGER) AS fold, ts[pos + 1] AS time_window, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role FROM p
WHERE pos < train_end OR (pos >= train_end + {gap} AND pos < train_end + {gap} + step)"""


@register("M02_walk_forward_folds", with_(FRAME, TIMES, [
    ("folds", folds_sql(5, "6 + fold * (step + 1)", "greatest(1, (n - 6) // 5)"))], final="SELECT * FROM folds"))
def _folds(spark, sf):
    return V.walk_forward_folds(frame(spark, sf), 5, 6, 1)


@register("M13_stacking_folds", with_(FRAME, TIMES, [
    ("folds", folds_sql(3, "step * (fold + 1)", "greatest(1, n // 4)"))], final="SELECT * FROM folds"))
def _stack_folds(spark, sf):
    return V.stacking_folds(frame(spark, sf))


# --- probabilities and metrics over two rule-based members ------------------------------

def member_probs(df):
    """Two rule-based members; their probabilities follow volume_lead and reversion."""
    keys = ["cluster", "time_window", "target", *[c for c in ("split", "epsilon") if c in df.columns]]
    s = F.col("volume_lead") / (F.col("post_count") + 1)
    g = F.greatest(F.least(F.col("volume_pct_change"), F.lit(1.0)), F.lit(-1.0))
    zero = F.lit(0.0)
    parts = []
    for name, down, flat, up in (
        ("trend", 1 + F.greatest(-s, zero) * 4, F.lit(1.2), 1 + F.greatest(s, zero) * 4),
        ("revert", 1 + F.greatest(g, zero) * 3, F.lit(1.0), 1 + F.greatest(-g, zero) * 3),
    ):
        size = down + flat + up
        parts.append(df.select(*keys, F.lit(name).alias("model"), (down / size).alias("p_down"),
                               (flat / size).alias("p_flat"), (up / size).alias("p_up")))
    return parts[0].unionByName(parts[1])


def members_sql(source: str, extra: str = "") -> list:
    return [("raw_members", f"""SELECT cluster, time_window, target{extra}, 'trend' AS model, 1 + greatest(-volume_lead / (post_count + 1), 0) * 4 AS d, 1.2::DOUBLE AS f,
            1 + greatest(volume_lead / (post_count + 1), 0) * 4 AS u FROM {source}
        UNION ALL SELECT cluster, time_window, target{extra}, 'revert', 1 + greatest(greatest(least(volume_pct_change, 1.0), -1.0), 0) * 3, 1.0::DOUBLE,
            1 + greatest(-greatest(least(volume_pct_change, 1.0), -1.0), 0) * 3 FROM {source}"""),
            ("probs", f"""SELECT cluster, time_window, target{extra}, model, d / (d + f + u) AS p_down, f / (d + f + u) AS p_flat, u / (d + f + u) AS p_up FROM raw_members""")]


PICK = "CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 'down' WHEN p_flat >= p_up THEN 'flat' ELSE 'up' END"


def adjusted_sql(source: str, d: str, f: str, u: str, cols: str) -> str:
    t = f"(p_down * {d} + p_flat * {f} + p_up * {u})"
    return f"SELECT {cols}, p_down * {d} / {t} AS p_down, p_flat * {f} / {t} AS p_flat, p_up * {u} / {t} AS p_up FROM {source}"


def metrics_sql(source: str, keys: str) -> str:
    D = V.DIRECTIONS
    cm = ", ".join(f"CAST(sum(CASE WHEN target = '{a}' AND prediction = '{b}' THEN 1 ELSE 0 END) AS BIGINT) AS cm_{a}_{b}" for a in D for b in D)
    said = lambda d: "(" + " + ".join(f"cm_{a}_{d}" for a in D) + ")"
    was = lambda d: "(" + " + ".join(f"cm_{d}_{b}" for b in D) + ")"
    ratio = lambda x, y: f"CASE WHEN {y} > 0 THEN CAST({x} AS DOUBLE) / {y} ELSE 0.0 END"
    per = ", ".join(f"{ratio(f'cm_{d}_{d}', said(d))} AS precision_{d}, {ratio(f'cm_{d}_{d}', was(d))} AS recall_{d}, "
                    f"{ratio(f'2.0 * cm_{d}_{d}', f'({said(d)} + {was(d)})')} AS f1_{d}" for d in D)
    return (f"SELECT *, CAST(cm_down_down + cm_flat_flat + cm_up_up AS DOUBLE) / n AS accuracy, (f1_down + f1_flat + f1_up) / 3.0 AS macro_f1 FROM ("
            f"SELECT *, {per} FROM (SELECT {keys}, CAST(count(*) AS BIGINT) AS n, {cm} FROM {source} GROUP BY {keys}))")


METRIC_OUT = ", ".join(["n", *[f"cm_{a}_{b}" for a in V.DIRECTIONS for b in V.DIRECTIONS]]) + ", " + r6(
    "accuracy", "macro_f1", *[f"{m}_{d}" for m in ("precision", "recall", "f1") for d in V.DIRECTIONS])
PROBS = [*FRAME, *members_sql("frame")]
MULT = {"down": 1.1, "flat": 1.0, "up": 0.9}
ADJ = [*PROBS, ("adjusted", adjusted_sql("probs", "1.1", "1.0", "0.9", "cluster, time_window, target, model")),
       ("picked", f"SELECT *, {PICK} AS prediction FROM adjusted")]


def probs(spark, sf):
    return member_probs(frame(spark, sf))


def picked(df, mult=None):
    return V.adjusted_probabilities(df, mult).withColumn("prediction", V.picked_label())


@register("M07_adjusted_probabilities", with_(ADJ, final=f"SELECT cluster, time_window, model, prediction, {r6('p_down', 'p_flat', 'p_up')} FROM picked"))
def _adjusted(spark, sf):
    return picked(probs(spark, sf), MULT).select("cluster", "time_window", "model", "prediction", *V.PROBS)


@register("M08_confidence", with_(PROBS, final=f"""
SELECT cluster, time_window, model, {r6("list_sort([p_down, p_flat, p_up], 'DESC')[1] - list_sort([p_down, p_flat, p_up], 'DESC')[2] AS confidence")} FROM probs"""))
def _confidence(spark, sf):
    return probs(spark, sf).select("cluster", "time_window", "model", V.confidence().alias("confidence"))


@register("M10_metrics", with_(ADJ, [("m", metrics_sql("picked", "model"))], final=f"SELECT model, {METRIC_OUT} FROM m"))
def _metrics(spark, sf):
    return V.evaluate(picked(probs(spark, sf), MULT), ["model"])


CANDS = ", ".join(f"({i}, {c['down']}, {c['flat']}, {c['up']})" for i, c in enumerate(V.THRESHOLD_CANDIDATES))


@register("M11_tuned_thresholds", with_(PROBS, [
    ("cands", f"SELECT * FROM (VALUES {CANDS}) v(candidate, m_down, m_flat, m_up)"),
    ("tried", "SELECT * FROM probs, cands"),
    ("adj", adjusted_sql("tried", "m_down", "m_flat", "m_up", "cluster, time_window, target, model, candidate, m_down, m_flat, m_up")),
    ("pk", f"SELECT *, {PICK} AS prediction FROM adj"),
    ("m", metrics_sql("pk", "model, candidate, m_down, m_flat, m_up")),
    ("bestm", "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, candidate) = 1")],
    final=f"SELECT model, candidate, {r6('CAST(m_down AS DOUBLE) AS m_down', 'CAST(m_flat AS DOUBLE) AS m_flat', 'CAST(m_up AS DOUBLE) AS m_up', 'accuracy', 'macro_f1')} FROM bestm"))
def _tuned(spark, sf):
    return V.tune_thresholds(probs(spark, sf), ["model"]).select(
        "model", "candidate", "m_down", "m_flat", "m_up", "accuracy", "macro_f1")


VOTE = [*PROBS, ("vote", "SELECT cluster, time_window, target, avg(p_down) AS p_down, avg(p_flat) AS p_flat, avg(p_up) AS p_up FROM probs GROUP BY 1, 2, 3")]


@register("M12_soft_vote", with_(VOTE, final=f"SELECT cluster, time_window, target, {r6('p_down', 'p_flat', 'p_up')} FROM vote"))
def _vote(spark, sf):
    return V.soft_vote(probs(spark, sf), ["cluster", "time_window", "target"])


EPS = (0.03, 0.05, 0.08)
EPS_METRICS = [*FEATS, ("eps_frame", " UNION ALL ".join(
    f"SELECT *, {e}::DOUBLE AS epsilon, {target_sql(e)} AS target FROM feats WHERE next_volume_pct_change IS NOT NULL" for e in EPS)),
    *members_sql("eps_frame", ", epsilon"), ("pk", f"SELECT *, {PICK} AS prediction FROM probs"), ("cv", metrics_sql("pk", "epsilon, model"))]


def cv_metrics(spark, sf):
    base, out = feats(spark, sf), None
    for e in EPS:
        part = X.with_target(base, e).withColumn("epsilon", F.lit(e))
        out = part if out is None else out.unionByName(part)
    return V.evaluate(picked(member_probs(out)), ["epsilon", "model"])


@register("M15_best_epsilon", with_(EPS_METRICS, [
    ("b", "SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY epsilon ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, model) = 1")],
    final=f"SELECT epsilon, model AS best_model, {r6('macro_f1 AS best_macro_f1')} FROM b ORDER BY round(macro_f1, 9) DESC, epsilon LIMIT 1"))
def _epsilon(spark, sf):
    return V.best_epsilon(cv_metrics(spark, sf))


ALL_METRICS = [*PROBS, ("all_preds", f"""SELECT target, model, {PICK} AS prediction FROM probs
    UNION ALL SELECT target, 'heuristic' AS model, {HEUR} AS prediction FROM frame"""), ("m", metrics_sql("all_preds", "model"))]


def all_metrics(spark, sf):
    f = frame(spark, sf)
    rows = picked(member_probs(f)).select("target", "model", "prediction").unionByName(
        f.select("target", F.lit("heuristic").alias("model"), X.heuristic_direction(0.05).alias("prediction")))
    return V.evaluate(rows, ["model"])


@register("M16_best_model", with_(ALL_METRICS, final=f"""
SELECT model, {r6('macro_f1', 'accuracy')} FROM m WHERE model <> 'heuristic' ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, model LIMIT 1"""))
def _best(spark, sf):
    return V.rank_models(all_metrics(spark, sf)).select("model", "macro_f1", "accuracy")


@register("M19_comparison_with_heuristic", with_(ALL_METRICS, [("h", "SELECT accuracy AS a, macro_f1 AS f FROM m WHERE model = 'heuristic'")], final=f"""
SELECT model, {r6('accuracy - a AS accuracy_delta', 'macro_f1 - f AS macro_f1_delta')}, (accuracy >= a OR macro_f1 >= f) AS meets_acceptance
FROM m, h WHERE model <> 'heuristic'"""))
def _comparison(spark, sf):
    return V.compare_with_heuristic(all_metrics(spark, sf))


SPLIT_METRICS = [*SPLIT, *members_sql("split_frame", ", split"),
    ("voted", """SELECT target, split, model, p_down, p_flat, p_up FROM probs UNION ALL
        SELECT target, split, 'soft_voting_ensemble', avg(p_down), avg(p_flat), avg(p_up) FROM probs GROUP BY cluster, time_window, target, split"""),
    ("pk", f"SELECT *, {PICK} AS prediction FROM voted"), ("sm", metrics_sql("pk", "split, model")),
    ("gaps", """SELECT model, CASE WHEN model <> 'soft_voting_ensemble' THEN max(CASE WHEN split = 'train' THEN macro_f1 END) END AS train_f1,
        max(CASE WHEN split = 'test' THEN macro_f1 END) AS test_f1, max(CASE WHEN split = 'train' THEN macro_f1 END) AS cv_f1 FROM sm GROUP BY 1""")]


@register("M18_overfit_verdicts", with_(SPLIT_METRICS, final=f"""
SELECT model, {r6('train_f1', 'test_f1', 'cv_f1', 'CAST(train_f1 - test_f1 AS DOUBLE) AS test_gap', 'test_f1 - cv_f1 AS holdout_cv_gap')},
CASE WHEN train_f1 - test_f1 > 0.15 THEN 'likely_overfitting' WHEN train_f1 - test_f1 > 0.08 THEN 'mild_overfitting'
     WHEN train_f1 IS NOT NULL THEN 'no_significant_overfitting' WHEN test_f1 - cv_f1 > 0.10 THEN 'ensemble_unstable_vs_cv' ELSE 'ensemble_stable_vs_cv' END AS verdict,
CASE WHEN test_f1 - cv_f1 > 0.10 THEN 'unstable' ELSE 'stable' END AS temporal_stability FROM gaps"""))
def _verdicts(spark, sf):
    p = member_probs(V.holdout_split(frame(spark, sf)))
    vote = V.soft_vote(p, ["cluster", "time_window", "target", "split"]).withColumn("model", F.lit("soft_voting_ensemble"))
    m = V.evaluate(picked(p.unionByName(vote.select(*p.columns))), ["split", "model"])
    on = lambda s: F.max(F.when(F.col("split") == s, F.col("macro_f1")))
    gaps = m.groupBy("model").agg(on("train").alias("cv_f1"), on("test").alias("test_f1")).withColumn(
        "train_f1", F.when(F.col("model") != "soft_voting_ensemble", F.col("cv_f1")))
    return V.overfit_verdict(gaps)


# --- trained models: SQL checks what any right model must give ---------------------------

SETTINGS = training.Settings()


def _member(name: str, calibrate: bool):
    def query(spark, sf):
        f = materialize(V.holdout_split(frame(spark, sf)))
        member = training.fit_member(f.where("split = 'train'"), FEATURES_OUT, name, SETTINGS, calibrate)
        return member.predict(f.where("split = 'test'").select("cluster", "time_window", "target", *FEATURES_OUT)).select(
            "cluster", "time_window", "target", *V.PROBS)
    return query


register("M03_logistic_probabilities")(_member("logistic", False))
register("M04_random_forest_probabilities")(_member("random_forest", False))
register("M05_boosted_tree_probabilities")(_member("gradient_boosting", False))
register("M06_calibrated_probabilities")(_member("logistic", True))


# Every test row gets shares of the three classes, whatever the model says.
@register("M09_probability_rows", with_(SPLIT, final="""
SELECT cluster, time_window, target, model, true AS shares FROM split_frame, (SELECT unnest(['random_forest', 'gradient_boosting']) AS model)
WHERE split = 'test'"""))
def _probability_rows(spark, sf):
    f = materialize(V.holdout_split(frame(spark, sf)))
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    fitted = training.in_parallel([lambda m=m: training.fit_member(train, FEATURES_OUT, m, SETTINGS) for m in ("random_forest", "gradient_boosting")],
                                  SETTINGS, spark)
    shares = (F.abs(F.col("p_down") + F.col("p_flat") + F.col("p_up") - 1) < 1e-9) & (F.least(*V.PROBS) >= 0)
    return training.member_rows(fitted, test, SETTINGS).select("cluster", "time_window", "target", "model", shares.alias("shares"))


# A binary tree of at most 80 leaves, each of at least 8 sampled rows.
@register("M04_forest_leaves", "SELECT CAST(unnest(range(300)) AS INTEGER) AS tree, true AS limited, true AS binary")
def _leaves(spark, sf):
    member = training.fit_member(frame(spark, sf), FEATURES_OUT, "random_forest", SETTINGS, False)
    inner, leaf = F.sum(F.col("feature").isNotNull().cast("int")), F.sum(F.col("feature").isNull().cast("int"))
    return forests.table(member.model, spark).groupBy("tree").agg((leaf <= 80).alias("limited"), (leaf == inner + 1).alias("binary"))


WALK = [*FEATS, ("walk", " UNION ALL ".join(f"""
    SELECT {e}::DOUBLE AS epsilon, f.fold, t.* FROM (SELECT *, {target_sql(e)} AS target FROM feats WHERE next_volume_pct_change IS NOT NULL) t
    JOIN folds f ON f.time_window = t.time_window AND f.role = 'test'""" for e in EPS))]
_WALK_FOLDS = [("frame", f"SELECT *, {target_sql(0.05)} AS target FROM feats WHERE next_volume_pct_change IS NOT NULL"), *TIMES,
               ("folds", folds_sql(5, "6 + fold * (step + 1)", "greatest(1, (n - 6) // 5)"))]
_HEUR_AT = HEUR.replace("0.05", "epsilon")


def walked(spark, sf):
    return training.walk_forward_predictions(materialize(feats(spark, sf)), FEATURES_OUT, list(SETTINGS.epsilons), SETTINGS)


# The heuristic's row can be recomputed; every model answers for the same rows.
@register("M14_walk_forward_rows", with_(FEATS, _WALK_FOLDS, WALK[-1:], final=f"""
SELECT epsilon, fold, model, count(*) AS n, sum(CAST(model = 'heuristic' AND target = {_HEUR_AT} AS BIGINT))::BIGINT AS heuristic_hits
FROM walk, (SELECT unnest(['logistic', 'random_forest', 'gradient_boosting', 'soft_voting_ensemble', 'heuristic']) AS model) GROUP BY ALL"""))
def _walk_rows(spark, sf):
    hit = ((F.col("model") == "heuristic") & (F.col("target") == F.col("prediction"))).cast("long")
    return walked(spark, sf).groupBy("epsilon", "fold", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("heuristic_hits"))


def bundle(spark, sf):
    return training.train_direction_model(nation_stats(spark, sf), None, SETTINGS)


@register("M14_walk_forward_metrics")
def _walk(spark, sf):
    return training.walk_forward(materialize(feats(spark, sf)), FEATURES_OUT, list(SETTINGS.epsilons), SETTINGS)


@register("M17_feature_importances")
def _importances(spark, sf):
    f = frame(spark, sf)
    member = training.fit_member(f, FEATURES_OUT, "random_forest", SETTINGS)
    return V.with_kept(training.importances(member, spark)).drop("position")


@register("M20_saved_model_metrics")
def _saved(spark, sf):
    path = scratch_path(spark)
    training.save_bundle(bundle(spark, sf), path, spark)
    return training.model_metrics(path, spark)


@register("E13_trained_forecast")
def _trained(spark, sf):
    stats = materialize(doc_stats(spark, sf))
    scores = materialize(theme_scores(spark, sf, stats))  # of the model and of the map
    wide = materialize(H.wide(H.activate(scores, LEXICON, PER_THEME), LEXICON))
    model = training.train_direction_model(stats, wide, SETTINGS)
    return forecast.trained_forecast(
        event_texts(spark, sf), LEXICON, cluster_profiles(stats), stats, model, theme_map(spark, sf, stats, scores),
        per_theme=EVENT_THRESHOLDS).select("event_id", "predicted_direction", "method", "confidence", "risk_band", "model_name")
