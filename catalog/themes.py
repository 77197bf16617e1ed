"""Labels, text normalisation, documents, TF-IDF and theme activation: queries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.temporal import keyed_sql, stats_sql
from catalog.views import (
    DOCS, LEXICON, ORDERS, PER_THEME, names_sql, posts_docs, posts_orders, r6, raw_terms_sql, register, table,
    tokens_sql, with_)
from topictide.functions import text as X
from topictide.operators import labels as L
from topictide.operators import temporal as T
from topictide.operators import themes as H
from topictide.operators import topic_merge as M
from topictide.runtime import materialize

# --- labels -----------------------------------------------------------------------

VOWELS = "length(regexp_replace({t}, '[^aeiou]', '', 'g'))"
LETTERS = r"length(regexp_replace({t}, '[^\p{{L}}]', '', 'g'))"


def noise_sql(t: str) -> str:
    v, a = VOWELS.format(t=t), LETTERS.format(t=t)
    return (f"({t} IN ('http', 'https', 'ftp', 'www') OR regexp_matches({t}, '^\\p{{Nd}}+$') OR (length({t}) >= 8 AND ("
            f"regexp_matches({t}, '^[0-9a-f]{{8,}}$') OR regexp_matches({t}, '^\\p{{Nd}}[a-z0-9]{{7,}}$') OR "
            rf"(regexp_matches({t}, '\p{{Nd}}') AND regexp_matches({t}, '\p{{L}}')) OR "
            f"coalesce(CAST({v} AS DOUBLE) / nullif({a}, 0) < 0.30, false))))")


TOPIC_TERMS = [
    *DOCS,
    ("topics", "SELECT * FROM posts WHERE cluster <> -1"),
    ("tf", f"""SELECT row_id, cluster, term, count(*) AS tf FROM (SELECT row_id, cluster,
        unnest({tokens_sql('text', X.ENGLISH_STOP_WORDS, X.WORD_PATTERN)}) AS term FROM topics) GROUP BY 1, 2, 3"""),
    ("sizes", "SELECT cluster, count(*) AS n_docs FROM topics GROUP BY 1"),
    ("vocab", """SELECT cluster, term, n_docs, ln((n_docs + 1.0) / (df + 1.0)) + 1.0 AS idf FROM (
        SELECT t.cluster, term, n_docs, count(*) AS df, sum(tf) AS total FROM tf t JOIN sizes s ON t.cluster = s.cluster GROUP BY 1, 2, 3)
        WHERE df >= 2 AND df <= n_docs * 0.9
        QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY total DESC, term) <= 100"""),
    ("weighted", """SELECT t.row_id, t.cluster, t.term, n_docs, tf * idf AS w FROM tf t JOIN vocab v ON t.cluster = v.cluster AND t.term = v.term"""),
    ("unit", "SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS u FROM weighted"),
    ("weights", "SELECT cluster, term, sum(u) / any_value(n_docs) AS weight FROM unit GROUP BY 1, 2"),
    ("top", """SELECT cluster, list(term ORDER BY rn) AS terms FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) AS rn FROM weights) WHERE rn <= 3 GROUP BY 1"""),
]


@register("C06_topic_term_weights", with_(TOPIC_TERMS, final=f"SELECT cluster, term, {r6('weight')} FROM weights"))
def _weights(spark, sf):
    return L.cluster_term_weights(posts_docs(spark, sf))


@register("C06_topic_labels", with_(TOPIC_TERMS, final=f"""
SELECT c.cluster, CASE WHEN c.cluster = -1 THEN 'Uncategorized/Noise' WHEN terms IS NULL THEN 'Cluster ' || c.cluster
  WHEN len(list_filter(terms, lambda t: NOT {noise_sql('t')})) = 0 THEN 'unlabelled'
  ELSE array_to_string(list_filter(terms, lambda t: NOT {noise_sql('t')})[1:3], ', ') END AS cluster_label
FROM (SELECT DISTINCT cluster FROM posts) c LEFT JOIN top ON c.cluster = top.cluster"""))
def _labels(spark, sf):
    return L.cluster_labels(posts_docs(spark, sf))


# Twelve topics, three of each language: those of a language say the same.
CLASS_VOCABULARY = 400
CLASS_POSTS = [("class_posts", "SELECT doc_id AS row_id, text, CAST(list_position(['de', 'en', 'es', 'fr'], lang) * 3 + doc_id % 3 AS INTEGER) AS cluster FROM documents")]


def class_weights_sql(posts: str, name: str) -> list:
    """CTEs that end in ``name``: unit vectors of the topics of ``posts``."""
    return [
        (f"{name}_tf", f"""SELECT cluster, term, count(*) AS tf FROM (SELECT cluster, unnest({tokens_sql('text', X.ENGLISH_STOP_WORDS, X.WORD_PATTERN)}) AS term
            FROM {posts}) GROUP BY 1, 2"""),
        (f"{name}_terms", f"SELECT term, sum(tf) AS total FROM {name}_tf GROUP BY 1 ORDER BY total DESC, term LIMIT {CLASS_VOCABULARY}"),
        (f"{name}_words", f"SELECT cluster, sum(tf) AS words FROM {name}_tf JOIN {name}_terms USING (term) GROUP BY 1"),
        (f"{name}_raw", f"""SELECT cluster, term, tf::DOUBLE / words * ln(1.0 + (SELECT avg(words) FROM {name}_words) / total) AS w
            FROM {name}_tf JOIN {name}_terms USING (term) JOIN {name}_words USING (cluster)"""),
        (name, f"SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS weight FROM {name}_raw")]


MERGED = [
    *CLASS_POSTS, *class_weights_sql("class_posts", "cw"),
    ("alike", "SELECT a.cluster AS a, b.cluster AS b FROM cw a JOIN cw b USING (term) GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.85 OR a.cluster = b.cluster"),
    ("reach(cluster, topic)", "/* RECURSIVE_STEP */ SELECT a, b FROM alike UNION SELECT r.cluster, alike.b FROM reach r JOIN alike ON alike.a = r.topic"),
    ("merged", "SELECT cluster, min(topic) AS topic FROM reach GROUP BY 1"),
    ("merged_posts", "SELECT p.row_id, p.text, m.topic AS cluster FROM class_posts p JOIN merged m USING (cluster)"),
    *class_weights_sql("merged_posts", "mw")]


def class_posts(spark, sf):
    lang = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", (lang * 3 + F.col("doc_id") % 3).cast("int").alias("cluster"))


def class_weights(posts):
    return materialize(M.class_weights(M.topic_term_counts(posts), CLASS_VOCABULARY))


def merged_posts(spark, sf):
    posts = class_posts(spark, sf)
    names = M.merged_topics(class_weights(posts))
    return posts.join(names, "cluster").select("row_id", "text", F.col("topic").alias("cluster"))


@register("C10_class_weights", with_(CLASS_POSTS, class_weights_sql("class_posts", "cw"), final=f"SELECT cluster, term, {r6('weight')} FROM cw"))
def _class_weights(spark, sf):
    return class_weights(class_posts(spark, sf))


@register("C10_merged_topics", with_(MERGED, final="SELECT cluster, topic FROM merged"))
def _merged(spark, sf):
    return M.merged_topics(class_weights(class_posts(spark, sf)))


@register("C10_topic_terms", with_(MERGED, final=f"""SELECT cluster, term, CAST(position AS INTEGER) AS position, {r6('weight')} FROM (
SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) AS position FROM mw) WHERE position <= 8"""))
def _topic_terms(spark, sf):
    return M.top_terms(class_weights(merged_posts(spark, sf))).select("cluster", "term", "position", "weight")


@register("C10_representative_posts", with_(MERGED, [
    ("post_tf", f"""SELECT row_id, cluster, term, count(*) AS tf FROM (SELECT row_id, cluster, unnest({tokens_sql('text', X.ENGLISH_STOP_WORDS, X.WORD_PATTERN)}) AS term
        FROM merged_posts) GROUP BY ALL"""),
    ("post_like", "SELECT row_id, cluster, sum(tf * weight) / sqrt(sum(tf * tf)) AS similarity FROM post_tf JOIN mw USING (cluster, term) GROUP BY 1, 2")],
    final=f"""SELECT cluster, CAST(position AS INTEGER) AS position, row_id, {r6('similarity')} FROM (
SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(similarity, 9) DESC, row_id) AS position FROM post_like) WHERE position <= 5"""))
def _representatives(spark, sf):
    posts = merged_posts(spark, sf)
    return M.representative_posts(posts, class_weights(posts))


@register("C05_topic_sizes", with_(ORDERS, final=f"""
SELECT cluster, CAST(count(*) AS BIGINT) AS cluster_size, {r6('count(*) / (SELECT count(*) FROM posts)::DOUBLE AS share')} FROM posts GROUP BY 1"""))
def _sizes(spark, sf):
    return L.cluster_sizes(posts_orders(spark, sf))


@register("C05_clustering_summary", with_(ORDERS, final=f"""
SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters,
       CAST(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise,
       {r6('avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) AS noise_share')} FROM posts"""))
def _summary(spark, sf):
    return L.clustering_summary(posts_orders(spark, sf))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@register("C07_clean_labels", f"""
WITH d AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS terms FROM documents),
k AS (SELECT doc_id, list_filter(terms, lambda t: NOT {noise_sql('t')}) AS kept FROM d)
SELECT doc_id, CASE WHEN len(kept) = 0 THEN 'unlabelled' ELSE array_to_string(kept[1:3], ', ') END AS label FROM k""")
def _clean(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_sort(F.array_distinct(X.raw_tokens(F.col("text")))).alias("terms"))
    return d.select("doc_id", X.clean_label(F.col("terms")).alias("label"))


@register("C08_noise_tokens", f"""
WITH t AS (SELECT DISTINCT unnest({_TOK}) AS token FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages))
SELECT token, {noise_sql('token')} AS is_noise FROM t""")
def _noise(spark, sf):
    texts = table(spark, sf, "documents").select("text").union(table(spark, sf, "pages").select("html"))
    tokens = texts.select(F.explode(X.raw_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", X.is_noise_token(F.col("token")).alias("is_noise"))


@register("C09_strip_noise_tokens", f"""
WITH d AS (SELECT page_id, regexp_extract_all(lower(html), '[a-z0-9]+') AS toks FROM pages)
SELECT page_id, md5(array_to_string(list_filter(toks, lambda t: NOT {noise_sql('t')}), ' ')) AS stripped_md5 FROM d""")
def _strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_noise_tokens(F.col("html"))).alias("stripped_md5"))


# --- normalisation and documents ----------------------------------------------------

DOC_TOK = tokens_sql("text", X.DOCUMENT_STOP_WORDS)
EVENT_TOK = tokens_sql("text", X.EVENT_STOP_WORDS)


@register("H01_normalized_texts", f"SELECT doc_id, md5(array_to_string({DOC_TOK}, ' ')) AS normalized_md5 FROM documents")
def _normalized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalized(F.col("text"))).alias("normalized_md5"))


@register("H02_stop_lists", f"""
SELECT doc_id, CAST(len({DOC_TOK}) AS INTEGER) AS document_tokens, CAST(len({EVENT_TOK}) AS INTEGER) AS event_tokens FROM documents""")
def _stops(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.size(X.content_tokens(F.col("text"), X.DOCUMENT_STOP_WORDS)).alias("document_tokens"),
        F.size(X.content_tokens(F.col("text"), X.EVENT_STOP_WORDS)).alias("event_tokens"))


def theme_terms_sql(stop_words) -> list:
    return [("raw_terms", raw_terms_sql()),
            ("theme_terms", f"""SELECT DISTINCT theme_id, array_to_string({tokens_sql('raw', stop_words)}, ' ') AS term FROM raw_terms
                WHERE array_to_string({tokens_sql('raw', stop_words)}, ' ') <> ''""")]


@register("H03_theme_term_documents", with_(theme_terms_sql(X.DOCUMENT_STOP_WORDS), [
    ("norm", f"SELECT doc_id, ' ' || array_to_string({DOC_TOK}, ' ') || ' ' AS body FROM documents")], final="""
SELECT theme_id, term, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM theme_terms
LEFT JOIN norm ON contains(body, ' ' || term || ' ') GROUP BY 1, 2"""))
def _term_docs(spark, sf):
    posts = posts_docs(spark, sf)
    tokens = posts.select("row_id", X.content_tokens(F.col("text")).alias("t"))
    grams = tokens.select("row_id", F.explode(F.array_union(F.col("t"), X.bigrams(F.col("t")))).alias("term"))
    hits = grams.join(F.broadcast(LEXICON.terms(spark)), "term").groupBy("theme_id", "term").agg(
        F.countDistinct("row_id").alias("documents"))
    return LEXICON.terms(spark).join(hits, ["theme_id", "term"], "left").select(
        "theme_id", "term", F.coalesce("documents", F.lit(0)).alias("documents"))


PLACED = [("placed", "SELECT *, row_number() OVER (PARTITION BY cluster, time_window ORDER BY row_id) - 1 AS position FROM keyed")]


@register("H04_topic_documents", with_(DOCS, keyed_sql("1M"), PLACED, final="""
SELECT cluster, time_window, position // 3 AS part, md5(string_agg(coalesce(text, ''), ' ' ORDER BY row_id)) AS document_md5,
       CAST(count(*) AS BIGINT) AS source_posts, any_value(cluster_label) AS cluster_label FROM placed GROUP BY 1, 2, 3"""))
def _documents(spark, sf):
    return H.documents(posts_docs(spark, sf), part_rows=3).select(
        "cluster", "time_window", "part", F.md5("document").alias("document_md5"), "source_posts", "cluster_label")


DOC_STATS = stats_sql(DOCS, "1M", {"likes": "likes"})
TARGETS = [("targets", "SELECT cluster, time_window, cluster_label FROM stats")]


def doc_stats(spark, sf):
    return T.temporal_stats(posts_docs(spark, sf))


@register("H05_event_targets", with_(DOC_STATS, final=f"""
SELECT cluster, time_window, cluster_label, {r6('anomaly_score')} FROM stats WHERE abs(anomaly_score) > 1.5"""))
def _targets(spark, sf):
    stats = doc_stats(spark, sf)
    return H.resolve_targets("events", stats, T.detect_events(stats, 1.5)).select(
        "cluster", "time_window", "cluster_label", "anomaly_score")


@register("H06_window_targets_fallback", with_(DOCS, keyed_sql("1M"), final="""
SELECT cluster, time_window, any_value(cluster_label) AS cluster_label, CAST(count(*) AS INTEGER) AS post_count FROM keyed GROUP BY 1, 2"""))
def _fallback(spark, sf):
    return H.window_targets(posts_docs(spark, sf))


@register("H07_targets_with_documents", with_(DOC_STATS, TARGETS, PLACED, [
    ("docs", "SELECT cluster, time_window, position // 10000 AS part, string_agg(coalesce(text, ''), ' ' ORDER BY row_id) AS document, count(*) AS n FROM placed GROUP BY 1, 2, 3")],
    final=f"""SELECT t.cluster, t.time_window, t.cluster_label, coalesce(part, 0) AS part, md5(coalesce(document, '')) AS document_md5,
    md5(array_to_string({tokens_sql('document', X.DOCUMENT_STOP_WORDS)}, ' ')) AS normalized_md5,
    CAST(coalesce(n, 0) AS BIGINT) AS source_posts FROM targets t LEFT JOIN docs d ON t.cluster = d.cluster AND t.time_window = d.time_window"""))
def _attached(spark, sf):
    targets = doc_stats(spark, sf).select("cluster", "time_window", "cluster_label")
    parts = H.attach_documents(targets, posts_docs(spark, sf))
    return parts.select("cluster", "time_window", "cluster_label", "part", F.md5("document").alias("document_md5"),
                        F.md5("document_normalized").alias("normalized_md5"), "source_posts")


@register("H08_document_token_counts", with_(DOCS, keyed_sql("1M"), final=f"""
SELECT cluster, time_window, CAST(count(*) AS BIGINT) AS source_posts, CAST(sum(len({DOC_TOK})) AS BIGINT) AS document_token_count
FROM keyed GROUP BY 1, 2"""))
def _token_counts(spark, sf):
    return H.document_sizes(posts_docs(spark, sf))


# --- TF-IDF and activation ------------------------------------------------------------

TFIDF = [
    *DOC_STATS, *TARGETS,
    ("bodies", f"""SELECT cluster, time_window, {tokens_sql("string_agg(coalesce(text, ''), ' ' ORDER BY row_id)", X.DOCUMENT_STOP_WORDS)} AS toks
        FROM keyed GROUP BY 1, 2"""),
    ("grams", """SELECT cluster, time_window, unnest(toks) AS term FROM bodies UNION ALL
        SELECT cluster, time_window, p[1] || ' ' || p[2] AS term FROM (
            SELECT cluster, time_window, unnest(list_zip(toks[1:len(toks) - 1], toks[2:])) AS p FROM bodies WHERE len(toks) > 1)"""),
    ("terms", "SELECT cluster, time_window, term, count(*) AS tf FROM grams GROUP BY 1, 2, 3"),
    ("vocabulary", """SELECT term, df, total, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM (
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, (SELECT count(*) FROM targets) AS n FROM terms GROUP BY 1)
        WHERE df >= 2 AND df <= n * 0.9 ORDER BY total DESC, term LIMIT 50000"""),
    ("raw", "SELECT cluster, time_window, t.term, tf * idf AS w FROM terms t JOIN vocabulary v ON t.term = v.term"),
    ("norms", "SELECT cluster, time_window, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1, 2"),
    ("tfidf", """SELECT r.cluster, r.time_window, term, w / norm AS weight FROM raw r
        JOIN norms n ON r.cluster = n.cluster AND r.time_window = n.time_window"""),
]
_THRESH = "CASE theme_id " + " ".join(f"WHEN {k} THEN {v}" for k, v in PER_THEME.items()) + " ELSE 0.03 END"
SCORES = [
    *TFIDF, *theme_terms_sql(X.DOCUMENT_STOP_WORDS), ("names", names_sql()),
    ("hits", "SELECT cluster, time_window, theme_id, sum(weight) AS score FROM tfidf JOIN theme_terms ON tfidf.term = theme_terms.term GROUP BY 1, 2, 3"),
    ("scores", """SELECT t.cluster, t.time_window, t.cluster_label, n.theme_id, coalesce(h.score, 0.0) AS score FROM targets t CROSS JOIN names n
        LEFT JOIN hits h ON h.cluster = t.cluster AND h.time_window = t.time_window AND h.theme_id = n.theme_id"""),
    ("active", f"SELECT *, CAST({_THRESH} AS DOUBLE) AS threshold, CAST(score >= {_THRESH} AS INTEGER) AS active FROM scores"),
]


def tfidf(spark, sf, stats=None) -> H.Tfidf:
    return H.Tfidf(posts_docs(spark, sf), doc_stats(spark, sf) if stats is None else stats)


@register("H09_vocabulary", with_(TFIDF, final=f"SELECT term, df, total, {r6('idf')} FROM vocabulary"))
def _vocabulary(spark, sf):
    return tfidf(spark, sf).vocabulary


@register("H09_tfidf_weights", with_(TFIDF, final=f"SELECT cluster, time_window, term, {r6('weight')} FROM tfidf"))
def _tfidf(spark, sf):
    return tfidf(spark, sf).weights()


def theme_scores(spark, sf, stats=None):
    return tfidf(spark, sf, stats).theme_scores(LEXICON)


def activations(spark, sf, stats=None):
    return H.activate(theme_scores(spark, sf, stats), LEXICON, PER_THEME)


def labelled_scores(spark, sf, stats=None, scores=None):
    stats = materialize(doc_stats(spark, sf)) if stats is None else stats
    scores = theme_scores(spark, sf, stats) if scores is None else scores
    return scores.join(stats.select("cluster", "time_window", "cluster_label"), ["cluster", "time_window"])


@register("H10_theme_scores", with_(SCORES, final=f"SELECT cluster, time_window, theme_id, {r6('score')} FROM scores"))
def _scores(spark, sf):
    return theme_scores(spark, sf)


@register("H11_activation_flags", with_(SCORES, final=f"""
SELECT cluster, time_window, theme_id, {r6('score', 'threshold')}, active FROM active"""))
def _flags(spark, sf):
    return activations(spark, sf)


@register("H12_wide_activations", with_(SCORES, final="SELECT cluster, time_window, " + ", ".join(
    r6(f"max(CASE WHEN theme_id = {i} THEN score END) AS theme_{i}_score") + f", max(CASE WHEN theme_id = {i} THEN active END) AS theme_{i}"
    for i in LEXICON.ids) + " FROM active GROUP BY 1, 2"))
def _wide(spark, sf):
    return H.wide(activations(spark, sf), LEXICON)


EXPLAINED = f"""
SELECT n.theme_id, coalesce(string_agg(DISTINCT v.term, '|' ORDER BY v.term), '') AS matched_terms,
       CAST(count(DISTINCT v.term) AS INTEGER) AS matched_feature_count, any_value(CAST({_THRESH.replace('theme_id', 'n.theme_id')} AS DOUBLE)) AS threshold
FROM names n LEFT JOIN theme_terms t ON n.theme_id = t.theme_id LEFT JOIN vocabulary v ON t.term = v.term GROUP BY 1"""


@register("H13_activation_explained", with_(SCORES, final=EXPLAINED))
def _explain(spark, sf):
    return H.explain(tfidf(spark, sf), LEXICON, PER_THEME).withColumn("matched_terms", F.array_join("matched_terms", "|"))


@register("H13_activation_explain_json", with_(SCORES, [("explained", EXPLAINED)], final=f"""
SELECT '{{' || string_agg('"theme_' || theme_id || '":' || CAST(to_json({{'matched_terms': CASE WHEN matched_terms = '' THEN [] ELSE string_split(matched_terms, '|') END,
       'matched_feature_count': matched_feature_count, 'threshold': threshold}}) AS VARCHAR), ',' ORDER BY 'theme_' || theme_id) || '}}' AS activation_explain,
       '{H.REASONING.replace(chr(39), chr(39) * 2)}' AS activation_reasoning FROM explained"""))
def _explain_json(spark, sf):
    return H.explain_json(H.explain(tfidf(spark, sf), LEXICON, PER_THEME))


@register("H14_average_active_themes", with_(SCORES, [
    ("per_doc", "SELECT cluster, time_window, sum(active) AS n FROM active GROUP BY 1, 2")],
    final=f"SELECT CAST(count(*) AS BIGINT) AS units, {r6('avg(n) AS avg_active_themes')} FROM per_doc"))
def _average(spark, sf):
    return H.average_active(activations(spark, sf))


THEME_MAP = [
    *SCORES,
    ("means", "SELECT theme_id, cluster, cluster_label, avg(score) AS avg_score FROM scores GROUP BY 1, 2, 3"),
    ("best", """SELECT * FROM means WHERE avg_score > 0
        QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY round(avg_score, 9) DESC, cluster, cluster_label) = 1"""),
    ("theme_map", """SELECT n.theme_id, n.theme_name, b.cluster AS cluster_id, b.cluster_label, coalesce(b.avg_score, 0.0) AS avg_score, n.theme_order
        FROM names n LEFT JOIN best b ON n.theme_id = b.theme_id"""),
    ("theme_names", "SELECT cluster_id AS cluster, arg_max(theme_name, theme_order) AS theme_name FROM theme_map WHERE cluster_id IS NOT NULL GROUP BY 1"),
]


def theme_map(spark, sf, stats=None, scores=None):
    return H.theme_cluster_map(labelled_scores(spark, sf, stats, scores), LEXICON)


@register("H15_theme_topic_map", with_(THEME_MAP, final=f"""
SELECT theme_id, theme_name, cluster_id, cluster_label, {r6('avg_score')} FROM theme_map"""))
def _map(spark, sf):
    return theme_map(spark, sf).drop("theme_order")


@register("H16_unmatched_themes", with_(THEME_MAP, final="""
SELECT theme_id, 'Theme ' || theme_id || ' has no cluster match' AS warning FROM theme_map WHERE cluster_id IS NULL"""))
def _unmatched(spark, sf):
    return H.unmatched_themes(theme_map(spark, sf))


@register("S12_topic_theme_names", with_(THEME_MAP, final="SELECT cluster, theme_name FROM theme_names"))
def _inverse(spark, sf):
    return H.cluster_theme_names(theme_map(spark, sf))
