"""Views over the given tables that stand in for posts, embeddings, events and themes,
as DataFrames and as the SQL of the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide.sources.lexicon import Lexicon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Sums differ in the last bits with the order of addition; the nudge keeps exact halves
# from rounding both ways.
NUDGE = 1e-9


def register(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded to six decimals like the SQL's."""
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + NUDGE, 6).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def r6(*exprs: str) -> str:
    """SQL: rounded 'expr AS name' items; a bare name keeps its name."""
    out = []
    for e in exprs:
        expr, _, name = e.rpartition(" AS ")
        out.append(f"round(({expr or name}) + {NUDGE:.9f}::DOUBLE, 6) + 0.0::DOUBLE AS {name}")
    return ", ".join(out)


def with_(*ctes: tuple[str, str] | list, final: str) -> str:
    flat: list[tuple[str, str]] = []
    for c in ctes:
        flat += c if isinstance(c, list) else [c]
    seen, parts = set(), []
    for name, sql in flat:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS ({sql})")
    head = "WITH RECURSIVE " if any("RECURSIVE_STEP" in sql for _, sql in flat) else "WITH "
    return head + ",\n".join(parts) + "\n" + final


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table. When it comes in fewer files than there are cores, its rows
    are spread first; a large table is in many files already and is not moved."""
    d = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores, "doc_id") if len(d.inputFiles()) < cores else d


# --- posts from orders ----------------------------------------------------------

NATION_TOPICS = [(24, 24, -1), (0, 0, 0), (1, 2, 1), (3, 6, 2), (7, 14, 3), (15, 23, 4)]


def _orders(spark, sf, cluster) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    prio = F.col("o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("author"), F.col("o_totalprice").alias("likes"),
        F.col("c_acctbal").alias("reach"), (F.col("o_orderkey") % 11).cast("double").alias("shares"),
        cluster.alias("cluster"), F.concat(F.lit("topic_"), cluster).alias("cluster_label"),
        F.when(prio == "1-URGENT", "Negative").when(prio == "5-LOW", "POSITIVE")
        .when(prio == "4-NOT SPECIFIED", None).when(prio == "2-HIGH", "neutral").otherwise("mixed").alias("sentiment"))


def posts_orders(spark, sf) -> DataFrame:
    """Six skewed topics, one of them noise."""
    n = F.col("c_nationkey")
    cluster = None
    for lo, hi, c in NATION_TOPICS:
        hit = n.between(lo, hi)
        cluster = F.when(hit, c) if cluster is None else cluster.when(hit, c)
    return _orders(spark, sf, cluster)


def posts_nation(spark, sf) -> DataFrame:
    """One topic per nation; cluster 0 is not noise, none is."""
    return _orders(spark, sf, F.col("c_nationkey"))


def _orders_sql(cluster: str) -> str:
    return f"""
SELECT o_orderkey AS row_id, o_orderdate AS timestamp, CAST(o_custkey AS VARCHAR) AS author,
       o_totalprice AS likes, c_acctbal AS reach, CAST(o_orderkey % 11 AS DOUBLE) AS shares,
       {cluster} AS cluster, 'topic_' || ({cluster}) AS cluster_label,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Negative' WHEN '5-LOW' THEN 'POSITIVE'
            WHEN '4-NOT SPECIFIED' THEN NULL WHEN '2-HIGH' THEN 'neutral' ELSE 'mixed' END AS sentiment
FROM orders JOIN customer ON o_custkey = c_custkey"""


ORDERS = [("posts", _orders_sql("CASE " + " ".join(
    f"WHEN c_nationkey BETWEEN {lo} AND {hi} THEN {c}" for lo, hi, c in NATION_TOPICS) + " END"))]
NATION = [("posts", _orders_sql("c_nationkey"))]


# --- posts from events ----------------------------------------------------------

def posts_events(spark, sf) -> DataFrame:
    """A month of posts in seven topics; author '0' writes about a fifth of them."""
    e, u = table(spark, sf, "events"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("ts").alias("timestamp"),
        F.when(u % 5 == 0, 0).otherwise(1 + u % 40).cast("string").alias("author"),
        F.col("value").alias("likes"), (u % 7).cast("int").alias("cluster"),
        F.concat(F.lit("topic_"), u % 7).alias("cluster_label"), F.col("event_type").alias("text"))


EVENTS = [("posts", """
SELECT event_id AS row_id, ts AS timestamp,
       CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 + user_id % 40 END AS VARCHAR) AS author,
       value AS likes, CAST(user_id % 7 AS INTEGER) AS cluster, 'topic_' || (user_id % 7) AS cluster_label,
       event_type AS text
FROM events""")]


# --- posts from documents -------------------------------------------------------

def posts_docs(spark, sf) -> DataFrame:
    """Whole texts in twelve topics over 18 months; topic 11 is noise. Author is null for
    one source."""
    d, i = texts(spark, sf), F.col("doc_id")
    topic = F.when(i % 12 == 11, -1).otherwise(i % 12).cast("int")
    return d.select(
        i.alias("row_id"), "text", F.when(F.col("source") != "src3", F.col("lang")).alias("author"),
        ((i * 31) % 97).cast("double").alias("likes"), topic.alias("cluster"),
        F.concat(F.lit("topic_"), topic).alias("cluster_label"),
        F.date_add(F.lit("2023-01-01").cast("date"), ((i * 37) % 540).cast("int")).cast("timestamp_ntz").alias("timestamp"))


DOCS = [("posts", """
SELECT doc_id AS row_id, text, CASE WHEN source <> 'src3' THEN lang END AS author,
       CAST((doc_id * 31) % 97 AS DOUBLE) AS likes,
       CAST(CASE WHEN doc_id % 12 = 11 THEN -1 ELSE doc_id % 12 END AS INTEGER) AS cluster,
       'topic_' || (CASE WHEN doc_id % 12 = 11 THEN -1 ELSE doc_id % 12 END) AS cluster_label,
       CAST(DATE '2023-01-01' + CAST((doc_id * 37) % 540 AS INTEGER) AS TIMESTAMP) AS timestamp
FROM documents""")]


def event_texts(spark, sf) -> DataFrame:
    """Every document as an incoming event."""
    return texts(spark, sf).select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("event_text"))


EVENT_TEXTS = [("event_texts", "SELECT doc_id AS event_id, text AS event_text FROM documents")]


# --- embeddings -----------------------------------------------------------------

def embeddings_planted(spark, sf) -> DataFrame:
    """Vectors with 3 added to the component of their label: ten clear clusters."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "label", F.transform(
        "embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 3.0).otherwise(0.0)).alias("embedding"))


PLANTED = [("points", """
SELECT vec_id AS row_id, label, list_transform(embedding, lambda x, i:
       CAST(x AS DOUBLE) + CASE WHEN i - 1 = label THEN 3.0 ELSE 0.0 END) AS embedding
FROM embeddings""")]


# --- themes ---------------------------------------------------------------------

LEXICON = Lexicon((
    {"id": 0, "name": "Alpha", "description": "", "keywords": ["Thor", "inti"], "synonyms": ["ntble"],
     "phrases": ["eriner thanea"]},
    {"id": 1, "name": "Beta", "description": "", "keywords": ["ther", "tion"], "synonyms": [],
     "phrases": ["attion thanedble", "the attion"]},
    {"id": 2, "name": "Gamma", "description": "", "keywords": ["thre", "thhein", "of"], "synonyms": ["thre ther"],
     "phrases": []},
    {"id": 3, "name": "Delta", "description": "", "keywords": ["thnt", "thst"], "synonyms": ["ther"],
     "phrases": ["aux queaux"]},
    {"id": 4, "name": "Anea Eriner", "description": "named by its own terms", "keywords": [], "synonyms": [],
     "phrases": []},
    {"id": 5, "name": "Zeta", "description": "never used", "keywords": ["zzunknown"], "synonyms": [],
     "phrases": ["qqmissing word"]},
))
PER_THEME = {"1": 0.05, "3": 0.02}
EVENT_THRESHOLDS = {"1": 6.0, "3": 2.5}


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def raw_terms_sql() -> str:
    rows = [(t["id"], x.lower()) for t in LEXICON.themes for x in Lexicon._raw(t)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in rows) + ") v(theme_id, raw)"


def names_sql() -> str:
    rows = ", ".join(f"({t['id']}, '{t['name']}', {i})" for i, t in enumerate(LEXICON.themes))
    return f"SELECT * FROM (VALUES {rows}) v(theme_id, theme_name, theme_order)"


def tokens_sql(text: str, stop_words, pattern: str = "[a-z0-9]+") -> str:
    # The stop list is a hashed look-up there, a list here.
    return (f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{pattern}'), "
            f"lambda t: NOT list_contains({sql_list(stop_words)}, t))")
