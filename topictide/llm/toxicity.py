"""Toxicity by non-negative positive-unlabelled learning: a linear classifier is trained from
confirmed toxic and unlabelled texts with a risk estimate corrected by the class prior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import ALNUM_LOWER, MEMO_ENTRIES, WordHashes, map_texts, sample_by_label
from topictide.runtime import materialize

HASH_BITS = 22
PART_BYTES = 6  # length of the parts of words that are features besides whole words


class Features:
    """Hashed features of texts: lower-cased words and, with their
    ends marked, their parts of PART_BYTES bytes.

    A feature's value is log(1 + times it occurs). ``selected`` narrows them to given hashes,
    and their places there stand for them."""

    def __init__(self, selected: np.ndarray | None = None):
        self.selected, self.known = selected, {}
        self.hashes = WordHashes()

    def of_words(self, fresh: list[bytes]) -> None:
        parts, sizes = [], []
        for w in fresh:
            framed = b"^" + w + b"$"
            own = [w, *(framed[i:i + PART_BYTES] for i in range(len(framed) - PART_BYTES + 1))]
            parts += own
            sizes.append(len(own))
        codes = (self.hashes(parts) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        if self.selected is not None:
            at = np.searchsorted(self.selected, codes)
            at[at == len(self.selected)] = 0
            hit = self.selected[at] == codes if len(self.selected) else np.zeros(len(codes), bool)
            codes = np.where(hit, at, -1)
        codes = codes.tolist()
        for w, a, b in zip(fresh, [0, *ends], ends):
            self.known[w] = tuple(c for c in codes[a:b] if c >= 0)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(features, values, number of words) of a text."""
        words = text.translate(ALNUM_LOWER).split() if text else []
        if len(self.known) > MEMO_ENTRIES:
            self.known.clear()
        get = self.known.get
        found = [get(w) for w in words]
        if None in found:
            self.of_words(list({w for w, f in zip(words, found) if f is None}))
            found = [get(w) for w in words]
        codes, n = np.unique(np.array([c for f in found for c in f], np.int64), return_counts=True)
        return codes, np.log1p(n), len(words)


@dataclass
class Model:
    """Weights of the selected features, of the log of the text's words, and a bias."""

    selected: np.ndarray
    weights: np.ndarray
    length_weight: float
    bias: float
    prior: float

    def score(self, codes: np.ndarray, values: np.ndarray, n_words: int) -> float:
        g = self.bias + self.length_weight * np.log1p(n_words) + float(values @ self.weights[codes])
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def prior_only(prior: float) -> Model:
    return Model(np.empty(0, np.int64), np.empty(0), 0.0, float(np.log(prior / (1 - prior))), prior)


def select_features(rows: DataFrame, n_positive: int, n_unlabelled: int, most: int, least_z: float) -> np.ndarray:
    """Of the sampled (_text, _positive) rows, the features whose mean value differs most
    between positive and unlabelled texts, as sums gathered over the executors."""

    def sums(batches):
        size = 2**HASH_BITS
        total, features = np.zeros((4, size), np.float32), Features()
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, values, _ = features(text)
                k = 0 if positive else 2
                total[k, codes] += values
                total[k + 1, codes] += values * values
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some].astype(np.float64)) for t in total)],
                                         ["code", "sp", "sp2", "su", "su2"])

    kinds = "code long, sp double, sp2 double, su double, su2 double"
    mean_p, mean_u = F.col("sp") / n_positive, F.col("su") / n_unlabelled
    spread = F.sqrt((F.col("sp2") / n_positive - mean_p * mean_p) / n_positive + (F.col("su2") / n_unlabelled - mean_u * mean_u) / n_unlabelled + 1e-9)
    rows = (rows.mapInArrow(sums, kinds).groupBy("code").agg(*[F.sum(c).alias(c) for c in ("sp", "sp2", "su", "su2")])
            .where(F.col("sp") + F.col("su") > 3).select("code", F.abs((mean_p - mean_u) / spread).alias("z"))
            .where(F.col("z") >= least_z).orderBy(F.desc("z"), "code").limit(most).collect())
    return np.sort(np.array([r.code for r in rows], np.int64))


class _Sparse:
    """Texts as rows of feature values; the last column is the log of the words."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray, int]], k: int):
        self.n, self.k = len(texts), k + 1
        self.rows = np.repeat(np.arange(self.n), [len(c) + 1 for c, _, _ in texts])
        self.columns = np.concatenate([np.append(c, k) for c, _, _ in texts])
        self.values = np.concatenate([np.append(v, np.log1p(w)) for _, v, w in texts])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns] * self.values, minlength=self.n)

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=v[self.rows] * self.values, minlength=self.k)


def fit(positive: list, unlabelled: list, selected: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03,
        l2: float = 1e-4) -> Model:
    """Minimises prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]) with the
    logistic loss. Where the second part falls below zero, which is overfitting, the step
    goes against it instead."""
    p, u = _Sparse(positive, len(selected)), _Sparse(unlabelled, len(selected))
    w, b = np.zeros(len(selected) + 1), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = p.dot(w) + b, u.dot(w) + b
        sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        toward_p, away_p, away_u = prior * (sp - 1) / p.n, -prior * sp / p.n, su / u.n
        at_p, at_u = (toward_p + away_p, away_u) if negative >= 0 else (-away_p, -away_u)
        g = np.append(p.transposed(at_p) + u.transposed(at_u) + l2 * w, at_p.sum() + at_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(selected, w[:-1], float(w[-1]), float(b), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          positives: int = 6_000, unlabelled: int = 12_000, max_features: int = 2_000, least_z: float = 4.5) -> Model:
    """A model from about ``positives`` confirmed texts and ``unlabelled`` of all texts,
    chosen by a hash of the id. The prior is the share of positives among labelled rows.
    Null labels are no labels; a label 1 outweighs other labels of the same id; without
    positives or texts every score is the prior, 0.5 where nothing is labelled."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label is not null")
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    present = known.join(texts.select("_id").distinct(), "_id", "left_semi")
    counts = {r["_label"]: r["count"] for r in present.groupBy("_label").count().collect()}
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total, 1e-3), 0.999) if total else 0.5
    # A sample of a size that is a parameter; joined by broadcast, so that texts don't move.
    chosen = F.broadcast(sample_by_label(known.where("_label = 1"), "_id", "_label", positives).select("_id"))
    rows = materialize(
        texts.join(chosen, "_id", "left_semi").select("_text", F.lit(True).alias("_positive")).unionAll(
            sample_by_label(texts.withColumn("_all", F.lit(0)), "_id", "_all", unlabelled).select("_text", F.lit(False))))
    n = {r["_positive"]: r["count"] for r in rows.groupBy("_positive").count().collect()}
    if len(n) < 2:
        return prior_only(prior)
    selected = select_features(rows, n[True], n[False], max_features, least_z)

    def make():
        features = Features(selected)

        def run(keys, found):
            got = [features(t) for t in found]
            return {"positive": keys, "codes": [c.astype("<i4").tobytes() for c, _, _ in got],
                    "values": [v.astype("<f4").tobytes() for _, v, _ in got], "n_words": [n for _, _, n in got]}

        return run

    sampled: dict[bool, list] = {True: [], False: []}
    for r in map_texts(rows, "_positive", "_text", "positive boolean, codes binary, values binary, n_words long", make).collect():
        sampled[r.positive].append((np.frombuffer(r.codes, "<i4").astype(np.int64), np.frombuffer(r.values, "<f4").astype(float), r.n_words))
    return fit(sampled[True], sampled[False], selected, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, 0 to 1. Null and empty texts have no words and get
    the score of the bias; repeated rows keep a row each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, features = sent.value, Features(sent.value.selected)
        return lambda keys, texts: {"doc_id": keys, "score": [m.score(*features(t)) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, score double", make).withColumnRenamed("doc_id", id_col)
