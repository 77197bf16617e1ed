"""Language identification of mixed-language text: script ranges narrow the candidates,
words are scored by letter trigrams, and a Viterbi path with a switching penalty labels spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import MEMO_ENTRIES, map_texts, sample_by_label

# Unicode blocks by script, first and last code point.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F),
    ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
# Scripts that are written without blanks between words.
WITHOUT_BLANKS = ("Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Kana", "Han")
UNKNOWN = "und"

_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for name, a, b in SCRIPTS if name in WITHOUT_BLANKS)
UNSPACED, PARTS = re.compile(f"[{_UNSPACED}]"), re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")


def script_of(letter: str) -> str:
    code = ord(letter)
    return next((name for name, a, b in SCRIPTS if a <= code <= b), "Other")


def trigrams(word: str) -> list[str]:
    framed = f"^{word}$"
    return [framed[i:i + 3] for i in range(len(framed) - 2)]


def letters(token: str) -> str:
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def parts(word: str) -> list[str]:
    """What speaks for a language on its own: a word, or in scripts without blanks each letter."""
    return [word] if word.isascii() or not UNSPACED.search(word) else PARTS.findall(word)


@dataclass
class Model:
    """Languages, log-likelihoods of trigrams relative to the languages' mean, and the
    languages each script was seen in."""

    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]
    penalty: float = 12.0
    limit: float = 6.0  # of what one word may say for or against a language
    excluded: float = field(default=-6.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = 4_000, smoothing: float = 0.5, script_share: float = 0.001) -> Model:
    """A model from about ``rows_per_language`` labelled rows of each language. Null texts
    and labels teach nothing; without any, there is no language to predict."""
    rows = sample_by_label(docs.where(F.col(text_col).isNotNull()), id_col, lang_col, rows_per_language)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
        for lang, seen in words.items():
            found: Counter = Counter()
            for token, n in seen.items():
                for part in parts(letters(token)):
                    if part:
                        found["script " + script_of(part[0])] += n
                        for g in trigrams(part):
                            found[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "gram", "n"])

    counted = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counted})
    of = {lang: i for i, lang in enumerate(languages)}
    scripts: dict[str, np.ndarray] = {}
    grams: dict[str, int] = {}
    for r in counted:
        if r.gram.startswith("script "):
            scripts.setdefault(r.gram[7:], np.zeros(len(languages)))[of[r.lang]] += r.n
        else:
            grams.setdefault(r.gram, len(grams))
    n = np.zeros((len(grams), len(languages)))
    for r in counted:
        if not r.gram.startswith("script "):
            n[grams[r.gram], of[r.lang]] = r.n
    log = np.log((n + smoothing) / (n.sum(axis=0) + smoothing * len(grams))) if len(grams) else n
    words_of = sum(scripts.values()) if scripts else np.zeros(len(languages))
    allowed = {s: seen > script_share * words_of for s, seen in scripts.items()}
    relative = log - log.mean(axis=1, keepdims=True) if languages else log
    return Model(languages, grams, relative.astype(np.float32),
                 {s: a for s, a in allowed.items() if a.any()})


class Scorer:
    """Scores of words by language, remembered up to a bound; row 0 is for tokens without letters."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((1, len(model.languages)), np.float32)
        self.n_letters = np.zeros(1, np.int64)

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the tables for the tokens of a batch of texts."""
        known = self.known
        if len(known) > MEMO_ENTRIES:
            known.clear()
            self.table, self.n_letters = self.table[:1], self.n_letters[:1]
        fresh: set[str] = set()
        for tokens in texts:
            fresh.update(tokens)
        fresh.difference_update(known)
        if fresh:
            self.learn(fresh)
        row = known.__getitem__
        return [np.fromiter(map(row, tokens), np.int64, len(tokens)) for tokens in texts]

    def learn(self, fresh: set[str]) -> None:
        m, number, sizes, flat, ends, narrowed, first = self.model, len(self.table), [], [], [], [], []
        for token in fresh:
            word = letters(token)
            if not word:
                self.known[token] = 0
                continue
            self.known[token] = number
            number += 1
            sizes.append(len(word))
            first.append(len(ends))
            for part in parts(word):
                flat += [i for i in map(m.grams.get, trigrams(part)) if i is not None]
                ends.append(len(flat))
                narrowed.append(m.scripts.get(script_of(part[0])))
        if not sizes:
            return
        upto = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(m.scores[np.array(flat, np.int64)], axis=0, dtype=np.float64)])
        ends = np.array(ends)
        scores = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
        scores = np.clip(scores - scores.max(axis=1, keepdims=True), -m.limit, 0)
        for i, allowed in enumerate(narrowed):
            if allowed is not None:
                scores[i, ~allowed] += m.excluded
        if len(scores) > len(first):
            scores = np.add.reduceat(scores, first, axis=0)  # a token says what its parts say
        self.table = np.concatenate([self.table, scores.astype(np.float32)])
        self.n_letters = np.concatenate([self.n_letters, np.array(sizes, np.int64)])


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the path with the largest sum of scores, less the penalty
    for each change. Ties stay with a language, then go to the first.

    If no stretch speaks for another language by more than the penalty, the path is the
    best single language; only other texts are walked through word by word."""
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, [best]], axis=0, dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(len(scores), best)
    n, k = scores.shape
    came = np.empty((n, k), np.int64)
    own = list(range(k))
    value = [0.0] * k
    for t, row in enumerate(scores.tolist()):
        top = max(value)
        at, least = value.index(top), top - penalty
        came[t] = [at if v < least else i for i, v in zip(own, value)]
        value = [max(v, least) + s for v, s in zip(value, row)]
    path = np.empty(n, np.int64)
    last = value.index(max(value))
    for t in range(n - 1, -1, -1):
        path[t] = last
        last = int(came[t, last])
    return path


def portions(texts: list[str | None], target: int = 4 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about ``target`` characters, whose words may be held at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > target:
            yield texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts[start:]


class Labeller:
    """Labels texts, one batch after another."""

    def __init__(self, model: Model):
        self.model, self.score = model, Scorer(model)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """(language, share of letters, spans) of each text."""
        return [self.one(rows) for rows in self.score([t.lower().split() if t else [] for t in texts])]

    def one(self, rows: np.ndarray) -> tuple[str, float, list[dict]]:
        m, n = self.model, self.score.n_letters[rows]
        if not m.languages or not n.any():
            return UNKNOWN, 0.0, []
        path = viterbi(self.score.table[rows], m.penalty)
        share = np.bincount(path, weights=n, minlength=len(m.languages)) / n.sum()
        at = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        spans = [{"lang": m.languages[path[a]], "start": int(a), "stop": int(b)} for a, b in zip(at, at[1:])]
        top = int(np.argmax(share))
        return m.languages[top], float(share[top]), spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every whole text. ``spans`` are runs of words in one
    language (lang, start, stop); the prediction is the language with most letters, the score
    its share of them. Null, empty and letterless texts are 'und' with score 0 and no spans;
    repeated rows keep a row each; ties go to the first language in order of name."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:int,stop:int>>"

    def make():
        label = Labeller(sent.value)

        def run(keys, texts):
            found = label([t.decode() if t else None for t in texts])
            return {"doc_id": keys, **{c: [f[i] for f in found] for i, c in enumerate(("lang_pred", "score", "spans"))}}

        return run

    return map_texts(docs, id_col, text_col, schema, make).withColumnRenamed("doc_id", id_col)


def in_known_language(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose prediction is a language with a score of at least ``least``, with
    all their columns; 'und' goes, so null and empty texts do. Rows don't move."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        label = Labeller(sent.value)
        for part in parts:
            kept: list[bool] = []
            for texts in portions(part.tolist()):
                kept += [lang != UNKNOWN and score >= least for lang, score, _ in label(texts)]
            yield pd.Series(kept, dtype=bool)

    return docs.where(known(F.col(text_col).cast("string")))
