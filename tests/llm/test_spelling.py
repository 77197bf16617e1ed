"""Spelling variants against all pairs, and PartEnum's promise."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from topictide.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, min_length=6, min_count=5, ratio=5):
    n = Counter()
    for key, text in docs:
        for run in spelling.WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, c in close.items():
        best = min(c, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n}


def corpus(seed=1):
    r = random.Random(seed)
    bases = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(60)]
    words = []
    for w in bases:
        k = r.choice([6, 40, 300])
        words += [w] * k
        for _ in range(3):  # variants, and variants of variants
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcÉ") + w[i:], w[:i] + r.choice("abcÀ") + w[i + 1:]])
            k = max(k // r.choice([2, 5, 6]), 1)
            words += [w.capitalize() if r.random() < 0.3 else w] * k
    r.shuffle(words)
    return [(i, " ".join(words[i * 97:(i + 1) * 97])) for i in range(len(words) // 97 + 1)]


@pytest.fixture(scope="module")
def found(spark):
    docs = corpus() + [(None, "anonym " * 30), (5, None), (6, ""), (7, "abc " * 50), (8, "Groß groß größe " * 9), (8, "Groß groß größe " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "'y' as form").repartition(5)
    return docs, {tuple(r) for r in spelling.spelling_groups(df).collect()}


def test_equals_all_pairs(found):
    docs, got = found
    want = brute(docs)
    assert got == want and len(got) > 50
    assert sum(f is not None for _, f, *_ in got) > 10
    assert any(f is not None and r != f for _, f, r, *_ in got)  # a path of several forms


@pytest.mark.parametrize("distance, parts", [(2, 5), (2, 7), (1, 3)])
def test_signatures_miss_no_vectors_within_the_distance(distance, parts):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 14))) for _ in range(300)]
    pairs = []
    for w in words:
        i = r.randrange(len(w))
        pairs.append((w, w[:i] + w[i + 1:]))  # one place differs
        if distance == 2:
            pairs.append((w, w[:i] + r.choice("xyz") + w[i + 1:]))  # two places differ
    a, b = (spelling.signatures([p[k] for p in pairs], distance, parts) for k in (0, 1))
    assert (a == b).any(axis=0).all()
    anagrams = spelling.signatures(["listen", "silent"], distance, parts)
    assert (anagrams[:, 0] == anagrams[:, 1]).all() and len(np.unique(anagrams[:, 0])) > 1


def test_empty_and_no_pairs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).collect() == []
    alone = spark.createDataFrame([(1, "lonely " * 6), (2, "w" * 200_000 + " " + "verylongtext " * 20_000)], "doc_id long, text string")
    got = {r.word: tuple(r) for r in spelling.spelling_groups(alone).collect()}
    assert got["lonely"] == ("lonely", None, "lonely", 6, 0, None) and got["verylongtext"][3] == 20_000


def test_ties_take_the_smallest_form(spark):
    docs = spark.createDataFrame([(100, "abcdefx " * 5 + "abcdefa " * 50 + "abcdefb " * 50)], "doc_id long, text string")
    got = {r.word: r for r in spelling.spelling_groups(docs).collect()}
    assert got["abcdefx"].form == "abcdefa" and got["abcdefx"].n_near == 2 and got["abcdefa"].form is None


def test_ratio_has_to_grow(spark):
    with pytest.raises(ValueError):
        spelling.with_roots(spark.createDataFrame([], "word string, n long, n_near long, form string, form_n long"), 1)


def test_signatures_are_not_broadcast(spark, tmp_path):
    words = spark.createDataFrame([("abcdefg", 9), ("abcdefh", 7)], "word string, n long")
    words.write.parquet(f"{tmp_path}/words")  # a table whose size Spark takes for that of its signatures
    pairs = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.n_a, r.b, r.n_b) for r in pairs.collect()] == [("abcdefg", 9, "abcdefh", 7)]
