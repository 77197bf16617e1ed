"""Collocations against counts of all phrases, with and without ranks for all of them."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from topictide.llm import collocations as C

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, longest, top, share):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    many = {k: v for k, v in f.items() if v >= least}
    rows = []
    for (lang, p), a in many.items():
        if len(p) < 2:
            continue
        longer = [v for (x, q), v in many.items() if x == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * v >= share * a for v in longer):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def corpus(seed=2):
    r = random.Random(seed)
    words = ["the", "Of", "é", "x y", "漢字", "\x1c", "a", "b", "c"]
    fixed = ["new york city hall clock", "the end of the", "b b b b b b", "x y é"]
    out = []
    for i in range(150):
        text = ""
        for _ in range(r.randint(0, 40)):
            text += r.choice(fixed) if r.random() < 0.3 else r.choice(words)
            text += r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "; "])
        out.append((r.choice(["en", "de", None, "und"]), text))
    return out + [("en", None), ("en", ""), (None, "  .,\n"), ("fr", "new york " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'k' as key", "2 as rank", "0L as score").repartition(4)


@pytest.mark.parametrize("least, top, share, head", [(5, 2000, 100, 1 << 18), (5, 2000, 100, 12), (5, 2000, 100, 0), (8, 7, 100, 1 << 18), (6, 2000, 60, 30)])
def test_equals_counts_of_all_phrases(docs, least, top, share, head):
    rows, df = docs
    got = sorted(tuple(r) for r in C.collocations(df, least=least, top=top, share=share, head=head).collect())
    want = brute(rows, least, 5, top, share)
    assert got == want and len(want) > 20


def test_long_texts_go_on_in_other_blocks(spark, monkeypatch):
    """Slices and blocks of a few bytes: run in this process, as the settings don't travel."""
    monkeypatch.setattr(C, "SLICE_BYTES", 40)
    r = random.Random(9)
    text = " ".join(r.choice(["aa", "bb", "cc", "dd."]) for _ in range(2_000)).encode()
    for longest in (2, 5):
        building, before, want, got = [], [], Counter(), Counter()
        for part in C._slices(text.translate(C.PIECES)):
            b = C._Building()
            words = C._words(part)
            b.add(before + words, len(before))
            last = (before + words)[-(longest - 1):]
            before = last[max((i + 1 for i, w in enumerate(last) if w == C.BREAK), default=0):]
            building.append(b.row("x"))
        for piece in text.decode().split("."):
            w = piece.split()
            want.update(tuple(w[i:i + longest]) for i in range(len(w) - longest + 1))
        for row in building:
            lang, _, vocabulary, _, words, context = (c[0].as_py() for c in row.columns)
            places, ctx = C.unpacked(words, "<u4"), set(C.unpacked(context, "<u4").tolist())
            names = [None, *vocabulary.decode().split(" ")]
            run = [names[p] for p in places]
            for i in range(len(run) - longest + 1):
                if None not in run[i:i + longest] and i + longest - 1 not in ctx:
                    got[tuple(run[i:i + longest])] += 1
        assert got == want and len(building) > 100


def test_dense_and_sparse_tiles():
    r = np.random.default_rng(1)
    left = np.concatenate([r.integers(0, 64, 60_000), r.integers(0, 3_000, 4_000), r.integers(1_100_000, 1_100_040, 9_000)])
    right = np.concatenate([r.integers(0, 64, 60_000), r.integers(0, 3_000, 4_000), r.integers(0, 40, 9_000)])
    for some in (slice(0, 64_000), slice(None)):  # tiles addressed directly, or too many for that
        a, b, n = C.tile_counts(left[some], right[some])
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left[some].tolist(), right[some].tolist()))
        assert len(a) == len(set(zip(a.tolist(), b.tolist())))


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(["p", "q"], [2**50, 5], [2**49, 2**50], 2**50 - 3, 2**51)], "words array<string>, starts array<long>, ends array<long>, a long, n long")
    got = row.selectExpr(f"{C._CUT} as cut").first().cut
    assert got.score == 1000 * (2**50 - 3) * 2**51 // (2**50 * 2**49)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert C.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).collect() == []


def test_a_block_is_looked_up_in_steps_of_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    vocabulary = [b"w%d" % i for i in range(2000)]
    keys = C.word_keys(vocabulary)
    known = C.Known(keys[:1500], np.arange(1500, 0, -1), None)
    words = rng.integers(0, 2001, 400_000).astype("<u4")
    block = (b" ".join(vocabulary), C.packed(words), C.packed(np.array([5, 6, 70_000], "<u4")))
    tracemalloc.start()
    found = C._level_pairs(*block, 1, known)
    C.tile_counts(*found[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28e6, peak
    few = words[:3000]
    block = (block[0], C.packed(few), C.packed(np.array([5, 6, 70], "<u4")))
    for level in (1, 2, 3):
        monkeypatch.setattr(C, "STEP_WORDS", 1 << 16)
        whole = C._level_pairs(*block, level, known)
        monkeypatch.setattr(C, "STEP_WORDS", 7)
        for a, b in zip(whole, C._level_pairs(*block, level, known)):
            assert [x.tolist() for x in a] == [x.tolist() for x in b]
