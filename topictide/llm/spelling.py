"""Spelling variants: words of a corpus that differ by one code point, found through PartEnum
signatures of their letters, and the frequent form that a rare variant belongs to.

A word's letters are a set of (letter, how many of it came before), that is a binary vector.
One inserted or deleted code point changes one place of it and a replaced one two, so near
words have vectors at a Hamming distance of at most two. Places are dealt over ``PARTS``
parts by a hash; two vectors at that distance agree in all but two parts at most, so near
words share the signature (the letters of the other parts) of at least one choice of two
parts left out."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import ASCII_LOWER, mix, rows_per_batch
from topictide.runtime import materialize

WORD = re.compile("[A-Za-zÀ-ÿ]+")
DISTANCE, PARTS = 2, 5
NOISE = 199  # one run in so many loses a code point
HELD_WORDS = 300_000  # distinct words a task adds up before it sends them on


def altered(prefix_crc: int, run: str) -> str:
    """The run, without one of its code points where its document and the run say so."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` code points stands in all
    whole texts, if at least ``min_count`` times. A null text has no words; a null id is
    the empty string where it decides about a run. Repeated rows count again."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
                       F.col(text_col).cast("string").cast("binary").alias("_text")).where("_text is not null")

    def count(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for whole in batches:
            for batch in rows_per_batch(whole, "_text"):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    start = zlib.crc32(f"{key}:".encode())
                    for run, n in Counter(WORD.findall(text.translate(ASCII_LOWER).decode("utf-8", "replace"))).items():
                        if len(run) >= min_length:
                            word = altered(start, run)
                            if len(word) >= min_length:
                                held[word] += n
                    if len(held) > HELD_WORDS:
                        yield sent()
        if held:
            yield sent()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def signatures(words: list[str], distance: int = DISTANCE, parts: int = PARTS) -> np.ndarray:
    """A row for each choice of ``distance`` parts left out, a column for each word: the
    letters in the other parts as a 64-bit hash. Words whose vectors differ in at most
    ``distance`` places agree in a row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    letters, owner = letters[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])])[:len(letters)])
    before = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    places = letters << np.uint64(32) | before.astype(np.uint64)
    part = (mix(places + np.uint64(777)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros((parts, len(words)), np.uint64)
    np.add.at(sums, (part, owner), mix(places + np.uint64(12_345)))
    total = sums.sum(axis=0)
    return np.stack([mix(total - sums[list(out)].sum(axis=0)) for out in combinations(range(parts), distance)])


def signature_rows(words: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """(key, word, n, longer): words under their signatures. Near words also share the first
    or the last half of the shorter one, whichever the difference is not in, and ``key``
    holds that half and the shorter one's length as well: it keeps the many words apart that
    use the same letters. ``longer`` is 1 where the word would be the longer one of a pair."""
    def rows(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh3_64_intdigest as digest

        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                own, n = batch.column(0).to_pylist(), batch.column(1)
                signed, every = signatures(own, distance, parts), np.arange(len(own))
                for longer in (0, 1):
                    for last in (0, 1):
                        halves = []
                        for w in own:
                            size = len(w) - longer
                            halves.append(digest((w[len(w) - size // 2:] if last else w[:size // 2]).encode(), 2 * size + last))
                        keys = mix(signed + np.array(halves, np.uint64)).ravel().astype(np.int64)
                        place = pa.array(np.tile(every, len(signed)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), batch.column(0).take(place), n.take(place), pa.array(np.full(len(keys), longer, np.int32))],
                            ["key", "word", "n", "longer"])

    return words.select("word", "n").mapInArrow(rows, "key long, word string, n long, longer int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of words that differ by exactly one inserted,
    deleted or replaced code point, each once."""
    rows = signature_rows(words)
    a = rows.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("longer").alias("longer_a"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("longer").alias("longer_b"))
    # A word has 40 rows here, which Spark's estimate of their size doesn't know: never broadcast them.
    found = a.join(b.hint("merge"), "key").where("a < b and longer_a + longer_b < 2").where(F.levenshtein("a", "b", 1) == 1)
    return found.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): how many near words each word has, and the most
    frequent of them (ties: the smallest) if it is at least ``ratio`` times as frequent."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))


def with_roots(found: DataFrame, ratio: int = 5) -> DataFrame:
    """Adds the word that following the forms ends at. Along forms the count grows ``ratio``
    times, so the longest path is known and a few rounds of doubling reach every end."""
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their variants")
    found = materialize(found)
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    low, high = found.where("form is not null").agg(F.min("n"), F.max("form_n")).first()
    longest = int(math.log(high / low, ratio) + 1e-9) if low else 0
    for _ in range(max(longest - 1, 0).bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = materialize(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                    ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the whole texts that is long
    and frequent enough. Empty tables and texts without words give no rows."""
    words = materialize(word_counts(docs, id_col, text_col, min_length, min_count))
    return with_roots(variants(words, ratio), ratio).select("word", "form", "root", "n", "n_near", "form_n")
