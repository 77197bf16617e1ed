"""Phrase collocations: all phrases of two to five words that are frequent in a language, and
how much more often they occur than their parts would by chance.

Phrases grow level by level. A frequent phrase of k + 1 words starts and ends with frequent
phrases of k words, so at every place the pair (phrase that starts here, phrase that starts at
the next word) is looked up and counted. The frequent phrases of a level are ranked by
frequency; pairs of ranks are the cells of square tiles, tiles with many hits are counted by
direct addressing (one bincount), all others as sorted coordinates. The frequent pairs are
ranked again for the next level."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topictide.llm.common import mix, rows_per_batch
from topictide.llm.lm_scoring import packed, unpacked
from topictide.runtime import materialize

# Lower-cased words of all bytes but blanks; what ends a piece becomes a byte that UTF-8 has not.
BREAK = b"\xff"
PIECES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
SLICE_BYTES = 2 << 20  # of a text that are split into words at once
BLOCK_WORDS = 500_000
BLOCK_VOCABULARY = 80_000
HELD_WORDS = 1_500_000  # in the unfinished blocks of a task
TILE = 256  # ranks on a side
DENSE_HITS = TILE * TILE // 16  # from so many hits on a tile is counted by direct addressing
DENSE_TILES = 16  # counted at once
STEP_WORDS = 1 << 16  # of a block that are looked up at once
HEAD = 1 << 18  # most frequent phrases of a level that have ranks; the others go by their keys
MOST_BITS = 1 << 28  # of the bitmap of those others
BUCKET_WORDS = 250_000  # of a language's words to a bucket of pairs
MOST_BUCKETS = 1 << 16
PENDING = 500_000  # entries that a bucket adds up at once
JOINED = np.uint64(0x9E3779B97F4A7C15)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of the phrase that two overlapping phrases make."""
    return mix(left * JOINED + right + np.uint64(1))


def word_keys(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


# --- texts as blocks of words -------------------------------------------------------

class _Building:
    """A block of one language being filled: words as places in its vocabulary from 1 on, 0 between pieces."""

    def __init__(self):
        self.known, self.parts, self.context, self.n = {BREAK: 0}, [], [], 0

    def add(self, words: list[bytes], seen: int = 0) -> None:
        """``seen``: so many of the first words were counted before and stand there only as context."""
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(known)
        self.parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        self.context += range(self.n, self.n + seen)
        self.n += len(words)
        self.parts.append(np.zeros(1, np.uint32))
        self.n += 1

    def row(self, lang: str) -> pa.RecordBatch:
        words, context = np.concatenate(self.parts), np.array(self.context, "<u4")
        counted = np.delete(words, context) if len(context) else words
        counts = np.bincount(counted, minlength=len(self.known))[1:].astype("<u4")
        vocabulary = [w for w in self.known if w is not BREAK and w != BREAK]
        return pa.RecordBatch.from_arrays([
            pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([b" ".join(vocabulary)], pa.binary()),
            *(pa.array([packed(x)], pa.binary()) for x in (counts, words.astype("<u4"), context))],
            ["lang", "n", "vocabulary", "counts", "words", "context"])


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a very long text, cut at a space: no word is cut."""
    start = 0
    while len(text) - start > SLICE_BYTES:
        end = text.find(b" ", start + SLICE_BYTES)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _words(text: bytes) -> list[bytes]:
    return text.replace(BREAK, b" \xff ").split()


def blocks(docs: DataFrame, text_col: str, lang_col: str, longest: int) -> DataFrame:
    """(lang, n, vocabulary, counts, words, context): the words of all texts, some millions
    of one language to a block, written to the shared folder. A very long text goes on in
    other blocks, each of which repeats the last words of the one before as context."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_key"),
                       F.col(text_col).cast("string").cast("binary").alias("_text")).where("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, _Building] = {}

        def full(lang: str) -> bool:
            return held[lang].n >= BLOCK_WORDS or len(held[lang].known) >= BLOCK_VOCABULARY

        for whole in batches:
            for batch in rows_per_batch(whole, "_text", SLICE_BYTES):
                short: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if len(text) <= SLICE_BYTES:
                        short.setdefault(lang, []).append(text.translate(PIECES))
                        continue
                    before: list[bytes] = []
                    for part in _slices(text.translate(PIECES)):
                        words = _words(part)
                        held.setdefault(lang, _Building()).add(before + words, len(before))
                        last = (before + words)[-(longest - 1):]
                        before = last[max((i + 1 for i, w in enumerate(last) if w == BREAK), default=0):]
                        if full(lang):
                            yield held.pop(lang).row(lang)
                for lang, texts in short.items():
                    held.setdefault(lang, _Building()).add(_words(BREAK.join(texts)))
                    if full(lang):
                        yield held.pop(lang).row(lang)
                while sum(b.n for b in held.values()) > HELD_WORDS:
                    lang = max(held, key=lambda x: held[x].n)
                    yield held.pop(lang).row(lang)
        for lang in list(held):
            yield held.pop(lang).row(lang)

    return materialize(rows.mapInArrow(run, "lang string, n long, vocabulary binary, counts binary, words binary, context binary"))


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, key, word, n): the words that occur at least ``least`` times in a language."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, vocabulary, counts = (c[i].as_py() for c in batch.columns)
                words, n = vocabulary.split(b" ") if vocabulary else [], unpacked(counts, "<u4")
                for i in range(0, len(words), 20_000):
                    own = words[i:i + 20_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()), pa.array(n[i:i + len(own)].astype(np.int64))], ["lang", "word", "n"])

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), pa.array(word_keys(words).astype(np.int64)),
                pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), batch.column("n")], ["lang", "key", "word", "n"])

    counted = rows.select("lang", "vocabulary", "counts").mapInArrow(run, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).mapInArrow(
        keyed, "lang string, key long, word string, n long")


# --- the frequent phrases of a level ---------------------------------------------------

class Known:
    """The frequent phrases of a level in one language: sorted keys with their ranks for the
    most frequent ones, ``by_rank`` the other way round, and a bitmap for the rest."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: np.ndarray | None):
        order = np.lexsort((keys, -counts))
        self.by_rank = keys[order]
        by_key = np.argsort(self.by_rank)
        self.keys, self.ranks, self.bits = self.by_rank[by_key], by_key.astype(np.int64), bits

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of phrases; -1 for those that are not frequent, -2 for those that may be so without a rank."""
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            found = np.where(self.keys[at] == keys, self.ranks[at], -1)
        else:
            found = np.full(len(keys), -1)
        if self.bits is not None:
            at = (mix(keys) % np.uint64(len(self.bits) * 8)).astype(np.int64)
            found[(found < 0) & ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)] = -2
        return found


def _bitmap(tail: DataFrame, bits: int) -> np.ndarray | None:
    """Bits of the hashed keys, gathered from bitmaps of the tasks; false positives only make work."""
    def run(batches: Iterator[pa.RecordBatch]):
        own = None
        for batch in batches:
            own = np.zeros(bits // 8, np.uint8) if own is None else own
            at = (mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if own is not None:
            for i in range(0, len(own), 4096):
                if own[i:i + 4096].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([own[i:i + 4096].tobytes()])], ["at", "bits"])

    merged = tail.select("key").mapInArrow(run, "at long, bits binary").groupBy("at").agg(F.collect_list("bits").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        for b in r.bits:
            out[r.at:r.at + len(b)] |= np.frombuffer(b, np.uint8)
    return out


def known_phrases(found: DataFrame, head: int) -> dict[str, Known]:
    """By language. Ranks go to at most ``head`` phrases, all those above a count that a
    histogram gives, so what is collected and broadcast is bounded; the others are exact
    too, as their pairs go by 64-bit keys."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = found.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()
    total, least = 0, None
    for r in sizes:
        if total + r["count"] > head:
            break
        total, least = total + r["count"], r["s"]
    rest = sum(r["count"] for r in sizes) - total
    ranked: dict[str, tuple[list, list]] = {}
    if least is not None:
        for r in found.where(step >= least).select("lang", "key", "n").collect():
            keys, counts = ranked.setdefault(r["lang"], ([], []))
            keys.append(r["key"])
            counts.append(r["n"])
    bits = None
    if rest:
        tail = found if least is None else found.where(step < least)
        bits = _bitmap(tail, min(MOST_BITS, 1 << max(16, (rest * 16).bit_length())))
        for r in tail.select("lang").distinct().collect():
            ranked.setdefault(r["lang"], ([], []))
    return {lang: Known(np.array(k, np.int64).astype(np.uint64), np.array(n, np.int64), bits) for lang, (k, n) in ranked.items()}


# --- pairs -------------------------------------------------------------------------

def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, times) of pairs of ranks, each once."""
    if not len(left):
        return left, right, left
    side = int(max(left.max(), right.max())) // TILE + 1
    if side <= 4096:
        tile = left // TILE * np.uint32(side) + right // TILE
        hits = np.bincount(tile, minlength=side * side)
        dense = np.flatnonzero(hits >= DENSE_HITS)
        place = np.full(side * side, -1, np.int32)
    else:  # tiles too many to be addressed themselves
        tile = left.astype(np.int64) // TILE * side + right // TILE
        every, hits = np.unique(tile, return_counts=True)
        dense, place = every[hits >= DENSE_HITS], None
    out = []
    in_dense = np.zeros(len(tile), bool)
    cell = left % TILE * TILE + right % TILE
    for i in range(0, len(dense), DENSE_TILES):
        some = dense[i:i + DENSE_TILES]
        if place is not None:
            place[:] = -1
            place[some] = np.arange(len(some))
            at = place[tile]
        else:
            at = np.searchsorted(some, tile)
            at[at == len(some)] = 0
            at = np.where(some[at] == tile, at, -1)
        own = at >= 0
        in_dense |= own
        counts = np.bincount(at[own].astype(np.int64) * TILE * TILE + cell[own], minlength=len(some) * TILE * TILE)
        full = np.flatnonzero(counts)
        t, c = some[full // (TILE * TILE)], full % (TILE * TILE)
        out.append((t // side * TILE + c // TILE, t % side * TILE + c % TILE, counts[full]))
    keys, times = np.unique(left[~in_dense].astype(np.int64) << 32 | right[~in_dense], return_counts=True)
    out.append((keys >> 32, keys & 0xFFFFFFFF, times))
    return tuple(np.concatenate(x) for x in zip(*out))


def key_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, times) of pairs of keys, each once."""
    _, first, times = np.unique(joined(left, right), return_index=True, return_counts=True)
    return left[first], right[first], times


def _level_pairs(vocabulary: bytes, words: bytes, context: bytes, level: int, known: Known):
    """The pairs of frequent phrases of ``level`` words that start at neighbouring words of a block."""
    every = unpacked(words, "<u4")
    of = np.concatenate([np.zeros(1, np.uint64), word_keys(vocabulary.split(b" ") if vocabulary else [])])
    seen = np.sort(unpacked(context, "<u4"))
    pairs: tuple[list, ...] = ([], [], [], [])
    # Places go by in steps; a pair is found from the level + 1 words that it has.
    for lo in range(0, len(every) - level, STEP_WORDS):
        place = every[lo:lo + STEP_WORDS + level]
        keys, piece = of[place], np.cumsum(place == 0, dtype=np.int32)
        ends = np.ones(len(place), bool)
        ends[seen[np.searchsorted(seen, lo):np.searchsorted(seen, lo + len(place))].astype(np.int64) - lo] = False
        for k in range(1, level):
            keys = joined(keys[:-1], keys[1:])
        n = len(keys) - 1
        ranks = known.rank(keys)
        # One piece from the first to the last word, which is not a break; the last word is counted here.
        whole = (piece[:n] == piece[level:level + n]) & (place[:n] > 0) & (place[level:level + n] > 0) & ends[level:level + n]
        at = np.flatnonzero(whole & (ranks[:n] != -1) & (ranks[1:] != -1))
        ranked = (ranks[at] >= 0) & (ranks[at + 1] >= 0)
        a, b = at[ranked], at[~ranked]
        for held, found in zip(pairs, (ranks[a].astype(np.uint32), ranks[a + 1].astype(np.uint32), keys[b], keys[b + 1])):
            held.append(found)
    left, right, first, second = (np.concatenate([np.empty(0, t), *held]) for t, held in zip((np.uint32, np.uint32, np.uint64, np.uint64), pairs))
    return (left, right), (first, second)


def pair_counts(rows: DataFrame, level: int, known: dict[str, Known], words_of: dict[str, int], least: int) -> DataFrame:
    """(lang, key, left, right, n): the phrases of ``level`` + 1 words that occur at least
    ``least`` times. Blocks send each pair once, packed, to a bucket that follows from the
    pair alone, so a very frequent one is as many entries as there are blocks."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    buckets = {k: min(max(8, n // BUCKET_WORDS), MOST_BUCKETS) for k, n in words_of.items()}

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, *block = (c[i].as_py() for c in batch.columns)
                own = sent.value.get(lang)
                if own is None:
                    continue
                ranked, keyed = _level_pairs(*block, level, own)
                for ranks, (left, right, times) in ((True, tile_counts(*ranked)), (False, key_counts(*keyed))):
                    if not len(left):
                        continue
                    kind = "<u4" if ranks else "<u8"
                    bucket = (joined(left.astype(np.uint64), right.astype(np.uint64)) % np.uint64(buckets[lang])).astype(np.int64)
                    order = np.lexsort((right, left, bucket))
                    left, right, times, bucket = left[order].astype(kind), right[order].astype(kind), times[order].astype("<u4"), bucket[order]
                    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
                    spans = list(zip(edges, edges[1:]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(spans), pa.string()), pa.array(bucket[edges[:-1]]), pa.array([ranks] * len(spans)),
                         *(pa.array([packed(x[a:b]) for a, b in spans], pa.binary()) for x in (left, right, times))],
                        ["lang", "bucket", "ranked", "left", "right", "times"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            left, right, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((right, left))
            left, right, n = left[order], right[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
            return left[first], right[first], np.add.reduceat(n, first)

        lang = ranked = None
        size = done = 0
        for batch in group:
            for i in range(batch.num_rows):
                lang, _, ranked, left, right, times = (c[i].as_py() for c in batch.columns)
                kind = "<u4" if ranked else "<u8"
                held.append((unpacked(left, kind), unpacked(right, kind), unpacked(times, "<u4").astype(np.int64)))
                size += len(held[-1][0])
                if size > PENDING + 2 * done:
                    held = [merged()]
                    size = done = len(held[0][0])
        left, right, n = merged()
        enough = n >= least
        left, right, n = left[enough], right[enough], n[enough]
        if ranked:
            by_rank = sent.value[lang].by_rank
            left, right = by_rank[left], by_rank[right]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), *(pa.array(x.astype(np.int64)) for x in (joined(left, right), left, right, n))],
            ["lang", "key", "left", "right", "n"])

    asked = rows.select("lang", "vocabulary", "words", "context").mapInArrow(
        count, "lang string, bucket long, ranked boolean, left binary, right binary, times binary")
    return asked.groupBy("lang", "bucket", "ranked").applyInArrow(add, "lang string, key long, left long, right long, n long")


# --- phrases -------------------------------------------------------------------------

def frequent_phrases(rows: DataFrame, least: int, longest: int, head: int = HEAD) -> list[DataFrame]:
    """For each length from 1 to ``longest``: (lang, key, left, right, n, words, starts, ends),
    the phrases that occur at least ``least`` times, with how often their first and their
    last 1, 2, ... words occur. Ends at the first length without any."""
    counted = word_counts(rows, least)
    levels = [materialize(counted.select(
        "lang", "key", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "n",
        F.array("word").alias("words"), F.array("n").alias("starts"), F.array("n").alias("ends")))]
    words_of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for level in range(1, longest):
        known = known_phrases(levels[-1], head)
        if not known:
            break
        pairs = pair_counts(rows, level, known, words_of, least)
        a = levels[-1].select("lang", F.col("key").alias("left"), F.col("words").alias("a"), F.col("starts").alias("s"))
        b = levels[-1].select("lang", F.col("key").alias("right"), F.col("words").alias("b"), F.col("ends").alias("e"))
        levels.append(materialize(pairs.join(a, ["lang", "left"]).join(b, ["lang", "right"]).select(
            "lang", "key", "left", "right", "n", F.concat("a", F.slice("b", -1, 1)).alias("words"),
            F.concat("s", F.array("n")).alias("starts"), F.concat("e", F.array("n")).alias("ends"))))
    return levels


def _not_inside(shorter: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Phrases that don't lie inside a longer one that is at least ``share`` hundredths as
    frequent. If one lies inside any such phrase, the part of that with one more word is
    at least as frequent, so phrases of one more word decide."""
    parts = longer.select("lang", "n", F.explode(F.array("left", "right")).alias("key"))
    most = parts.groupBy("lang", "key").agg(F.max("n").alias("_most"))
    return shorter.join(most, ["lang", "key"], "left").where(
        F.coalesce(F.lit(100) * F.col("_most") < F.lit(share) * F.col("n"), F.lit(True))).drop("_most")


# The lowest-scoring cut, the first of several. Products of three counts need more than 64 bits.
_CUT = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
    (cast(1000 as decimal(4, 0)) * (cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))))
    div (cast(starts[k - 1] as decimal(19, 0)) * cast(ends[size(words) - k - 1] as decimal(19, 0))) as score,
    k as k, starts[k - 1] as l, ends[size(words) - k - 1] as r)))"""


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5,
                 top: int = 2_000, share: int = 100, head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts are cut into pieces and words; n counts a language's words. A phrase of 2 to
    ``longest`` words that occurs a times, ``least`` at least, is rated by its worst cut into
    parts that occur l and r times: 1000 * a * n / (l * r), rounded down. Phrases inside a
    longer one that is ``share`` hundredths as frequent go; each language keeps its first
    ``top`` by score, a, and bytes of the phrase. A null text has no words, a null language
    is ``und``, repeated rows count again, and empty tables give no rows.

    Counts are exact whatever ``head`` is; words and phrases are told apart by 64-bit hashes."""
    rows = blocks(docs, text_col, lang_col, longest)
    levels = frequent_phrases(rows, least, longest, head)
    kept = [_not_inside(shorter, longer, share) for shorter, longer in zip(levels[1:], levels[2:])] + levels[2:][-1:]
    if len(levels) < 3:
        kept = levels[1:] or [levels[0].where(F.lit(False))]
    total = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    every = reduce(DataFrame.unionByName, [x.select("lang", "words", "starts", "ends", F.col("n").alias("a")) for x in kept])
    rated = every.join(total, "lang").select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.expr(_CUT).alias("cut"))
    rated = rated.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # First in each of some parts of a language, so that no task has to rank all of it.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return (rated.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
            .withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
