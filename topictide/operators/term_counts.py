"""Counts of tokens and of neighbouring tokens per document: the text of a document goes by in
runs, a run is split and counted where it lies, with tokens as numbers, and Spark adds up the
counts of the runs."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kernels travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lower-cased bytes of [a-z0-9]; all others end a token. Of the other letters only the Kelvin
# sign and the dotted I have an ASCII letter as their lower case.
TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
KELVIN, DOTTED_I = "K".encode(), "İ".encode()
RUN_TOKENS = 1 << 21
PART_BYTES = 1 << 20  # of a document that are split at once
OUT_ROWS = 100_000
BUCKET_BITS = 22  # of a hashed token or pair
SEGMENT_BITS = 16  # of the buckets that are added up together


def _parts(texts: Iterable[bytes]) -> Iterator[bytes]:
    """Texts as lower-cased tokens and blanks, joined by a blank and cut at one."""
    held, size = [], 0
    for text in texts:
        text = text.replace(KELVIN, b"k").replace(DOTTED_I, b"i ").translate(TOKEN_BYTES)
        held.append(text)
        size += len(text)
        if size < PART_BYTES:
            continue
        whole, start = b" ".join(held), 0
        while len(whole) - start > 2 * PART_BYTES:
            end = whole.find(b" ", start + PART_BYTES)
            if end < 0:
                break
            yield whole[start:end]
            start = end
        yield whole[start:]
        held, size = [], 0
    if held:
        yield b" ".join(held)


class _Run:
    """Neighbouring tokens of a document."""

    def __init__(self, keys: list[pa.Array], stop: pa.Array):
        self.keys, self.stop, self.tokens, self.n = keys, stop, [], 0

    def add(self, part: bytes) -> None:
        self.tokens.append(pc.ascii_split_whitespace(pa.array([part], pa.binary()).cast(pa.string())).flatten())
        self.n += len(self.tokens[-1])

    def rows(self, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """One row; none where all tokens are stop words."""
        found = pa.concat_arrays(self.tokens).dictionary_encode() if self.tokens else pa.array([], pa.string()).dictionary_encode()
        # Stop words are looked up once each, then left out by number.
        kept = pc.invert(pc.is_in(found.dictionary, value_set=self.stop))
        words, kept = found.dictionary.filter(kept), kept.to_numpy(zero_copy_only=False)
        ids = (np.cumsum(kept, dtype=np.uint32) - np.uint32(1))[found.indices.to_numpy()[kept[found.indices.to_numpy()]]]
        if not len(ids):
            return
        vocabulary = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
        yield pa.RecordBatch.from_arrays(
            [*self.keys, pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), vocabulary.cast(pa.binary()),
             pa.array([ids.astype("<u4").tobytes()], pa.binary()),
             *(pa.array([words[int(ids[i])].as_py()], pa.string()) for i in (0, -1))], names)


def token_runs(rows: DataFrame, keys: list[str], text: str, stop_words: Iterable[str]) -> DataFrame:
    """(both keys, at, n, vocabulary, ids, first, last): the ``n`` tokens of neighbouring
    rows of a document in their order, from RUN_TOKENS or little more, stop words included, to a
    run; ``at`` grows with it."""
    stop = sorted({"", *stop_words})  # blanks at an end leave an empty token
    names = [*keys, "at", "n", "vocabulary", "ids", "first", "last"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, none = None, TaskContext.get().partitionId() << 32, pa.array(stop, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in (0, 1)]
            edges = np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                own = [pa.concat_arrays([batch.column(i).slice(a, 1)]) for i in (0, 1)]
                if held is None or not all(x.equals(y) for x, y in zip(own, held.keys)):
                    if held is not None:
                        yield from held.rows(at, names)
                        at += 1
                    held = _Run(own, none)
                for part in _parts(x.as_py() for x in batch.column(2).slice(a, b - a) if x.is_valid):
                    held.add(part)
                    if held.n >= RUN_TOKENS:
                        yield from held.rows(at, names)
                        at += 1
                        held = _Run(own, none)
        if held is not None:
            yield from held.rows(at, names)

    texts = rows.select(*keys, F.col(text).cast("string").cast("binary").alias("_text"))
    return texts.mapInArrow(run, f"{kinds}, at long, n long, vocabulary binary, ids binary, first string, last string")


def pair_run(before, after) -> dict:
    """Columns of the run that two tokens make; ``n`` is 0, as both are counted where they stand."""
    same = before == after
    return {"n": F.lit(0).cast("long"),
            "vocabulary": F.when(same, before).otherwise(F.concat_ws(" ", before, after)).cast("binary"),
            "ids": F.when(same, F.lit(np.array([0, 0], "<u4").tobytes())).otherwise(F.lit(np.array([0, 1], "<u4").tobytes()))}


def _spelled(batch: pa.RecordBatch, i: int) -> tuple[list[pa.Array], pa.Array, np.ndarray, np.ndarray]:
    """Keys, vocabulary, counts and tokens of a run."""
    words = pc.split_pattern(batch.column(3).slice(i, 1).cast(pa.string()), " ").flatten()
    ids = np.frombuffer(batch.column(4)[i].as_py(), "<u4").astype(np.int64)
    counts = np.bincount(ids, minlength=len(words)) if batch.column(2)[i].as_py() else np.zeros(len(words), np.int64)
    return [batch.column(k).slice(i, 1) for k in (0, 1)], words, counts, ids


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word: a polynomial of its bytes, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts, n = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(n.max(), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(data * powers[np.arange(len(data)) - np.repeat(starts, n)], starts)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _buckets(own: np.ndarray) -> np.ndarray:
    return ((own * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _pair_buckets(own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _buckets((own * np.uint64(0x9E3779B97F4A7C15))[left] ^ own[right])


def _counted(keys: list[pa.Array], terms: pa.Array, tf: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(terms), OUT_ROWS):
        some = terms[lo:lo + OUT_ROWS]
        place = pa.array(np.zeros(len(some), np.int64))
        yield pa.RecordBatch.from_arrays([*(k.take(place) for k in keys), some, pa.array(tf[lo:lo + OUT_ROWS].astype(np.int64))], names)


def run_counts(runs: DataFrame, keys: list[str], ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """(both keys, term, tf) of the tokens and the pairs of neighbours in the runs."""
    names = [*keys, "term", "tf"]
    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, words, counts, ids = _spelled(batch, i)
                if ngrams[0] == 1:
                    some = counts > 0
                    yield from _counted(of, words.filter(pa.array(some)), counts[some], names)
                if ngrams[1] == 2:
                    found, tf = np.unique(ids[:-1] * len(words) + ids[1:], return_counts=True)
                    a, b = (words.take(pa.array(x)) for x in np.divmod(found, len(words)))
                    yield from _counted(of, pc.binary_join_element_wise(a, b, " "), tf, names)

    counted = runs.select(*keys, "n", "vocabulary", "ids").mapInArrow(run, f"{kinds}, term string, tf long")
    return counted.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def dealt_counts(runs: DataFrame, keys: list[str], buckets: tuple[np.ndarray, np.ndarray], segments: int, summed: bool = False) -> DataFrame:
    """(both keys, segment, terms, tfs, sums): the tokens and the pairs of neighbours of a run that
    are in the true buckets, for tokens and for pairs, joined as text and dealt to ``segments``
    ranges of buckets. ``summed`` adds rows without keys, for full_buckets: how many tokens and
    pairs each bucket has."""
    names = [*keys, "segment", "terms", "tfs", "sums"]
    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    sent = runs.sparkSession.sparkContext.broadcast([np.packbits(b) for b in buckets])
    width = 1 << SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = [np.unpackbits(b).astype(bool) for b in sent.value]
        sums, held, size = np.zeros(1 << BUCKET_BITS if summed else 0, np.int64), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                of, words, counts, ids = _spelled(batch, i)
                own = _hashes(words)
                places = _buckets(own)
                some = np.flatnonzero((counts > 0) & chosen[0][places])
                left, right = ids[:-1], ids[1:]
                pairs = _pair_buckets(own, left, right)
                if summed:
                    np.add.at(sums, places, counts)
                    held.append(pairs)
                    size += len(pairs)
                    if size > RUN_TOKENS:
                        sums += np.bincount(np.concatenate(held), minlength=len(sums))
                        held, size = [], 0
                pairs = chosen[1][pairs]
                found, tf = np.unique(left[pairs] * len(words) + right[pairs], return_counts=True)
                left, right = np.divmod(found, len(words))
                terms = pa.concat_arrays([words.take(pa.array(some)), pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in (left, right)), " ")])
                if not len(terms):
                    continue
                segment = np.concatenate([places[some], _pair_buckets(own, left, right)]) * segments >> BUCKET_BITS
                order = np.argsort(segment, kind="stable")
                segment = segment[order]
                edges = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1, [len(segment)]])
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), terms.take(pa.array(order))), "\n")
                tfs = np.concatenate([counts[some], tf])[order].astype("<u4")
                first = edges[:-1]
                yield pa.RecordBatch.from_arrays([
                    *(k.take(pa.array(np.zeros(len(first), np.int64))) for k in of), pa.array(segment[first]), joined.cast(pa.binary()),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(tfs)]),
                    pa.nulls(len(first), pa.binary())], names)
        if held:
            sums += np.bincount(np.concatenate(held), minlength=len(sums))
        for i in range(0, len(sums), width):
            if sums[i:i + width].any():
                part = np.minimum(sums[i:i + width], (1 << 32) - 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k.type) for k in of), pa.array([i >> SEGMENT_BITS], pa.int64()),
                                                  *(pa.nulls(1, pa.binary()),) * 2, pa.array([part.tobytes()], pa.binary())], names)

    return runs.select(*keys, "n", "vocabulary", "ids").mapInArrow(run, f"{kinds}, segment long, terms binary, tfs binary, sums binary")


def limited_counts(dealt: DataFrame, keys: list[str], documents: DataFrame, least: int, df: tuple[float, float],
                   by_document: bool = True) -> DataFrame:
    """(both keys, term, tf, df, total) of the ``dealt_counts`` of terms that the ``documents`` have
    ``least`` times and that lie in ``df`` of them, ends included. The first row of a term has its
    df and total, the others nulls; without ``by_document`` there is no other."""
    names = [*keys, "term", "tf", "df", "total"]
    kinds = ", ".join(f"{k} {dealt.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(group)
        of = [pa.concat_arrays([b.column(i) for b in batches]) for i in (0, 1)]
        a, b = (x.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for x in of)
        _, row, document = np.unique(a * (b.max() + 1) + b, return_index=True, return_inverse=True)
        lists = [pc.split_pattern(x.column(3).cast(pa.string()), "\n") for x in batches]
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in lists])
        found = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        tf = np.concatenate([np.frombuffer(x, "<u4") for t in batches for x in t.column(4).to_pylist()]).astype(np.int64)
        own = found.indices.to_numpy().astype(np.int64) * len(row) + np.repeat(document, sizes)
        order = np.argsort(own, kind="stable")
        own = own[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        term, document = np.divmod(own[starts], len(row))
        tf = np.add.reduceat(tf[order], starts)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        count, total = np.diff(np.append(first, len(term))), np.add.reduceat(tf, first)
        kept = (count >= df[0]) & (count <= df[1]) & (total >= least)
        some = np.flatnonzero(np.repeat(kept, count)) if by_document else first[kept]
        head = np.zeros(len(term), bool)
        head[first] = True
        for lo in range(0, len(some), OUT_ROWS):
            at = some[lo:lo + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([
                *(k.take(pa.array(row[document[at]])) for k in of), found.dictionary.take(pa.array(term[at])), pa.array(tf[at]),
                *(pa.array(x[term[at]], pa.int64(), mask=~head[at]) for x in (count, total))], names)

    own = dealt.where("sums IS NULL").drop("sums").join(documents, keys, "left_semi")
    return own.groupBy("segment").applyInArrow(run, f"{kinds}, term string, tf long, df long, total long")


def full_buckets(summed: DataFrame, least: int) -> np.ndarray:
    """Which buckets hold ``least`` tokens and pairs of neighbours or more, by the sums of
    ``dealt_counts``: all that are that frequent are in these. One flag for each of a fixed number
    of buckets."""
    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SEGMENT_BITS, np.int64)
        for batch in group:
            for i in range(batch.num_rows):
                segment = batch.column(0)[i].as_py()
                total += np.frombuffer(batch.column(1)[i].as_py(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["segment", "full"])

    sums = summed.where("sums IS NOT NULL").select("segment", "sums")
    out = np.zeros(1 << BUCKET_BITS, bool)
    for r in sums.groupBy("segment").applyInArrow(add, "segment long, full binary").collect():
        out[r.segment << SEGMENT_BITS:(r.segment + 1) << SEGMENT_BITS] = np.unpackbits(np.frombuffer(r.full, np.uint8)).astype(bool)
    return out
