"""Language-model scores by stupid backoff: counts of hashed n-grams, partitioned by hash,
are joined to the n-grams of the documents and summed per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import ALNUM_LOWER, WordHashes, inner_windows, mix, rows_per_batch, window_hashes
from topictide.runtime import materialize

BUCKET_ENTRIES = 2_000_000  # n-grams of a hash bucket, on average
BLOCK_BYTES = 6 << 20  # of text in a block
ORDER_SALT = 0xA24BAED4963EE407


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on: those of small and
    of sorted numbers compress far better apart."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T.copy().view(kind).ravel()


def word_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n_words, ids, lengths, vocabulary, words): documents as packed words, some
    megabytes of text to a block; words are places in the block's vocabulary of hashes."""
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]):
        hashes, block = WordHashes(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in rows_per_batch(whole, "_text", BLOCK_BYTES):
                block += 1
                known: dict[bytes, int] = {}
                flat, lengths = [], []
                for text in batch.column(1).to_pylist():
                    words = text.translate(ALNUM_LOWER).split() if text else []
                    flat += [known.setdefault(w, len(known)) for w in words]
                    lengths.append(len(words))
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([len(flat)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                    *(pa.array([packed(x)], pa.binary()) for x in (
                        np.array(lengths, "<u4"), hashes(list(known)).astype("<u8"), np.array(flat, "<u4")))],
                    ["block", "n_words", "ids", "lengths", "vocabulary", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"block long, n_words long, ids array<{kind}>, lengths binary, vocabulary binary, words binary"))


class Block:
    """A block's n-grams. ``ends[k - 1]`` are the words that n-grams of k words end at, and
    ``grams`` holds all distinct ones in the order in which they are asked for."""

    def __init__(self, lengths: bytes, vocabulary: bytes, words: bytes, order: int, buckets: int):
        self.lengths = unpacked(lengths, "<u4").astype(np.int64)
        flat = unpacked(vocabulary, "<u8")[unpacked(words, "<u4")]
        self.ends, every = [], []
        for k in range(1, order + 1):
            starts = inner_windows(self.lengths, k)
            hashed = window_hashes(flat, k)
            every.append(mix(hashed[starts] + np.uint64(ORDER_SALT * k % 2**64)) if len(starts) else hashed[:0])
            self.ends.append(starts + k - 1)
        grams, place, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        bucket = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        self.grams, self.times, self.bucket = grams[by_bucket], times[by_bucket], bucket[by_bucket]
        moved = np.empty(len(grams), np.int64)
        moved[by_bucket] = np.arange(len(grams))
        self.place = np.split(moved[place].astype(np.int32), np.cumsum([len(e) for e in every])[:-1])


def ngram_counts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, bucket, counts): how often each n-gram of a block stands in the whole corpus.

    A block asks once for each of its distinct n-grams, however frequent, so a very
    frequent one is as many entries as there are blocks; a bucket adds up what the blocks
    counted and answers each of them."""
    def ask(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(*(batch.column(c)[i].as_py() for c in (1, 2, 3)), order, buckets)
                edges = np.flatnonzero(np.concatenate([[True], b.bucket[1:] != b.bucket[:-1], [True]])) if len(b.bucket) else np.array([0])
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(spans), pa.int64()), pa.array([int(b.bucket[x]) for x, _ in spans], pa.int64()),
                    pa.array([packed(b.grams[x:y].astype("<u8")) for x, y in spans], pa.binary()),
                    pa.array([packed(b.times[x:y].astype("<u4")) for x, y in spans], pa.binary())], ["block", "bucket", "grams", "times"])

    def add(part: pa.Table) -> pa.Table:
        grams = [unpacked(g, "<u8") for g in part.column("grams").to_pylist()]
        times = np.concatenate([unpacked(t, "<u4") for t in part.column("times").to_pylist()])
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(place, weights=times).astype(np.int64)[place]
        counts = [packed(c.astype("<u8" if len(total) and total.max() >= 2**32 else "<u4"))
                  for c in np.split(total, np.cumsum([len(g) for g in grams])[:-1])]
        return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "counts": pa.array(counts, pa.binary()),
                         "n": pa.array([len(g) for g in grams], pa.int64())})

    asked = blocks.select("block", "lengths", "vocabulary", "words").mapInArrow(ask, "block long, bucket long, grams binary, times binary")
    return asked.groupBy("bucket").applyInArrow(add, "block long, bucket long, counts binary, n long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, alpha: float = 0.4,
          leave_out: bool = True) -> DataFrame:
    """(id, n_words, log_score, n_backed_off) of every whole text, by the n-grams of all texts.

    A word's score is the count of the longest n-gram ending at it that occurs elsewhere,
    over the count of its first words; each word by which it is shorter than ``order``, or
    than what the text has before it, costs the factor ``alpha``. A word that occurs
    nowhere else gets one more such factor over the number of words. ``log_score`` is the
    sum of natural logs. With ``leave_out`` a document's own n-grams are taken off all
    counts, so that a text isn't likely for being in the corpus once.

    Words are lower-cased runs of letters and digits. Null texts and texts without words
    have no words and score 0; repeated rows are separate documents that know each other;
    an empty table gives no rows. N-grams are told apart by 64-bit hashes."""
    blocks = word_blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total * order // BUCKET_ENTRIES))
    answers = ngram_counts(blocks, order, buckets)
    kind = docs.schema[id_col].dataType.simpleString()

    def rate(own: pa.Table, answered: pa.Table) -> pa.Table:
        parts = [rate_block(own, i, answered) for i in range(own.num_rows)]
        return pa.concat_tables(parts)

    def rate_block(own: pa.Table, i: int, answered: pa.Table) -> pa.Table:
        b = Block(*(own.column(c)[i].as_py() for c in ("lengths", "vocabulary", "words")), order, buckets)
        by_bucket = sorted(zip(*(answered.column(c).to_pylist() for c in ("bucket", "counts", "n"))))
        counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(c, "<u8" if len(c) == 8 * n else "<u4").astype(np.int64) for _, c, n in by_bucket)])
        n_words = int(b.lengths.sum())
        doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
        inside = np.arange(n_words) - np.repeat(np.cumsum(b.lengths) - b.lengths, b.lengths)
        elsewhere = []  # by k: counts of the n-gram of k words that ends at each word
        for place, ends in zip(b.place, b.ends):
            c = counts[place]
            if leave_out and len(place):
                key = place.astype(np.int64) * len(b.lengths) + doc[ends]
                _, which, times = np.unique(key, return_inverse=True, return_counts=True)
                c = c - times[which]
            full = np.zeros(n_words, np.int64)
            full[ends] = c
            elsewhere.append(full)
        others = np.maximum(total - (b.lengths[doc] if leave_out else 0), 1)
        longest = np.minimum(inside + 1, order)
        found = np.zeros(n_words, np.int64)
        value = 1 / others
        for k in range(1, order + 1):
            base = others if k == 1 else np.concatenate([[1], elsewhere[k - 2][:-1]])
            hit = (elsewhere[k - 1] > 0) & (longest >= k)
            value = np.where(hit, elsewhere[k - 1] / np.maximum(base, 1), value)
            found = np.where(hit, k, found)
        logs = np.log(value) + (longest - found) * np.log(alpha)
        return pa.table({
            "id": own.column("ids").combine_chunks()[i].values, "n_words": b.lengths,
            "log_score": np.bincount(doc, weights=logs, minlength=len(b.lengths)),
            "n_backed_off": np.bincount(doc[found < longest], minlength=len(b.lengths)).astype(np.int64)})

    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(rate, f"id {kind}, n_words long, log_score double, n_backed_off long").withColumnRenamed("id", id_col))
