"""Benchmark decontamination by a positional inverted index of the training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import ALNUM_LOWER, WordHashes, rows_per_batch
from topictide.runtime import materialize

SEGMENT_BYTES = 2 << 20  # of text in a segment of the index
BLOCK_WORDS = 500_000  # words of benchmark items that are searched for at a time
CANDIDATES = 2_000_000  # postings followed at a time within a segment


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index, written to the shared folder and partitioned by
    documents: a row is a segment of a few hundred documents with, for each of its terms
    (64-bit hashes, sorted), the places where it stands. Places count through the segment;
    one place is left empty between documents.

    Null and empty texts have no words but keep their row; repeated rows are separate
    documents; no rows make no segment."""
    key = F.col(id_col)
    rows = docs.select(key.alias("_key"), F.col(text_col).cast("string").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]):
        hashes, segment = WordHashes(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in rows_per_batch(whole, "_text", SEGMENT_BYTES):
                segment += 1
                ids, n_words, flat, known = batch.column(0), [], [], {}
                for text in batch.column(1).to_pylist():
                    words = text.translate(ALNUM_LOWER).split() if text else []
                    flat += [known.setdefault(w, len(known)) for w in words]
                    n_words.append(len(words))
                counts = np.array(n_words, np.int64)
                term = hashes(list(known))
                order = np.argsort(term)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                of = rank[np.array(flat, np.int64)] if flat else np.empty(0, np.int64)
                places = np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)
                postings = places[np.argsort(of, kind="stable")]
                yield pa.RecordBatch.from_arrays([
                    pa.array([segment]), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (
                        counts.astype("<u4"), term[order], np.bincount(of, minlength=len(order)).astype("<u4"),
                        postings.astype("<u4")))], ["segment", "ids", "n_words", "terms", "lengths", "postings"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"segment long, ids array<{kind}>, n_words binary, terms binary, lengths binary, postings binary"))


def _windows(items: list, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(item number, terms) of all windows, grouped by how many words they have."""
    hashes, groups = WordHashes(), {}
    for number, text in enumerate(items):
        words = text.encode().translate(ALNUM_LOWER).split() if text else []
        if words:
            h = hashes(words)
            w = min(width, len(h))
            groups.setdefault(w, []).extend((number, h[i:i + w]) for i in range(len(h) - w + 1))
    return [(np.array([n for n, _ in g]), np.array([h for _, h in g])) for _, g in sorted(groups.items())]


def term_counts(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often the wanted terms stand in all documents; they are at most a block's words."""
    sent = index.sparkSession.sparkContext.broadcast(np.unique(wanted))

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, lengths = np.frombuffer(terms, "<u8"), np.frombuffer(lengths, "<u4")
                at = np.searchsorted(terms, sent.value)
                found = at < len(terms)
                found[found] = terms[at[found]] == sent.value[found]
                total[found] += lengths[at[found]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    rows = index.select("terms", "lengths").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r.term % 2**64: r.n for r in rows}


class Segment:
    """A row of the index, to be searched."""

    def __init__(self, terms: bytes, lengths: bytes, postings: bytes):
        self.terms = np.frombuffer(terms, "<u8")
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.postings = np.frombuffer(postings, "<u4").astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, self.lengths) + self.postings

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms in this segment, -1 where there is none."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(terms.shape, -1)

    def rarest_places(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into term, place) of all postings of the terms, some at a time."""
        n = self.lengths[term]
        upto = np.cumsum(n)
        for lo in np.unique(np.searchsorted(upto, np.arange(0, max(int(upto[-1]) if len(upto) else 0, 1), CANDIDATES), "right")):
            done = int(upto[lo - 1]) if lo else 0
            hi = max(int(np.searchsorted(upto, done + CANDIDATES, "right")), lo + 1)
            part = np.arange(lo, min(hi, len(term)))
            which = np.repeat(part, n[part])
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            yield which, self.postings[self.starts[term[which]] + inside]

    def exact(self, number: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences. ``number`` holds the terms of a window from
        the rarest on, ``offset`` their places in it: lists are shifted by the offset and
        intersected one after another."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for which, place in self.rarest_places(number[:, 0]):
            start = place - offset[which, 0]
            for k in range(1, number.shape[1]):
                if not len(start):
                    break
                want = (number[which, k] << 32) + start + offset[which, k]
                at = np.searchsorted(self.keys, want)
                at[at == len(self.keys)] = 0
                hit = (self.keys[at] == want) & (start >= 0)
                which, start = which[hit], start[hit]
            found.append((which[start >= 0], start[start >= 0]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def near(self, number: np.ndarray, slop: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its rarest term) where every other term stands within ``slop``
        places in the same document; first and last are the places a document takes."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for which, place in self.rarest_places(number[:, 0]):
            doc = np.searchsorted(first, place, "right") - 1
            low, high = np.maximum(place - slop, first[doc]), np.minimum(place + slop, last[doc])
            for k in range(1, number.shape[1]):
                term = number[which, k] << 32
                at = np.searchsorted(self.keys, term + low)
                hit = at < len(self.keys)
                hit[hit] = self.keys[at[hit]] <= (term + high)[hit]
                which, place, low, high = which[hit], place[hit], low[hit], high[hit]
            found.append((which, place))
        return tuple(np.concatenate(x) for x in zip(*found))


def _spans(doc: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[int, list]:
    """By document the spans of each item, overlapping and touching ones as one."""
    out: dict[int, list] = {}
    order = np.lexsort((start, item, doc))
    for d, i, a, b in zip(*(x[order].tolist() for x in (doc, item, start, stop))):
        spans = out.setdefault(d, [])
        if spans and spans[-1][0] == i and a <= spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], b)
        else:
            spans.append([i, a, b])
    return out


def search(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = None, item_col: str = "item_id",
           text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, matches) for every document of the index. ``matches`` holds the spans
    (item, start, stop), in words, that windows of ``width`` consecutive item words cover;
    an item of fewer words is one window. With ``slop`` a match is a place where all words
    of a window stand, in any order, within that many words of its rarest one.

    Items without words match nothing; items with the same id are taken together; items
    are searched in blocks of about ``block_words`` words, which bounds what is broadcast."""
    spark = index.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.length("text") / 6 + 1)).first()[0] or 0
    n_blocks = max(1, int(-(-words // block_words)))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"_row string, id {kind}, n_words long, matches array<struct<item:string,start:long,stop:long>>"
    blocks = []
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        names, groups = [r.item for r in rows], _windows([r.text for r in rows], width)
        counts = term_counts(index, np.concatenate([g.ravel() for _, g in groups])) if groups else {}
        ranked = []
        for item, terms in groups:
            n = np.array([[counts.get(t, 0) for t in row] for row in terms.tolist()])
            known = (n > 0).all(axis=1)  # a window with a word that no document has is nowhere
            order = np.argsort(n[known], axis=1, kind="stable")
            ranked.append((item[known], np.take_along_axis(terms[known], order, 1), order))
        blocks.append(_search_block(index, spark.sparkContext.broadcast((names, ranked)), slop, schema))
    if n_blocks > 1:
        every = blocks[0]
        for more in blocks[1:]:
            every = every.unionAll(more)
        blocks = [every.groupBy("_row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                                            F.flatten(F.collect_list("matches")).alias("matches"))]
    return blocks[0].select("id", "n_words", "matches")


def _search_block(index: DataFrame, sent, slop: int | None, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        names, ranked = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment, ids, n_words, *packed = (batch.column(i)[row].as_py() for i in range(6))
                part = Segment(*packed)
                n = np.frombuffer(n_words, "<u4").astype(np.int64)
                first = np.cumsum(n + 1) - (n + 1)
                found = [[np.empty(0, np.int64)] * 4]
                for item, terms, order in ranked:
                    number = part.numbers(terms)
                    here = (number >= 0).all(axis=1)
                    if not here.any():
                        continue
                    if slop is None:
                        which, place = part.exact(number[here], order[here])
                        stop = place + terms.shape[1]
                    else:
                        which, place = part.near(number[here], slop, first, first + n - 1)
                        stop = place + 1
                    doc = np.searchsorted(first, place, "right") - 1
                    found.append([doc, item[here][which], place - first[doc], stop - first[doc]])
                spans = _spans(*(np.concatenate(x) for x in zip(*found)))
                matches = [[{"item": names[i], "start": a, "stop": b} for i, a, b in spans.get(d, ())] for d in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(
                    ([f"{segment}/{d}" for d in range(len(ids))], ids, n, matches), arrow)], schema=arrow)

    return index.select("segment", "ids", "n_words", "terms", "lengths", "postings").mapInArrow(run, schema)


def hit_words(matches: str = "matches"):
    """How many words the spans cover, each counted once."""
    return F.aggregate(
        F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), m["stop"].alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["b"]).alias("upto")),
        lambda acc: acc["n"])
