"""Byte-level BPE: texts to token ids and back, equal to merging pairs by rank."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.common import MEMO_ENTRIES, rows_per_batch

NEVER = 1 << 40  # above every rank


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes pieces by backtracking over the longest tokens at each place.

    Token sequences in which every two neighbours stay apart when their bytes are merged
    alone are just those that merging the whole piece gives. So tokens are taken greedily,
    longest first, and given up only where a neighbour is not compatible; each place is
    found to be a dead end once at most, which keeps the work linear in the piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_ENTRIES):
        import ahocorasick
        import regex

        self.ranks, self.memo_limit = ranks, memo
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.merged(token) == [i]:  # others appear as whole pieces only
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The ids that merging by lowest rank gives; for short byte strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            at = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(at)
            if best == NEVER:
                break
            i = at.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, t: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts of token t that touch its right (or left) end while it is merged, from
        one byte up, each with the rank of the merge that ends it."""
        known = self.spines[right].get(t)
        if known is None:
            data, inner = self.tokens[t], []
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 1:
                at = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                best = min(at)
                i = at.index(best)
                if i == (len(parts) - 2 if right else 0):
                    inner.append((parts[-1] if right else parts[0], best))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            known = self.spines[right][t] = [*inner, (data, NEVER)]
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens leaves them apart: no pair across the
        border may come before the merges that its two parts go into. Equal ranks merge
        from the left."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.memo_limit:
                self.pairs.clear()
            left, right, get = self.spine(a, True), self.spine(b, False), self.ranks.get
            i = j = 0
            known = True
            while known:
                (x, until_x), (y, until_y) = left[i], right[j]
                rank = get(x + y, NEVER)
                if rank < until_x and rank <= until_y and rank < NEVER:
                    known = False
                elif until_x == until_y == NEVER:
                    break
                elif until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = known
        return known

    def next_shorter(self, t: int) -> int | None:
        """The longest token that is a proper prefix of token t."""
        if t not in self.shorter:
            data, found = self.tokens[t], None
            for n in range(len(data) - 1, 0, -1):
                i = self.ranks.get(data[:n])
                if i is not None and self.automaton.exists(data[:n].decode("latin-1")):
                    found = i
                    break
            self.shorter[t] = found
        return self.shorter[t]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest: list[int] = [0] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = i  # ends rise, so the last is the longest
        tokens, pairs, size_of, shorter = [], self.pairs, self.sizes, self.shorter
        dead = bytearray(n + 1)
        pos, t, last = 0, longest[0], -1
        while True:
            end = pos + size_of[t]
            if not dead[end]:
                fits = last < 0 or pairs.get(last << 32 | t)
                if fits is None:
                    fits = self.compatible(last, t)
                if fits:
                    tokens.append(t)
                    if end == n:
                        return tokens
                    pos, t, last = end, longest[end], t
                    continue
            t = shorter[t] if t in shorter else self.next_shorter(t)
            while t is None:
                dead[pos] = 1
                back = tokens.pop()
                pos -= size_of[back]
                last = tokens[-1] if tokens else -1
                t = self.next_shorter(back)

    def pack(self, text: str) -> bytes:
        """The ids of all pieces of the text, as little-endian unsigned 32-bit integers."""
        pieces, out = self.pieces, []
        if len(pieces) > self.memo_limit:
            pieces.clear()
        for piece in self.find(text):
            packed = pieces.get(piece)
            if packed is None:
                ids = self.piece(piece.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    pieces[piece] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text. Between two characters that are no white space, a single
        blank always starts a piece, so what lies between such blanks is remembered whole."""
        chunks = text.split(" ")
        words = self.words
        if len(words) > self.memo_limit:
            words.clear()
        out, get = [], words.get
        for i, chunk in enumerate(chunks):
            packed = get(chunk)
            if packed is None:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self.uneven(chunks)
                packed = self.pack(" " + chunk)
                if len(chunk) <= 64:
                    words[chunk] = packed
            out.append(packed)
        first = chunks[0]
        out[0] = self.pack(first)
        return b"".join(out)

    def uneven(self, chunks: list[str]) -> bytes:
        """The same where blanks come in runs or meet other white space: chunks that touch
        such a place are encoded together with their neighbours."""
        out, held, get = [], [], self.words.get
        rough = [not c or c[0].isspace() or c[-1].isspace() for c in chunks]
        start = True
        for i, chunk in enumerate(chunks):
            held.append(chunk)
            after = i + 1 < len(chunks)
            if after and (rough[i] or rough[i + 1]):
                continue
            text = " ".join(held)
            held = []
            packed = None if start else get(text)
            if packed is None:
                packed = self.pack(text if start else " " + text)
            out.append(packed)
            start = False
        return b"".join(out)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every whole text as token ids, packed as little-endian unsigned 32-bit
    integers. Null and empty texts have no ids; repeated rows and null ids are kept as they
    come; other columns are ignored; an empty table gives none. The rank file is read by the
    driver and sent to the executors; its size is that of the vocabulary."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(ranks.value, pattern)
        for whole in batches:
            for batch in rows_per_batch(whole, "_text"):
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the packed ids with the bytes they stand for. Null ids decode to
    no bytes; an id outside the vocabulary is an error."""
    import numpy as np

    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(F.col(id_col).alias("_key"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]):
        tokens = {i: t for t, i in ranks.value.items()}
        get = tokens.__getitem__
        for whole in batches:
            for batch in rows_per_batch(whole, "_ids"):
                packed = batch.column(1).to_pylist()
                texts = [b"".join(map(get, np.frombuffer(p, "<u4").tolist())) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.binary())], [id_col, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode`` and ``decode`` in one pass, which needs half the
    Python workers. The bytes are decoded from the ids alone."""
    import numpy as np

    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(ranks.value, pattern)
        get = encoder.tokens.__getitem__
        for whole in batches:
            for batch in rows_per_batch(whole, "_text"):
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                texts = [b"".join(map(get, np.frombuffer(p, "<u4").tolist())) for p in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], [id_col, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")
