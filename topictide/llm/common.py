"""Helpers the operators share: words, hashes and passes over texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-cased letters, digits and every byte of a non-ASCII character stay; the rest parts words.
ALNUM_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MEMO_ENTRIES = 300_000  # entries a worker's look-up table may hold before it starts anew


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the fold of a row. Null has no fold."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string")) % n


def rows_per_batch(batch: pa.RecordBatch, column: str, target: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``target`` bytes of the column, so that very long texts don't meet in memory."""
    col, start, size = batch.column(column), 0, 0
    lengths = pc.binary_length(col).to_numpy(zero_copy_only=False)
    for i, n in enumerate(np.nan_to_num(lengths.astype("float64")).tolist()):
        if size and size + n > target:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, key: str, text: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """One Arrow pass over (key, text). ``make`` runs once in every task and returns a
    function from (list of keys, list of UTF-8 texts or None) to a dict of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        function = make()
        for whole in batches:
            for batch in rows_per_batch(whole, "_text"):
                out = function(batch.column("_key").to_pylist(), batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = MEMO_ENTRIES // 2):
        from xxhash import xxh3_64_intdigest

        self.hash, self.limit, self.known = xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.hash
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive items; fewer items make none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(width):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
        out += h[i:i + n] * np.uint64(factor)
    return mix(out)


def inner_windows(lengths: np.ndarray, width: int) -> np.ndarray:
    """Of texts laid one after another, where the windows start that lie within one text."""
    total = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(total) + width <= ends)


def sample_by_label(df: DataFrame, id_col: str, label_col: str, rows_per_label: int) -> DataFrame:
    """About ``rows_per_label`` rows of each label, chosen by a hash of the id, and all of a
    rarer label. Rows with a null label are left out. Labels are assumed to be few."""
    df = df.where(F.col(label_col).isNotNull())
    share = None
    for r in df.groupBy(label_col).count().collect():
        part = min(1.0, rows_per_label / r["count"])
        share = (F if share is None else share).when(F.col(label_col) == F.lit(r[label_col]), F.lit(int(part * 2**20)))
    if share is None:
        return df.where(F.lit(False))
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(2**20)) < share)


FILTER_BITS = 1 << 26  # 8 MB, whatever it stands for


def hash_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the values' hashes, of fixed size: a value whose bit is not set is not
    among them. Fuller bitmaps let more through; a join has to follow."""
    at = (F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1).alias("at")
    parts = ids.select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096:r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def may_be_among(ids: DataFrame, column: str, value: Column) -> Column:
    """Whether a value can be among the ids: surely so for those that are."""
    sent = ids.sparkSession.sparkContext.broadcast(hash_filter(ids, column))

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (at & 7)) & 1 == 1)

    return test(F.pmod(F.xxhash64(value), F.lit(FILTER_BITS)))


def texts_among(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, column: str) -> DataFrame:
    """(_id, _text) of the rows whose id can be among ``ids``; the others need not move."""
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(ids, column))
    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)).alias("_at"), F.col(id_col).alias("_id"),
                       F.col(text_col).cast("string").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]):
        bits = sent.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield batch.select(["_id", "_text"]).filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))

    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _text binary")
