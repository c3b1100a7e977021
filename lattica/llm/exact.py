"""Exact deduplication with two passes of a Bloom filter.

Pass one fills a counting filter of two saturating bits a cell from the hashes of all texts: a
cell holds "none", "one" or "more". Each task sends only the cells it touched (sparse per segment
of the filter, dense where that is smaller), so what is shuffled follows the rows and not the
size of the filter. Pass two tests every row: a text that occurs twice has "more" in all of its
cells, so rows that fail the test are unique for certain and pass straight through. Only the rest
shuffle, are grouped by the hash and compared by the text itself.

The filter is sized by the counted rows and bounded by ``max_filter_bytes``; beyond the bound more
unique rows take the shuffled path, and the result stays exact.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

SEGMENT = 1 << 16  # cells
PROBES = 4


def filter_cells(rows: int, max_filter_bytes: int, cells_per_row: int = 16) -> int:
    """A power of two: at least one segment, at most the bound (a cell takes one bit in pass two)."""
    want = 1 << max(16, int(np.ceil(np.log2(max(1, rows) * cells_per_row))))
    return min(want, 1 << int(np.log2(max(max_filter_bytes, SEGMENT // 8) * 8)))


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    """rows x PROBES distinct-or-equal cell numbers of each hash."""
    a = X.mix64(h.astype(np.uint64))
    b = X.mix64(a) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + k[None, :] * b[:, None]) & np.uint64(cells - 1)).astype(np.int64)


def _touch(batches, cells: int):
    """Cells touched once and more than once by a task, one record a segment."""
    once, more = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(once, more, c):
        u, n = np.unique(c, return_counts=True)
        both = np.isin(u, once, assume_unique=True)
        again = u[(n > 1) | both]
        return np.union1d(once, u), np.union1d(more, again)

    for b in batches:
        h = b.column(0).drop_null().to_numpy(zero_copy_only=False)
        c = np.sort(cells_of(h, cells), axis=1)
        # a row counts once for each of its cells
        distinct = np.ones(c.shape, bool)
        distinct[:, 1:] = c[:, 1:] != c[:, :-1]
        once, more = merge(once, more, c[distinct])
    for seg in np.unique(once // SEGMENT) if len(once) else ():
        o = once[np.searchsorted(once, seg * SEGMENT) : np.searchsorted(once, (seg + 1) * SEGMENT)] - seg * SEGMENT
        m = more[np.searchsorted(more, seg * SEGMENT) : np.searchsorted(more, (seg + 1) * SEGMENT)] - seg * SEGMENT
        yield pa.RecordBatch.from_pydict({"seg": pa.array([int(seg)], pa.int64()), "once": pa.array([_pack(o)], pa.binary()), "more": pa.array([_pack(m)], pa.binary())})


def _pack(c: np.ndarray) -> bytes:
    """Sorted cells of a segment as 16-bit numbers, or as bits where that is shorter."""
    if 2 * len(c) < SEGMENT // 8:
        return b"s" + c.astype(np.uint16).tobytes()
    bits = np.zeros(SEGMENT, bool)
    bits[c] = True
    return b"d" + np.packbits(bits).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    bits = np.zeros(SEGMENT, bool)
    if x[:1] == b"s":
        bits[np.frombuffer(x, np.uint16, offset=1)] = True
    else:
        bits[:] = np.unpackbits(np.frombuffer(x, np.uint8, offset=1)).astype(bool)
    return bits


def _merge_segments(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    once, more = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for o, m in zip(table["once"].to_pylist(), table["more"].to_pylist()):
        o = _unpack(o)
        more |= _unpack(m) | (once & o)
        once |= o
    return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(more).tobytes()], pa.binary())})


def repeated_filter(hashes: DataFrame, cells: int) -> np.ndarray:
    """The bits (packed, cells / 8 bytes) of the cells that more than one row touches.

    ``hashes`` has one long column; nulls are left out.
    """
    touched = hashes.mapInArrow(lambda it: _touch(it, cells), "seg long, once binary, more binary")
    merged = touched.groupBy("seg").applyInArrow(_merge_segments, "seg long, bits binary")
    out = np.zeros(cells // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["seg"] * (SEGMENT // 8) : (r["seg"] + 1) * (SEGMENT // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row of each distinct text, that of the smallest id; the columns of ``docs``.

    Texts are equal when all their characters are. Rows with a null text are no copies of anything
    and all stay; the empty text is a text like any other. Null ids come after all others. Among
    rows with the same text and id the one with the smallest hash of its other columns stays. Very
    long texts are compared whole, clashing column names do no harm, and an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).count()
    cells = filter_cells(rows, max_filter_bytes)
    bits = repeated_filter(docs.select(F.xxhash64(text_col).alias("h")).where(F.col(text_col).isNotNull()), cells)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        c = cells_of(h.to_numpy().astype(np.int64), cells)
        b = shared.value
        return pd.Series(((b[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).all(axis=1))

    mark, rank, h1 = (X.fresh(docs, n) for n in ("maybe_repeated", "copy_rank", "text_hash"))
    marked = docs.withColumn(mark, F.col(text_col).isNotNull() & maybe(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    alone = marked.where(~F.col(mark)).select(*docs.columns)
    again = marked.where(F.col(mark)).withColumn(h1, F.xxhash64(text_col))
    # the rank filter is also applied before the shuffle, so a text of many copies sends one a task
    other = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    ties = [F.xxhash64(*other)] if other else []
    w = Window.partitionBy(h1, text_col).orderBy(F.col(id_col).asc_nulls_last(), *ties)
    first = again.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*docs.columns)
    return alone.unionByName(first)
