"""Shared text helpers: Arrow batches in, integer word streams out.

A *word* is a whitespace token, lower-cased, with everything that is neither a letter nor a
number removed; tokens that become empty are dropped. Only distinct tokens are normalised, so the
cost per running word is one dictionary lookup inside Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step holds at most; a single longer document is a step of its own.
STEP_BYTES = 4 << 20
NOT_WORD = r"[^\p{L}\p{N}]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, underscored until no column of ``df`` clashes with it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


#: The place of null ids: behind all others.
LAST_ID = (1 << 63) - 1


def plain_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long where its type is integral, else as a string; null where it is null."""
    integral = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return docs[id_col].cast("long" if integral else "string")


def ordered_id(docs: DataFrame, id_col: str) -> Column:
    """``plain_id`` without nulls: they come last. Ids that aren't integral compare as strings."""
    i = plain_id(docs, id_col)
    if docs.select(i).schema[0].dataType == T.LongType():
        return F.coalesce(i, F.lit(LAST_ID))
    return F.coalesce(F.concat(F.lit("s"), i), F.lit("t"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where no such folder is set, one of our own is chosen.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="lattica-checkpoint-")
        sc.setCheckpointDir(named)


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Non-null large strings of one batch column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def steps(batches: Iterator[pa.RecordBatch], col: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``col`` each; no row is dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()  # what the last slice needed goes back before the next
            at = to


def raw_tokens(arr: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct whitespace tokens, the token id of every position and the offsets of the rows."""
    lists = pc.utf8_split_whitespace(arr)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    enc = lists.flatten().dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def normalise(tokens: pa.Array) -> pa.Array:
    """The word of each token, empty where it has none."""
    return pc.replace_substring_regex(pc.utf8_lower(tokens), pattern=NOT_WORD, replacement="")


def words(arr: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word id of every position and the offsets of the rows."""
    vocab, ids, offsets = raw_tokens(arr)
    norm = normalise(vocab).dictionary_encode()
    to = norm.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = to[ids] if len(ids) else ids
    empty = pc.index(norm.dictionary, pa.scalar("", norm.dictionary.type)).as_py() if len(norm.dictionary) else -1
    if empty >= 0:
        keep = ids != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
    return norm.dictionary, ids, offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def hash64(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string that is the same in every process."""
    if not len(vocab):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocab.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, pa.field(name, values.type), values)


def append_columns(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *cols.values()], names=[*batch.schema.names, *cols])
