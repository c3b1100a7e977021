"""Stupid-backoff language-model scores: n-gram count tables partitioned by hash, joined to all occurrences.

Order three over the corpus's own counts, all of them. An occurrence is no evidence for itself, so
each n-gram is scored by the counts c of all *other* occurrences: a word w after u v scores
c(uvw) / c(uv) where c(uvw) > 0, else 0.4 c(vw) / c(v) where c(vw) > 0, else 0.16 c(w) / N (here c
counts every occurrence, so that no word scores nothing). The second word of a text has no trigram
to back off from, the first no bigram either. Logs have base ten and are summed per document in units
of 1/10,000, so sums are exact.

One row (u, v, w, document) for each occurrence of a word v goes to the partition that v hashes to.
There a count table of trigrams is made from the rows, with the counts of their bigrams and words
beside it, and looked up for each row. It settles the score of w after v, and that of v itself where
its own bigram occurs nowhere else. A partition adds up its rows by document; documents add up what
comes from all partitions.

A word with very many occurrences would make one partition large. Its occurrences go by (u, v), where
trigrams and left bigrams are counted, and by (v, w), where right bigrams are; its own count is
broadcast. All occurrences of one pair of words still meet in one partition: it opens a chunk at a
time, and keeps the distinct trigrams of each chunk and 12 bytes an occurrence.

Rows cross the network as columns of small numbers, those of a few batches of texts for one partition
together, byte by byte and compressed; sums do, too, by partition and block of documents. The README
has the bytes a word that this takes.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

UNIT = 10_000
BACKOFF = 0.4
#: Occurrences that one partition is planned for.
PARTITION_WORDS = 1_200_000
MAX_PARTITIONS = 100_000
#: Occurrences from which a word is split; the corpus has 2^20 such words at most.
HEAVY_WORDS = 1 << 20
#: Text and rows that one batch of occurrences is made from; larger ones pack tighter and need more memory.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1 << 14
#: Packed rows that are held to be squeezed together, and occurrences of one partition in a piece of them.
HELD_BYTES, PIECE = 32 << 20, 1 << 18
#: Occurrences that are opened at once.
CHUNK = 1 << 20
#: Documents whose sums are gathered in one place, as bits of their numbers.
BLOCK = 14
LAST = (1 << BLOCK) - 1
#: Words numbered from 1; all others are 59 bits of their hashes behind this bit.
FREQUENT = (1 << 15) - 1
RARE = 1 << 59
#: Occurrences in a packed row; its three columns then name fewer than 2^15 words.
PACKED = 10_900
#: The last two bits of v: which copy of an occurrence a row is.
WHOLE, LEFT, RIGHT, DOCUMENT = range(4)


def word_hash(vocab: pa.Array) -> np.ndarray:
    return (X.hash64(vocab) >> np.uint64(5)).astype(np.int64) | np.int64(RARE)


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c): the hash of each word and how often it occurs."""

    def run(batches):
        for b in X.steps(batches, "t", BATCH_BYTES):
            vocab, ids, _ = X.words(X.texts(b.column(b.schema.get_field_index("t"))))
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(vocab)), pa.array(np.bincount(ids, minlength=len(vocab)))], names=["w", "c"])

    return texts.mapInArrow(run, "w long, c long").where("c > 0").groupBy("w").agg(F.sum("c").alias("c"))


# == exploded n-grams, packed by partition
def partition_keys(n: int) -> np.ndarray:
    """For each partition a number that Spark's hash partitioning sends there."""
    out, left, at = np.full(n, -1, np.int32), n, 0
    while left:
        x = np.arange(at, at + 4 * n + 64, dtype=np.uint32)
        at += len(x)
        k = x * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        to = np.mod((h ^ (h >> np.uint32(16))).view(np.int32), n)
        where, first = np.unique(to, return_index=True)
        new = out[where] < 0
        out[where[new]] = x[first[new]].astype(np.int32)
        left -= int(new.sum())
    return out


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The position of each number in a sorted table, -1 where it isn't."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _scatter(partitions: int, shared):
    keys = partition_keys(partitions)

    def batch(b: pa.RecordBatch, base: int):
        vocab, ids, offsets = X.words(X.texts(b.column(1)))
        # documents: their ids and numbers of words
        n = b.num_rows
        sizes, number = np.diff(offsets), np.arange(n)
        names = np.stack([np.full(n, base), sizes], 1).ravel()
        codes = np.zeros((n, 4), np.int16)
        to = keys[(base + number) % partitions]
        # one packed row a document: its number of words is a name, its place in the batch is added to the base
        names[::2] += 2 * number
        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(n, DOCUMENT, np.int32)), _lists(pa.array(names), 2 * np.arange(1, n + 1)), _lists(pa.array(codes.ravel()), 4 * np.arange(1, n + 1)), b.column(0)], names=["p", "copy", "names", "codes", "id"])
        if not len(ids):
            return
        frequent, numbers, heavy = shared.value
        h = word_hash(vocab)
        at = _find(frequent, h)
        wid = np.where(at >= 0, numbers[at] if len(numbers) else 0, h)
        many = _find(heavy, wid) >= 0
        # words by their rank among those of the batch, 0 for none
        order = np.argsort(wid)
        rank = np.empty(len(wid), np.int64)
        rank[order] = np.arange(1, len(wid) + 1)
        wid, many = np.concatenate([[0], wid[order]]), np.concatenate([[False], many[order]])
        v = rank[ids]
        u, w = np.zeros_like(v), np.zeros_like(v)
        u[1:], w[:-1] = v[:-1], v[1:]
        some = sizes > 0
        first, last = offsets[:-1][some], offsets[1:][some] - 1
        u[first], w[last] = 0, 0
        second = np.zeros(len(v), bool)
        second[(first + 1)[first < last]] = True
        x = 2 * X.row_of(offsets) + second
        split = many[v]
        right = np.flatnonzero(split & (w > 0))
        mixed = X.mix64(wid.astype(np.uint64))
        to = mixed[v]
        to[split] ^= X.mix64(mixed[u[split]] + np.uint64(LEFT))
        to = np.concatenate([to, mixed[v[right]] ^ X.mix64(mixed[w[right]] + np.uint64(RIGHT))]) % np.uint64(partitions)
        copy = np.concatenate([np.where(split, LEFT, WHOLE), np.full(len(right), RIGHT)])
        u, v, w, x = (np.concatenate([a, a[right]]) for a in (u, v, w, x))
        group = to.astype(np.int64) * 4 + copy
        if (int(group.max()) + 1) * len(wid) ** 2 < 1 << 63:
            order = np.argsort((group * len(wid) + v) * len(wid) + u)
        else:  # one document of very many words
            order = np.lexsort((u, v, group))
        group, u, v, w, x = (a[order] for a in (group, u, v, w, x))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        inside = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        starts = np.flatnonzero(inside % PACKED == 0)
        ends = np.append(starts[1:], len(group))
        piece = np.repeat(np.arange(len(starts)), ends - starts)
        # the rare words of each packed row behind its base; codes are word numbers or minus the place of a name
        code = np.empty((4, len(group)), np.int16)
        rare = wid > FREQUENT
        named, where = [], []
        for k, a in enumerate((u, v, w)):
            code[k] = np.where(rare[a], 0, wid[a])
            pos = np.flatnonzero(rare[a])
            named.append(piece[pos] * len(wid) + a[pos])
            where.append((k, pos))
        distinct, back = np.unique(np.concatenate(named), return_inverse=True)
        owner = distinct // len(wid)
        count = np.bincount(owner, minlength=len(starts))
        begin = np.cumsum(count) - count
        place, done = np.arange(len(distinct)) - begin[owner] + 2, 0
        for k, pos in where:
            code[k, pos] = -place[back[done : done + len(pos)]]
            done += len(pos)
        code[3] = x
        names = np.empty(len(distinct) + len(starts), np.int64)
        names[begin + np.arange(len(starts))] = base
        names[np.arange(len(distinct)) + owner + 1] = wid[distinct % len(wid)]
        # columns one after the other in each packed row
        size = ends - starts
        flat = np.empty(4 * len(group), np.int16)
        at = 4 * starts[piece] + inside - inside[starts][piece]
        for k in range(4):
            flat[at + k * size[piece]] = code[k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[group[starts] // 4]), pa.array((group[starts] % 4).astype(np.int32)), _lists(pa.array(names), np.cumsum(count + 1)), _lists(pa.array(flat), 4 * ends), pa.nulls(len(starts), b.schema.field(0).type)],
            names=["p", "copy", "names", "codes", "id"],
        )

    def run(batches):
        part, rows = TaskContext.get().partitionId(), 0
        for b in X.steps(batches, "t", BATCH_BYTES):
            for at in range(0, b.num_rows, BATCH_ROWS):
                few = b.slice(at, BATCH_ROWS)
                yield from batch(few, (part << 40) | (2 * rows))
                rows += few.num_rows

    return run


# == packed rows, squeezed
def _planes(x: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: small numbers leave planes of like bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _open_planes(raw: memoryview, kind, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _rows(schema: pa.Schema, keys: list, blocks: list, raws: list[bytes], ids: list | None = None) -> pa.RecordBatch:
    codec = pa.Codec("zstd", 1)
    n = len(keys)
    of_ids = pa.nulls(n, schema.field(4).type) if ids is None else _lists(pa.concat_arrays(ids), np.cumsum([len(x) for x in ids])).cast(schema.field(4).type)
    columns = [pa.array(keys, pa.int32()), pa.array(blocks, pa.int64()), pa.array([len(x) for x in raws], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raws], pa.binary()), of_ids]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    """raw is the size of ``blob`` before it was squeezed; ``block`` is that of the documents, -1 for occurrences."""
    return pa.schema([pa.field("p", pa.int32(), False), pa.field("block", pa.int64(), False), pa.field("raw", pa.int64(), False), pa.field("blob", pa.binary(), False), pa.field("ids", pa.list_(id_type))])


def _order(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions of slices of the given sizes and starts, one slice after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _squeeze(parts: list[pa.RecordBatch]):
    """The packed rows of a few batches by partition, and their documents by block."""
    t = pa.Table.from_batches(parts).combine_chunks()
    schema = _schema(t.schema.field("id").type)
    to, copy = t["p"].to_numpy(), t["copy"].to_numpy()
    names, codes = (t[k].combine_chunks() for k in ("names", "codes"))
    name_at, code_at = (x.offsets.to_numpy().astype(np.int64) for x in (names, codes))
    names, codes = names.values.to_numpy(), codes.values.to_numpy()
    own = np.flatnonzero(copy == DOCUMENT)
    if len(own):
        d, size = names[name_at[own]] >> 1, names[name_at[own] + 1]
        ids = t["id"].combine_chunks().take(pa.array(own))
        cuts = np.flatnonzero(np.diff(d >> BLOCK, prepend=-1)).tolist()
        spans = list(zip(cuts, [*cuts[1:], len(d)]))
        yield _rows(schema, [int(to[own[i]]) for i, _ in spans], [int(d[i] >> BLOCK) for i, _ in spans], [_planes(d[i:j] & LAST) + _planes(size[i:j]) for i, j in spans], [ids[i:j] for i, j in spans])
    rows = np.flatnonzero(copy != DOCUMENT)
    if not len(rows):
        return
    rows = rows[np.argsort(to[rows], kind="stable")]
    n, m, to = np.diff(code_at)[rows] // 4, np.diff(name_at)[rows], to[rows]
    names = names[_order(m, name_at[rows])]
    at = _order(n, code_at[rows])
    step = np.repeat(n, n)
    columns = [codes[at + k * step] for k in range(4)]
    del at, step
    # a partition's rows in pieces, so that no piece is too large to be opened
    ends = np.cumsum(n)
    first = np.flatnonzero(np.diff(to, prepend=-1))
    inside = (ends - n) - np.repeat((ends - n)[first], np.diff(np.append(first, len(to))))
    cuts = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(inside // PIECE, prepend=0) != 0))
    name_ends, raws = np.cumsum(m), []
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
        x, y, r, s = int(ends[i] - n[i]), int(ends[j - 1]), int(name_ends[i] - m[i]), int(name_ends[j - 1])
        head = np.array([j - i, y - x, s - r], np.int64)
        raws.append(b"".join([head.tobytes(), _planes(np.concatenate([copy[rows[i:j]], n[i:j], m[i:j]]).astype(np.int32)), _planes(names[r:s]), *(_planes(c[x:y]) for c in columns)]))
    yield _rows(schema, to[cuts].tolist(), [-1] * len(cuts), raws)


def _squeezed(scatter):
    def run(batches):
        held, size = [], 0
        for b in scatter(batches):
            held.append(b)
            size += b.nbytes
            if size >= HELD_BYTES:
                yield from _squeeze(held)
                held, size = [], 0
        if held:
            yield from _squeeze(held)

    return run


def _open(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """v with the copy in its last two bits, u, w and x of the occurrences in these blobs."""
    codec = pa.Codec("zstd", 1)
    meta, names, codes = [], [], []
    for raw, blob in blobs:
        buf = memoryview(codec.decompress(blob, raw))
        r, n, m = np.frombuffer(buf, np.int64, 3).tolist()
        meta.append(_open_planes(buf[24:], np.int32, 3 * r).reshape(3, r))
        names.append(_open_planes(buf[24 + 12 * r :], np.int64, m))
        at = 24 + 12 * r + 8 * m
        codes.append(np.stack([_open_planes(buf[at + 2 * k * n :], np.int16, n) for k in range(4)]))
    copy, n, m = np.concatenate(meta, 1).astype(np.int64)
    names, codes = np.concatenate(names), np.concatenate(codes, 1)
    begin = np.cumsum(m) - m
    row = np.repeat(begin, n)

    def word(k: int) -> np.ndarray:
        out = codes[k].astype(np.int64)
        rare = np.flatnonzero(out < 0)
        out[rare] = names[row[rare] - out[rare] - 1]
        return out

    return word(1) * 4 + np.repeat(copy, n), word(0), word(2), names[row] + codes[3]


# == count tables
def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(x) * UNIT).astype(np.int64)


def _numbers(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's number among the distinct ones, and how many these are."""
    at, distinct = pd.factorize(x)
    return at, len(distinct)


def _trigrams(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers of v, (v, u), (v, w) and (v, u, w)."""
    (v, _), (u, us), (w, ws) = map(_numbers, (v, u, w))
    vu, _ = _numbers(v * us + u)
    return v, vu, _numbers(v * ws + w)[0], _numbers(vu * ws + w)[0]


def scored(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """What an occurrence of each trigram of a partition's count table adds to a score.

    The table has the number of occurrences c; a trigram may have several rows. The first result is
    for occurrences whose v isn't a text's second word, the other for those where it is. ``heavy``
    has the split words and their counts.
    """
    local, cuv, cvw, c3 = (np.bincount(at, c).astype(np.int64)[at] for at in _trigrams(v, u, w))
    copy, at = v & 3, _find(heavy[0], v >> 2)
    cv = np.where(at >= 0, heavy[1][at], local) if len(heavy[0]) else local
    starts, left, right = u == 0, copy != RIGHT, copy != LEFT
    first = np.zeros(len(v), np.int64)
    # the score of w after v
    tri = np.flatnonzero((w != 0) & left & ~starts & (c3 > 1))
    first[tri] = _units((c3[tri] - 1) / (cuv[tri] - 1))
    bi = np.flatnonzero((w != 0) & right & (starts | (c3 == 1)) & (cvw > 1))
    first[bi] = _units(np.where(starts[bi], 1.0, BACKOFF) * (cvw[bi] - 1) / (cv[bi] - 1))
    # that of v itself, as a word
    plain = np.flatnonzero(left & (starts | (cuv == 1)))
    second = first.copy()
    log_total = round(math.log10(total or 1) * UNIT)
    first[plain] += _units(np.where(starts[plain], 1.0, BACKOFF * BACKOFF) * cv[plain]) - log_total
    second[plain] += _units(np.where(starts[plain], 1.0, BACKOFF) * cv[plain]) - log_total
    return first, second


def _sums(d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents in order, and the sum of each. Float sums of integers below 2^53 are exact."""
    d, at = np.unique(d, return_inverse=True)
    return d, np.bincount(at, s, len(d)).astype(np.int64)


def _score(heavy, total: int):
    """Sums by document of what one partition knows; documents' own rows pass.

    Occurrences are opened a chunk at a time and kept as numbers in the chunk's own count table; the
    tables together make the partition's.
    """

    def run(batches):
        chunks, blobs, words, schema = [], [], 0, None

        def opened() -> None:
            v, u, w, x = _open(blobs)
            at = _trigrams(v, u, w)[3].astype(np.int32)
            n = int(at.max()) + 1
            one = np.empty(n, np.int64)
            one[at] = np.arange(len(at))
            chunks.append((v[one], u[one], w[one], np.bincount(at, minlength=n), at, x))

        for b in batches:
            schema = b.schema
            block = b.column(1).to_numpy()
            own = pa.array(block >= 0)
            if (block >= 0).any():
                yield b.filter(own)
            b = b.filter(pc.invert(own))
            for raw, blob in zip(b.column(2).to_pylist(), b.column(3)):
                blobs.append((raw, blob.as_buffer()))
                words += raw // 8  # not less than there are
                if words >= CHUNK:
                    opened()
                    blobs, words = [], 0
        if blobs:
            opened()
        if not chunks:
            return
        first, second = scored(*(np.concatenate([x[k] for x in chunks]) for k in range(4)), heavy.value, total)
        sums, begin = [], 0
        for v, _, _, _, at, x in chunks:
            f, s = (a[begin : begin + len(v)][at] for a in (first, second))
            begin += len(v)
            sums.append(_sums(x >> 1, np.where(x & 1, s, f)))
        del chunks[:]
        d, s = _sums(*map(np.concatenate, zip(*sums))) if len(sums) > 1 else sums[0]
        d, s = d[s != 0], s[s != 0]
        cuts = np.flatnonzero(np.diff(d >> BLOCK, prepend=-1)).tolist()
        if not cuts:
            return
        narrow = np.abs(s).max() < 1 << 31
        raws = [_planes(np.diff(d[i:j] & LAST, prepend=0).astype(np.int16)) + _planes(s[i:j].astype(np.int32 if narrow else np.int64)) for i, j in zip(cuts, [*cuts[1:], len(d)])]
        n = np.diff([*cuts, len(d)]).tolist()
        # p, which isn't read again, tells how many sums there are
        yield _rows(_schema(schema.field(4).type.value_type), n, (d[cuts] >> BLOCK).tolist(), raws)

    return run


def _gather(batches):
    """Each document's id, number of words and sum; the parts of a block are all here."""
    codec = pa.Codec("zstd", 1)
    units, own, ids = {}, [], []
    for b in batches:
        for n, block, raw, blob, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
            buf = memoryview(codec.decompress(blob.as_buffer(), raw))
            if i.is_valid:
                n = raw // 16
                own.append((block, _open_planes(buf, np.int64, n), _open_planes(buf[8 * n :], np.int64, n)))
                ids.append(i.values.take(pa.array(np.arange(n))))  # a copy, so that the batch can go
                continue
            s = units.setdefault(block, np.zeros(1 << BLOCK, np.int64))
            s[np.cumsum(_open_planes(buf, np.int16, n), dtype=np.int64)] += _open_planes(buf[2 * n :], np.int32 if raw == 6 * n else np.int64, n)
    for (block, at, size), i in zip(own, ids):
        s = units[block][at] if block in units else np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([i, pa.array(size), pa.array(s)], names=["i", "n", "s"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partition_words: int = PARTITION_WORDS, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(id, n_words, lm_logprob, lm_mean): the text's log10 score and that per word, one row a row.

    The id column keeps its name; ids that aren't integral become strings. If it is called like one
    of the others, that one gets an underscore in front. Null, empty and wordless texts have 0 words,
    score 0 and mean null. Rows that repeat an id, and null ids, have rows of their own. Counts are
    over all rows and whole texts of ``docs``. An empty table gives an empty table. Other columns are
    left out. Words are told apart by 59 bits of their hashes.
    """
    spark = docs.sparkSession
    names = [n if n.lower() != id_col.lower() else "_" + n for n in ("n_words", "lm_logprob", "lm_mean")]
    narrow = docs.select(X.plain_id(docs, id_col).alias("i"), F.col(text_col).alias("t"))
    words = X.cut_lineage(word_counts(narrow))
    total = words.agg(F.sum("c")).first()[0] or 0
    limit = max(heavy_words, total >> 20)
    # words by size class, so that only frequent ones come to the driver, and no more than are numbered
    size = F.floor(F.log2("c") * 64)
    least, room = 1 << 30, FREQUENT
    for r in words.groupBy(size.alias("k")).count().orderBy(F.desc("k")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["k"]
    top = words.where(size >= least).toPandas().sort_values(["c", "w"], ascending=[False, True], ignore_index=True)
    many = words.where(F.col("c") > limit).toPandas()
    frequent = np.argsort(top["w"].to_numpy(np.int64))
    hashes = top["w"].to_numpy(np.int64)[frequent]
    at = _find(hashes, many["w"].to_numpy(np.int64))
    own = np.where(at >= 0, frequent[at] + 1 if len(frequent) else 0, many["w"].to_numpy(np.int64))
    order = np.argsort(own)
    heavy = spark.sparkContext.broadcast((own[order], many["c"].to_numpy(np.int64)[order]))
    shared = spark.sparkContext.broadcast((hashes, frequent + 1, own[order]))
    partitions = min(MAX_PARTITIONS, max(1, math.ceil((total + int(many["c"].sum())) / partition_words)))

    kind = narrow.schema["i"].dataType
    squeezed = T.StructType([
        T.StructField("p", T.IntegerType(), False), T.StructField("block", T.LongType(), False), T.StructField("raw", T.LongType(), False),
        T.StructField("blob", T.BinaryType(), False), T.StructField("ids", T.ArrayType(kind)),
    ])
    rows = narrow.mapInArrow(_squeezed(_scatter(partitions, shared)), squeezed).repartition(partitions, "p")
    rows = rows.mapInArrow(_score(heavy, total), squeezed).repartition("block")
    sums = X.cut_lineage(rows.mapInArrow(_gather, T.StructType([T.StructField("i", kind), T.StructField("n", T.LongType()), T.StructField("s", T.LongType())])))
    units = F.col("s")
    return sums.select(
        F.col("i").alias(id_col), F.col("n").alias(names[0]), (units / F.lit(float(UNIT))).alias(names[1]),
        F.when(F.col("n") > 0, units / F.lit(float(UNIT)) / F.col("n")).alias(names[2]),
    )
