"""SimHash near-deduplication with the nearest-neighbour recursion of May and Ozerov.

A text's fingerprint has 128 bits: the signs of the summed hashes of its distinct words, words of
more than three characters weighing three times as much as shorter ones. Two texts are near copies
when their fingerprints differ in at most ``max_distance`` bits.

Search: draw random coordinate strips; the weight of a fingerprint on a strip (its partial weight)
decides the list it falls into, and two near fingerprints have equal partial weights with a known
probability. The top strips make lists that one task holds; inside it each list is filtered by the
weights on further random strips into small lists, which are searched by brute force. Both levels
repeat until a pair at ``design_distance`` is met with probability ``target_recall``. A small list
that stays large (many near copies) is searched in blocks, never cut off.

Pairs are only kept as a spanning forest of each list; the groups are the connected components.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

BITS = 128
STRIP = 2  # coordinates a strip
HEAVY, LIGHT, SHORT = 3, 1, 3


# == fingerprints
def fingerprints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """rows x 2 words of 64 bits, and whether the row has any word."""
    vocab, ids, offsets = X.words(arr)
    n = len(offsets) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.diff(offsets) > 0
    if not some.any():
        return out, some
    row = X.row_of(offsets)
    key = np.unique(row * np.int64(len(vocab)) + ids)  # distinct words of each row
    row, word = key // len(vocab), key % len(vocab)
    h = X.hash64(vocab)
    length = _lengths(vocab)
    weight = np.where(length > SHORT, HEAVY, LIGHT).astype(np.uint8)
    # bytes of 0 / weight for each bit; sums stay below 256 for GROUP words at a time
    both = np.stack([X.mix64(h), X.mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A))], axis=1)
    group = 255 // HEAVY
    total = np.zeros((n, BITS), np.int32)
    start = np.searchsorted(row, np.arange(n + 1))
    chunk = 1 << 18
    at = 0
    while at < len(row):
        to = min(at + chunk, len(row))
        w = word[at:to]
        bits = np.unpackbits(both[w].view(np.uint8).reshape(len(w), BITS // 8), axis=1)
        bits *= weight[w][:, None]
        lanes = bits.view(np.uint64)  # 8 counters a lane
        r = row[at:to]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        inside = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        cut = np.flatnonzero(inside % group == 0)
        sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).reshape(len(cut), BITS)
        rr = r[cut]
        heads = np.flatnonzero(np.diff(rr, prepend=-1))
        total[rr[heads]] += np.add.reduceat(sums, heads, axis=0, dtype=np.int32)
        at = to
    wsum = np.zeros(n, np.int64)
    np.add.at(wsum, row, weight[word].astype(np.int64))
    assert start[-1] == len(row)
    signs = (2 * total > wsum[:, None]).astype(np.uint8)
    out = np.packbits(signs, axis=1).view(">u8").astype(np.uint64).reshape(n, 2)
    return out, some


def _lengths(vocab: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.utf8_length(vocab).to_numpy(zero_copy_only=False)


def _type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo) of every row with an id and at least one word."""

    def run(batches):
        for b in X.steps(batches, "t"):
            fp, some = fingerprints(X.texts(b.column(1)))
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(fp[some, 0]), pa.array(fp[some, 1])], names=["id", "hi", "lo"])

    narrow = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(X.plain_id(docs, id_col).alias("id"), F.col(text_col).alias("t"))
    return narrow.mapInArrow(run, f"id {_type(narrow)}, hi long, lo long")


# == the plan of the search
@dataclass(frozen=True)
class Plan:
    top_strips: int
    top_repeats: int
    strips: int
    repeats: int
    max_distance: int
    leaf: int
    seed: int


def keep_probability(distance: int, strips: int, width: int = STRIP, bits: int = BITS) -> float:
    """Chance that two fingerprints at this distance have equal weights on disjoint random strips.

    Differing coordinates are taken to fall independently (rate distance / bits), each raising or
    lowering the weight with equal chance.
    """
    d = distance / bits
    one = sum(math.comb(width, k) * d**k * (1 - d) ** (width - k) * (math.comb(k, k // 2) / 2**k if k % 2 == 0 else 0) for k in range(width + 1))
    return one**strips


def make_plan(n: int, max_distance: int, design_distance: int, target_recall: float, leaf: int = 256, list_size: int = 1 << 15, seed: int = 17) -> Plan:
    """Strips from the number of fingerprints, repeats from the recall wanted (shared by both levels)."""
    p = np.array([math.comb(STRIP, k) for k in range(STRIP + 1)]) / 2**STRIP
    bits = -math.log2(float((p**2).sum()))  # by which a strip shrinks the list a fingerprint meets
    top = max(2, math.ceil(math.log2(max(2, n / list_size)) / bits))
    rest = max(0, math.ceil(math.log2(max(1, n * 2 ** (-top * bits) / leaf)) / bits))
    miss = (1 - target_recall) / 2

    def repeats(strips: int) -> int:
        q = keep_probability(design_distance, strips)
        return 1 if q >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - q)))

    return Plan(top, repeats(top), rest, repeats(rest) if rest else 1, max_distance, leaf, seed)


def strip_key(hi: np.ndarray, lo: np.ndarray, strips: int, rng: np.random.Generator) -> np.ndarray:
    """The partial weights on ``strips`` disjoint random strips, as one number.

    More strips than coordinates allow start a new draw of coordinates.
    """
    key = np.zeros(len(hi), np.uint64)
    order = np.zeros(0, int)
    for _ in range(strips):
        if len(order) < STRIP:
            order = rng.permutation(BITS)
        coords, order = order[:STRIP], order[STRIP:]
        w = np.zeros(len(hi), np.uint64)
        for c in coords:
            word, shift = (hi, 63 - c) if c < 64 else (lo, 127 - c)
            w += (word >> np.uint64(shift)) & np.uint64(1)
        key = key * np.uint64(0x100000001B3) + w + np.uint64(1)
    return key


# == search inside one list
class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _near_blocks(hi: np.ndarray, lo: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int, found) -> None:
    """Every pair of neighbours in runs of a sorted array, at most ``limit`` apart, goes to ``found``."""
    for s, m in zip(start[size > 512].tolist(), size[size > 512].tolist()):
        for x in range(s, s + m, 256):
            to = min(x + 256, s + m)
            d = np.bitwise_count(hi[x:to, None] ^ hi[None, x : s + m]) + np.bitwise_count(lo[x:to, None] ^ lo[None, x : s + m])
            a, b = np.nonzero(d <= limit)
            later = b > a
            if later.any():
                found(a[later] + x, b[later] + x)
    # short runs together: position against position, one distance in the run at a time
    short = size <= 512
    s, m = start[short], size[short]
    if not len(s):
        return
    pos = np.concatenate([np.arange(a, a + k) for a, k in zip(s.tolist(), m.tolist())]) if len(s) < 64 else np.repeat(s, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
    left = np.repeat(s + m, m) - pos  # members from here to the end of the run
    step = 1
    while True:
        keep = left > step
        if not keep.all():
            pos, left = pos[keep], left[keep]
        if not len(pos):
            return
        d = np.bitwise_count(hi[pos] ^ hi[pos + step]) + np.bitwise_count(lo[pos] ^ lo[pos + step])
        hit = np.flatnonzero(d <= limit)
        if len(hit):
            found(pos[hit], pos[hit] + step)
        step += 1


def search_list(hi: np.ndarray, lo: np.ndarray, plan: Plan, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent positions) of the near pairs that the recursion meets."""
    forest = _Forest(len(hi))
    for r in range(plan.repeats if plan.strips else 1):
        rng = np.random.default_rng([plan.seed, seed, r])
        key = strip_key(hi, lo, plan.strips, rng)
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        size = np.diff(np.append(start, len(k)))
        many = size > 1
        _near_blocks(hi[order], lo[order], start[many], size[many], plan.max_distance, lambda a, b, o=order: forest.join(o[a], o[b]))
    root = np.array([forest.root(x) for x in range(len(hi))], np.int64)
    child = np.flatnonzero(root != np.arange(len(hi)))
    return child, root[child]


# == groups
def near_edges(points: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) edges between ids of distinct fingerprints: a forest of each list."""

    def lists(batches):
        for b in batches:
            if not b.num_rows:
                continue
            hi, lo = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2))
            for r in range(plan.top_repeats):
                key = strip_key(hi, lo, plan.top_strips, np.random.default_rng([plan.seed, 1 << 20, r]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), r, np.int32)), pa.array(key.view(np.int64)), *b.columns], names=["rep", "key", "id", "hi", "lo"])

    def search(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")  # the forest points to smaller ids
        hi, lo = (t[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        child, parent = search_list(hi, lo, plan, (key[0].as_py() << 8) + (key[1].as_py() & 0xFF))
        return pa.table({"a": t["id"].take(pa.array(child)), "b": t["id"].take(pa.array(parent))})

    kind = _type(points)
    return points.mapInArrow(lists, f"rep int, key long, id {kind}, hi long, lo long").groupBy("rep", "key").applyInArrow(search, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component, for every id but the roots.

    Alternating large-star and small-star rounds, each cut off by a checkpoint, until nothing moves.
    """
    e = X.cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "a", "m")
        e = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = X.cut_lineage(e)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 24, design_distance: int = 22, target_recall: float = 0.95, leaf: int = 256, list_size: int = 1 << 15, seed: int = 17) -> DataFrame:
    """(id, root) of every document that is a near copy of one with a smaller id, by groups."""
    prints = X.cut_lineage(fingerprint_table(docs, id_col, text_col))
    points = prints.groupBy("hi", "lo").agg(F.min("id").alias("id")).select("id", "hi", "lo")
    # one id may have several rows; its fingerprints are then one group
    n = prints.select("hi", "lo").distinct().count()
    roots = components(near_edges(points, make_plan(n, max_distance, design_distance, target_recall, leaf, list_size, seed)).unionByName(_same_print(prints)))
    return roots


def _same_print(prints: DataFrame) -> DataFrame:
    """Edges of equal fingerprints: each id to the smallest one."""
    least = prints.groupBy("hi", "lo").agg(F.min("id").alias("b"), F.max("id").alias("c")).where("b < c").drop("c")
    return prints.join(least, ["hi", "lo"]).where("id > b").select(F.col("id").alias("a"), "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """``docs`` without near copies: of each group the document with the smallest id stays.

    Rows with a null id or text, and texts without any word, are near copies of nothing and stay.
    Ids may be of any type; those that aren't integral compare as strings. Rows that repeat an id
    are one document and stay or go together (exact deduplication, which comes first in the
    pipeline, keeps one of them). Very long texts are read whole. An empty table gives an empty
    table. Columns are those of ``docs``, whatever their names.
    """
    gone = X.fresh(docs, "near_copy_id")
    roots = near_groups(docs, id_col, text_col, **search).select(F.col("id").alias(gone))
    return docs.join(roots, X.plain_id(docs, id_col) == roots[gone], "left_anti")
