"""Benchmark decontamination with a generalised suffix automaton over the test items' words.

The automaton holds every word sequence of every item. Training texts stream through it; at each
word the longest sequence that ends there and occurs in an item is known, and by the suffix links
every shorter one, which may occur in shorter items. A span is removed when it has ``max_words``
words, or covers ``max_coverage`` of an item that contains it (and has ``min_words`` at least).
Words are as in ``text``: case, punctuation and white space don't matter.

Only runs of words whose every neighbouring pair occurs in some item can hold such a span, so the
pairs are tested in numpy and the automaton walks those runs alone; nothing is lost by that.
"""

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Longer than any item: the shortest item of a state that none has reached.
NO_ITEM = (1 << 31) - 1


class Automaton:
    """Generalised suffix automaton; each state knows the shortest item that contains it.

    States are numbers in flat arrays. Most have one way on, which lies in ``word`` and ``to``;
    only further ones are in dictionaries. That is about 150 bytes a word of the items.
    """

    def __init__(self, items: list[list[int]]):
        self.word, self.to = array("i"), array("i")
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.item = array("i"), array("i"), array("i")
        self._new(0, -1)
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # the shortest item of each state: walk every item again, then pass on along suffix links
        for words in items:
            s = 0
            for w in words:
                s = self.go(s, w)
                self.item[s] = min(self.item[s], len(words))
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[:0:-1].tolist():
            up = self.link[s]
            self.item[up] = min(self.item[up], self.item[s])

    def go(self, s: int, w: int) -> int:
        """The state after ``w``, -1 where there is none."""
        if self.word[s] == w:
            return self.to[s]
        more = self.more.get(s)
        return more.get(w, -1) if more else -1

    def _set(self, s: int, w: int, q: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, q
        else:
            self.more.setdefault(s, {})[w] = q

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        new = len(self.link)
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(-1 if like is None else self.to[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.length.append(length)
        self.link.append(link)
        self.item.append(NO_ITEM)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], q)
        while p >= 0 and self.go(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.go(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._new(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self.go(p, w) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self.go(p, w)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def walk(self, words):
        """(state, longest match length) after each word."""
        s = n = 0
        for w in words:
            q = self.go(s, w)
            while s and q < 0:
                s = self.link[s]
                n = self.length[s]
                q = self.go(s, w)
            s, n = (q, n + 1) if q >= 0 else (0, 0)
            yield s, n


class Matcher:
    """The automaton of some items, with the tests that come before it."""

    def __init__(self, item_texts: list[str], max_words: int, max_coverage: float, min_words: int):
        vocab, ids, offsets = X.words(pa.array(item_texts, pa.large_string()))
        self.vocab = vocab
        items = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:]) if b > a]
        self.automaton = Automaton(items)
        self.max_words, self.max_coverage, self.min_words = max_words, max_coverage, min_words
        self.need = min([max_words, *(self.limit(len(x)) for x in items)])
        # of each state, the length of the longest sequence at or above it that reaches the limit of its own shortest item
        a = self.automaton
        self.over = array("i", bytes(4 * len(a.link)))
        for s in np.argsort(np.frombuffer(a.length, np.int32), kind="stable")[1:].tolist():
            self.over[s] = a.length[s] if a.length[s] >= self.limit(a.item[s]) else self.over[a.link[s]]
        pairs = [a * len(vocab) + b for x in items for a, b in zip(x, x[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))

    def limit(self, item_words: int) -> int:
        """Words from which a span inside an item of this length is removed."""
        return max(1, min(self.max_words, max(self.min_words, math.ceil(self.max_coverage * item_words)))) if item_words < NO_ITEM else self.max_words

    def spans(self, vocab: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Row -> merged [from, to) word spans over a limit."""
        if not len(ids) or not len(self.vocab):
            return {}
        known = pc.fill_null(pc.index_in(vocab, value_set=self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
        row = X.row_of(offsets)
        if self.need >= 2:
            pair = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (row[:-1] == row[1:]))
            key = known[pair] * len(self.vocab) + known[pair + 1]
            at = np.searchsorted(self.pairs, key)
            hit = pair[self.pairs[np.minimum(at, len(self.pairs) - 1)] == key] if len(self.pairs) else pair[:0]
            breaks = np.flatnonzero((np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])) if len(hit) else []
            starts, ends = np.concatenate([hit[:1], hit[1:][breaks]]), np.concatenate([hit[:-1][breaks], hit[-1:]]) + 2
        else:
            starts = np.flatnonzero(known >= 0)
            ends = starts + 1
        out: dict[int, list[tuple[int, int]]] = {}
        long = ends - starts >= self.need
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            r = int(row[a])
            for i, (s, n) in enumerate(self.automaton.walk(known[a:b].tolist())):
                if n < self.need:
                    continue
                if n < self.limit(self.automaton.item[s]):
                    n = self.over[self.automaton.link[s]]
                if n:
                    lo, hi = a + i + 1 - n - int(offsets[r]), a + i + 1 - int(offsets[r])
                    own = out.setdefault(r, [])
                    while own and own[-1][1] >= lo:
                        lo = min(lo, own.pop()[0])
                    own.append((lo, hi))
        return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what lies between a span and the next token goes with it.

    Tokens and words are taken by the same Arrow kernels as in ``text.words``, as other libraries
    differ in what is white space, a letter or a number.
    """
    tokens = pc.utf8_split_whitespace(pa.array([text], pa.large_string())).flatten()
    is_word = pc.not_equal(X.normalise(tokens), "").to_pylist()
    starts, ends, at = [], [], 0
    for t in tokens.to_pylist():
        at = text.index(t, at)  # only white space lies before it
        starts.append(at)
        at += len(t)
        ends.append(at)
    word = [k for k, w in enumerate(is_word) if w]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : starts[word[a]]])
        last = word[b - 1]
        done = starts[last + 1] if last + 1 < len(starts) else len(text)
        if last + 1 < len(starts) and starts[last + 1] == ends[last + 1]:
            done = len(text)  # the empty token behind white space that ends a text
    out.append(text[done:])
    return "".join(out)


def _groups(items: DataFrame, item_col: str, group_words: int):
    """The distinct items, a bounded number of words at a time."""
    group, size = [], 0
    for r in items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string")).distinct().orderBy(item_col).toLocalIterator():
        n = len(r[0].split()) + 1
        if group and size + n > group_words:
            yield group
            group, size = [], 0
        group.append(r[0])
        size += n
    yield group


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "text", max_words: int = 13, max_coverage: float = 0.7, min_words: int = 8, group_words: int = 500_000, removed: str | None = None) -> DataFrame:
    """``docs`` with the spans of test items cut from ``text_col``.

    A document that loses all its words goes; every other row stays, and a text without such a
    span stays as it is. Null, empty and wordless texts stay. Repeated rows are treated alike, each
    on its own; very long texts are read whole. Null and empty items match nothing, repeated items
    count once; no items at all leave ``docs`` as it is. With ``removed``, a column of that name
    (underscored where it clashes) counts the words cut.

    The items' automaton is broadcast. Items of more than ``group_words`` words together (about 75
    MB) make several automata, built one after the other and used so on the same whole texts, so
    none outgrows the driver or a worker.
    """
    spans_col, count_col = X.fresh(docs, "leak_spans"), X.fresh(docs, removed or "leak_words")
    spans_type = T.ArrayType(T.LongType())
    out, shared = docs, None
    for i, group in enumerate(_groups(items, item_col, group_words)):
        if shared is not None:
            out = out.mapInArrow(_pass(shared, text_col, spans_col, count_col, i > 1, False), X.with_fields(docs, (spans_col, spans_type)))
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(group, max_words, max_coverage, min_words))
    out = out.mapInArrow(_pass(shared, text_col, spans_col, count_col, i > 0, True), X.with_fields(docs, (count_col, T.LongType())))
    kept = out.where(F.col(count_col) >= 0)
    return kept if removed else kept.select(*docs.columns)


def _pass(shared, text_col: str, spans_col: str, count_col: str, more: bool, last: bool):
    def run(batches):
        m = shared.value
        for b in X.steps(batches, text_col):
            i = b.schema.get_field_index(text_col)
            arr = X.texts(b.column(i))
            vocab, ids, offsets = X.words(arr)
            found = m.spans(vocab, ids, offsets)
            if more:
                for r, flat in enumerate(b.column(b.schema.get_field_index(spans_col)).to_pylist()):
                    if flat:
                        found[r] = merge([*found.get(r, []), *zip(flat[::2], flat[1::2])])
                b = b.drop_columns([spans_col])
            if not last:
                lists = [[x for s in found.get(r, []) for x in s] for r in range(b.num_rows)]
                yield X.append_columns(b, **{spans_col: pa.array(lists, pa.list_(pa.int64()))})
                continue
            counts = np.zeros(b.num_rows, np.int64)
            if found:
                new = arr.to_pylist()
                for r, spans in found.items():
                    new[r] = cut_words(new[r], spans)
                    counts[r] = sum(y - x for x, y in spans)
                    if counts[r] == offsets[r + 1] - offsets[r]:
                        counts[r] = -1
                texts = pa.array(new, pa.large_string())
                b = X.set_column(b, text_col, pc.if_else(pc.is_null(b.column(i)), pa.scalar(None, pa.large_string()), texts).cast(b.schema.field(i).type))
            yield X.append_columns(b, **{count_col: pa.array(counts)})

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
