"""Dynamic programming over the trie of distinct pre-tokens, one level at a time.

The sorted distinct pre-tokens are the trie: two neighbours share the nodes of their common
prefix. A node's value is computed once, whatever number of pre-tokens pass through it, from the
values of its ancestors at most the longest piece away. All nodes of one depth are one numpy step.

Pre-tokens have any length. Those of up to ``SHORT`` characters make one trie, whose probabilities
can't underflow. Longer ones make a trie of each class of lengths, in logs, where the class has
enough of them to share steps; the rest run down the same recurrence one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE = "▁"
SHORT = 31
#: Longer pre-tokens share a trie where their class has so many, none longer than ``DEEP``.
TOGETHER, DEEP = 32, 1 << 12
#: Characters of a single pre-token that are matched with the vocabulary at a time.
CHUNK = 1 << 15
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = 0x100000001B3


class Pieces:
    """A fixed public vocabulary, looked up by hashes of substrings.

    A piece matches inside one pre-token only, so pieces with an inner word mark never occur.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        self.tables, left = [], np.arange(len(keys))
        for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            at = (keys[left] * np.uint64(k)) >> np.uint64(44)
            _, first = np.unique(at, return_index=True)
            table = np.full(1 << 20, -1, np.int32)
            table[at[first]] = left[first]
            self.tables.append((np.uint64(k), table))
            left = np.delete(left, first)
            if not len(left):
                break
        assert not len(left)
        self.keys = np.append(keys, np.uint64(0))

    def __reduce__(self):
        return Pieces, (self.pieces,)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for j, c in enumerate(reversed(piece)):
            h = (h + (ord(c) + 1) * pow(_BASE, j + 1, 1 << 64)) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for k, table in self.tables:
            at = table[(h * k) >> np.uint64(44)]
            hit = self.keys[at] == h
            hit &= at >= 0
            out = np.where(hit, at, out)
        return out


@functools.lru_cache(maxsize=2)
def load_pieces(path: str = DEFAULT_VOCABULARY) -> tuple[Pieces, np.ndarray]:
    """The pieces of a sentencepiece model and their ranks, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out, rank = [], []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or SPACE in p[1:]):
            out.append(p)
            rank.append(i)
    return Pieces(out), np.array(rank)


def pretokens(vocab: pa.Array) -> tuple[list[str], np.ndarray]:
    """Marked pre-tokens of distinct white-space tokens, and the token each belongs to."""
    tokens = vocab.to_pylist()
    owner = [i for i, w in enumerate(tokens) if w]
    return [SPACE + tokens[i].replace("\0", "\ufffd") for i in owner], np.array(owner, np.int64)


def classes(items: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Positions of the short items, of each class of long ones that share a trie, and of single ones."""
    n = np.fromiter(map(len, items), np.int64, len(items))
    short = np.flatnonzero(n <= SHORT)
    together, single = [], []
    long = np.flatnonzero(n > SHORT)
    kind = np.frexp(n[long])[1]
    for c in np.unique(kind):
        at = long[kind == c]
        if len(at) >= TOGETHER and n[at].max() <= DEEP:
            together.append(at)
        else:
            single += at.tolist()
    return short, together, single


def arcs(item: str, pieces: Pieces):
    """(number of characters before, ends, lengths, pieces) of a part of the item, by ends, then lengths.

    A character that is no piece is an arc of length 1 with piece -1.
    """
    codes = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    for s in range(0, len(codes), CHUNK):
        lo = max(0, s - pieces.longest + 1)
        c = codes[lo : s + CHUNK]
        h = np.zeros(len(c), np.uint64)
        power, found = 1, []
        for k in range(1, min(pieces.longest, len(c)) + 1):
            power = power * _BASE % (1 << 64)
            h[k - 1 :] += c[: len(c) - k + 1] * np.uint64(power)
            first = max(k - 1, s - lo)
            p = pieces.find(h[first:])
            hit = np.flatnonzero(p >= 0) if k > 1 else np.arange(len(p))
            found.append((hit + first + lo - s, np.full(len(hit), k), p[hit]))
        end, k, p = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        yield s, end[order], k[order], p[order]


class Levels:
    """Depth by depth: the new nodes, their last characters and the matching pieces."""

    def __init__(self, items: list[str], pieces: Pieces):
        arr = np.array(items)
        width = max(1, arr.dtype.itemsize // 4)
        self.items, self.inverse = np.unique(arr, return_inverse=True)
        self.n = len(self.items)
        self.chars = np.ascontiguousarray(self.items.view(np.uint32).reshape(self.n, width))
        self.length = (self.chars != 0).sum(1) if self.n else np.zeros(0, int)
        self.depth = int(self.length.max()) if self.n else 0
        self.pieces = pieces
        same = np.ones(self.n, bool)
        same[:1] = False
        self.node = [np.zeros(self.n, np.int64)]
        self.first: list[np.ndarray] = [np.zeros(1, np.int64)]
        for d in range(self.depth):
            same[1:] &= self.chars[1:, d] == self.chars[:-1, d]
            # a row that ends above this depth has no node here; it never shares one either
            new = ~same & (self.length > d)
            self.node.append(np.cumsum(new) - 1)
            self.first.append(np.flatnonzero(new))

    def matches(self, d: int):
        """(length, numbers of the nodes of depth d, nodes above, pieces) for every piece that ends at d."""
        rows = self.first[d]
        h = np.zeros(len(rows), np.uint64)
        power = 1
        for k in range(1, min(d, self.pieces.longest) + 1):
            power = power * _BASE % (1 << 64)
            h = h + (self.chars[rows, d - k].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
            p = self.pieces.find(h)
            hit = np.flatnonzero(p >= 0)
            if len(hit) or k == 1:
                yield k, hit, (self.node[d - k][rows[hit]] if d > k else np.zeros(len(hit), np.int64)), p[hit]

    def bytes_at(self, d: int) -> np.ndarray:
        c = self.chars[self.first[d], d - 1]
        return 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)


def forward(items: list[str], pieces: Pieces, prob: np.ndarray, unknown: float) -> np.ndarray:
    """Log of the summed probability of all segmentations; prob: pieces x models. One row per item.

    A character that no piece covers counts as a piece of probability ``unknown`` in every model.
    """
    out = np.zeros((len(items), prob.shape[1]))
    short, together, single = classes(items)
    if len(short):
        out[short] = np.log(np.maximum(_sums(Levels([items[i] for i in short], pieces), prob, unknown, False), 1e-300))
    if together or single:
        logs = log_prob(prob, unknown)
        for at in together:
            out[at] = _sums(Levels([items[i] for i in at], pieces), logs[:-1], unknown, True)
        for i in single:
            for _, end in chain(items[i], pieces, logs):
                out[i] = end[-1]
    return out


def log_prob(prob: np.ndarray, unknown: float) -> np.ndarray:
    """Logs of the pieces' probabilities, and in the last row of an unknown character's."""
    return np.log(np.maximum(np.vstack([prob, np.full((1, prob.shape[1]), unknown)]), 1e-300))


def _sums(lv: Levels, prob: np.ndarray, unknown: float, logs: bool) -> np.ndarray:
    """Summed probabilities, or from log probabilities their logs, taken relative to the node above."""
    out = np.zeros((lv.n, prob.shape[1]))
    alpha = {0: np.zeros((1, prob.shape[1])) if logs else np.ones((1, prob.shape[1]))}
    for d in range(1, lv.depth + 1):
        rows = lv.first[d]
        up = alpha[d - 1][lv.node[d - 1][rows] if d > 1 else np.zeros(len(rows), np.int64)]
        a = np.zeros((len(rows), prob.shape[1]))
        for k, hit, above, p in lv.matches(d):
            a[hit] += np.exp(alpha[d - k][above] - up[hit] + prob[p]) if logs else alpha[d - k][above] * prob[p]
            if k == 1 and len(hit) < len(rows):
                miss = np.ones(len(rows), bool)
                miss[hit] = False
                a[miss] += unknown if logs else up[miss] * unknown
        alpha[d] = up + np.log(np.maximum(a, 1e-300)) if logs else a
        alpha.pop(d - lv.pieces.longest, None)
        end = np.flatnonzero(lv.length == d)
        out[end] = alpha[d][lv.node[d][end]]
    return out[lv.inverse]


def chain(item: str, pieces: Pieces, logs: np.ndarray):
    """The arcs of each part of one long item, and the forward log sums at all ends in the part."""
    size = pieces.longest + 1
    last = np.zeros((size, logs.shape[1]))  # the sums at position d are in row d % size
    d = 0
    for part in arcs(item, pieces):
        _, ends, k, p = part
        cut = np.flatnonzero(np.diff(ends, prepend=-1, append=-1)).tolist()
        out = np.zeros((len(cut) - 1, logs.shape[1]))
        terms = logs[p]
        for j, (x, y) in enumerate(zip(cut, cut[1:])):
            up = last[d % size]
            d += 1
            out[j] = last[d % size] = up + np.log(np.exp(last[(d - k[x:y]) % size] - up + terms[x:y]).sum(0))
        yield part, out


def best_counts(items: list[str], pieces: Pieces, score: np.ndarray, byte_score: float) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation score and its number of pieces; fewer pieces win ties.

    A character that no piece covers falls back to one piece per UTF-8 byte at ``byte_score`` each.
    """
    best, count = np.zeros(len(items)), np.zeros(len(items), np.int64)
    short, together, single = classes(items)
    for at in [short] * (len(short) > 0) + together:
        best[at], count[at] = _best(Levels([items[i] for i in at], pieces), score, byte_score)
    for i in single:
        best[i], count[i] = _chain_best(items[i], pieces, score, byte_score)
    return best, count


def _best(lv: Levels, score: np.ndarray, byte_score: float) -> tuple[np.ndarray, np.ndarray]:
    out, number = np.zeros(lv.n), np.zeros(lv.n, np.int64)
    best, count = {0: np.zeros(1)}, {0: np.zeros(1, np.int64)}
    for d in range(1, lv.depth + 1):
        rows = lv.first[d]
        b, c = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for k, hit, above, p in lv.matches(d):
            s, n = best[d - k][above] + score[p], count[d - k][above] + 1
            take = (s > b[hit]) | ((s == b[hit]) & (n < c[hit]))
            b[hit[take]], c[hit[take]] = s[take], n[take]
            if k == 1 and len(hit) < len(rows):
                miss = np.ones(len(rows), bool)
                miss[hit] = False
                up = lv.node[d - 1][rows[miss]] if d > 1 else 0
                width = lv.bytes_at(d)[miss]
                b[miss], c[miss] = best[d - 1][up] + byte_score * width, count[d - 1][up] + width
        best[d], count[d] = b, c
        best.pop(d - lv.pieces.longest, None)
        count.pop(d - lv.pieces.longest, None)
        end = np.flatnonzero(lv.length == d)
        out[end], number[end] = b[lv.node[d][end]], c[lv.node[d][end]]
    return out[lv.inverse], number[lv.inverse]


def _chain_best(item: str, pieces: Pieces, score: np.ndarray, byte_score: float) -> tuple[float, int]:
    size = pieces.longest + 1
    best, count = [0.0] * size, [0] * size
    d = 0
    for start, ends, k, p in arcs(item, pieces):
        terms = score[p].tolist()
        at = -1
        for e, k1, p1, term in zip(ends.tolist(), k.tolist(), p.tolist(), terms):
            if e != at:
                at = e
                d += 1
                b, c = -np.inf, 0
            x = (d - k1) % size
            if p1 < 0:
                width = len(item[start + e].encode("utf-8", "surrogatepass"))
                s, n = best[x] + byte_score * width, count[x] + width
            else:
                s, n = best[x] + term, count[x] + 1
            if s > b or (s == b and n < c):
                b, c = s, n
            best[d % size], count[d % size] = b, c
    return best[d % size], count[d % size]
