"""Personal data and secrets: a linear-chain conditional random field over word shapes.

Trained by gradient ascent on the likelihood of the small labelled table in ``pii_examples``,
decoded by Viterbi over all sentences of a batch at once. A token's features depend on the token
alone; its neighbours' features enter through weights of their own, so features are computed once
per distinct token of a batch. A sentence here ends with a token that ends in ``.``, ``!`` or ``?``.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as X
from .pii_examples import LABELS, labelled_table

_TOKEN = re.compile(r"\S+")
_RUNS = re.compile(r"(.)\1*", re.S)
_END = re.compile(r"[.!?]+[\"')\]]*$")
_OPEN, _CLOSE = "\"'([<{", "\"')]>},.;:!?"


# == word shapes
def features(token: str) -> tuple[str, ...]:
    """Shape features of one token."""
    core = token.strip("\"'()[]<>{},;:!?").rstrip(".") or token
    if core.isalpha() and not (core.isupper() and len(core) >= 16):
        case = "U" if core.isupper() and len(core) > 1 else "C" if core[0].isupper() else "l" if core.islower() else "M"
        return ("w", "case=" + case, "long" if len(core) > 18 else "short")
    shape = "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.isalpha() else c for c in core)
    runs = [(m.group(1), len(m.group())) for m in _RUNS.finditer(shape)]
    digits = sum(n for c, n in runs if c == "d")
    groups = [n for c, n in runs if c == "d"]
    letters = sum(n for c, n in runs if c in "lU")
    out = ["n", "shape=" + "".join(c for c, _ in runs)[:24], "set=" + "".join(sorted(set(shape))), "len=" + str(min(len(core) // 4, 8)), "digits=" + (str(digits) if digits < 20 else "20+"), "letters=" + str(min(letters, 12) // 3), "groups=" + str(min(len(groups), 6))]
    if len(runs) <= 9:
        out.append("runs=" + "".join(f"{c}{n}" for c, n in runs))
    if "@" in core and "." in core.partition("@")[2]:
        out.append("mail")
    if core.count(".") == 3 and len(groups) == 4 and digits + 3 == len(core) and max(groups) <= 3:
        out.append("quad")
    if digits and letters and len(core) >= 16:
        out.append("mixed")
        if all(c in "0123456789abcdef" for c in core.rpartition("=")[2]):
            out.append("hex")
    if len(core) >= 16 and core[:4].isupper():
        out.append("key=" + core[:4])
    if "=" in core[:-8]:
        out.append("assign=" + core.partition("=")[0].lower()[:12])
    if core.startswith(("+", "(")) or token.startswith("("):
        out.append("lead=" + token[0])
    if letters == 0 and digits >= 9:
        out.append("number")
    return tuple(out)


def ends_sentence(token: str) -> bool:
    return bool(_END.search(token))


# == the model
@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray  # features x 3 x labels: a token's own, and as the one before and after
    trans: np.ndarray  # labels x labels
    edge: np.ndarray  # 2 x labels: at the start and at the end

    def vectors(self, token: str) -> np.ndarray:
        """3 x labels."""
        at = [self.index[f] for f in features(token) if f in self.index]
        return self.weights[at].sum(0) if at else np.zeros(self.weights.shape[1:])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def train(table=None, rounds: int = 150, rate: float = 0.1, ridge: float = 2e-4) -> Model:
    """Adam on the regularised mean log likelihood of a labelled table of (tokens, labels)."""
    table = labelled_table() if table is None else table
    k = len(LABELS)
    index: dict[str, int] = {}
    n, longest = len(table), max(len(t) for t, _ in table)
    rows, cols, y = [], [], np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (tokens, labels) in enumerate(table):
        for j, (token, label) in enumerate(zip(tokens, labels)):
            mask[i, j], y[i, j] = True, LABELS.index(label)
            for f in features(token):
                rows.append(i * longest + j)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    last = mask.sum(1) - 1
    params = {"weights": np.zeros((len(index), 3, k)), "trans": np.zeros((k, k)), "edge": np.zeros((2, k))}
    m1, m2 = ({name: np.zeros_like(p) for name, p in params.items()} for _ in range(2))
    one = np.eye(k)[y] * mask[..., None]
    for step in range(1, rounds + 1):
        w, trans, edge = params["weights"], params["trans"], params["edge"]
        own = np.zeros((n * longest, 3, k))
        np.add.at(own, rows, w[cols])
        own = own.reshape(n, longest, 3, k)
        e = own[:, :, 0].copy()
        e[:, 1:] += own[:, :-1, 1]
        e[:, :-1] += own[:, 1:, 2]
        e[:, 0] += edge[0]
        e[np.arange(n), last] += edge[1]
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0]
        for j in range(1, longest):
            alpha[:, j] = np.where(mask[:, j, None], _log_sum(alpha[:, j - 1, :, None] + trans, 1) + e[:, j], alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = _log_sum(trans[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], nxt, 0)
        z = _log_sum(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.zeros((k, k))
        real = np.zeros((k, k))
        for j in range(1, longest):
            p = np.exp(alpha[:, j - 1, :, None] + trans + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]) * mask[:, j, None, None]
            pair += p.sum(0)
            real += np.einsum("na,nb->ab", one[:, j - 1], one[:, j])
        diff = one - post
        three = np.zeros((n, longest, 3, k))
        three[:, :, 0] = diff
        three[:, :-1, 1] = diff[:, 1:]
        three[:, 1:, 2] = diff[:, :-1]
        three = three.reshape(n * longest, 3, k)
        grad = {"weights": np.zeros_like(w), "trans": (real - pair) / n, "edge": np.stack([diff[:, 0].sum(0), diff[np.arange(n), last].sum(0)]) / n}
        np.add.at(grad["weights"], cols, three[rows] / n)
        for name, p in params.items():
            g = grad[name] - ridge * p
            m1[name] = 0.9 * m1[name] + 0.1 * g
            m2[name] = 0.99 * m2[name] + 0.01 * g * g
            params[name] = p + rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)
    return Model(index, **params)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


# == decoding
def viterbi(e: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of many sequences laid end to end; ties go to the first label in order."""
    out = np.zeros(len(e), np.int8)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    back = np.zeros(e.shape, np.int8)
    if not len(size):
        return out
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # sequences longer than each step
    score = e[start]
    for j in range(1, int(size[0])):
        a = active[j]
        if a < len(score):
            out[start[a : len(score)] + j - 1] = score[a:].argmax(1)
            score = score[:a]
        cand = score[:, :, None] + trans
        at = start[:a] + j
        back[at] = cand.argmax(1)
        score = cand.max(1) + e[at]
    out[start[: len(score)] + int(size[0]) - 1] = score.argmax(1)
    for j in range(int(size[0]) - 1, 0, -1):
        at = start[: active[j]] + j
        out[at - 1] = back[at, out[at]]
    return out


def label_batch(arr: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label of every white-space token of the texts, and the offsets of the rows."""
    vocab, ids, offsets = X.raw_tokens(arr)
    if not len(ids):
        return np.zeros(0, np.int8), offsets
    classes: dict[tuple, int] = {}
    kinds, ends, vectors = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), bool), []
    empty = np.zeros(len(vocab), bool)
    for i, token in enumerate(vocab.to_pylist()):
        if not token:
            empty[i] = True
            continue
        f = features(token)
        c = classes.get(f)
        if c is None:
            c = classes[f] = len(vectors)
            vectors.append(model.vectors(token))
        kinds[i] = c
        ends[i] = token[-1] in ".!?\"')]" and ends_sentence(token)
    if empty.any():
        keep = ~empty[ids]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
        if not len(ids):
            return np.zeros(0, np.int8), offsets
    v = np.array(vectors)
    kind = kinds[ids]
    first = np.zeros(len(ids) + 1, bool)
    first[offsets] = True
    first[1:] |= ends[ids]
    first[0] = first[-1] = True
    start = np.flatnonzero(first[:-1])
    size = np.diff(np.append(start, len(ids)))
    e = v[kind, 0].astype(np.float32)
    inner = ~first[1:-1]  # token i and i + 1 are in one sentence
    e[1:][inner] += v[kind[:-1][inner], 1]
    e[:-1][inner] += v[kind[1:][inner], 2]
    e[start] += model.edge[0]
    e[start + size - 1] += model.edge[1]
    return viterbi(e, start, size, model.trans.astype(np.float32)), offsets


def redact(text: str, labels: np.ndarray) -> tuple[str, int]:
    """The text with each run of tokens of one label replaced by ``[LABEL]``, and how many there were."""
    spans = []
    for m, y in zip(_TOKEN.finditer(text), labels.tolist()):
        if not y:
            continue
        a, b = m.span()
        if spans and spans[-1][2] == y and not text[spans[-1][1] : a].strip() and spans[-1][3] == a:
            spans[-1][1], spans[-1][3] = b, None
        else:
            spans.append([a, b, y, None])
        nxt = b
        while nxt < len(text) and text[nxt].isspace():
            nxt += 1
        spans[-1][3] = nxt
    out, done = [], 0
    for a, b, y, _ in spans:
        phone = LABELS[y] == "PHONE"
        while a < b - 1 and text[a] in _OPEN and not (phone and text[a] == "(" and ")" in text[a:b]):
            a += 1
        while b > a + 1 and text[b - 1] in _CLOSE:
            b -= 1
        out += [text[done:a], f"[{LABELS[y]}]"]
        done = b
    return "".join([*out, text[done:]]), len(spans)


def redact_pii(docs: DataFrame, text_col: str = "text", model: Model | None = None, count: str = "n_entities") -> DataFrame:
    """``docs`` with personal data and secrets in ``text_col`` replaced, and the number of entities.

    Null texts stay null; texts without an entity stay as they are; neighbouring tokens of one
    label are one entity. Repeated rows change alike and very long texts are read whole. Empty tables
    give empty tables. The count's name is underscored where it
    clashes.
    """
    name = X.fresh(docs, count)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        m = shared.value
        for b in X.steps(batches, text_col):
            i = b.schema.get_field_index(text_col)
            arr = X.texts(b.column(i))
            labels, offsets = label_batch(arr, m)
            n = np.zeros(b.num_rows, np.int64)
            hit = np.flatnonzero(np.add.reduceat(np.append(labels != 0, False), offsets[:-1]) * (np.diff(offsets) > 0))
            if len(hit):
                new = b.column(i).to_pylist()
                for r in hit.tolist():
                    new[r], n[r] = redact(new[r], labels[offsets[r] : offsets[r + 1]])
                b = X.set_column(b, text_col, pa.array(new, b.schema.field(i).type))
            yield X.append_columns(b, **{name: pa.array(n)})

    return docs.mapInArrow(run, X.with_fields(docs, (name, T.LongType())))
