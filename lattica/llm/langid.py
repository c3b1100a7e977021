"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood
is the sum over all its segmentations into pieces, found by the forward algorithm (``trie.forward``)
once per distinct pre-token of a batch. A further model, uniform over the vocabulary, stands for
"none of these": text that it explains better than every language is rejected.

Fitting reads at most ``docs_per_language`` labelled rows of each language (those with the
smallest hashes of their ids); scoring reads all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from . import trie

#: Probability of a character that no piece covers, in every model.
UNKNOWN = 1e-7
#: Mass of the uniform distribution mixed into each language's pieces.
SMOOTHING = 0.02


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prob: np.ndarray  # pieces x (languages + 1); the last column is the uniform model
    vocabulary: str
    pieces: trie.Pieces


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_language: int = 300, rounds: int = 3, max_token_chars: int = 4096, vocabulary: str = trie.DEFAULT_VOCABULARY) -> Model:
    """Piece probabilities by expectation maximisation over the labelled sample's distinct tokens.

    Rows whose label, text or id is null are not used, nor are tokens of the sample that are longer
    than ``max_token_chars``. Rows that repeat an id and label share a place in the sample. Without
    any labelled row the model has no language and rejects every text.
    """
    narrow = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l"))
    w = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = narrow.withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_per_language).select("i", "l").distinct()
    sample = docs.join(F.broadcast(chosen), (docs[id_col] == chosen["i"]) & (docs[label_col].cast("string") == chosen["l"]), "left_semi")
    # the sample is bounded, so its distinct tokens fit the driver
    counted = (
        sample.select(F.col(label_col).cast("string").alias("l"), F.explode(F.split(F.col(text_col), r"\s+")).alias("w")).where((F.col("w") != "") & (F.length("w") <= max_token_chars))
        .groupBy("l", "w").count().toPandas()
    )
    languages = tuple(sorted(counted["l"].unique()))
    pieces, _ = trie.load_pieces(vocabulary)
    v = len(pieces.pieces)
    prob = np.full((v, len(languages) + 1), 1.0 / v)
    if languages:
        vocab = pa.array(sorted(counted["w"].unique()))
        items, owner = trie.pretokens(vocab)
        counts = counted.pivot_table(index="w", columns="l", values="count", fill_value=0).reindex(index=vocab.to_pylist(), columns=list(languages), fill_value=0).to_numpy(float)[owner]
        size = np.fromiter(map(len, items), np.int64, len(items))
        short, long = np.flatnonzero(size <= trie.SHORT), np.flatnonzero(size > trie.SHORT)
        lv = trie.Levels([items[i] for i in short], pieces)
        by_item = np.zeros((lv.n, len(languages)))
        np.add.at(by_item, lv.inverse, counts[short])
        for _ in range(rounds):
            expected = _expected(lv, prob[:, :-1], by_item)
            if len(long):
                logs = trie.log_prob(prob[:, :-1], UNKNOWN)
                for i in long:
                    _add_expected(expected, items[i], pieces, logs, counts[i])
            p = expected / np.maximum(expected.sum(0), 1e-300)
            prob[:, :-1] = (1 - SMOOTHING) * p + SMOOTHING / v
    return Model(languages, prob, vocabulary, pieces)


def _expected(lv: trie.Levels, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by forward and backward passes over the trie.

    Backward values are kept divided by the forward value of the whole item, so those of all items
    below a node simply add up.
    """
    out = np.zeros_like(prob)
    alpha = [np.ones((1, prob.shape[1]))]
    arcs = []
    for d in range(1, lv.depth + 1):
        rows = lv.first[d]
        a = np.zeros((len(rows), prob.shape[1]))
        for k, hit, above, p in lv.matches(d):
            a[hit] += alpha[d - k][above] * prob[p]
            arcs.append((d, k, hit, above, p))
            if k == 1 and len(hit) < len(rows):
                miss = np.ones(len(rows), bool)
                miss[hit] = False
                up = lv.node[d - 1][rows[miss]] if d > 1 else np.zeros(miss.sum(), np.int64)
                a[miss] += alpha[d - 1][up] * UNKNOWN
                arcs.append((d, 1, np.flatnonzero(miss), up, None))
        alpha.append(a)
    beta = [np.zeros_like(a) for a in alpha]
    for d in range(1, lv.depth + 1):
        end = np.flatnonzero(lv.length == d)
        node = lv.node[d][end]
        np.add.at(beta[d], node, counts[end] / np.maximum(alpha[d][node], 1e-300))
    for d, k, hit, above, p in reversed(arcs):
        b = beta[d][hit]
        if p is None:
            np.add.at(beta[d - k], above, b * UNKNOWN)
        else:
            np.add.at(out, p, alpha[d - k][above] * prob[p] * b)
            np.add.at(beta[d - k], above, b * prob[p])
    return out


def _add_expected(out: np.ndarray, item: str, pieces: trie.Pieces, logs: np.ndarray, counts: np.ndarray) -> None:
    """The expected uses in one long item, ``counts`` times, in logs."""
    ends, k, p, alpha = [], [], [], [np.zeros((1, logs.shape[1]))]
    for (start, e, k1, p1), a in trie.chain(item, pieces, logs):
        ends.append(e + start + 1)
        k.append(k1)
        p.append(p1)
        alpha.append(a)
    ends, k, p, alpha = np.concatenate(ends), np.concatenate(k), np.concatenate(p), np.concatenate(alpha)
    beta = np.full(alpha.shape, -np.inf)
    beta[-1] = 0
    terms = logs[p]
    for j in range(len(ends) - 1, -1, -1):
        at = ends[j] - k[j]
        beta[at] = np.logaddexp(beta[at], beta[ends[j]] + terms[j])
    known = p >= 0
    np.add.at(out, p[known], (np.exp(alpha[ends - k] + terms + beta[ends] - alpha[-1]) * counts)[known])


def score_texts(arr: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods (rows x models) of whole texts, their characters scored and their tokens."""
    vocab, ids, offsets = X.raw_tokens(arr)
    items, owner = trie.pretokens(vocab)
    per = np.zeros((len(vocab) + 1, model.prob.shape[1]))
    chars = np.zeros(len(vocab) + 1)
    if items:
        per[owner] = trie.forward(items, model.pieces, model.prob, UNKNOWN)
        chars[: len(vocab)] = pc.utf8_length(vocab).to_numpy(zero_copy_only=False)
    padded = np.append(ids, len(vocab))
    total = np.add.reduceat(per[padded], offsets[:-1], axis=0) if len(offsets) > 1 else np.zeros((0, per.shape[1]))
    n_chars = np.add.reduceat(chars[padded], offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
    none = np.diff(offsets) == 0
    total[none], n_chars[none] = 0, 0
    # the token before leading white space is empty; a blank text has no other
    real = np.append(chars[:-1] > 0, False)[padded]
    n = np.add.reduceat(real.astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    n[none] = 0
    return total, n_chars, n


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_posterior: float = 0.9, out: tuple[str, str, str] = ("lang_id", "lang_score", "lang_ok")) -> DataFrame:
    """``docs`` with the likeliest language, its log likelihood a character, and whether it is accepted.

    Accepted: some text, a posterior (uniform prior over the languages) of ``min_posterior`` at
    least, and a likelihood above the uniform model's. Null, empty and blank texts get language
    null, score 0 and are not accepted. Equal likelihoods go to the language first in order.
    Repeated rows are scored alike, very long texts and unspaced runs whole; an empty table gives an
    empty table. The added columns get underscores in front where ``docs`` has columns of these
    names. The model holds its pieces, so workers need no vocabulary file.
    """
    names = [X.fresh(docs, n) for n in out]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = X.with_fields(docs, (names[0], T.StringType()), (names[1], T.DoubleType()), (names[2], T.BooleanType()))

    def run(batches):
        m = shared.value
        for b in X.steps(batches, text_col):
            total, n_chars, n = score_texts(X.texts(b.column(b.schema.get_field_index(text_col))), m)
            k = len(m.languages)
            if k:
                best = total[:, :k].argmax(1)
                top = total[np.arange(len(best)), best]
                post = 1 / np.exp(np.minimum(total[:, :k] - top[:, None], 0)).sum(1)
                ok = (n > 0) & (post >= min_posterior) & (top > total[:, k])
                lang = pa.array(np.array(m.languages, object)[best], pa.string(), mask=n == 0)
                rate = np.where(n > 0, top / np.maximum(n_chars, 1), 0.0)
            else:
                ok, lang, rate = np.zeros(len(n), bool), pa.nulls(len(n), pa.string()), np.zeros(len(n))
            yield X.append_columns(b, **{names[0]: lang, names[1]: pa.array(rate, pa.float64()), names[2]: pa.array(ok, pa.bool_())})

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None = None, **fit_args) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with the columns of ``docs``."""
    model = model or fit(docs, **fit_args)
    names = [X.fresh(docs, n) for n in ("lang_id", "lang_score", "lang_ok")]
    return identify(docs, model).where(F.col(names[2])).select(*docs.columns)
