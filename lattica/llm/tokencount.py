"""Token counts under a unigram tokeniser, by dynamic programming shared along a trie.

The distinct pre-tokens of a batch form a trie; each node's best score and its number of pieces is
computed once per shared prefix (``trie.best_counts``), and the value at a pre-token's terminal
node is its token count. A document's count is the sum over its pre-tokens.

The vocabulary is a fixed public one of merge ranks; a piece's unigram log probability is taken
from its rank by Zipf's law. Tokenisers are never trained here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as X
from . import trie


def zipf_scores(ranks: np.ndarray) -> tuple[np.ndarray, float]:
    """Log probabilities by rank, and the score of a fallback byte (below every piece)."""
    order = np.argsort(np.argsort(ranks))
    p = 1.0 / (order + 10.0)
    score = np.log(p / p.sum())
    return score, float(score.min() - 2.0)


def count_texts(arr: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of whole texts."""
    return count_with(arr, *trie.load_pieces(vocabulary))


def count_with(arr: pa.Array, pieces: trie.Pieces, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    score, byte_score = zipf_scores(ranks)
    vocab, ids, offsets = X.raw_tokens(arr)
    items, owner = trie.pretokens(vocab)
    tokens, pre = np.zeros(len(vocab) + 1, np.int64), np.zeros(len(vocab) + 1, np.int64)
    if items:
        tokens[owner] = trie.best_counts(items, pieces, score, byte_score)[1]
        pre[owner] = 1
    at = np.append(ids, len(vocab))
    out = [np.add.reduceat(v[at], offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64) for v in (pre, tokens)]
    none = np.diff(offsets) == 0
    for v in out:
        v[none] = 0
    return out[0], out[1]


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = trie.DEFAULT_VOCABULARY, out: tuple[str, str] = ("n_pretokens", "n_tokens")) -> DataFrame:
    """``docs`` with each text's numbers of pre-tokens and of tokens.

    Null, empty and blank texts count 0. A run of characters without white space is one pre-token,
    however long. Among segmentations of equal score the one with fewest pieces counts. Repeated
    rows count alike, an empty table gives an empty table, very long texts are read whole. The
    added columns get underscores in front where names clash. Only the driver reads the file
    ``vocabulary``; its pieces are broadcast.
    """
    names = [X.fresh(docs, n) for n in out]
    shared = docs.sparkSession.sparkContext.broadcast(trie.load_pieces(vocabulary))

    def run(batches):
        for b in X.steps(batches, text_col):
            pre, tokens = count_with(X.texts(b.column(b.schema.get_field_index(text_col))), *shared.value)
            yield X.append_columns(b, **{names[0]: pa.array(pre, pa.int64()), names[1]: pa.array(tokens, pa.int64())})

    return docs.mapInArrow(run, X.with_fields(docs, *((n, T.LongType()) for n in names)))
