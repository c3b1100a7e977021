"""Substring deduplication by sliding runs of sentences.

Every run of three consecutive sentences is hashed and joined with all other runs of the corpus, and
so are shorter runs of 16 words or more: they catch passages that share fewer whole sentences. In a
run that occurs more than once, every sentence of every occurrence but the first is removed. First
is by id, then by place in the text.

Runs are hashed in Arrow batches; then all is relational: the runs' hashes are grouped and joined,
and what they cover is joined back to the texts, of which only those with a repeat are rebuilt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Splits behind sentence ends and behind line ends; the parts put together again are the text.
#: The classes are spelled out because Java and RE2 differ in what white space is.
BOUNDARY = r"([.!?]+[ \t\n\r\f]+|\n+)"
MARK, ESCAPE = "\u0001", "\u0002"
#: (sentences in a run, least words that they have together)
RUNS = ((3, 0), (2, 16), (1, 16))


def parts(text: Column) -> Column:
    """The sentences, with marks of the text's own escaped."""
    own = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    return F.split(F.regexp_replace(own, BOUNDARY, "$1" + MARK), MARK)


def whole(text: Column) -> Column:
    """The text whose sentences, escaped, are put together again."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def arrow_parts(texts: pa.Array) -> pa.Array:
    """``parts`` of lower-cased texts, as lists."""
    own = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), ESCAPE, ESCAPE + "b"), MARK, ESCAPE + "a")
    return pc.split_pattern(pc.replace_substring_regex(own, pattern=BOUNDARY, replacement="\\1" + MARK), MARK)


def run_table(docs: DataFrame, id_col: str, text_col: str, runs=RUNS) -> DataFrame:
    """(h, id, th, of, pos, n) for every run: its hash, the document and its sentences, the run's first and how many."""

    def run(batches):
        for b in X.steps(batches, "t"):
            lists = arrow_parts(X.texts(b.column(2)))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            sentences = pc.utf8_trim_whitespace(lists.flatten())
            words = np.cumsum(np.append(0, pc.count_substring(sentences, " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1))
            hashes = X.hash64(sentences)
            row = X.row_of(offsets)
            at, h, of_n = [], [], []
            for n, least in runs:
                i = np.arange(max(0, len(row) - n + 1))
                i = i[(row[i] == row[i + n - 1]) & (words[i + n] - words[i] >= least)]
                key = np.full(len(i), n, np.uint64)
                for k in range(n):
                    key = X.mix64(key ^ hashes[i + k])
                at.append(i)
                h.append(key.view(np.int64))
                of_n.append(np.full(len(i), n, np.int32))
            at = np.concatenate(at)
            r, count = pa.array(row[at]), np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(h)), b.column(0).take(r), b.column(1).take(r), pa.array(count[row[at]]), pa.array((at - offsets[row[at]]).astype(np.int32)), pa.array(np.concatenate(of_n))],
                names=["h", "id", "th", "of", "pos", "n"],
            )

    d = docs.where(F.col(text_col).isNotNull()).select(X.ordered_id(docs, id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, f"h long, id {d.schema['id'].dataType.simpleString()}, th long, of int, pos int, n int")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs=RUNS, removed: str | None = None) -> DataFrame:
    """``docs`` without the sentences that lie in a non-first occurrence of a repeated run.

    Sentences compare by their lower-cased text without white space around it. Texts without such a sentence
    stay as they are, null and empty texts among them; a document that loses all its sentences
    goes. Ids may be of any type: integral ones compare as numbers, others as strings; null ids come
    after all others. Rows with the same id and text are one document: they stay, lose or go alike
    (exact deduplication removes them). Very long texts are read whole, and what is left of a text
    keeps every character, control characters too. An empty table gives an empty table. Columns are
    those of ``docs``; with ``removed``, a column of that name (underscored where it clashes) counts
    the sentences cut.
    """
    table = run_table(docs, id_col, text_col, runs)
    place = F.struct("id", "th", "pos")
    first = table.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select(F.col("h").alias("fh"), "f")
    again = table.join(first, table["h"] == first["fh"]).where(place > F.col("f"))
    gone = again.groupBy("id", "th", "of").agg(F.collect_set(F.struct("pos", "n")).alias("c"))
    gi, gt, gs, gc, n_col = (X.fresh(docs, c) for c in ("span_id", "span_text_hash", "span_of", "span_cover", removed or "span_sentences"))
    gone = gone.select(F.col("id").alias(gi), F.col("th").alias(gt), F.col("of").alias(gs), F.array_distinct(F.flatten(F.transform("c", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))).alias(gc))
    joined = docs.join(gone, (X.ordered_id(docs, id_col) == gone[gi]) & (F.xxhash64(docs[text_col]) == gone[gt]) & docs[text_col].isNotNull(), "left")
    # the outer transform binds the parts once; named inside a lambda they would be made for each sentence
    text = whole(F.transform(F.array(parts(F.col(text_col))), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gc)), lambda i: F.element_at(p, i + 1)), ""))[0])
    out = joined.where(F.col(gc).isNull() | (F.size(gc) < F.col(gs)))
    out = out.select(*[F.when(F.col(gc).isNull(), F.col(text_col)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns], F.when(F.col(gc).isNull(), 0).otherwise(F.size(gc)).cast("long").alias(n_col))
    return out if removed else out.select(*docs.columns)
