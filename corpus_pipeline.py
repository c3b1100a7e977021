"""The cleaning pipeline over ``documents``: each stage is one operator of ``lattica.llm``.

Each stage reads all that the one before kept; each but the last returns the columns of documents,
whatever other columns there are. Rows and columns without meaning for a stage go through it as they
are: an empty table gives an empty table, and so does each stage on one; long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, exact, langid, mixing, simhash
from lattica.llm.text import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the segmentation-marginalised unigrams accept.

    Null, empty and blank texts have no language and go; rows without ``lang`` or ``doc_id`` are
    judged but not learnt from. Repeated rows stay or go together. A tie goes to the language first
    in order, and is rejected, as neither has the posterior. Without any label all go.
    """
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text: the one with the smallest id, null ids last.

    Null texts all stay; empty texts are copies of each other. Of rows that repeat id and text one
    stays; if their other columns differ, it may be either.
    """
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null ids, null texts and texts without a word are near copies of nothing and stay. Rows that
    repeat an id stay or go together.
    """
    return simhash.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; ``n_chars`` follows the texts that changed.

    Null, empty and wordless texts stay as they are, a document that is nothing but passages goes.
    Repeated rows change alike. Null and empty items match nothing; an empty benchmark cuts nothing.
    """
    cut = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), removed="leak_words_cut")
    return cut.select(*[F.when(F.col("leak_words_cut") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture of sources has them: a row for each pass that takes a document.

    Null sources are one source. Texts without tokens ride along with their source; a source without
    any token has no weight and goes. Rows with equal ids, or null ones, are taken together.
    """
    return mixing.mix(docs)


STAGES = [
    ("language identification", language),
    ("exact deduplication", exact_copies),
    ("near deduplication", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]

#: No SQL: the first and third stages can't be expressed in it; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again.

    What a stage has read is removed once its own rows are written, and the last of it when the
    driver ends.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}"), True)
            else:
                files.deleteOnExit(folder)
    return docs
