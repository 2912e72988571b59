"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

1. Language ID drops documents whose language it rejects: texts without letters, such that no language takes at
   least half of the probability, and such that are in none of the learned languages, as their letters are far less
   likely than those of labelled texts.
2. Exact dedup keeps one document of each group of equal texts.
3. The n-gram Jaccard join keeps one document of each group of near copies: five words, similarity 0.8.
4. Benchmark decontamination drops documents that hold a passage of a test item.
5. BPE encoding gives each document its token ids and, decoded from them, its text.

All but the last return the columns of documents. Null ids, repeated ids and repeated rows go through every stage as
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._staging import stage
from textloom.llm.bpe import encode
from textloom.llm.decontaminate import remove_leaks
from textloom.llm.exact_dedup import mark_duplicates
from textloom.llm.language_id import predict, train
from textloom.llm.ngram_join import drop_near_copies

#: The least share of probability for a language, and the least fit: deviations from the mean of labelled texts.
LEAST_SCORE, LEAST_FIT = 0.5, -40
#: The most rows of a batch that goes to Python. Spark's 10,000 documents are tens of MB in the JVM and in Python, for each task.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """From now on the session's batches have at most BATCH_ROWS rows; results don't depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: learned from those with a label, applied to all."""
    _small_batches(spark)
    marked = predict(docs, train(docs, "text", "lang"), fit=True)
    pred, score, fit = marked.columns[-3:]
    taken = (F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE) & (F.col(fit).isNull() | (F.col(fit) >= LEAST_FIT))
    return marked.filter(taken).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z in lower case, the document with the largest id."""
    _small_batches(spark)
    marked = mark_duplicates(docs, "doc_id", "text")
    return marked.filter(F.col(marked.columns[-2])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    _small_batches(spark)
    return drop_near_copies(docs, "doc_id", "text", width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded their text."""
    _small_batches(spark)
    coded = encode(docs, "doc_id", "text", decoded="decoded", lookup=True)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: SQL can't express the language model, the similarity join at its size, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
