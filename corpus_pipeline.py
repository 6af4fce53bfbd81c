"""The corpus pipeline: documents in, packed training batches out.

Each stage applies one operator of docsignal.llm to all that the stage before it kept, and its
decisions take effect. All stages but the last return the columns of documents, texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsignal.llm import jaccard_join, length_buckets, mixing, pii, toxicity
from docsignal.llm.common import save, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go. Rows with one doc_id are judged by their own texts."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id. Documents without words stay."""
    return jaccard_join.first_of_each(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed(docs, weight=F.expr(mixing.LESS_IF_LONG)).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in a batch of one padded length."""
    return length_buckets.pack(length_buckets.token_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The nearest examples, the span classifier and hashed random numbers have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
