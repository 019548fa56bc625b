"""From raw documents to token ids: five operators of lumora.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. What a stage does with nulls, empty and long texts, ties, repeated rows and further columns is its
operator's: rows without a text are scored, kept and encoded like empty ones; rows without a doc_id stay unless the classifier or
the decontamination rejects them; rows that repeat a doc_id are judged each by its own text; further columns are carried through to the last
stage, whose result has its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumora.llm import decontam, mil, neardup, secrets, tokens
from lumora.llm.jobs import stored, sweep, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, takes for good ones."""
    return mil.keep_good(docs, mil.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return neardup.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by markers."""
    return secrets.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents."""
    return tokens.encode(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("secret scan", secret_scan), ("tokens", tokenise)]

#: SQL can express the near-duplicates and the decontamination, but neither the classifier before nor the tokens after them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written as Parquet to the checkpoint folder and read from there by the next."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            sweep(spark, before, docs)  # what the stages so far had written
    return docs
