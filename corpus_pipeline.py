"""The corpus pipeline: documents go through its stages in order, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.functions.storage import new_path
from tracewell.llm import bpe, decontaminate, minhash, pii, quality
from tracewell.llm.queries import PSEUDONYM_KEY, table, word_vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 6)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score="_score").where("_score >= 0.5").drop("_score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (operator 9), and all without an id."""
    gone = minhash.near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    # What goes grows with the documents, so it is never broadcast.
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (operator 10)."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data under pseudonyms (operator 7)."""
    return pii.pseudonymised(docs, PSEUDONYM_KEY).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to (operator 3)."""
    docs = bpe.encode(docs.select("doc_id", "text"), word_vocabulary(), decoded="decoded")
    return docs.select("doc_id", "ids", "decoded")


STAGES = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", clean),
    ("pseudonyms", private),
    ("bpe", encoded),
]

#: SQL can express neither the trained dictionaries of the first stage nor the last: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``; what the others make is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
