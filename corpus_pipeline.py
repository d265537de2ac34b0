"""Cleaning the documents table: toxicity, line and near duplicates, benchmark leaks, then BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, lines, queries, simhash, toxicity
from tessera.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a score of 0.5 or more go; null and empty texts score as empty."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later lines of a class go, and documents that consist of such lines alone."""
    return lines.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the document of the least id of each component stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents into which a benchmark item is leaked go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: ids and decoded text as digests, a row for each document that is left."""
    return queries.token_digests(bpe.encode_decode(docs, queries.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_duplicate_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("bpe", tokenize),
]
#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
