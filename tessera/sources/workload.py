"""Synthetic documents and queries, the same for the same seed on any number of executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Workload:
    docs: int = 64
    least_tokens: int = 16
    most_tokens: int = 48
    vocabulary: int = 4096
    queries: int = 32
    query_tokens: int = 3
    seed: int = 1
    tie_pair: bool = True
    topic_share: int = 25

    def __post_init__(self) -> None:
        if min(self.docs, self.least_tokens, self.vocabulary, self.queries, self.query_tokens) < 1 or self.most_tokens < self.least_tokens:
            raise ValueError("counts must be 1 or more, and most_tokens at least least_tokens")

    def drawn(self, *what: Column, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *what), F.lit(below))


def word(number: Column) -> Column:
    return F.concat(F.lit("w"), F.lpad(number.cast("string"), 6, "0"))


def generate(spark: SparkSession, w: Workload = Workload()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and (query_id, text). A quarter of a document's tokens are its topic; the last two
    documents are equal if ``tie_pair``; each query is drawn from one document's topic and the vocabulary."""
    like = F.when(F.lit(w.tie_pair) & (F.col("id") == w.docs - 1), F.col("id") - 1).otherwise(F.col("id"))
    topic = w.drawn(F.lit("topic"), F.col("like"), below=w.vocabulary)

    def token(i: Column) -> Column:
        own = w.drawn(F.lit("share"), F.col("like"), i, below=100) < w.topic_share
        return word(F.when(own, topic).otherwise(w.drawn(F.lit("token"), F.col("like"), i, below=w.vocabulary)))

    length = (w.drawn(F.lit("length"), F.col("like"), below=w.most_tokens - w.least_tokens + 1) + w.least_tokens).cast("int")
    docs = spark.range(w.docs).withColumn("like", like).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), length), token), " ").alias("text"))
    of = w.drawn(F.lit("of"), F.col("id"), below=w.docs)
    first = word(w.drawn(F.lit("topic"), of, below=w.vocabulary))
    rest = F.transform(F.sequence(F.lit(1), F.lit(w.query_tokens)), lambda i: F.when(i == 1, first).otherwise(word(w.drawn(F.lit("query"), F.col("id"), i, below=w.vocabulary))))
    queries = spark.range(w.queries).select(F.col("id").alias("query_id"), F.array_join(rest, " ").alias("text"))
    return docs, queries
