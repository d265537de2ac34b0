"""Incremental ingest with Structured Streaming: each batch of new documents appends index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators import gating, index


#: Segments that a batch can have.
BATCH_SEGMENTS = 1 << 32


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Index the Parquet files that appear in a folder; a batch that is redone replaces what it wrote.

    A batch numbers its documents and has segments of its own, whose ids begin with the batch's number, so
    (segment, row) is unique over batches; ``target`` can be read as an ``Index``, of which a batch is a pack.
    """
    docs = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        numbered = batch.where("doc_id is not null").join(index.dense_numbers(batch), "doc_id")
        rows = index.frames(numbered, number_col="doc_number").withColumn("segment_id", F.lit(number * BATCH_SEGMENTS) + F.col("segment_id"))
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        written = batch.sparkSession.read.parquet(f"{target}/rows/batch={number}")
        index.row_terms(written).write.mode("overwrite").parquet(f"{target}/postings/pack={number}")
        gating.maxima(batch.sparkSession.read.parquet(f"{target}/postings/pack={number}")).write.mode("overwrite").parquet(f"{target}/peaks/batch={number}")
        peaks = batch.sparkSession.read.parquet(f"{target}/peaks/batch={number}")
        told = index.segments(written).withColumn("pack", F.lit(number).cast("bigint")).join(gating.versions(peaks), "segment_id", "left")
        told.write.mode("overwrite").parquet(f"{target}/segments/batch={number}")
        gating.signatures(peaks).write.mode("overwrite").parquet(f"{target}/signatures/batch={number}")
        signs = batch.sparkSession.read.parquet(f"{target}/signatures/batch={number}")
        gating.signature_map(signs).write.mode("overwrite").parquet(f"{target}/signature_map/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type and window of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
