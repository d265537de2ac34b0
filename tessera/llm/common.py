"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one Arrow batch handed back to the JVM may stem from.
OUT_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent (tests, a laptop) a temporary folder is used, which driver and
    executors then share.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def ordered_places(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``rows``, cut from their lineage, with ``place`` (0 .. in their group's ``order``) and ``group_rows`` (its size).

    Rows are sorted over all tasks by range, and written; a row's place is its place in its piece, less that of
    its group's first row there, plus the group's rows in earlier pieces. Groups of any size are thus spread, as
    rows that are alike are: their number in the scan breaks ties. The counts have a row for each group in each piece.
    ``rows`` is read twice and should be cut from its lineage if it is dear.
    """
    at, piece, first, n, before, place, total = fresh(rows, "_at", "_piece", "_first", "_n", "_before", "place", "group_rows")
    keys = [F.col(g).asc_nulls_first() for g in groups]
    ranged = rows.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*keys, *order, F.col(at))
    ranged = durable(ranged.sortWithinPartitions(*keys, *order, F.col(at)).drop(at))
    ranged = ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(piece, F.spark_partition_id())
    counts = ranged.groupBy(*groups, piece).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    by = Window.partitionBy(*groups)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(by.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum(n).over(by))
    told = counts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col(piece).alias("_in"), first, before, total)
    on = [F.col(piece) == F.col("_in"), *[F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]]
    return ranged.join(told, reduce(and_, on)).select(*rows.columns, (F.col(at) - F.col(first) + F.col(before)).alias(place), F.col(total))


def give_back() -> None:
    """Hand the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run):
    """``run`` for mapInArrow, whose worker holds no freed memory while it waits beside the executor's heap for its next task."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start .. start+length-1 of every range, one range after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def text_chunks(batch, id_at: int, text_at: int, limit: int):
    """(ids, texts) of an Arrow batch in pieces of about ``limit`` bytes, at least a row each."""
    ids, texts, size = [], [], 0
    column, keys = batch.column(text_at), batch.column(id_at)
    for row in range(batch.num_rows):
        text = column[row].as_py() or ""
        ids.append(keys[row].as_py())
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def null_to_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until none is a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Classes that hold at least one in HOT of all rows; there are at most HOT of them.
HOT = 1000


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], spread: str, n: str = "n") -> DataFrame:
    """``rows`` inner-joined with ``classes``, one row a key, whose column ``n`` counts each key's rows.

    The at most HOT classes that hold one in HOT of all rows or more are sent to the rows; rows of theirs
    are dealt by a hash of their column ``spread`` past the join of the others, so no task gets them all.
    ``classes`` is read twice and should be cut from its lineage.
    """
    more = [c for c in classes.columns if c not in (*keys, n)]
    whole = classes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = classes.where(F.col(n) * HOT >= whole).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*more).alias("_hot"))
    cold = classes.where(F.col(n) * HOT < whole).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], F.struct(*more).alias("_cold"))
    same = lambda side, key: F.col(key) == F.col(f"_{side}_{key}")
    told = rows.join(F.broadcast(hot), reduce(and_, [same("hot", k) for k in keys]), "left")
    told = told.withColumn("_deal", F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(spread)))
    on = reduce(and_, [F.col("_deal") == F.col(f"_cold_{keys[0]}"), *[same("cold", k) for k in keys[1:]], F.col("_hot").isNull()])
    met = told.join(cold, on, "left").withColumn("_class", F.coalesce("_hot", "_cold")).where("_class is not null")
    return met.select(*rows.columns, *[F.col(f"_class.{c}").alias(c) for c in more])
