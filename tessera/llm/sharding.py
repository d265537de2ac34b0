"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. N-1 in an order of the rows' own values (hash bucket, id, size, checksum), so
the numbers do not depend on files or partitions. A balanced Feistel network permutes 0 .. 4^w - 1,
the least such range that holds N; values of N or more walk on along their cycle. A row's place p
gives shard p mod n and slot p div n, so shards differ by at most one row (the law ``rows``).

Only ids, sizes and checksums move. Rows that are equal in all three are counted per input task
before the shuffle and numbered together, so a row repeated without end fills no task; which of equal
rows gets which of their numbers makes no difference. The offsets
of the ``BUCKETS`` hash buckets are the only broadcast: at most BUCKETS rows.

Defined cases: a null text has no bytes (size 8, checksum 0); a null id is a value like any other;
equal rows get different places; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
ROUNDS = 6
ROW_OVERHEAD = 8
SALTS = 64


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of (x, key); the round function takes its low bits."""
    x = x + np.uint64(key)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers 0 .. n-1 under the seed's permutation of that range."""
    half = max(1, -(-int(max(n - 1, 1)).bit_length() // 2))
    width, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [(seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % (1 << 64) for k in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & low
        for key in keys:
            left, right = right, left ^ (mixed(right, key) & low)
        return left << width | right

    out = network(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = network(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def row_numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` (0 .. N-1, in no partition's order) and ``n_rows``."""
    counted = rows.groupBy(*keys, (F.spark_partition_id() % SALTS).alias("_salt")).agg(F.count(F.lit(1)).alias("_copies"))
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    one = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    offsets = offsets.select("_bucket", F.coalesce(F.sum("_n").over(one), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    within = Window.partitionBy("_bucket").orderBy(*keys, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(within), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    return placed.select(*keys, "n_rows", F.col("_offset"), F.col("_before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy")).select(*keys, "n_rows", (F.col("_offset") + F.col("_before") + F.col("_copy")).alias("row_number"))


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, row_number, place, shard and slot of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(data) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))

    @F.pandas_udf("bigint")
    def place(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), int(n.iloc[0]), seed) if len(number) else number)

    out = row_numbers(rows, [id_col, "size", "text_crc32"]).withColumn("place", place("row_number", "n_rows"))
    return out.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))
