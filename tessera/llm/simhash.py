"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes, so the
guaranteed minimum of shared positional bytes is 4. Lists of single positional bytes would hold a
256th of all fingerprints each; the index therefore keeps the intersections of four of them: one
list for each choice of four positions and their bytes (70 choices). Fingerprints are made distinct
first, so copies never meet in a list. A list is cut by its counted size into blocks of about ``BLOCK``
fingerprints, and each two blocks meet in one row, wherever it is dealt: there the positional bytes that
each pair shares are tallied, pairs of 4 or more are retained and verified by the popcount of their XOR,
and a spanning forest of the links leaves, which has the same components. Those come from alternating
large-star and small-star steps over the links.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; very long
texts are hashed whole; repeated rows each give a row; rows whose id is null are kept and get the
smallest id of their component (null where it has none); an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, lean, text_chunks, utf8, with_class
from .graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
POSITIONS = 8
SHARED = POSITIONS - DISTANCE
#: Fingerprints of a block, on average.
BLOCK = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | bytes) -> list[int]:
    """XXH64 of every run of SHINGLE words (of all words where there are fewer)."""
    data = text if isinstance(text, bytes) else utf8(text)
    words = data.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())]


def fingerprints_of(texts: list) -> np.ndarray:
    """The fingerprints as uint64: a bit is set where more than half of the hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    counts, hashes = [], []
    for text in texts:
        h = shingle_hashes(text)
        counts.append(len(h))
        hashes.append(np.array(h, np.uint64))
    n = np.array(counts, np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h, m = np.concatenate(hashes), n[some]
    # runs of up to 255 hashes of one text: the counters of eight bits fit in the bytes of a word
    runs = -(-m // 255)
    text_start = np.cumsum(m) - m
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(text_start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    value = np.zeros(len(some), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat(h >> np.uint64(bit) & LANES, starts)
        per_text = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            value |= (2 * per_text[:, byte] > m).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[some] = value
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp`` (the 64 bits as a long) of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for keys, texts in text_chunks(batch, 0, 1, 4 << 20):
                fp = fingerprints_of(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(fp)], names=["id", "fp"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(run), f"id {kind.simpleString()}, fp bigint").withColumnRenamed("id", id_col)


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct uint64 values: each value but the first of a component
    and the one it was reached from."""
    differ = values[:, None] ^ values[None, :]
    shared = (differ.view(np.uint8).reshape(len(values), -1, POSITIONS) == 0).sum(axis=2, dtype=np.uint8)
    linked = shared >= SHARED
    at = np.nonzero(linked)
    linked[at] = np.bitwise_count(differ[at]) <= DISTANCE
    left, out = np.ones(len(values), bool), []
    while left.any():
        reached = np.array([left.argmax()])
        while len(reached):
            left[reached] = False
            new = linked[reached][:, left]
            some = np.flatnonzero(left)[new.any(axis=0)]
            out.append((reached[new.argmax(axis=0)[new.any(axis=0)]], some))
            reached = some
    a, b = (np.concatenate(x) for x in zip(*out))
    return values[a], values[b]


#: Four byte offsets of a choice of positions, the first in the highest byte, under the choice's number.
CHOICES = [sum(8 * p << 8 * (SHARED - 1 - i) for i, p in enumerate(at)) + (k << 32) for k, at in enumerate(combinations(range(POSITIONS), SHARED))]


def entries(distinct: DataFrame) -> DataFrame:
    """(fp, list): each fingerprint ``fp`` with its list of each choice, whose number stands over its four bytes.

    The choices are one literal: an expression for each would be walked by every rule of every plan that reads
    the entries, on the driver, again whenever a stage of it ends.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes 70: not in few tasks
    each = distinct.repartition(parts, "fp").select("fp", F.explode(F.array(*[F.lit(c).cast("long") for c in CHOICES])).alias("at"))
    key = "shiftright(at, 32)"
    for i in reversed(range(SHARED)):
        key = f"shiftleft({key}, 8) | shiftrightunsigned(fp, int(shiftright(at, {8 * i}) & 255)) & 255"
    return each.selectExpr("fp", f"{key} AS list")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, a spanning forest of each two blocks of a list."""
    lists = entries(distinct)
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    # the estimate of ``lists`` misses that each row became 70: without the hint Spark would broadcast them all
    met = lists.join(sizes.hint("merge"), "list").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    blocks = durable(met.groupBy("list", "block", "blocks").agg(F.collect_list("fp").alias("fps")))
    left = blocks.select("list", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), "block", F.col("fps").alias("xs"))
    right = blocks.where("block > 0").select("list", F.col("block").alias("other"), F.col("fps").alias("ys"))
    both = left.where("other > block").join(right, ["list", "other"]).select(F.concat("xs", "ys").alias("fps"))
    own = left.where("other = block").select(F.col("xs").alias("fps"))

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for fps in batch.column(0):
                x, y = forest(fps.values.to_numpy().view(np.uint64))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return own.unionByName(both).mapInArrow(lean(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fp`` (long) and ``component_id`` (smallest id reachable over links) of every row."""
    fps = durable(fingerprints(docs, id_col, text_col))
    classes = durable(fps.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("n")))
    group = durable(components(links(classes.select("fp"))).withColumnRenamed("node", "fp"))
    least = classes.join(group, "fp").groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = durable(classes.join(group, "fp", "left").join(least, "component", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"), "n"))
    return with_class(fps, label, ["fp"], id_col).select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: that of the least id, null ids last; of rows that
    share it, that of the least fingerprint and hash of the text; of rows with one id and text, any one."""
    own, mark, of, rows = fresh(docs, "_kept", "_mark", "_of", "_rows")
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark")).alias("key"), text.alias("text"))
    fps = durable(fingerprints(keyed, "key", "text").select("key.id", "key.mark", "fp").groupBy("fp", "id", "mark").agg(F.count(F.lit(1)).alias("n")))
    least = durable(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp", "mark", "n")).alias("least")))
    group = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    first = least.join(group, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least"))
    kept = durable(first.select(F.col("least.id").alias(own), F.col("least.mark").alias(of), F.col("least.n").alias(rows)))
    marked = docs.withColumn(mark, F.xxhash64(text))
    # ``kept`` has a row for almost every document: under the threshold Spark would still build it on the driver
    semi = lambda some: marked.join(some.hint("merge"), F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(of)), "left_semi")
    repeated = kept.where(F.col(rows) > 1)
    if repeated.isEmpty():
        return semi(kept).drop(mark)
    return semi(kept.where(F.col(rows) == 1)).unionByName(semi(repeated).dropDuplicates([id_col, mark])).drop(mark)
