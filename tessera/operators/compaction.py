"""Segments packed into groups: which go together, and an index written anew by groups.

Packing is next-fit in the segments' order: a group takes segments until the next one would not fit. Where a group that
begins with a segment ends is a search in the running sums, so it is known for every segment at once; the groups that there
are begin with what is reached from the first segment by these steps, which are doubled until all is reached. No task and no
array holds all segments; what meets in one window is a range of ids, or the segments of one group's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.store import kept

#: Ranges of ids whose sums are made apart.
RANGES = 1 << 16


def running(sizes: DataFrame, order_col: str, size_col: str) -> DataFrame:
    """(order_col, size_col, at, before, n): each segment's place (0 ..), the bytes before it, and how many there are."""
    own = sizes.select(F.col(order_col).cast("bigint").alias(order_col), F.col(size_col).cast("bigint").alias(size_col))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    ends = own.agg(F.min(order_col).alias("_low"), F.max(order_col).alias("_high"))
    step = F.greatest(F.lit(1), F.ceil((wide("_high") - wide("_low") + 1) / RANGES))
    ranged = own.crossJoin(F.broadcast(ends)).select(order_col, size_col, F.floor((wide(order_col) - wide("_low")) / step).cast("bigint").alias("_range"))  # one row
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(size_col).alias("_bytes"))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("_range", zero("_n", earlier).alias("_at"), zero("_bytes", earlier).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    within = Window.partitionBy("_range").orderBy(order_col)
    placed = ranged.withColumn("at", F.row_number().over(within) - 1).withColumn("before", zero(size_col, within.rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(F.broadcast(sums), "_range").select(order_col, size_col, (F.col("at") + F.col("_at")).alias("at"), (F.col("before") + F.col("_before")).alias("before"), "n")


def dealt(at: Column, n: Column, groups: int) -> Column:
    """The group of the at-th of n, dealt into runs whose counts differ by at most one, longer ones first."""
    small, more = F.floor(n / groups), n % groups
    first = more * (small + 1)
    return F.when(at < first, F.floor(at / (small + 1))).otherwise(more + F.floor((at - first) / F.greatest(small, F.lit(1)))).cast("bigint")


def even_groups(sizes: DataFrame, groups: int, order_col: str = "segment_id", size_col: str = "bytes") -> DataFrame:
    """(order_col, size_col, group_id): segments dealt into ``groups`` runs whose counts differ by at most one."""
    if groups < 1:
        raise ValueError("groups must be 1 or more")
    return running(sizes, order_col, size_col).select(order_col, size_col, dealt(F.col("at"), F.col("n"), groups).alias("group_id"))


def next_begins(sums: DataFrame, target: int) -> DataFrame:
    """(at, to): of each segment of ``running``, the place where the group that begins with it ends, and the next begins.

    The end of the table is a place too. A segment's probe lies ``target`` bytes beyond its place, so in the next range of
    ``target`` bytes: the last place up to it is there, or else it is the last of the segment's own range.
    """
    part = F.floor(F.col("value") / target).alias("part")
    places = sums.select("at", F.col("before").alias("value")).unionByName(sums.agg((F.max("at") + 1).alias("at"), F.max(F.col("before") + F.col("bytes")).alias("value")))
    points = places.select("at", "value", part, F.lit(0).alias("kind"))
    probes = sums.select("at", (F.col("before") + target).alias("value")).select("at", "value", part, F.lit(1).alias("kind"))
    held = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(Window.partitionBy("part").orderBy("value", "kind", "at"))
    ends = points.groupBy((F.col("part") + 1).alias("part")).agg(F.max("at").alias("_end"))
    found = points.unionByName(probes).withColumn("held", held).where("kind = 1").join(ends, "part")
    return found.select("at", F.greatest(F.coalesce("held", "_end"), F.col("at") + 1).alias("to"))


def greedy_groups(sizes: DataFrame, target: int, max_out: int = 8, order_col: str = "segment_id", size_col: str = "bytes") -> DataFrame:
    """(order_col, size_col, group_id): segments packed in order into groups of at most ``target`` bytes, a larger one
    alone; an even deal into ``max_out`` groups if that needs more. The driver sees one count a doubling."""
    if target < 1 or max_out < 1:
        raise ValueError("target and max_out must be 1 or more")
    sums = kept(running(sizes.withColumnRenamed(size_col, "bytes"), order_col, "bytes"))
    steps, begun, n = kept(next_begins(sums, target)), kept(sums.where("at = 0").select("at")), 1
    while True:
        # with steps of 2^k groups, what is reached in up to 2^k of them becomes what is reached in up to 2^(k+1)
        begun = kept(begun.unionByName(begun.join(steps, "at").select(F.col("to").alias("at"))).join(sums.select("at"), "at", "left_semi").distinct())
        before, n = n, begun.count()
        if n == before or n > max_out:
            break
        steps = kept(steps.join(steps.select(F.col("at").alias("to"), F.col("to").alias("_to")), "to").select("at", F.col("_to").alias("to")))
    if n > max_out:
        return even_groups(sizes, max_out, order_col, size_col)
    flags = sums.join(begun.withColumn("flag", F.lit(1)), "at", "left").select(order_col, "bytes", F.coalesce("flag", F.lit(0)).alias("flag"))
    placed = running(flags, order_col, "flag").select(order_col, (F.col("before") + F.col("flag") - 1).alias("group_id"))
    return flags.select(order_col, F.col("bytes").alias(size_col)).join(placed, order_col)


def compact(rows: DataFrame, groups: DataFrame, order: list[str] = ["segment_id"]) -> DataFrame:
    """Rows of an index table with the group their segment goes to, dealt by group and sorted in it. Segments stay
    as they are, so statistics and scores do too."""
    return rows.join(groups.select("segment_id", "group_id"), "segment_id").repartition("group_id").sortWithinPartitions("group_id", *order)


def compact_stored(spark: SparkSession, path: str, out: str, target: int, max_out: int = 8) -> DataFrame:
    """Writes the index of ``path`` anew to ``out``, its postings in a folder a group, and returns the report.

    (group_id, first_segment, last_segment, n_segments, bytes, n_postings): bytes are those of the segments' texts. The
    old files are not touched; the report is written last, once every posting has been found again, so a folder without
    one is not whole, and may be written again. Old postings are read once: what is read is summed up on the way, and only
    where new files sum up to something else is it looked at by segment.
    """
    from tessera.plans.loop import Index

    old = Index.read(spark, path)
    sizes = old.rows.groupBy("segment_id").agg(F.sum(F.octet_length("body")).cast("bigint").alias("bytes"))
    groups = kept(greedy_groups(kept(sizes), target, max_out))
    sums = F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("segment_id", "term", "row_ix", "doc_id", "tf")), F.lit(0)).alias("h")
    read = Observation()
    Index(old.rows, old.postings.drop("pack").observe(read, *sums), old.segments.drop("pack"), old.peaks, old.signatures, old.signature_map).write(out, packs=groups.select("segment_id", F.col("group_id").alias("pack")))
    new = Index.read(spark, out)
    held = kept(new.postings.groupBy(F.col("pack").cast("bigint").alias("group_id")).agg(*sums))
    whole = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h")).first().asDict()
    if whole != read.get:
        counts = lambda ix: ix.postings.groupBy("segment_id").agg(*sums)
        lost = counts(old).unionByName(counts(new)).groupBy("segment_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("n", "h").alias("v")).where("m <> 2 or v <> 1")
        if (bad := lost.first()) is not None:
            raise ValueError(f"segment {bad['segment_id']} was not written whole")
    told = groups.groupBy("group_id").agg(F.min("segment_id").alias("first_segment"), F.max("segment_id").alias("last_segment"), F.count(F.lit(1)).alias("n_segments"), F.sum("bytes").alias("bytes"))
    told.join(held, "group_id", "left").select("group_id", "first_segment", "last_segment", "n_segments", "bytes", F.coalesce("n", F.lit(0)).alias("n_postings")).write.mode("overwrite").parquet(f"{out}/report")
    return spark.read.parquet(f"{out}/report")
