"""Evidence: hits become de-duplicated, byte-budgeted bundles with row sketches; claims are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Encoded sizes in bytes.
HEADER, ITEM, SKETCH, ENTITY, CODE, TERM = 86, 46, 12, 4, 4, 8
SKETCH_TERMS = 16
BUDGET = 64 * 1024


def bundle(hits: DataFrame, max_items: int = 0) -> DataFrame:
    """(query_id, item_ix, score, segment_id, row_ix, doc_id): a row once with its best score, best first."""
    best = hits.groupBy("query_id", "segment_id", "row_ix", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "segment_id", "row_ix")
    out = best.withColumn("item_ix", (F.row_number().over(order) - 1).cast("bigint"))
    return out if not max_items else out.where(F.col("item_ix") < max_items)


def segments_touched(items: DataFrame) -> DataFrame:
    return items.groupBy("query_id").agg(F.count_distinct("segment_id").alias("segments_touched"))


def sketches(items: DataFrame, postings: DataFrame, max_terms: int = SKETCH_TERMS) -> DataFrame:
    """(segment_id, row_ix, place, term, tf): each item row's strongest terms, by tf then key."""
    rows = postings.join(items.select("segment_id", "row_ix").distinct(), ["segment_id", "row_ix"], "left_semi")
    order = Window.partitionBy("segment_id", "row_ix").orderBy(F.col("tf").desc(), T.order_key("term"), "term")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= max_terms).select("segment_id", "row_ix", "place", "term", "tf")


def folded_ids(ids: Column, most: int = 16) -> Column:
    """Sorted distinct 32-bit folds of an array of ids, at most ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(ids, T.xor_fold))), 1, most)


def sketch_cost(terms: Column, entities: Column | int = 0, codes: Column | int = 0) -> Column:
    return terms * TERM + entities * ENTITY + codes * CODE + SKETCH


def budgeted(items: DataFrame, costs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Items with ``cost`` and ``sketched``: in order, a sketch that does not fit any more is left out
    and the next one is tried. Items themselves (with the header) are paid for first."""
    item = F.struct("item_ix", "cost", "segment_id", "row_ix", "score")
    listed = items.join(costs, ["segment_id", "row_ix"]).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    free = (F.lit(budget - HEADER) - F.size("all") * ITEM).cast("bigint")
    start = F.struct(free.alias("free"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        fits = x["cost"] <= acc["free"]
        return F.struct(F.when(fits, acc["free"] - x["cost"]).otherwise(acc["free"]).cast("bigint").alias("free"), F.when(fits, F.concat(acc["kept"], F.array(x["item_ix"]))).otherwise(acc["kept"]).alias("kept"))

    out = listed.withColumn("kept", F.aggregate("all", start, step)["kept"]).select("query_id", "kept", F.explode("all").alias("x"))
    return out.select("query_id", "x.item_ix", "x.segment_id", "x.row_ix", "x.score", "x.cost", F.array_contains("kept", F.col("x.item_ix")).alias("sketched"))


def missing_refs(refs: DataFrame, segs: DataFrame) -> DataFrame:
    """References to segments that do not exist or rows beyond their segment, with the reason."""
    out = refs.join(segs.select("segment_id", "row_count"), "segment_id", "left")
    reason = F.when(F.col("row_count").isNull(), "missing_segment").when((F.col("row_ix") < 0) | (F.col("row_ix") >= F.col("row_count")), "row_out_of_range")
    return out.withColumn("reason", reason).where("reason is not null").drop("row_count")


#: Violation codes, in the order of the checks.
CODES = ["V000", "V001", "V010", "V011", "V020", "V021", "V022"]


def verify_claims(claims: DataFrame, refs: DataFrame, items: DataFrame, max_refs: int = 64) -> DataFrame:
    """(code, bundle_id, claim_id) violations of an evidence set, empty if all is well.

    claims (bundle_id, claim_id, text), refs (bundle_id, claim_id, segment_id, row_ix, score), items
    the bundles' rows (bundle_id, segment_id, row_ix, score). V000: no claim in a bundle; V001: claim
    numbers repeat; V010: empty text; V011: no reference; V020: a reference repeats or there are too
    many; V021: not in the bundle; V022: another score than in the bundle.
    """
    at = ["bundle_id", "claim_id"]
    code = lambda c, rows: rows.select(F.lit(c).alias("code"), "bundle_id", F.col("claim_id").cast("bigint").alias("claim_id"))
    none = items.select("bundle_id").distinct().join(claims, "bundle_id", "left_anti").withColumn("claim_id", F.lit(None).cast("bigint"))
    counted = refs.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment_id", "row_ix").alias("m"))
    held = items.select("bundle_id", "segment_id", "row_ix", F.col("score").alias("held"))
    met = refs.join(held, ["bundle_id", "segment_id", "row_ix"], "left")
    parts = [
        code("V000", none),
        code("V001", claims.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
        code("V010", claims.where(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)),
        code("V011", claims.join(refs, at, "left_anti")),
        code("V020", counted.where((F.col("n") > F.col("m")) | (F.col("n") > max_refs))),
        code("V021", met.where("held is null")),
        code("V022", met.where("held <> score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def canonical_refs(refs: DataFrame) -> DataFrame:
    order = Window.partitionBy("bundle_id", "claim_id").orderBy("segment_id", "row_ix")
    return refs.distinct().withColumn("ref_ix", (F.row_number().over(order) - 1).cast("bigint"))
