"""Co-occurrence graph of frame rows: symmetric weighted edges between terms, entities and verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Kinds, the weight of one row's pair by kinds, and limits.
KINDS = {"term": 0, "entity": 1, "verb": 2}
WEIGHTS = {("term", "term"): 4096, ("term", "entity"): 8192, ("term", "verb"): 6144, ("entity", "verb"): 10240}
ROW_TERMS, ROW_ENTITIES, TOP_EDGES, MAX_SEEDS, MOST = 8, 4, 32, 1024, 65535


def row_nodes(postings: DataFrame, entities: DataFrame | None = None, verbs: DataFrame | None = None) -> DataFrame:
    """(segment_id, row_ix, kind, node): a row's terms and entities of lowest key, and its verb."""

    def lowest(rows: DataFrame, kind: str, most: int) -> DataFrame:
        order = Window.partitionBy("segment_id", "row_ix").orderBy(T.order_key("node"), "node")
        return rows.select("segment_id", "row_ix", "node").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("segment_id", "row_ix", F.lit(kind).alias("kind"), "node")

    out = lowest(postings.withColumnRenamed("term", "node"), "term", ROW_TERMS)
    if entities is not None:
        out = out.unionByName(lowest(entities, "entity", ROW_ENTITIES))
    if verbs is not None:
        out = out.unionByName(verbs.select("segment_id", "row_ix", F.lit("verb").alias("kind"), "node").distinct())
    return out


def cooccurrence(nodes: DataFrame) -> DataFrame:
    """(seed_kind, seed, target_kind, target, weight, hop, symmetric), both directions of each pair.

    A row has at most 13 nodes, so its pairs are built inside the row, without a join.
    """
    node = F.struct("kind", "node")
    rows = nodes.groupBy("segment_id", "row_ix").agg(F.collect_list(node).alias("all"))
    pairs = rows.select(F.explode(F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: (a["kind"] != b["kind"]) | (a["node"] != b["node"])), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    weight = F.lit(None).cast("int")
    for (x, y), w in WEIGHTS.items():
        k, m = F.col("p.a.kind"), F.col("p.b.kind")
        weight = F.when(((k == x) & (m == y)) | ((k == y) & (m == x)), w).otherwise(weight)
    out = pairs.select(F.col("p.a.kind").alias("seed_kind"), F.col("p.a.node").alias("seed"), F.col("p.b.kind").alias("target_kind"), F.col("p.b.node").alias("target"), weight.cast("bigint").alias("w")).where("w is not null")
    return out.groupBy("seed_kind", "seed", "target_kind", "target").agg(F.least(F.sum("w"), F.lit(MOST)).cast("bigint").alias("weight")).withColumns({"hop": F.lit(1).cast("bigint"), "symmetric": F.lit(True)})


def strongest(edges: DataFrame, per_seed: int = TOP_EDGES, seeds: int = MAX_SEEDS) -> DataFrame:
    """Each seed's ``per_seed`` strongest edges, of the ``seeds`` seeds of lowest kind and key."""
    first = edges.select("seed_kind", "seed").distinct().orderBy("seed_kind", T.order_key("seed"), "seed").limit(seeds)
    own = edges.join(first, ["seed_kind", "seed"], "left_semi")
    order = Window.partitionBy("seed_kind", "seed").orderBy(F.col("weight").desc(), "target_kind", T.order_key("target"), "target")
    return own.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= per_seed)


def build_plan(inputs: DataFrame, per_kind: int = 64, total: int = 256) -> DataFrame:
    """Distinct inputs (kind, id), at most ``per_kind`` of a kind and ``total`` in all, in order."""
    one = inputs.select("kind", "id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where(F.col("_n") <= per_kind)
    return one.orderBy("kind", "id").limit(total).select("kind", "id")
