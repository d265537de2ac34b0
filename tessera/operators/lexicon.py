"""Lexicon tables (lemmas, senses, relations, pronunciations): build, shard, check, look up, walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.phonetic import code_column
from tessera.sources.store import kept

#: Parts of speech as bits, and relation types.
POS = {"noun": 1, "verb": 2, "adjective": 4, "adverb": 8, "proper noun": 16, "pronoun": 32, "determiner": 64, "preposition": 128, "conjunction": 256, "interjection": 512, "numeral": 1024, "particle": 2048}
CONTENT = POS["noun"] | POS["verb"] | POS["adjective"] | POS["adverb"] | POS["proper noun"]
RELATIONS = ["synonyms", "antonyms", "hypernyms", "hyponyms", "derived terms", "related terms", "coordinate terms", "holonyms", "meronyms"]
WALKED = [r for r in RELATIONS if r != "antonyms"]
#: Where the walks for cue words begin.
PROBLEM_SEEDS = ["problem", "solve", "fix", "error", "issue", "debug", "troubleshoot"]
PUZZLE_SEEDS = ["puzzle", "riddle", "logic", "constraint", "deduce"]


def lemma_key(c):
    """Look-up key: trimmed, A-Z lower-cased."""
    return T.ascii_lower(F.trim(T.col(c)))


def tables(pages: DataFrame) -> dict[str, DataFrame]:
    """The four tables from parsed pages (title, pos_mask, glosses, relations array of (type, target), ipa); pages without a
    part of speech are no lemmas.

    Of pages with one title the least (by all columns) stands, whatever the partitions; ``duplicates`` names them.
    """
    own = pages.where("pos_mask <> 0").groupBy("title").agg(F.min(F.struct("pos_mask", "glosses", "relations", "ipa")).alias("page")).select("title", "page.*")
    lemmas = own.select(F.col("title").alias("lemma"), lemma_key("title").alias("lemma_key"), F.col("pos_mask").cast("bigint").alias("pos_mask"))
    senses = own.select(F.col("title").alias("lemma"), F.posexplode("glosses").alias("sense_rank", "gloss")).withColumn("sense_rank", F.col("sense_rank").cast("bigint"))
    relations = own.select(F.lit("lemma").alias("from_kind"), F.col("title").alias("from_id"), F.explode("relations").alias("r")).select("from_kind", "from_id", F.col("r.type").alias("rel_type"), F.col("r.target").alias("to_lemma")).distinct()
    ipa = own.select(F.col("title").alias("lemma"), F.explode("ipa").alias("ipa")).distinct()
    pronunciations = ipa.select("lemma", "ipa", F.array_distinct(F.filter(F.array(code_column(F.col("lemma")), code_column(F.col("ipa"))), lambda c: c.isNotNull())).alias("meta_codes"))
    return {"lemmas": lemmas, "senses": senses, "relations": relations, "pronunciations": pronunciations}


def sense_id(lemma, rank):
    """The id of a lemma's sense."""
    return T.numeric_id(F.concat(F.lit("sense:"), T.col(lemma), F.lit("#"), T.col(rank).cast("string")))


def duplicates(rows: DataFrame, key: str = "lemma") -> DataFrame:
    """Keys that stand more than once in a table, which a segment build is to reject."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def segment_of(owner, n: int):
    return F.pmod(T.numeric_id(F.concat(F.lit("lemma:"), T.col(owner))), F.lit(n)).cast("bigint")


def segmented(lemmas: DataFrame, senses: DataFrame, relations: DataFrame, n: int) -> dict[str, DataFrame]:
    """Tables with the segment of their owner lemma; a relation of a sense ("lemma#rank") goes to the sense's lemma."""
    owner = F.when(F.col("from_kind") == "sense", F.substring_index("from_id", "#", 1)).otherwise(F.col("from_id"))
    return {"lemmas": lemmas.withColumn("segment_id", segment_of("lemma", n)), "senses": senses.withColumn("segment_id", segment_of("lemma", n)), "relations": relations.withColumn("segment_id", segment_of(owner, n))}


def unknown_owners(senses: DataFrame, relations: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Rows whose owner is no lemma: (what, owner)."""
    owner = F.when(F.col("from_kind") == "sense", F.substring_index("from_id", "#", 1)).otherwise(F.col("from_id"))
    rows = senses.select(F.lit("sense").alias("what"), F.col("lemma").alias("owner")).unionByName(relations.select(F.lit("relation").alias("what"), owner.alias("owner")))
    return rows.join(lemmas.select(F.col("lemma").alias("owner")), "owner", "left_anti").distinct()


def shared_owners(segment_lemmas: DataFrame) -> DataFrame:
    """Lemmas that stand in more than one segment."""
    return segment_lemmas.groupBy("lemma").agg(F.count_distinct("segment_id").alias("n_segments")).where("n_segments > 1")


def inventory(segment_lemmas: DataFrame) -> DataFrame:
    return segment_lemmas.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_lemmas"))


def lookup(keys: DataFrame, lemmas: DataFrame, cap: int = 64) -> DataFrame:
    """(key, lemma, pos_mask): the first ``cap`` lemmas of each key."""
    out = keys.select(lemma_key("key").alias("key")).distinct().join(lemmas.withColumnRenamed("lemma_key", "key"), "key")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(T.order_key("lemma"), "lemma"))).where(F.col("_n") <= cap).select("key", "lemma", "pos_mask")


def related(lemmas: DataFrame, relations: DataFrame, types: list[str], cap: int = 16) -> DataFrame:
    """(lemma, to_lemma): distinct targets of some relation types, the first ``cap`` of each lemma."""
    own = relations.where(F.col("rel_type").isin(types)).select(F.col("from_id").alias("lemma"), "to_lemma").distinct()
    own = lemmas.select("lemma").distinct().join(own, "lemma")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("lemma").orderBy(T.order_key("to_lemma"), "to_lemma"))).where(F.col("_n") <= cap).select("lemma", "to_lemma")


def neighbourhood(seeds: DataFrame, relations: DataFrame, depth: int = 2, per_node: int = 64, cap: int = 4096) -> DataFrame:
    """(lemma, depth): lemmas reached from the seeds in up to ``depth`` relation steps, at the least
    depth; the ``cap`` of least depth and key. Each step goes on from what the last one found anew, which is written."""
    edges = relations.where(F.col("rel_type").isin(WALKED)).select(F.col("from_id").alias("lemma"), "to_lemma").distinct()
    edges = kept(edges.withColumn("_n", F.row_number().over(Window.partitionBy("lemma").orderBy(T.order_key("to_lemma"), "to_lemma"))).where(F.col("_n") <= per_node).drop("_n"))
    seen = fresh = kept(seeds.select("lemma").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    for d in range(1, depth + 1):
        found = fresh.select("lemma").join(edges, "lemma").select(F.col("to_lemma").alias("lemma")).distinct()
        fresh = kept(found.join(seen, "lemma", "left_anti").withColumn("depth", F.lit(d).cast("bigint")))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen.orderBy("depth", T.order_key("lemma"), "lemma").limit(cap)
