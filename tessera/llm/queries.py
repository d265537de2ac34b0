"""The thin opN queries: each applies its operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licence, lines, media, merkle, negatives, ordermin, quality, sharding, simhash, toxicity
from .common import table

SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licence.scan(table(spark, sf_dir, "documents"))
    place = lambda name: F.transform("phrases", lambda p: p[name])
    base = F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    every = F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))
    found = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(place("first")).alias("first_word"),
        F.array_max(place("first")).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.least(found, F.lit(1.0))).alias("score"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(id_col: str = "doc_id"):
    """Whether a row is of the fold that is never learnt from; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations told as raw transcripts, whose roles are recovered from the lines alone by a model
    counted from those that are not held out."""
    rows = table(spark, sf_dir, "conversations")
    lines_ = chat.split_lines(rows, "conv_id", "turn", chat.raw_form(F.col("role"), F.col("text"), F.col("conv_id")))
    out = chat.parse(lines_, chat.train(rows.where(~held_out("conv_id"))))
    return out.select(F.col("conv").alias("conv_id"), "turn", F.col("line_no").cast("long").alias("line_no"), "role", "begins", F.sha2("rendered", 256).alias("rendered_sha256"), held_out("conv").alias("held_out"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proven against the root; every second one, by its checksum, is claimed with its line feeds deleted."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.checked(merkle.manifest(table(spark, sf_dir, "documents"), {"text": text}))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, label_col=label)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordermin.edited(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id", "next_chars")


def token_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the hashes of ids and decoded text, of rows of ``bpe.encode_decode``."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_licence, op2_decontamination, op3_sharding, op4_media, op5_quality, op6_bpe, op7_simhash, op8_toxicity, op9_chat, op10_lines, op11_merkle, op12_hard_negatives, op13_fingerprints)}
#: Letters beyond ASCII in the test tables: DuckDB's levenshtein counts bytes, so each becomes one control character first.
WIDE = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍáàâîôûœúù"
NARROW = " || ".join(f"chr({k})" for k in [*range(1, 10), *range(11, 32)])
#: CRC-32 of an ASCII string, bit by bit, as DuckDB has none.
CRC32 = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


ORACLE: dict[str, str] = {
    "op10_lines": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS line_no, trim(x) AS line, doc_id::HUGEINT * {lines.LINE_SPAN} + i - 1 AS own
  FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
  WHERE length(trim(x)) >= {lines.EXACT_CHARS}),
c AS (SELECT line, min(own) AS pos, length(line) AS n, translate(line, '{WIDE}', {NARROW}) AS narrow FROM l GROUP BY line),
e AS (SELECT a.pos AS a, b.pos AS b FROM c a JOIN c b ON b.n BETWEEN a.n - {lines.THRESHOLD} AND a.n + {lines.THRESHOLD}
  WHERE a.pos <> b.pos AND a.n >= {lines.NEAR_CHARS} AND b.n >= {lines.NEAR_CHARS} AND levenshtein(a.narrow, b.narrow) <= {lines.THRESHOLD}),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT node, least(node, min(other)) AS first FROM r GROUP BY node),
d AS (SELECT a, count(*)::BIGINT AS n_links FROM e GROUP BY a)
SELECT l.doc_id, l.line_no, (coalesce(g.first, c.pos) // {lines.LINE_SPAN})::BIGINT AS class_id, (coalesce(g.first, c.pos) % {lines.LINE_SPAN})::BIGINT AS class_line, coalesce(d.n_links, 0) AS n_links, l.own = coalesce(g.first, c.pos) AS kept
FROM l JOIN c USING (line) LEFT JOIN g ON g.node = c.pos LEFT JOIN d ON d.a = c.pos""",
    "op11_merkle": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf, claimed
  FROM (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS claimed FROM documents)),
tree AS (
  SELECT 0 AS level, source, place, leaf AS node FROM leaves
  UNION ALL SELECT level + 1, source, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM tree) WHERE n > 1 GROUP BY level, source, place // 3),
subroots AS (SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM (SELECT *, max(level) OVER (PARTITION BY source) AS top FROM tree) WHERE level = top),
forest AS (
  SELECT 0 AS level, place, subroot AS node FROM subroots
  UNION ALL SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM forest) WHERE n > 1 GROUP BY level, place // 3),
tops AS (SELECT node AS root, level AS height FROM forest ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT l.doc_id, l.leaf, t.level, string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < l.place // (3 ** t.level)::BIGINT) AS lefts, string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > l.place // (3 ** t.level)::BIGINT) AS rights
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.level < s.height AND t.place // 3 = l.place // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
  UNION ALL SELECT l.doc_id, l.leaf, s.height + t.level, string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < s.place // (3 ** t.level)::BIGINT), string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > s.place // (3 ** t.level)::BIGINT)
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN tops JOIN forest t ON t.level < tops.height AND t.place // 3 = s.place // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
folds AS (
  SELECT doc_id, leaf, 0 AS level, claimed AS node FROM leaves
  UNION ALL SELECT f.doc_id, f.leaf, f.level + 1, sha256(coalesce(s.lefts, '') || f.node || coalesce(s.rights, '')) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.level = f.level),
proofs AS (SELECT doc_id, leaf, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY level) AS proof FROM steps GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, s.subroot, tops.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = tops.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN tops LEFT JOIN proofs p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
JOIN (SELECT doc_id, leaf, node, level, max(level) OVER (PARTITION BY doc_id, leaf) AS top FROM folds) f ON f.doc_id = l.doc_id AND f.leaf = l.leaf AND f.level = f.top""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS own, list_dot_product(a.vec, b.vec)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3""",
}
