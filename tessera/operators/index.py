"""Frames, postings, statistics, segment maintenance.

A frame row is a piece of a document; a segment holds the rows of ``seg_docs`` consecutive document
ids, so segments need no global numbering and every window below is over one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.phonetic import MARK, code_freqs, codes_of
from tessera.sources import store

ROW_BYTES = 8192
SEG_DOCS = 512
MAX_SHARDS = 4096
#: Documents whose row numbers are sent to the texts: 24 MB.
BROADCAST_DOCS = 1_000_000
#: Rows of a table of asked terms, or of rows, that are sent to the postings: 30 MB.
BROADCAST_ROWS = 200_000
#: Words, with the asked terms that they stand for, that are sent to the rows: about 300 MB.
BROADCAST_HEARD = 2_000_000


#: Documents of a table that are dealt to one task, by segment; the column that says by what.
TASK_DOCS, DEALT = 4096, "_segment"


#: Ranges of ids that ``dense_numbers`` numbers apart.
RANGES = 1 << 16


def dense_numbers(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, doc_number): the distinct ids numbered 0 .. n-1 in their order, so that hashed ids fill segments.

    The span of the ids is cut into RANGES ranges; their counts are summed up in one window over at most
    RANGES rows, and each range numbers its own ids. Texts do not move.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    ends = ids.agg(F.min(id_col).alias("_low"), F.max(id_col).alias("_high"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    at = F.floor((wide(id_col) - wide("_low")) / F.greatest(F.lit(1), F.ceil((wide("_high") - wide("_low") + 1) / RANGES)))
    ranged = ids.crossJoin(F.broadcast(ends)).select(id_col, at.cast("bigint").alias("_range"))  # one row
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(id_col)) - 1
    return ranged.join(F.broadcast(offsets), "_range").select(id_col, (F.col("_offset") + within).cast("bigint").alias("doc_number"))


def task_parts(docs: DataFrame) -> int:
    """How many tasks share a table of documents: about TASK_DOCS each."""
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCS))


def dealt(docs: DataFrame, parts: int, seg_docs: int = SEG_DOCS, id_col: str = "doc_id", number_col: str | None = None) -> DataFrame:
    """Documents dealt by their segment to so many tasks (``task_parts``): all tables of segments are made where
    the texts then are, and what a task holds does not grow with the table."""
    return docs.withColumn(DEALT, segment_of(F.col(number_col or id_col).cast("bigint"), seg_docs)).repartition(parts, DEALT)


def segment_of(number: Column, seg_docs: int) -> Column:
    return F.floor(number / seg_docs)


def pieces(docs: DataFrame, row_bytes: int = ROW_BYTES, seg_docs: int = SEG_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", number_col: str | None = None) -> DataFrame:
    """(segment_id, doc_id, text_hash, source_id, chunk, body) of the documents' pieces of up to ``row_bytes`` bytes in
    UTF-8, cut where the scan reads them; null and empty texts have none, nor have documents without an id."""
    doc, number = F.col(id_col).cast("bigint"), F.col(number_col or id_col).cast("bigint")
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    segment = F.col(DEALT) if DEALT in docs.columns else segment_of(number, seg_docs)
    rows = docs.where(doc.isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(segment.alias("segment_id"), doc.alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), source.alias("source_id"), F.posexplode_outer(T.utf8_pieces(text_col, row_bytes)).alias("chunk", "body"))
    return rows.withColumn("chunk", F.col("chunk").cast("bigint"))


def first_rows(docs: DataFrame, row_bytes: int = ROW_BYTES, seg_docs: int = SEG_DOCS, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """(doc_id, text_hash, first_row): the number, in its segment, of each document's first piece: the pieces of the
    documents before it, summed up over ids and counts alone."""
    doc, number = F.col(id_col).cast("bigint"), F.col(number_col or id_col).cast("bigint")
    rows = docs.where(doc.isNotNull() & (F.length(text_col) > 0))
    counts = rows.select(F.floor(number / seg_docs).alias("segment_id"), doc.alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(T.utf8_starts(F.encode(text_col, "UTF-8"), row_bytes)).alias("n")).distinct()
    before = Window.partitionBy("segment_id").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("doc_id", "text_hash", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first_row"))


def frames(docs: DataFrame, row_bytes: int = ROW_BYTES, seg_docs: int = SEG_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", number_col: str | None = None, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """(segment_id, row_ix, doc_id, source_id, chunk, body) of rows of up to ``row_bytes`` bytes.

    A segment has ``seg_docs`` consecutive ids or, where ids are not dense, values of ``number_col``. Up to
    ``broadcast_docs`` documents (24 bytes each) their numbers go to the texts, which stay where they are read; beyond that
    both meet by document id, which takes one shuffle of the texts and no sort. Rows of ``dealt`` documents are numbered
    where they are. Rows of one id and text count once.
    """
    whole = pieces(docs, row_bytes, seg_docs, id_col, text_col, source_col, number_col)
    if DEALT in docs.columns:
        place = F.dense_rank().over(Window.partitionBy("segment_id").orderBy("doc_id", "text_hash", "chunk")) - 1
        return whole.select("segment_id", place.cast("bigint").alias("row_ix"), "doc_id", "source_id", "chunk", "body")
    numbers = first_rows(docs, row_bytes, seg_docs, id_col, text_col, number_col)
    numbers = F.broadcast(numbers) if docs.count() <= broadcast_docs else numbers.hint("shuffle_hash")
    row_ix = (F.col("first_row") + F.col("chunk")).alias("row_ix")
    return whole.join(numbers, ["doc_id", "text_hash"]).select("segment_id", row_ix, "doc_id", "source_id", "chunk", "body")


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether documents share an id, so that a row may be told twice."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint")).agg(F.count(F.lit(1)).alias("n"))
    return not ids.where("n > 1").isEmpty()


def row_terms(rows: DataFrame, max_token: int = T.MAX_TOKEN, phonetic: bool = False, repeated: bool = True) -> DataFrame:
    """(segment_id, row_ix, doc_id, term, tf): the postings, with ``phonetic`` those of codes too.

    A row's terms are counted where the row is; only where rows may be ``repeated`` their counts meet in a shuffle.
    """
    # not inline: that some terms are there would be inferred, and every text taken apart twice
    out = rows.select("segment_id", "row_ix", "doc_id", F.inline_outer(T.counted(T.terms("body", max_token)))).where("term is not null")
    if repeated:
        out = out.groupBy("segment_id", "row_ix", "doc_id", "term").agg(F.sum("tf").alias("tf"))
    return out.unionByName(code_freqs(out, ["segment_id", "row_ix", "doc_id"], "tf")) if phonetic else out


def sent(few: DataFrame) -> DataFrame:
    """``few`` for a join with postings: sent to where these are if it has at most BROADCAST_ROWS rows, which are counted."""
    return F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few


def asked_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the queries' terms: what is not asked for does not leave its task, where the terms can be sent."""
    return postings.join(sent(terms.select("term").distinct()), "term", "left_semi")


def query_batches(terms: DataFrame, most: int = BROADCAST_ROWS) -> list[DataFrame]:
    """The rows of queries' terms in batches of whole queries, of about ``most`` rows each."""
    if terms.limit(most + 1).count() <= most:
        return [terms]
    terms = store.kept(terms)  # each batch looks at it
    many = -(-terms.count() // most)
    return [terms.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i) for i in range(many)]


def asked_terms(rows: DataFrame, few: DataFrame, max_token: int = T.MAX_TOKEN) -> DataFrame:
    """``row_terms`` of the distinct terms ``few`` alone, which are sent to the rows: what is not asked for is left out before
    anything is counted, and rows dealt by segment are counted where they are."""
    # not explode: that some terms are there would be inferred, and every text taken apart twice
    words = rows.select("segment_id", "row_ix", "doc_id", F.explode_outer(T.terms("body", max_token)).alias("term")).where("term is not null")
    own = words.join(F.broadcast(few), "term", "left_semi")
    return own.groupBy("segment_id", "row_ix", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def heard_words(bodies: DataFrame, few: DataFrame, max_token: int = T.MAX_TOKEN) -> DataFrame:
    """(word, term): each of the distinct terms ``few`` as its own word, and each code among them with the words of ``bodies``
    that sound like it. Words meet once; only these and their codes move, no postings."""
    codes = few.where(F.col("term").startswith(MARK))
    words = bodies.select(F.explode_outer(F.array_distinct(T.terms("body", max_token))).alias("word")).where("word is not null").distinct()
    coded = codes_of(words, "word").select("word", F.concat(F.lit(MARK), "code").alias("term"))
    return few.where(~F.col("term").startswith(MARK)).select(F.col("term").alias("word"), "term").unionByName(coded.join(sent(codes), "term", "left_semi"))


def heard_terms(rows: DataFrame, heard: DataFrame, max_token: int = T.MAX_TOKEN) -> DataFrame:
    """The postings, codes among them, of the terms of ``heard_words``, which are sent to the rows: a row's words are counted
    by what they stand for, where the row is. More than BROADCAST_HEARD of them meet the rows' counted words in a shuffle."""
    keys = ["segment_id", "row_ix", "doc_id", "term"]
    if heard.count() > BROADCAST_HEARD:
        counted = row_terms(rows, max_token, repeated=False).withColumnRenamed("term", "word")
        return counted.join(heard.hint("shuffle_hash"), "word").groupBy(*keys).agg(F.sum("tf").alias("tf"))
    words = rows.select("segment_id", "row_ix", "doc_id", F.explode_outer(T.terms("body", max_token)).alias("word")).where("word is not null")
    return words.join(F.broadcast(heard), "word").groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.sum(F.size(T.tokens("body"))).cast("bigint").alias("doc_len"), F.count(F.lit(1)).alias("n_rows"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_sum"))


def segments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("doc_id").alias("doc_count"))


def counted_segments(docs: DataFrame, row_bytes: int = ROW_BYTES, seg_docs: int = SEG_DOCS, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """The ``segments`` of the documents' rows; pieces are counted where the scan reads the texts, which do not move."""
    doc, number = F.col(id_col).cast("bigint"), F.col(number_col or id_col).cast("bigint")
    n = F.when(F.octet_length(text_col) <= row_bytes, 1).otherwise(F.size(T.utf8_starts(F.encode(text_col, "UTF-8"), row_bytes)))
    rows = docs.where(doc.isNotNull() & (F.length(text_col) > 0)).select(segment_of(number, seg_docs).alias("segment_id"), doc.alias("doc_id"), n.cast("bigint").alias("n"))
    return rows.groupBy("segment_id").agg(F.sum("n").alias("row_count"), F.count_distinct("doc_id").alias("doc_count"))


def mixed_sources(rows: DataFrame) -> DataFrame:
    """(segment_id, n_sources) of the segments whose rows have more than one source."""
    return rows.groupBy("segment_id").agg(F.count_distinct("source_id").alias("n_sources")).where("n_sources > 1")


def of_one_source(rows: DataFrame) -> DataFrame:
    """``rows`` as they are; the run fails at a row whose segment has rows of another source."""
    by = Window.partitionBy("segment_id")
    bad = F.raise_error(F.concat(F.lit("rows of different sources in segment "), F.col("segment_id").cast("string"))).cast("boolean")
    return rows.withColumns({"_low": F.min("source_id").over(by), "_high": F.max("source_id").over(by)}).where(F.when(F.col("_low") < F.col("_high"), bad).otherwise(F.lit(True))).drop("_low", "_high")


def snapshot(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """One row a segment: rows, terms, postings, and a hash of its sorted dictionary."""
    stats = term_stats(postings).groupBy("segment_id").agg(F.count(F.lit(1)).alias("term_count"), F.sum("df").alias("posting_count"), F.sum("tf_sum").alias("token_count"))
    return segments(rows).join(stats, "segment_id")


def shard_of(id_col: str, shards: int):
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be 1 .. {MAX_SHARDS}")
    return F.pmod(T.numeric_id(F.concat(F.lit("doc:"), F.col(id_col).cast("string"))), F.lit(shards)).cast("bigint")


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """Rows with their shard, dealt so that a shard's rows meet: one scan serves all shards."""
    return docs.withColumn("shard_id", shard_of(id_col, shards)).repartition(shards, "shard_id")


def conflicts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in any other column, with the number of different rows."""
    others = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.count_distinct(F.struct(*others)).alias("versions")).where("versions > 1")


def reduced(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the parts without identical rows; fails when it is run if a key has two versions."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.dropDuplicates()
    versions = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.raise_error(F.concat(F.lit("conflicting rows for "), F.to_json(F.struct(*keys)))).cast("boolean")
    return union.withColumn("_n", versions).where(F.when(F.col("_n") > 1, bad).otherwise(F.lit(True))).drop("_n")


def list_hash(rows: DataFrame, value: str) -> DataFrame:
    """Count, first, last and hash of a short sorted list of strings."""
    v = F.col(value)
    return rows.agg(F.count(v).alias("n"), F.min(v).alias("first"), F.max(v).alias("last"), F.sha2(F.array_join(F.array_sort(F.collect_list(v)), ""), 256).alias("list_hash"))
