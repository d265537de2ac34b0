"""Which segments a query opens: Bloom signatures as bitmaps, and bounds of what a segment can score.

A signature is one bitmap a segment, made for one version of the segment's dictionary. What rules a segment out is a
sound signature that has none of the query's terms (or lacks one of them, if all must match); a segment whose signature
is not listed, not there, or made for another version is opened. Bounds rule out, among what is left, the segments
whose best row could not reach the list: both change what is read, never a result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import text as T

from tessera.sources import store

from . import scoring
from .index import asked_postings, query_batches, sent

#: Size and probes of a signature. The bitmap has SIGNATURE_BYTES bytes, as Spark's bitmaps have.
SIGNATURE_BYTES = 4096
SIGNATURE_HASHES = 6
#: Terms are probed in so many lists.
TERM_LISTS = 64


def probes(term: str, size: int = SIGNATURE_BYTES, hashes: int = SIGNATURE_HASHES) -> Column:
    if not 1 <= size <= SIGNATURE_BYTES or hashes < 1:
        raise ValueError(f"a signature has 1 .. {SIGNATURE_BYTES} bytes and a probe at least")
    bits = F.lit(8 * size)
    first, step = (F.pmod(T.numeric_id(F.concat(F.lit(f"h{k}:"), F.col(term))), bits) for k in (1, 2))
    # double hashing: the two hashes are taken once, not once a probe
    return F.transform(F.array(F.struct(first.alias("first"), step.alias("step"))), lambda h: F.array_distinct(F.array(*[F.pmod(h["first"] + i * h["step"], bits) for i in range(hashes)])))[0]


def versions(stats: DataFrame) -> DataFrame:
    """(segment_id, version): a number of each segment's dictionary (segment_id, term, df, tf_sum), whatever its order."""
    return stats.groupBy("segment_id").agg(F.bit_xor(entry()).alias("version"))


def entry() -> Column:
    """A number of a dictionary's entry; a version is the bitwise sum of these."""
    return T.numeric_id(F.concat_ws(":", "term", F.col("df").cast("string"), F.col("tf_sum").cast("string")))


def bitmaps(bits: DataFrame, sums: str | None = None) -> DataFrame:
    """(segment_id, bitmap) of (segment_id, bit), with the bitwise sum of column ``sums``, if named: what ``bitmap_construct_agg`` gives, whose buffers would have all bits
    sorted; here they meet in a hash table of words of eight bytes, each as the hex digits of its bytes."""
    also, total = ([sums], [F.bit_xor(sums).alias(sums)]) if sums else ([], [])
    byte = F.floor(F.col("bit") / 8)
    shift = ((7 - F.pmod(byte, F.lit(8))) * 8 + F.pmod(F.col("bit"), F.lit(8))).cast("int")
    words = bits.select("segment_id", F.floor(byte / 8).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("one"), *also).groupBy("segment_id", "word").agg(F.bit_or("one").alias("ones"), *total)
    listed = words.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("word", "ones"))).alias("all"), *total)
    gap = lambda x, i: x["word"] - F.coalesce(F.get("all", i - 1)["word"], F.lit(-1)) - 1
    digits = F.array_join(F.transform("all", lambda x, i: F.concat(F.repeat(F.lit("0" * 16), gap(x, i)), F.lpad(F.hex(x["ones"]), 16, "0"))), "")
    return listed.select("segment_id", F.unhex(F.rpad(digits, 2 * SIGNATURE_BYTES, "0")).alias("bitmap"), *also)


def signatures(stats: DataFrame, size: int = SIGNATURE_BYTES, hashes: int = SIGNATURE_HASHES, parts: int | None = None) -> DataFrame:
    """(sig_id, segment_id, version, bitmap): one row a segment; made by ``parts`` tasks, if given."""
    own = stats.repartition(*([parts] if parts else []), "segment_id")  # terms move, not their bits
    # not explode: that some bits are there would be inferred, and hashed for every posting; an entry counts at its first bit
    bits = own.select("segment_id", entry().alias("_entry"), F.posexplode_outer(probes("term", size, hashes)).alias("_at", "bit"))
    maps = bitmaps(bits.select("segment_id", "bit", F.when(F.col("_at") == 0, F.col("_entry")).otherwise(0).alias("version")), "version")
    sig_id = F.sha2(F.concat(F.concat_ws(":", F.col("segment_id").cast("string"), F.col("version").cast("string"), F.hex("bitmap"))), 256)
    return maps.select(sig_id.alias("sig_id"), "segment_id", "version", "bitmap")


def signature_map(signs: DataFrame) -> DataFrame:
    """(segment_id, sig_id): which signature a segment is listed with."""
    return signs.select("segment_id", "sig_id")


def status(inventory: DataFrame, listed: DataFrame, signs: DataFrame) -> DataFrame:
    """(segment_id, status, bitmap) of every segment of the inventory (segment_id, version): ``sound``, or why its
    signature is not used: ``unlisted``, ``missing`` or ``stale``."""
    made = signs.select("sig_id", F.col("segment_id").alias("_for"), F.col("version").alias("_version"), "bitmap")
    out = inventory.select("segment_id", "version").join(listed, "segment_id", "left").join(made, "sig_id", "left")
    sound = F.col("_for").eqNullSafe(F.col("segment_id")) & F.col("_version").eqNullSafe(F.col("version"))
    kind = F.when(F.col("sig_id").isNull(), "unlisted").when(F.col("bitmap").isNull(), "missing").when(~sound, "stale").otherwise("sound")
    return out.select("segment_id", kind.alias("status"), F.when(kind == "sound", F.col("bitmap")).alias("bitmap"))


def words_of(bitmap: Column) -> Column:
    """A bitmap as an array of its words of four bytes."""
    return F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE_BYTES // 4 - 1)), lambda i: F.conv(F.hex(F.substring(bitmap, 4 * i + 1, F.lit(4))), 16, 10).cast("bigint"))


def place_of(bit: Column) -> Column:
    """Where a bit stands among ``words_of``: (word, mask)."""
    shift = ((3 - F.pmod(F.floor(bit / 8), F.lit(4))) * 8 + F.pmod(bit, F.lit(8))).cast("int")
    return F.struct(F.floor(bit / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("mask"))


def maybe_terms(signs: DataFrame, terms: DataFrame, size: int = SIGNATURE_BYTES, hashes: int = SIGNATURE_HASHES) -> DataFrame:
    """(segment_id, term) of the bitmaps that have all of a term's bits: no false negatives.

    The asked terms meet the bitmaps in TERM_LISTS lists, so a bitmap is met by lists, not by terms.
    """
    asked = terms.select("term").distinct().select("term", F.transform(probes("term", size, hashes), place_of).alias("bits"))
    lists = asked.groupBy(F.pmod(F.xxhash64("term"), F.lit(TERM_LISTS)).alias("_list")).agg(F.collect_list(F.struct("term", "bits")).alias("asked"))
    held = F.filter("asked", lambda t: F.forall(t["bits"], lambda b: F.get("words", b["word"]).bitwiseAND(b["mask"]) != 0))
    return signs.where("bitmap is not null").select("segment_id", words_of(F.col("bitmap")).alias("words")).crossJoin(F.broadcast(lists.select("asked"))).select("segment_id", F.explode(F.transform(held, lambda t: t["term"])).alias("term"))


def maybe_segments(signs: DataFrame, query_terms: DataFrame, size: int = SIGNATURE_BYTES, hashes: int = SIGNATURE_HASHES) -> DataFrame:
    """(query_id, term, segment_id) whose signature has all bits of the term."""
    return maybe_terms(signs, query_terms, size, hashes).join(query_terms.select("query_id", "term"), "term").select("query_id", "term", "segment_id")


def places(terms: DataFrame) -> DataFrame:
    """Query terms with ``place`` (1 ..), the order in which they are probed, and ``n_terms``."""
    by = Window.partitionBy("query_id")
    return terms.select("query_id", "term", F.row_number().over(by.orderBy(T.order_key("term"), "term")).alias("place"), F.count(F.lit(1)).over(by).alias("n_terms"))


def probed(told: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, segment_id, n_terms, first, run): for each query and each sound segment that may hold any of its terms,
    the first term that it may hold, and how many of the first terms it may hold without a gap. Bitmaps are probed where
    they are: no (query, segment, term) is listed."""
    kind = StructType([StructField("query_id", terms.schema["query_id"].dataType), StructField("segment_id", told.schema["segment_id"].dataType), *(StructField(c, LongType()) for c in ("n_terms", "first", "run"))])
    schema, sound = to_arrow_schema(kind), told.where("bitmap is not null").select("segment_id", "bitmap")

    def of(asked: DataFrame) -> DataFrame:
        sent_terms = told.sparkSession.sparkContext.broadcast(scoring.Probes(asked.toArrow()))
        return sound.mapInArrow(lambda batches: scoring.probed(batches, sent_terms.value, schema), kind)

    asked = query_batches(places(terms).select("query_id", "term", "place", probes("term").alias("bits")))
    return reduce(DataFrame.unionByName, map(of, asked))


def opened(told: DataFrame, terms: DataFrame, every: bool = False) -> DataFrame:
    """(query_id, segment_id) that a sound signature lets through: for any of the query's terms, or for all of them.
    Segments without a sound one are opened by every query and are not in it."""
    found = probed(told, terms)
    return (found.where("run = n_terms") if every else found).select("query_id", "segment_id")


def gate_counts(told: DataFrame, terms: DataFrame, every: bool = False) -> DataFrame:
    """For each query, what gating did: a row of eleven counters.

    Terms are probed in order until the answer is known: the first that may be there, or, if all must match, the first
    that is not. Segments that hold none of a query's terms are counted from the totals, not listed.
    """
    kinds = told.agg(F.count(F.lit(1)).alias("entries_total"), *[F.count_if(F.col("status") == k).alias(c) for k, c in (("unlisted", "sig_map_miss"), ("missing", "sig_missing"), ("stale", "sig_mismatch"), ("sound", "_sound"))])
    asked = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_terms_total"))
    found = probed(told, terms).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_some"),
        F.sum("first").alias("_firsts"),
        F.sum("run").alias("_runs"),
        F.count_if(F.col("run") == F.col("n_terms")).alias("_whole"),
    )
    out = asked.join(found, "query_id", "left").crossJoin(F.broadcast(kinds))  # one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.col("_sound") - n("_some")
    if every:
        through, maybe, miss = n("_whole"), n("_runs"), F.col("_sound") - n("_whole")
    else:
        through, maybe, miss = n("_some"), n("_some"), n("_firsts") - n("_some") + none * F.col("query_terms_total")
    without = F.col("sig_map_miss") + F.col("sig_missing") + F.col("sig_mismatch")
    counters = {
        "entries_skipped_sig": F.col("_sound") - through,
        "entries_decoded": through + without,
        "entries_missing_sig": without,
        "bloom_probes_total": maybe + miss,
        "bloom_definite_miss": miss,
        "bloom_maybe": maybe,
    }
    return out.select("query_id", "query_terms_total", "entries_total", "sig_map_miss", "sig_missing", "sig_mismatch", *[c.cast("bigint").alias(k) for k, c in counters.items()])


def gated_postings(postings: DataFrame, told: DataFrame, terms: DataFrame, every: bool = False) -> DataFrame:
    """Postings of the query terms in the segments that their queries open; what a signature rules out is not read on.
    Where any term opens a segment, all of the terms that it holds are among those let through, so it goes by segment."""
    own = asked_postings(postings, terms)
    if not every:
        return in_segments(own, open_segments(told, terms))
    whole = opened(told, terms, True).join(terms.select("query_id", "term"), "query_id").select("segment_id", "term").distinct()
    through = maybe_terms(told, terms).join(whole, ["segment_id", "term"], "left_semi")
    own = own.join(through.withColumn("_through", F.lit(True)), ["segment_id", "term"], "left")
    own = own.join(told.where("status <> 'sound'").select("segment_id", F.lit(True).alias("_open")), "segment_id", "left")
    return own.where("_through or _open").select(*postings.columns)


def open_segments(told: DataFrame, terms: DataFrame) -> DataFrame:
    """(segment_id) that any query opens, looked at once."""
    return store.kept(opened(told, terms).select("segment_id").unionByName(told.where("status <> 'sound'").select("segment_id")).distinct())


def in_segments(postings: DataFrame, some: DataFrame) -> DataFrame:
    """Postings of some segments (segment_id), which are sent to them if few."""
    return postings.join(sent(some), "segment_id", "left_semi").select(*postings.columns)


# ---- bounds -----------------------------------------------------------------------------------


def maxima(postings: DataFrame) -> DataFrame:
    """(segment_id, term, df, tf_sum, max_tf): what bounds a segment's scores; written beside the postings."""
    return postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_sum"), F.max("tf").alias("max_tf"))


def asked_maxima(peaks: DataFrame, segs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, segment_id, term, qtf, idf, df, max_tf) of the queries' terms, with the segment's own idf."""
    ratio = F.expr("((row_count + 1) * 256) div (df + 1)")
    own = peaks.join(terms.select("query_id", "term", "qtf"), "term").join(segs.select("segment_id", "row_count"), "segment_id")
    return own.select("query_id", "segment_id", "term", "qtf", ratio.alias("idf"), "df", "max_tf")


def segment_bounds(asked: DataFrame) -> DataFrame:
    """(query_id, segment_id, bound, sure): no row of the segment scores more; at least ``sure`` rows score at all."""
    most = F.coalesce(F.try_sum(T.saturated_product(F.col("qtf"), F.col("max_tf"), F.col("idf"))), F.lit(2**63 - 1))
    return asked.groupBy("query_id", "segment_id").agg(most.alias("bound"), F.max("df").alias("sure"))


def scored_pairs(postings: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, segment_id, row_ix, doc_id, score) of the rows of the (query_id, segment_id) pairs."""
    wanted = asked.join(pairs, ["query_id", "segment_id"], "left_semi").select("query_id", "segment_id", "term", "qtf", "idf")
    score = F.coalesce(F.try_sum(T.saturated_product(F.col("qtf"), F.col("tf"), F.col("idf"))), F.lit(2**63 - 1))
    return postings.join(wanted, ["segment_id", "term"]).groupBy("query_id", "segment_id", "row_ix", "doc_id").agg(score.alias("score"))


def first_pairs(bounds: DataFrame, k: int) -> DataFrame:
    """The pairs of greatest bound that surely have k rows for each query: at most k pairs a query."""
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment_id")
    best = bounds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    before = F.coalesce(F.sum("sure").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("_before", before).where(F.col("_before") < k).select("query_id", "segment_id")


def needed_pairs(read: Callable[[DataFrame], DataFrame], peaks: DataFrame, segs: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(the asked maxima, the (query_id, segment_id) pairs that must be scored for the k best rows and their ties).

    The first pairs' k-th best score is one that the list's last cannot be below; a segment is needed if its bound reaches
    it. ``read`` gives postings that have those of the given pairs at least.
    """
    asked = asked_maxima(peaks, segs, terms)
    bounds = segment_bounds(asked)
    first = first_pairs(bounds, k)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    last = scored_pairs(read(first), asked, first).withColumn("_n", F.row_number().over(by)).where(F.col("_n") == k).select("query_id", F.col("score").alias("_least"))
    need = bounds.join(last, "query_id", "left").where((F.col("bound") >= F.col("_least")) | F.col("_least").isNull())
    return asked, need.select("query_id", "segment_id")
