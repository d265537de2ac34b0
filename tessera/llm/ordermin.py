"""Order MinHash fingerprints: signatures of a text that tell its edits, in SQL functions only.

A text is a sequence of pieces (runs of letters and digits, cut every 8, and single other marks; white space only
parts them). Its k-mers are ``K`` consecutive pieces, each with the number of its earlier occurrences, so that repeats count.
Under each of ``ORDERS`` random orders the ``TAKEN`` least numbered k-mers are selected, put back in the order of
the text, and hashed as a tuple: two texts agree on it if they share these k-mers *and* have them in the same order, which an
edit distance sees and a set of k-mers does not. A fingerprint is the tuples' hashes, 16 bits each, in hex; likeness is the share
of equal ones.

The orders are rotations of one: a numbered k-mer has one hash, and order j counts hashes from j / ORDERS of their range
on, over the end to the start. So one sorted array serves all orders, and each order's least k-mers follow its first place.

All of it is a function of one row: arrays sorted twice, occurrence numbers and first places by binary search, so a
text of n pieces takes n log n steps and no rows. An array's places take 28 bits, hashes the other 36: texts may have 2^28
pieces, more than an array of strings in a row can hold.

``edited`` needs the next document too: ids alone are put in order over all tasks, then texts go to their documents' keys, once,
and of each the beginning that the document before it needs goes on to that one's key.

Defined cases: a null text is an empty one; texts without pieces have the fingerprint of zeros; fewer than K pieces are
one k-mer; rows that are equal in id and text are one document, and each gets its row; null ids come last; rows of one id are
ordered by a hash of their text; the next document after the last one is the first, so a lone document's is itself; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ordered_places

K = 3
TAKEN = 2
ORDER_BITS = 6
ORDERS = 1 << ORDER_BITS
PIECE = r"[\p{L}\p{M}\p{N}]{1,8}|[^\p{L}\p{M}\p{N}\s]"
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x computed once however often ``of`` names it."""
    return F.transform(F.array(x), of)[0]


def keyed(hashed: Column, place: Column) -> Column:
    """The high bits of a hash with a place in the low ones."""
    return hashed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("bigint"))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE)).cast("int")


def hash_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACE))


def searched(powers: Column, holds: Callable[[Column], Column]) -> Column:
    """The largest n for which ``holds``, which holds up to some number and not beyond."""
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(holds(n + p), n + p).otherwise(n))


def kmers(pieces: Column) -> Column:
    """Hashes of K consecutive pieces, of all of them if there are fewer, none if there are none."""

    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[h[i + k] for k in range(K)]))
        return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(pieces, lambda p: F.xxhash64(p)), of)


def numbered(grams: Column, powers: Column) -> Column:
    """Sorted hashes of (k-mer, number of its earlier occurrences), each with its place in the text.

    Equal k-mers lie side by side once sorted, in the order of the text: how many there are before one is searched for.
    """

    def of(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            alike = lambda n: F.when(n <= i, hash_of(s[F.greatest(i - n, F.lit(0))]) == hash_of(x)).otherwise(False)
            earlier = F.when(alike(F.lit(1)), searched(powers, alike)).otherwise(F.lit(0))
            return keyed(F.xxhash64(hash_of(x), earlier), place_of(x))

        return F.transform(s, one)

    return F.sort_array(let(F.sort_array(F.transform(grams, lambda g, i: keyed(g, i))), of))


def signature(text: Column) -> Column:
    """The tuples' hashes of all orders, as an array."""
    orders = F.sequence(F.lit(0), F.lit(ORDERS - 1))

    def of(grams: Column) -> Column:
        n = F.size(grams)
        powers = F.filter(F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))]), lambda p: p <= n)

        def tuples(s: Column) -> Column:
            def one(j: Column) -> Column:
                low = F.shiftleft((j - ORDERS // 2).cast("bigint"), 64 - ORDER_BITS)
                first = searched(powers, lambda m: F.when(m <= n, s[F.least(m, n) - 1] < low).otherwise(False))
                taken = lambda c: F.transform(F.sequence(F.lit(0), F.least(n, F.lit(TAKEN)) - 1), lambda t: place_of(s[(c + t) % n]))
                return F.xxhash64(F.transform(F.sort_array(let(first, taken)), lambda p: grams[p])).bitwiseAND(F.lit(0xFFFF))

            return F.transform(orders, one)

        return F.when(n > 0, let(numbered(grams, powers), tuples)).otherwise(F.array_repeat(F.lit(0).cast("bigint"), ORDERS))

    return let(kmers(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))), of)


def fingerprint(text: Column) -> Column:
    """The signature in hex, four digits an order."""
    return F.array_join(F.transform(signature(text), lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    part = lambda c, j: F.substring(c, j * 4 + 1, F.lit(4))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda j: part(a, j) == part(b, j))) / ORDERS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row: a function of its text, so no row moves."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def successors(rows: DataFrame) -> DataFrame:
    """(next_a, next_b, a, b, need) of rows (a, b, id, n_chars): of each document, by its key, the key and half the
    length of the document before it; ids descend, and the first comes after the last."""
    keys = durable(rows.groupBy("a", "b").agg(F.min("id").alias("id"), F.max("n_chars").alias("n_chars")))
    placed = ordered_places(keys, [], [F.col("id").desc_nulls_last(), F.col("a"), F.col("b")])
    after = placed.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("place").alias("_place"))
    met = placed.join(after, F.col("_place") == (F.col("place") + 1) % F.col("group_rows"))
    return met.select("next_a", "next_b", "a", "b", F.floor(F.col("n_chars") / 2).cast("int").alias("need"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, next_id, next_chars) of every row.

    ``edited`` is the text whose last half is replaced by as many characters of the next document's beginning.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("id", "text"), "b": F.xxhash64("text", F.lit(1)), "n_chars": F.length("text").cast("long")})
    links = successors(rows)
    whole = rows.withColumn("fingerprint", fingerprint(F.col("text"))).repartition("a", "b")
    told = links.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), "need")
    sent = whole.join(told.hint("shuffle_hash"), ["a", "b"]).dropDuplicates(["a", "b"])
    sent = sent.select("to_a", "to_b", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("begin"), F.col("fingerprint").alias("_next"), F.col("id").alias("next_id"), F.col("n_chars").alias("next_chars"))
    half = F.floor(F.col("n_chars") / 2)
    out = whole.join(sent.hint("merge"), (F.col("a") == F.col("to_a")) & (F.col("b") == F.col("to_b")))
    out = out.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("begin")))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("_next"))}
    return out.select(F.col("id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint", *[c.alias(k) for k, c in near.items()], "next_id", "next_chars")
