"""Benchmark decontamination by template canonicalisation.

Words are compared case-folded, without punctuation. A window of words becomes a template: numbers and
units after a number turn into typed placeholders, which leaves it free of case; where it has names
(capitalised words inside a sentence) it gets a second template in which these are placeholders too. A
template needs ``LITERALS`` literal words; a window without so many stands for itself, numbers and all.
So every place of an item has a window: ``WINDOW`` words, ``LONG`` (or all, if fewer) in an item most of
whose windows are short of literal words, all words in an item of fewer than WINDOW. Items of fewer than
LITERALS words are found as a whole sentence only.

Hashes of windows are joined with the benchmark's. Hits of one document and item on one diagonal
(document place minus item place) form a placement; its placeholders map item values to document values.
All its windows count if that map is a function both ways for each type (the same question with other
parameters), else those only that have no values or the item's own. An item is leaked into a document if
placements cover at least ``coverage`` of its places. As such an item shares at least one of its rarest
places, by the number of items that have the same window, only these look for candidates.

While the benchmark's text is at most ``BROADCAST_BYTES`` (checked), its window hashes travel to the
scan, so that only windows that will join leave it; beyond that all windows are shuffled by their hash.

Defined cases: null and empty texts have no words and are never leaked (nor do such items leak); very
long texts are read whole; repeated rows of a document count once; a null id is dropped from the pairs
(a null-id document is kept by ``drop_leaks``); empty tables give an empty result; only the named
columns are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_chunks, utf8

WINDOW = 5
LONG = 10
LITERALS = 3
COVERAGE = 0.5
BROADCAST_BYTES = 16 << 20
#: Units that may follow a number.
UNITS = "mm cm m km mg g kg t ml cl l s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents inch inches foot feet ft mile miles yard yards pound pounds lb lbs oz ounce ounces celsius fahrenheit kmh mph hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal".split()
NUMBER, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest(b"\x00" + x)) for x in (b"number", b"unit", b"name"))
UNIT_WORDS = {u.encode() for u in UNITS}
MIX = np.uint64(0x9E3779B97F4A7C15)
STOPS = b".!?\n\r"
_CASED = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 46 if c in STOPS else 32 for c in range(256))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    out = (ids[: len(ids) - size + 1] ^ np.uint64(size)).copy()
    for k in range(1, size):
        out = (out * MIX) ^ (out >> np.uint64(29)) ^ ids[k : len(ids) - size + 1 + k]
    return out


class Words:
    """All words of several texts, one text after another: ``text`` number, ``place`` in it, case-folded
    ``word``, its ``id``, whether it is a ``number``, ``unit`` or ``name``, and whether it ``begins`` or
    ``ends`` a sentence. With a vocabulary, words outside it get the id 0.
    """

    def __init__(self, texts: list[str], vocabulary: dict[bytes, int] | None = None) -> None:
        blob = b" . ".join(utf8(t).translate(_CASED).replace(b"\x00", b" ") + b" . \x00 " for t in texts)
        words = blob.replace(b".", b" . ").split()
        flat = np.frombuffer(b" ".join(words) + b"  ", np.uint8)
        start = np.r_[0, np.flatnonzero(flat[:-2] == 32) + 1][: len(words)]
        first, second = flat[start], flat[start + 1]
        stop, end = first == 46, first == 0
        upper = (first >= 65) & (first <= 90) & (second >= 97) & (second <= 122) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        apart = stop | end
        keep = ~apart
        self.text = (np.cumsum(end) - end)[keep]
        kept = [w for w, k in zip(words, keep.tolist()) if k]
        self.word = b" ".join(kept).decode("utf-8", "surrogatepass").casefold().encode("utf-8", "surrogatepass").split(b" ") if kept else []
        n = len(self.word)
        self.begins, self.ends = np.r_[True, apart[:-1]][keep], np.r_[apart[1:], True][keep]
        self.number = ((first >= 48) & (first <= 57))[keep]
        self.name = upper[keep] & ~self.begins & ~self.number
        self.unit = np.zeros(n, bool)
        after = np.flatnonzero(np.r_[False, self.number[:-1]] & ~self.number)
        self.unit[[i for i in after.tolist() if self.word[i] in UNIT_WORDS]] = True
        self.name &= ~self.unit
        if vocabulary is None:
            self.id = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.word), np.uint64, n)
        else:
            self.id = np.fromiter(map(vocabulary.get, self.word, repeat(0)), np.uint64, n)
        begin = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(n) - begin[self.text] if n else np.zeros(0, np.int64)


def counts(flag: np.ndarray, size: int) -> np.ndarray:
    """How many of each ``size`` neighbours are set."""
    total = np.cumsum(np.r_[0, flag.astype(np.int32)])
    return total[size:] - total[:-size]


def forms(w: Words, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(where it is made, hash, placeholders) of the templates that windows of a size have."""
    at = np.arange(max(0, len(w.id) - size + 1))
    if not len(at):
        return []
    whole = w.text[at] == w.text[at + size - 1]
    if size < LITERALS:
        whole &= w.begins[at] & w.ends[at + size - 1]
    measured = w.number | w.unit
    plain = np.where(w.number, NUMBER, np.where(w.unit, UNIT, w.id))
    typed = whole & (size - counts(measured, size) >= LITERALS)
    named = typed & (counts(w.name, size) > 0) & (size - counts(measured | w.name, size) >= LITERALS)
    none = np.zeros(len(w.id), bool)
    return [(typed, window_hashes(plain, size), measured), (named, window_hashes(np.where(w.name, NAME, plain), size), measured | w.name), (whole & ~typed, window_hashes(w.id, size), none)]


def found(w: Words, sizes: list[int], wanted: np.ndarray | None = None):
    """(text number, place, size, hash, slots) of the windows of these sizes; slots are "type:value"s."""
    for size in sizes:
        for made, h, slot in forms(w, size):
            at = np.flatnonzero(made)
            if wanted is not None and len(at):
                at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]] if len(wanted) else at[:0]
            for i in at.tolist():
                slots = [f"{'number' if w.number[k] else 'unit' if w.unit[k] else 'name'}:{w.word[k].decode('utf-8', 'replace')}" for k in range(i, i + size) if slot[k]]
                yield int(w.text[i]), int(w.place[i]), size, int(h[i : i + 1].view(np.int64)[0]), slots


def item_windows(texts: list[str]):
    """Windows of benchmark items, of the size that suits each."""
    w = Words(texts)
    length = np.bincount(w.text, minlength=len(texts)) if len(w.id) else np.zeros(len(texts), np.int64)
    size = np.minimum(length, WINDOW)
    if len(w.id) >= WINDOW:
        typed, literal = (np.bincount(w.text[: len(w.id) - WINDOW + 1][made], minlength=len(texts)) for made, _, _ in (forms(w, WINDOW)[0], forms(w, WINDOW)[2]))
        size = np.where(literal > typed, np.minimum(length, LONG), size)
    for row in found(w, sorted(set(size.tolist()) - {0})):
        if row[2] == size[row[0]]:
            yield row


ROWS = ("place", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))


def window_rows(rows: DataFrame, id_col: str, text_col: str, make) -> DataFrame:
    """(id, place, size, hash, slots) of what ``make`` finds in lists of a table's texts."""
    kind = rows.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for keys, texts in text_chunks(batch, 0, 1, 4 << 20):
                out = list(make(texts))
                columns = [pa.array([keys[x[0]] for x in out], batch.schema.field(0).type), *(pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(ROWS, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(name for name, _ in ROWS)])

    out = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return out.mapInArrow(run, f"id {kind.simpleString()}, place bigint, size int, hash bigint, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, item, n_windows, n_matched, coverage, verbatim) of all leaked items, a row for each pair.

    ``verbatim`` is false where placeholders that count differ from the item's.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    item = window_rows(benchmark, item_col, item_text_col, item_windows)
    item = durable(item.select(F.col("id").alias("item"), F.col("place").alias("item_place"), "size", "hash", F.col("slots").alias("item_slots")).distinct())
    sizes = sorted(r["size"] for r in item.select("size").distinct().collect())  # at most LONG
    vocabulary = wanted = None
    if size <= broadcast_bytes:  # so these are of bounded size too
        texts = [r[0] for r in benchmark.select(F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull()).collect()]
        vocabulary = {w: xxhash.xxh64_intdigest(w) for w in Words(texts).word}
        wanted = np.unique(np.array([x[3] for x in item_windows(texts)], np.int64).view(np.uint64))
    hits = window_rows(docs, id_col, text_col, lambda some: found(Words(some, vocabulary), sizes, wanted)).drop("size")
    hits = durable(hits) if wanted is not None else hits
    # an item with enough places covered has one of the rarest places covered that are one more than may be missed
    shared = item.groupBy("hash").agg(F.count_distinct("item").alias("shared"))
    places = item.join(shared, "hash").groupBy("item", "item_place").agg(F.sum("shared").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("shared", "item_place"))
    total = F.count(F.lit(1)).over(Window.partitionBy("item"))
    places = places.select("item", "item_place", rank.alias("rank"), total.alias("n_windows"))
    totals = places.where("rank = 1").select("item", "n_windows")
    rare = places.where(F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * coverage) + 1).select("item", "item_place")
    candidates = hits.select("id", "hash").join(item.join(rare, ["item", "item_place"]).select("hash", "item").distinct(), "hash").select("id", "item").distinct()
    met = candidates.join(item, "item").join(hits, ["id", "hash"])
    pairs = F.arrays_zip(F.col("item_slots").alias("want"), F.col("slots").alias("got"))
    met = met.select("id", "item", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", pairs.alias("pairs"))
    same = lambda pairs: F.forall(pairs, lambda p: p["want"] == p["got"])
    # a placement has at most as many distinct hits as its item has windows
    hit = F.struct("item_place", same("pairs").alias("same"))
    placed = met.groupBy("id", "item", "diagonal").agg(F.collect_set(hit).alias("hits"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    n = F.size("pairs")
    fits = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["want"]))) == n) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["got"]))) == n)
    placed = placed.select("id", "item", fits.alias("fits"), same("pairs").alias("same"), F.explode("hits").alias("hit")).where("fits or hit.same")
    matched = placed.groupBy("id", "item", "hit.item_place").agg(F.max(F.col("same") | ~F.col("fits")).alias("same")).groupBy("id", "item").agg(F.count(F.lit(1)).alias("n_matched"), F.min("same").alias("verbatim"))
    share = F.col("n_matched") / F.col("n_windows")
    return matched.join(totals, "item").withColumn("coverage", share).where(share >= coverage).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_matched", "coverage", "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item of the benchmark is leaked."""
    found = durable(leaks(docs, benchmark, coverage, id_col, text_col, **more).select(id_col).distinct())
    return docs.join(found, id_col, "left_anti")
