"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

Words are runs of letters, digits and marks, and each other visible character; nothing is folded or
left out. Counts of trigrams of words (64-bit hashes) cover all trusted text, so what is gathered grows
with it; continuation counts, discounts and context totals come from sums and joins over them. The
lowest order is interpolated with the spelling of a word: a Kneser-Ney model of ``ORDER`` letters,
folded to ``SYMBOLS``, of the distinct trusted words, at most SYMBOLS ** ORDER = 2^24 entries.

A text's log-likelihood is the sum of weights of those of its n-grams that the model has, plus its
words' spelling, so scoring is one join: n-grams counted in each document meet the sharded model, held
a shard at a time, in ``PASSES`` passes that each move one part of the hash space. A document is kept
if its log-perplexity a word is at most the ``quantile`` of trusted documents of its language. These
would be scored too well by counts that they are part of; so a FOLD-th of the trusted texts, chosen by
hash, sets the threshold (all do if none is in the fold) and is scored by the counts of the others.
All other documents are scored by all counts. Quantiles come from an exact histogram.

Defined cases: null and empty texts have only their end to predict and are scored like any other; a
null language is a language of its own; a language without trusted documents takes the quantile of
all trusted documents; without any trusted document all are kept (no threshold); repeated rows each
give a row; ids labelled more than once are trusted if any label says so and none says otherwise.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, text_chunks
from .sharding import mixed

ORDER = 4
SYMBOLS = 64
STEPS = 1024
QUANTILE = 0.995
#: Symbols after a to z (0 .. 25).
ACCENTED = "àâäçèéêëîïñóôöùúûüßœíá"
PUNCTUATION = ".,!?;:'\"()-/%@#$&*|"
BLANK, LINE, CAPITAL, DIGIT, LETTER, OTHER, EDGE = range(26 + len(ACCENTED), 33 + len(ACCENTED))
# what is left of the 64 goes to punctuation, in the order above; the rest is OTHER
FIRST_MARK = EDGE + 1

#: Spark's setting by which a query's shuffle files go when it ends.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# the word model
WORDS = 3
#: Passes over the documents; each moves the n-grams of one part of the hash space, so that disk stays a share of the input.
PASSES = 6
#: N-grams of the model that a shard has at most, on average; shards in a pass at least.
SHARD_ROWS = 1 << 20
SHARDS = 12
#: A FOLD-th of the trusted texts sets the threshold, scored by the counts of the others.
FOLD = 5
START = np.uint64(0x5851F42D4C957F2D)
BASE = np.uint64(0x2545F4914F6CDD1D)
BACK = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
SPACE, PART, SINGLE = 0, 1, 2
EDGE_MARK = "\ue000"


def folding() -> np.ndarray:
    """The symbol of each code point below U+10000."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for code in range(0x80, 1 << 16):
        c = chr(code)
        out[code] = LETTER if c.isalpha() and c.islower() else CAPITAL if c.isalpha() and c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c.isspace() else OTHER
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED):
        out[ord(c)] = k
    out[65:91], out[48:58] = CAPITAL, DIGIT
    for k, c in enumerate(PUNCTUATION[: SYMBOLS - FIRST_MARK]):
        out[ord(c)] = FIRST_MARK + k
    for c in " \t\v\f":
        out[ord(c)] = BLANK
    out[ord("\n")] = out[ord("\r")] = LINE
    return out


_FOLDED: list[np.ndarray] = []
_KINDS: list[np.ndarray] = []
_MIXED: list[np.ndarray] = []
_POWERS: dict[int, np.ndarray] = {}


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several texts, ORDER - 1 edges before each and one after, and each text's number of n-grams."""
    if not _FOLDED:
        _FOLDED.append(folding())
    gap = EDGE_MARK * (ORDER - 1)
    joined = gap + gap.join((t or "").replace(EDGE_MARK, "\ufffd") + EDGE_MARK for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _FOLDED[0][np.minimum(codes, 0xFFFF)]
    out[codes == ord(EDGE_MARK)] = EDGE
    return out, np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (integers) of several texts, one after another, and each text's number of them."""
    s, counts = symbols(texts)
    s = s.astype(np.int32)
    value = np.zeros(len(s) - ORDER + 1, np.int32)
    for k in range(ORDER):
        value = value * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
    # windows that reach from one text into the next are left out: ORDER - 1 after each text's last
    keep = np.ones(len(value), bool)
    ends = np.cumsum(counts + ORDER - 1)[:-1]
    for k in range(1, ORDER):
        keep[ends - k] = False
    return value[keep], counts


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of a one-column table of texts."""

    def run(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                some = [t.as_py() for t in column[at : at + 256]]
                value, n = np.unique(grams(some)[0], return_counts=True)
                total[value] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["gram", "n"])

    return texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of a table with a count column n, from its counts of counts."""
    return discounts_of({r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()})


def discounts_of(t: dict[int, int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (t.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    inside = lambda d, most: min(max(d, 0.05), most)
    return inside(1 - 2 * y * n2 / n1, 0.95), inside(2 - 3 * y * n3 / n2, 1.95), inside(3 - 4 * y * n4 / n3 if n3 else 1.5, 2.95)


def train(texts: DataFrame) -> np.ndarray | None:
    """log2-probabilities of all n-grams, as a dense float32 array; None without any text.

    The sums and joins are Spark's; the driver gets their results, at most SYMBOLS ** ORDER rows an
    order, and fills in the n-grams that were never seen.
    """
    level = durable(gram_counts(texts))
    if level.isEmpty():
        return None
    tables = []
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(level)
        context = F.floor(F.col("gram") / SYMBOLS).cast("long")
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = level.withColumns({"context": context, "cut": cut})
        total = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("given"))
        joined = own.join(total, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("p"), (F.col("given") / F.col("total")).alias("back"))
        tables.append((order, joined.toArrow()))
        if order > 1:  # continuation counts: in how many contexts the shorter n-gram stands
            level = durable(level.groupBy((F.col("gram") % SYMBOLS ** (order - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    lower = np.full(1, 1.0 / SYMBOLS)
    for order, rows in reversed(tables):
        gram = rows.column("gram").to_numpy()
        own, back = np.zeros(SYMBOLS**order, np.float32), np.ones(SYMBOLS ** (order - 1), np.float32)
        own[gram] = rows.column("p").to_numpy()
        back[gram // SYMBOLS] = rows.column("back").to_numpy()
        if order == 1:
            lower = own + back[0] / SYMBOLS
        else:
            own.reshape(SYMBOLS, SYMBOLS ** (order - 2), SYMBOLS)[...] += back.reshape(SYMBOLS, SYMBOLS ** (order - 2), 1) * lower.reshape(1, SYMBOLS ** (order - 2), SYMBOLS)
            lower = own
    return np.log2(lower).astype(np.float32)


def packed(model: np.ndarray) -> np.ndarray:
    """A model as 16-bit costs in steps of 1 / STEPS bit, so that what is sent is at most 2^25 bytes."""
    return np.minimum(np.rint(-model * STEPS), 65535).astype(np.uint16)


def kinds() -> np.ndarray:
    """Of each code point: blank, part of a word, or a word of its own."""
    if not _KINDS:
        _KINDS.append(np.fromiter((PART if c.isalnum() or unicodedata.category(c)[0] == "M" else SPACE if c.isspace() else SINGLE for c in map(chr, range(0x110000))), np.uint8, 0x110000))
    return _KINDS[0]


def mixed_codes() -> np.ndarray:
    """The hash of each code point."""
    if not _MIXED:
        _MIXED.append(mixed(np.arange(0x110000, dtype=np.uint64), 1))
    return _MIXED[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for texts of up to 2^22 characters together."""
    if n > len(held := _POWERS.get(int(base), np.zeros(0, np.uint64))):
        step = np.full(1 << max(20, int(n - 1).bit_length()), base)
        step[0] = 1
        with np.errstate(over="ignore"):
            held = np.cumprod(step)
        if n <= 1 << 22:
            _POWERS[int(base)] = held
    return held[:n]


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, an end after each text; each word's text number; the texts joined,
    and where each word begins and ends there."""
    joined = "".join((t or "").replace(EDGE_MARK, "\ufffd") + EDGE_MARK for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    part = np.concatenate([[False], kind == PART, [False]])
    single = kind == SINGLE
    start = np.flatnonzero(single | (part[1:-1] & ~part[:-2]))
    end = np.flatnonzero(single | (part[1:-1] & ~part[2:])) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed_codes()[codes] * powers(BASE, len(codes)))])
        value = mixed((total[end] - total[start]) * powers(BACK, len(codes))[start], 2)
    last = codes[start] == ord(EDGE_MARK)
    return value, np.cumsum(last) - last, joined, start, end


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Hashes of the words of several texts, an end after each text; each word's text number; the distinct
    words ("" is the end), and each word's number among them."""
    value, row, joined, start, end = spans(texts)
    _, first, number = np.unique(value, return_index=True, return_inverse=True)
    spelt = [joined[s:e].replace(EDGE_MARK, "") for s, e in zip(start[first].tolist(), end[first].tolist())]
    return value, row, spelt, number


def with_contexts(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words two places and one place before each word, START where the text has none."""
    b = np.concatenate([[START], value[:-1]])
    a = np.concatenate([[START], b[:-1]])
    fresh_row = np.concatenate([[True], row[1:] != row[:-1]])
    b[fresh_row] = START
    second = np.concatenate([[False], fresh_row[:-1]])
    a[fresh_row | second] = START
    return a, b


def key_of(*parts: np.ndarray) -> np.ndarray:
    """The 64-bit key of an n-gram of 1 to WORDS words."""
    with np.errstate(over="ignore"):
        out = np.uint64(len(parts))
        for k, p in enumerate(parts):
            out = mixed(out * BASE + p, k + 3)
    return out


def word_chunks(batches, id_at: int = 0, text_at: int = 1):
    for batch in batches:
        yield from text_chunks(batch, id_at, text_at, 1 << 20)


def spelling(spelt: list[str], table: np.ndarray) -> np.ndarray:
    """Costs of words by their letters alone, in steps of 1 / STEPS bit."""
    value, counts = grams(spelt)
    return np.add.reduceat(table[value].astype(np.int64), np.cumsum(counts) - counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(a, b, c, n, m): trigrams with their number in all texts and in those that set no threshold."""

    def run(batches):
        for folds, some in word_chunks(batches):
            value, row = spans(some)[:2]
            a, b = with_contexts(value, row)
            counts = ~np.array(folds, bool)[row]
            order = np.argsort(key_of(a, b, value), kind="stable")
            a, b, c, counts = a[order], b[order], value[order], counts[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(c)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at].view(np.int64), b[at].view(np.int64), c[at].view(np.int64), n, np.add.reduceat(counts.astype(np.int64), at))], names=["a", "b", "c", "n", "m"])

    counted = texts.mapInArrow(run, "a bigint, b bigint, c bigint, n bigint, m bigint")
    return counted.repartition("a", "b").groupBy("a", "b", "c").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """The distinct words of the texts, the end among them as an empty one."""

    def run(batches):
        for _, some in word_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(words(some)[2], pa.string())], names=["word"])

    return texts.mapInArrow(run, "word string").distinct()


def word_weights(texts: DataFrame, table) -> tuple[DataFrame, list[float], int]:
    """(a, b, c, weight, other) of every n-gram of (fold, text), a and b null in shorter ones; the log2 of
    the back-off to spelling, by all texts and by those without ``fold``; and the number of n-grams.

    An n-gram's weight is the log2 of its probability over that of its suffix times the back-off of its
    context, plus that of the back-off which it gives as a context itself. A text's log-likelihood is then
    the sum of the weights of its n-grams that the model has, plus its words' spelling and back-offs to
    it. ``other`` is the weight by the texts without ``fold``; where these lack the n-gram it is 0.
    """
    l3 = word_counts(texts)
    types = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") > 0).alias("m"))
    l2 = l3.groupBy("b", "c").agg(*types)
    l1 = l2.groupBy("c").agg(*types)
    few = lambda t, k, by: t.where(F.col(by) > 0).groupBy(F.least(by, F.lit(5)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.sum(by).alias("sum")).withColumns({"level": F.lit(k), "by": F.lit(by)})
    found = reduce(DataFrame.unionByName, [few(t, k, by) for k, t in ((3, l3), (2, l2), (1, l1)) for by in "nm"]).collect()
    rows_of = lambda k, by: [r for r in found if r["level"] == k and r["by"] == by]
    steps = {(k, by): discounts_of({r["n"]: r["k"] for r in rows_of(k, by)}) for k in (1, 2, 3) for by in "nm"}
    whole = {by: sum(r["sum"] for r in rows_of(1, by)) for by in "nm"}
    first = {by: sum(r["k"] * steps[1, by][min(r["n"], 3) - 1] for r in rows_of(1, by)) / whole[by] if whole[by] else 1.0 for by in "nm"}

    def level(t: DataFrame, k: int, context: list[str]) -> DataFrame:
        def cut(by: str):
            d1, d2, d3 = steps[k, by]
            return F.when(F.col(by) == 0, 0.0).when(F.col(by) == 1, d1).when(F.col(by) == 2, d2).otherwise(d3)

        own = t.withColumns({f"cut_{by}": cut(by) for by in "nm"})
        if context:
            own = own.join(own.groupBy(*context).agg(*[f(x).alias(f"{name}_{by}") for by in "nm" for f, x, name in ((F.sum, by, "total"), (F.sum, f"cut_{by}", "given"))]), context)
            back = {by: F.when(F.col(f"total_{by}") > 0, F.col(f"given_{by}") / F.col(f"total_{by}")).otherwise(1.0) for by in "nm"}
        else:
            own = own.withColumns({f"total_{by}": F.lit(whole[by]) for by in "nm"})
            back = {by: F.lit(first[by]) for by in "nm"}
        p = {by: F.when(F.col(f"total_{by}") > 0, (F.col(by) - F.col(f"cut_{by}")) / F.col(f"total_{by}")).otherwise(0.0) for by in "nm"}
        return own.select(*[c for c in t.columns if c not in "nm"], *[x[by].alias(f"{name}_{by}") for by in "nm" for x, name in ((p, "p"), (back, "back"))])

    def spell(batches):
        for batch in batches:
            spelt = batch.column(0).to_pylist()
            some = [w for w in spelt if w]
            own = words(some)[0][::2] if some else np.zeros(0, np.uint64)
            ends = [""] * (len(spelt) - len(some))
            own = np.concatenate([own, words(ends)[0]]) if ends else own
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(spelling(some + ends, table.value))], names=["c", "cost"])

    def smoothed(t: DataFrame, keys: list[str], lower) -> DataFrame:
        """Keys, probability and gain over the back-off alone, by each of the two counts."""
        chance = {by: F.col(f"p_{by}") + F.col(f"back_{by}") * lower(by) for by in "nm"}
        return t.select(*keys, *[chance[by].alias(f"chance_{by}") for by in "nm"], *[F.log2(chance[by] / (F.col(f"back_{by}") * lower(by))).alias(f"gain_{by}") for by in "nm"])

    def given(t: DataFrame, context: dict[str, str]) -> DataFrame:
        found = t.groupBy(*context).agg(*[F.log2(F.first(f"back_{by}")).alias(f"given_{by}") for by in "nm"])
        return found.select(*[F.col(k).alias(v) for k, v in context.items()], *[f"given_{by}" for by in "nm"])

    def weights(t: DataFrame, keys: list[str]) -> DataFrame:
        sums = [sum((F.coalesce(F.col(f"{x}_{by}"), F.lit(0.0)) for x in ("gain", "given") if f"{x}_{by}" in t.columns), F.lit(0.0)) for by in "nm"]
        return t.select(*[F.col(k) if k in keys else F.lit(None).cast("long").alias(k) for k in "abc"], sums[0].alias("weight"), sums[1].alias("other"))

    lower = lambda t, keys: t.select(*keys, *[F.col(f"chance_{by}").alias(f"lower_{by}") for by in "nm"])
    told = lambda by: F.col(f"lower_{by}")
    base = vocabulary(texts).mapInArrow(spell, "c bigint, cost bigint")
    one = smoothed(level(l1, 1, []).join(base, "c"), ["c"], lambda by: F.pow(F.lit(2.0), -F.col("cost") / STEPS))
    second, third = level(l2, 2, ["b"]), level(l3, 3, ["a", "b"])
    two = smoothed(second.join(lower(one, ["c"]), "c"), ["b", "c"], told)
    three = smoothed(third.join(lower(two, ["b", "c"]), ["b", "c"]), ["a", "b", "c"], told)
    out = weights(one.join(given(second, {"b": "c"}), "c", "full"), ["c"]).unionByName(weights(two.join(given(third, {"a": "b", "b": "c"}), ["b", "c"], "full"), ["b", "c"])).unionByName(weights(three, ["a", "b", "c"]))
    return out, [math.log2(first[by]) for by in "nm"], sum(r["k"] for r in found if r["by"] == "n")


def split(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's pass and its shard in the pass."""
    part = (key % np.uint64(PASSES * shards)).astype(np.int64)
    return part % PASSES, part // PASSES


ROWS = "part int, shard int, kind int, keys binary, rows binary, n binary"


def packed_rows(part, shard, kind: int, *arrays: np.ndarray) -> pa.RecordBatch | None:
    """A row of ROWS for each part and shard, its arrays as bytes."""
    if not len(part):
        return None
    order = np.argsort(part * (1 << 32) + shard, kind="stable")
    part, shard, arrays = part[order], shard[order], [x[order] for x in arrays]
    at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (shard[1:] != shard[:-1])]))
    ends = np.append(at[1:], len(part))
    columns = [pa.array(part[at], pa.int32()), pa.array(shard[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32())]
    columns += [pa.array([x[s:e].tobytes() for s, e in zip(at, ends)], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "kind", "keys", "rows", "n"])


def packed_model(weights: DataFrame, shards: int) -> DataFrame:
    """The weights as ROWS of kind 0: keys, and weights in steps of 1 / STEPS bit, two by two."""

    def run(batches):
        def flush(held):
            key, value = (np.concatenate(x) for x in zip(*held))
            return packed_rows(*split(key, shards), 0, key, np.zeros(len(key), np.uint8), value)

        held, size = [], 0
        for batch in batches:
            a, b, c = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3))
            no_a, no_b = (batch.column(k).is_null().to_numpy(zero_copy_only=False) for k in range(2))
            key = np.where(no_b, key_of(c), np.where(no_a, key_of(b, c), key_of(a, b, c)))
            held.append((key, np.rint(np.stack([batch.column(k).to_numpy() for k in (3, 4)], 1) * STEPS).astype(np.int32)))
            size += len(key)
            if size >= SHARD_ROWS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return weights.select("a", "b", "c", "weight", "other").mapInArrow(run, ROWS)


def document_grams(rows: DataFrame, part: int, shards: int) -> DataFrame:
    """ROWS of kind 1 of one pass: the n-grams of each row of (row, text), with their number in it."""

    def run(batches):
        for keys, some in word_chunks(batches):
            value, row = spans(some)[:2]
            a, b = with_contexts(value, row)
            # the contexts that stand before a text's first word count once
            before, each = np.full(len(some), START), np.arange(len(some))
            key = np.concatenate([key_of(value), key_of(b, value), key_of(a, b, value), key_of(before), key_of(before, before)])
            row = np.concatenate([row, row, row, each, each])
            own = split(key, shards)[0] == part
            key, row = key[own], row[own]
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
            n = np.diff(np.append(at, len(key))).astype(np.int32)
            yield packed_rows(*split(key[at], shards), 1, key[at], np.array(keys, np.int64)[row[at]], n)

    return rows.mapInArrow(run, ROWS)


def met(model: DataFrame, grams_: DataFrame, shards: int) -> DataFrame:
    """(row, gain, other): the sums of both weights over each row's n-grams.

    A merge join by hand: each shard's part of the model comes first and is held, the documents stream by.
    """

    def run(batches):
        at, held, keys, values = None, [], None, None
        for batch in batches:
            out = []
            for shard, kind, k, r, n in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                if shard != at:
                    at, held, keys = shard, [], None
                if kind == 0:
                    held.append((np.frombuffer(k, np.uint64), np.frombuffer(n, np.int32).reshape(-1, 2)))
                    continue
                if keys is None:
                    if held:
                        keys, values = (np.concatenate(x) for x in zip(*held))
                        order = np.argsort(keys)
                        keys, values, held = keys[order], values[order], []
                    else:
                        keys, values = np.zeros(1, np.uint64), np.zeros((1, 2), np.int32)
                k, r, n = np.frombuffer(k, np.uint64), np.frombuffer(r, np.int64), np.frombuffer(n, np.int32)
                place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                gain = values[place].astype(np.int64) * (n * (keys[place] == k))[:, None]
                new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                out.append((r[new], *np.add.reduceat(gain, new).T))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["row", "gain", "other"])

    both = model.unionByName(grams_).repartition(2 * shards, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, "row bigint, gain bigint, other bigint").groupBy("row").agg(F.sum("gain").alias("gain"), F.sum("other").alias("other"))


def spelt_rows(docs: DataFrame, table, kind: str) -> DataFrame:
    """id, lang, n_chars, row, fold, n_words and ``base``, the cost of each text's words by their letters alone."""

    def run(batches):
        for batch in batches:
            at = 0
            for keys, some in text_chunks(batch, 0, 1, 1 << 20):
                _, row, spelt, number = words(some)
                n = np.bincount(row, minlength=len(some))
                cost = np.add.reduceat(spelling(spelt, table.value)[number], np.cumsum(n) - n)
                some_of = lambda c: batch.column(c).slice(at, len(keys))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([some_of(0), some_of(2), pa.array([len(t) for t in some], pa.int64()), some_of(3), some_of(4), pa.array(n, pa.int64()), pa.array(cost)], names=["id", "lang", "n_chars", "row", "fold", "n_words", "base"])
                at += len(keys)

    return docs.select("id", "text", "lang", "row", "fold").mapInArrow(run, f"id {kind}, lang string, n_chars bigint, row bigint, fold boolean, n_words bigint, base bigint")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are left with no shuffle files once they are worked out: each is looked at once, or cut from its lineage."""
    held = spark.conf.get(DROPPED, None)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPPED) if held is None else spark.conf.set(DROPPED, held)


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame | None:
    """id, lang, n_chars, ``level`` (log2-perplexity a word in steps of 1 / STEPS bit), ``own`` (trusted) and
    ``sets`` (trusted and not counted for its own level) of every row; None without trusted text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), text).alias("row"), (F.pmod(F.xxhash64(text), F.lit(FOLD)) == 0).alias("fold"))
    texts = rows.select("id", "fold", "text").join(trusted.hint("shuffle_hash"), "id", "left_semi").select("fold", "text")
    letters = train(vocabulary(texts))  # of each word once
    if letters is None:
        return None
    table = spark.sparkContext.broadcast(packed(letters))
    weights, first, size = word_weights(texts, table)
    shards = max(SHARDS, -(-size // (PASSES * SHARD_ROWS)))
    model = durable(packed_model(weights, shards))
    sums = None
    for part in range(PASSES):
        one = durable(met(model.where(F.col("part") == part), document_grams(rows.select("row", "text"), part, shards), shards))
        sums = one if sums is None else sums.unionByName(one)
    base = spelt_rows(rows, table, docs.schema[id_col].dataType.simpleString())
    copies = base.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))  # equal rows have added to one sum
    sums = sums.groupBy("row").agg(F.sum("gain").alias("gain"), F.sum("other").alias("other")).join(copies, "row")
    scored = base.join(sums, "row", "left").join(trusted.withColumn("own", F.lit(True)), "id", "left")
    sets = F.col("own").isNotNull() & F.col("fold")
    gain = F.coalesce(F.when(sets, F.col("other")).otherwise(F.col("gain")) / F.col("copies"), F.lit(0.0))
    back = F.when(sets, first[1]).otherwise(first[0]) * STEPS
    return scored.select("id", "lang", "n_chars", F.floor((F.col("base") - gain) / F.col("n_words") - back).alias("level"), F.col("own").isNotNull().alias("own"), sets.alias("sets"))


def perplexities_kept(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame | None:
    """``perplexities``, cut from their lineage; nothing of what led to them stays in shuffle files."""
    with shuffles_dropped(docs.sparkSession):
        scores = perplexities(docs, trusted, id_col, text_col, lang_col)
        return scores if scores is None else durable(scores)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return good.where("quality = 1 and toxic = 0 and id is not null").select("id")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, n_chars, log2_perplexity, threshold and ``kept`` of every row of ``docs``."""
    trusted = trusted_ids(labels, id_col)
    scores = perplexities_kept(docs, trusted, id_col, text_col, lang_col)
    if scores is None:
        return docs.select(id_col, F.col(lang_col).cast("string").alias("lang"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("log2_perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    sets = "sets" if scores.where("sets").take(1) else "own"
    bins = durable(scores.where(sets).groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("level"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    least = lambda rows: rows.withColumns({"upto": upto, "whole": whole}).where(F.col("upto") >= F.ceil(F.col("whole") * quantile)).groupBy("lang").agg(F.min("level").alias("most"))
    each = least(bins)
    every = least(bins.groupBy("level").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("all"))).select(F.col("most").alias("most_of_all"))
    one = every.first()["most_of_all"]
    out = scores.join(each.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("most", F.coalesce("most", F.lit(one)))
    return out.select(F.col("id").alias(id_col), "lang", "n_chars", (F.col("level") / STEPS).alias("log2_perplexity"), (F.col("most") / STEPS).alias("threshold"), (F.col("level") <= F.col("most")).alias("kept"))
