"""Line de-duplication by a segment-partition edit join, in DataFrame operations only.

Lines are compared trimmed. Equal lines are one class, known by two 64-bit hashes with different
seeds. Two different lines of ``near_chars`` characters or more are linked if their edit distance is
at most ``threshold``. Each line is cut into threshold + 1 segments of nearly equal length; at least
one of them stands unchanged in any line within the threshold, and by the multi-match-aware bounds
only few places and lengths have to be probed for it. Segments and probes are hashed with their
length and number; a hash that two different lines share makes them candidates. Only candidates'
texts are gathered. A list is cut by its counted size into blocks of about ``BLOCK`` lines; each two
blocks meet in one row, which yields its lines' numbers of links and a spanning forest of the links,
never the pairs. A pair counts in the first list that it shares only, so the numbers add up. Signatures
of letter counts reject most lines that differ in more than the threshold.

Verification cuts the common ends off and runs a banded bit-parallel automaton over the rest: bit d
of word k says whether the diagonal d of the band can be reached with k edits.

The first line of a class (least document id, then least line number) stays, later ones go; classes
are the components of links and equality. ``drop_duplicates`` spares short lines: those under
``exact_chars`` are never dropped, and those under ``near_chars`` only with an equal one.

Defined cases: a null text has no lines and is kept; blank lines are no duplicates; documents whose
id is null keep all lines and are no one's first; rows with the same id and text count as one
document; an empty table gives an empty result; very long lines and texts are taken whole, as any
other; other columns pass through ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, with_class
from .graph import components

THRESHOLD = 2
#: Lines that are linked: all that have a segment for each edit and one more.
NEAR_CHARS = THRESHOLD + 1
#: Lines that are reported: all but blank ones.
EXACT_CHARS = 1
#: What ``drop_duplicates`` takes for short: such lines repeat by chance.
DROP_NEAR_CHARS = 30
DROP_EXACT_CHARS = 16
#: Lines of a list that are compared in one row, on average; longer lists meet block by block.
BLOCK = 64
#: Letters after which an alignment that has died is given up.
FIRST_LETTERS = 16
BUCKETS = 1 << 20
LINE_SPAN = 1 << 31


def numbered(docs: DataFrame, exact_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, line_no, line, h1, h2, pos) of all lines that may be duplicates."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    line = rows.withColumn("line", F.trim("line")).where(F.length("line") >= exact_chars).where("id is not null")
    pos = F.col("id").cast("decimal(20,0)") * F.lit(LINE_SPAN).cast("decimal(10,0)") + F.col("line_no")
    return line.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line"), "pos": pos.cast("decimal(31,0)")})


def keys(line: Column, threshold: int, near_chars: int) -> list[Column]:
    """Hashes of a line's segments, then of its other probes (null where a probe does not exist).

    A line of the same length is also probed for at the segments' own places: those probes are the
    segments' hashes themselves.
    """
    parts = threshold + 1
    n = F.length(line)

    def bounds(length: Column, i: int) -> tuple[Column, Column]:
        start = F.floor(length * i / parts).cast("int")
        return start, F.floor(length * (i + 1) / parts).cast("int") - start

    def key(i: int, length: Column, start: Column, size: Column) -> Column:
        return F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size))

    out = [key(i, n, *bounds(n, i)) for i in range(parts)]
    for shorter in range(threshold + 1):
        length = n - shorter
        for i in range(parts):
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i)
            start, size = bounds(length, i)
            for move in range(low, high + 1):
                if not shorter and not move:
                    continue
                at = start + move
                out.append(F.when((length >= near_chars) & (at >= 0) & (at + size <= n), key(i, length, at, size)))
    return out


def common_start(a: Column, b: Column) -> Column:
    """Length of the common prefix (up to 2^21 - 1 characters of it)."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substring(a, F.lit(1), n + s) == F.substring(b, F.lit(1), n + s)), n + s).otherwise(n))


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two strings, or threshold + 1 if it is larger."""
    if not 0 <= threshold <= 4:
        raise ValueError("threshold must be 0 .. 4")
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def once(value: Column, use) -> Column:
        """use(value) with the value made once: a lambda's variable, where an expression would be made anew."""
        return F.transform(F.array(value), use)[0]

    def automaton(a: Column, b: Column) -> Column:
        """State after all letters of b, of the alignments of b with prefixes of a."""
        return once(F.struct(letters(a).alias("x"), letters(b).alias("y")), lambda e: over(e["x"], e["y"]))

    def over(x: Column, y: Column) -> Column:
        def matches(j: Column) -> Column:
            c = F.get(y, j - 1)
            bits = [F.when(F.coalesce(F.get(x, j - 1 + d - threshold) == c, F.lit(False)) & (j + d - threshold >= 1), 1 << d).otherwise(0) for d in range(width)]
            total = bits[0]
            for one in bits[1:]:
                total = total + one
            return total.cast("long")

        def step(state: Column, match: Column) -> Column:
            word = lambda k: F.shiftright(state, width * k).bitwiseAND(F.lit(full).cast("long"))
            out = new = word(0).bitwiseAND(match)
            for k in range(1, threshold + 1):
                less = word(k - 1)
                new = word(k).bitwiseAND(match).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(full).cast("long"))
                out = out.bitwiseOR(F.shiftleft(new, width * k))
            return out

        begin = sum(sum(1 << threshold + d for d in range(k + 1)) << width * k for k in range(threshold + 1))
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(y)), matches), F.lit(begin).cast("long"), step)

    def letters(s: Column) -> Column:
        none = F.array().cast("array<string>")
        return once(s, lambda t: F.when(F.length(t) == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1)))))

    def banded(e: Column) -> Column:
        n, m = F.length(e["x"]), F.length(e["y"])

        def least(end: Column) -> Column:
            # shiftright takes no column as its distance: divide by a power of two instead
            found = F.lit(threshold + 1)
            for k in range(threshold, -1, -1):
                bit = F.floor(end / F.pow(F.lit(2.0), F.lit(width * k + threshold) + n - m)).cast("long") % 2 == 1
                found = F.when(bit, k).otherwise(found)
            return found

        found = once(automaton(e["x"], e["y"]), least)
        return F.when(F.abs(n - m) > threshold, threshold + 1).when(F.least(n, m) == 0, F.greatest(n, m)).otherwise(found)

    def without_start(e: Column) -> Column:
        tail = lambda t: F.substring(t, e["p"] + 1, F.length(t))
        return F.struct(tail(e["a"]).alias("x"), tail(e["b"]).alias("y"))

    def without_end(e: Column) -> Column:
        return F.struct(e["x"].alias("x"), e["y"].alias("y"), common_start(F.reverse(e["x"]), F.reverse(e["y"])).alias("q"))

    def cut(e: Column) -> Column:
        head = lambda t: F.substring(t, F.lit(1), F.length(t) - e["q"])
        return F.struct(head(e["x"]).alias("x"), head(e["y"]).alias("y"))

    def rest(e: Column) -> Column:
        first = lambda s, k: F.substring(s, 1, k)
        dead = (F.length(e["y"]) > FIRST_LETTERS) & (automaton(first(e["x"], FIRST_LETTERS + threshold), first(e["y"], FIRST_LETTERS)) == 0)
        return F.when(dead, threshold + 1).otherwise(once(without_end(e), lambda t: once(cut(t), banded)))

    start = F.struct(a.alias("a"), b.alias("b"), common_start(a, b).alias("p"))
    return once(start, lambda t: once(without_start(t), rest))


#: Letters whose counts are part of a line's signature.
COUNTED = "abcdefghijklmnopqrstuvwxyz .,éóè"


def signature(line: Column) -> Column:
    """Counts of 32 letters modulo 4 in Gray code, two bits each. One more or one less of a letter is
    one bit, so two lines within d edits differ in at most 2 * d bits."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED):
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        low = (n % 4).cast("long")
        gray = low.bitwiseXOR(F.shiftright(low, 1))
        out = out.bitwiseXOR(F.shiftleft(gray, 2 * k))
    return out


def forest(found: Column) -> Column:
    """Of the pairs (a, b) found between two blocks: their lines' numbers of pairs as (a, null, n), and pairs
    (a, b, 0) that join the same lines as all of them do, at most one fewer than there are lines."""
    out = "array<struct<a:decimal(31,0),b:decimal(31,0),n:bigint>>"
    nodes = F.array_distinct(F.flatten(F.transform(found, lambda f: F.array(f["a"], f["b"]))))

    def counts(nodes: Column) -> Column:
        return F.transform(nodes, lambda x: F.struct(x.alias("a"), F.lit(None).cast("decimal(31,0)").alias("b"), F.size(F.filter(found, lambda f: (f["a"] == x) | (f["b"] == x))).cast("bigint").alias("n")))

    def spanning(nodes: Column) -> Column:
        start = F.struct(nodes.alias("label"), F.array().cast(out).alias("kept"))

        def step(state: Column, f: Column) -> Column:
            x, y = (F.element_at(state["label"], F.array_position(nodes, f[c]).cast("int")) for c in "ab")
            label = F.transform(state["label"], lambda v: F.when(v == F.greatest(x, y), F.least(x, y)).otherwise(v))
            edge = F.struct(f["a"].alias("a"), f["b"].alias("b"), F.lit(0).cast("bigint").alias("n"))
            joined = F.struct(label.alias("label"), F.concat(state["kept"], F.array(edge)).alias("kept"))
            return F.when(x == y, state).otherwise(joined)

        return F.aggregate(found, start, step, lambda state: state["kept"])

    told = F.transform(F.array(nodes), lambda n: F.concat(counts(n).cast(out), spanning(n)))[0]
    return F.when(F.size(found) > 0, told)


def links(lines: DataFrame, threshold: int = THRESHOLD, near_chars: int = NEAR_CHARS) -> DataFrame:
    """What lines within the threshold have in common, in rows linear in the lines: (a, null, n) add to the
    number n of other lines linked to the line with first place a; (a, b, 0) are links that span the components.
    """
    long = lines.where(F.length("line") >= near_chars)
    probes = keys(F.col("line"), threshold, near_chars)
    classes = long.groupBy("h1", "h2").agg(*[F.min(k).alias(f"k{i}") for i, k in enumerate(probes)])
    entries = classes.select("h1", F.posexplode(F.array(*[f"k{i}" for i in range(len(probes))])).alias("kind", "key")).where("key is not null").repartition("key")
    indexed = F.col("kind") <= threshold
    live = entries.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max(indexed).alias("any"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("low <> high and any").select("key", "blocks")
    members = entries.join(live, "key").groupBy("key", "h1").agg(F.max(indexed).alias("indexed"), F.first("blocks").alias("blocks"))
    members = durable(members.withColumn("block", F.pmod("h1", "blocks")))
    wanted = members.select("h1").distinct()
    bucket = F.pmod("h1", F.lit(BUCKETS)).cast("int").alias("bucket")
    near = long.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi")  # BUCKETS rows at most
    texts = near.groupBy("h1", "line").agg(F.min("pos").alias("pos")).join(wanted, "h1", "left_semi")
    own = [f"s{i}" for i in range(threshold + 1)]
    every = F.array_compact(F.array(*probes)).alias("probes")
    texts = texts.select("h1", F.struct("pos", "line", signature(F.col("line")).alias("signature"), F.length("line").alias("n"), every, *[k.alias(s) for s, k in zip(own, probes)]).alias("entry"))
    told = members.join(texts, "h1")
    blocks = told.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("indexed", "entry.*")).alias("xs"))
    single = blocks.where("blocks = 1").select("key", "xs", F.col("xs").alias("ys"))
    several = blocks.where("blocks > 1")
    left = several.select("key", "xs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    right = several.select("key", F.col("block").alias("other"), F.col("xs").alias("ys"))
    met = single.unionByName(left.join(right, ["key", "other"]).select("key", "xs", "ys"))

    def may(x: Column, y: Column) -> Column:
        """Whether the indexed line y is to be compared with the probing line x: another line, of two of one
        length that with the later first place probing, in no list before this one, let through by the signatures."""
        first = F.coalesce(*[F.when(F.array_contains(x["probes"], y[s]), y[s]) for s in own])
        order = (x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["pos"] > y["pos"]))
        return y["indexed"] & order & (F.bit_count(x["signature"].bitwiseXOR(y["signature"])) <= 2 * threshold) & (first == F.col("key"))

    def against(x: Column) -> Column:
        return F.transform(F.filter("ys", lambda y: may(x, y)), lambda y: F.struct(x["pos"].alias("a"), y["pos"].alias("b"), edit_distance(x["line"], y["line"], threshold).alias("d")))

    found = F.filter(F.flatten(F.transform("xs", against)), lambda f: f["d"] <= threshold)
    # outer, since the inner form would have what it explodes made twice more for a filter before it
    told = met.select(F.explode_outer(F.transform(F.array(found), forest)[0]).alias("e")).where("e is not null")
    return told.select("e.a", "e.b", "e.n")


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, near_chars: int = NEAR_CHARS, exact_chars: int = EXACT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of ``exact_chars`` or more: id, text_hash, line_no, the first place of its
    class (class_id, class_line), n_links (different lines within the threshold) and kept."""
    lines = numbered(docs, exact_chars, id_col, text_col)
    found = durable(links(lines, threshold, near_chars))
    degree = found.groupBy("a").agg(F.sum("n").alias("n_links"))
    group = components(found.where("b is not null").select("a", "b")).join(degree, F.col("node") == F.col("a")).select(F.col("node").alias("first"), "component", "n_links")
    classes = lines.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    named = durable(classes.join(group, "first", "left").select("h1", "h2", F.coalesce("component", "first").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n"))
    out = with_class(lines.select("id", "text_hash", "line_no", "pos", "h1", "h2"), named, ["h1", "h2"], "pos")
    span = F.lit(LINE_SPAN)
    class_id = F.floor(F.col("first") / span.cast("decimal(10,0)")).cast("long")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("line_no").cast("long").alias("line_no"), class_id.alias("class_id"), F.pmod(F.col("first"), span.cast("decimal(10,0)")).cast("long").alias("class_line"), "n_links", (F.col("pos") == F.col("first")).alias("kept"))


def drop_duplicates(docs: DataFrame, threshold: int = THRESHOLD, near_chars: int = DROP_NEAR_CHARS, exact_chars: int = DROP_EXACT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its duplicate lines, all columns kept; documents of which nothing but blank
    lines is left go. Rows without a duplicate line are unchanged."""
    own, mark, lost, left = fresh(docs, "_id", "_hash", "_lost", "_left")
    gone = line_classes(docs, threshold, near_chars, exact_chars, id_col, text_col).where("not kept")
    gone = gone.groupBy(F.col(id_col).alias(own), F.col("text_hash").alias(mark)).agg(F.collect_set(F.col("line_no").cast("int")).alias(lost))
    text = F.col(text_col).cast("string")
    whole = docs.where(F.col(id_col).isNotNull()).join(gone, (F.col(id_col) == F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left")
    rest = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost)), lambda i: F.get(lines, i)), "\n"))[0]
    whole = whole.withColumn(left, F.when(F.col(lost).isNotNull(), rest))
    kept = whole.where(F.col(left).isNull() | (F.length(F.trim(F.translate(left, "\n\r\t", ""))) > 0))
    numbered_rows = kept.withColumn(text_col, F.coalesce(left, text)).select(*docs.columns)
    return numbered_rows.unionByName(docs.where(F.col(id_col).isNull()).withColumn(text_col, text))  # not all in the one task of null keys
