"""Order MinHash fingerprints against plain Python, and what they must tell apart."""

import hashlib
import random
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tessera.llm import ordermin, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, seed=42):
    """Spark's hash of longs (ints as four bytes), one after another."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if not isinstance(v, tuple) else struct.pack("<i", v[0]), seed=seed)
    return signed(seed)


def brute_fingerprint(text):
    pieces = [signed(xxhash.xxh64_intdigest(p.encode(), seed=42)) for p in regex.findall(r"[\p{L}\p{M}\p{N}]{1,8}|[^\p{L}\p{M}\p{N}\t\n\x0b\f\r ]", text or "")]
    grams = [chained(pieces[i : i + 3]) for i in range(len(pieces) - 2)] if len(pieces) >= 3 else [chained(pieces)] if pieces else []
    if not grams:
        return "0" * 256
    high = ~((1 << 28) - 1)
    seen, items = {}, []
    for place, g in enumerate(grams):
        n = seen[g & high] = seen.get(g & high, -1) + 1
        items.append(((chained([g & high, (n,)]) & high), place))
    items.sort()
    out = []
    for j in range(64):
        low = (j - 32) << 58
        ring = [x for x in items if x[0] >= low] + [x for x in items if x[0] < low]
        out.append(f"{chained([grams[p] for p in sorted(p for _, p in ring[:2])]) & 0xFFFF:04x}")
    return "".join(out)


def likeness(a, b):
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64


def brute(rows):
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), sorted."""
    rows = [(r[0], r[1] or "") for r in rows]
    # what is told apart: the id and the text; rows of one id by the hash of both
    tie = lambda r: signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42 if r[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", r[0]), seed=42)))
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r)))
    after = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    out = []
    for r in rows:
        text, follows = r[1], after[r][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        a, b, c = map(brute_fingerprint, (text, edited, follows))
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def result(spark, tmp_path, rows, more=()):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    for c in more:
        df = df.withColumn(c, F.lit("?"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_fingerprints(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r)[:7] for r in out.collect()), key=str)


def words(rng, n, of=5000):
    return " ".join("w%d" % rng.randrange(of) for _ in range(n))


ODD = [
    (None, "no id at all here"),
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "One"),
    (5, "two words"),
    (6, "exactly three pieces"),
    (7, "a a a a a a a a a a b a a a a a"),
    (8, "été \U0001f600 naïve \U0001f600\U0001f600 é"),
    (9, "same text of more than three pieces"),
    (10, "same text of more than three pieces"),
    (11, "abcdefgh" * 40),
    (12, "one id"),
    (12, "other text of the id"),
    (13, "a repeated row, three times"),
    (13, "a repeated row, three times"),
    (13, "a repeated row, three times"),
    (-20, "the least id of all, 中文文本没有空格"),
]


def test_equals_plain_python(spark, tmp_path):
    rng = random.Random(8)
    rows = ODD + [(100 + i, words(rng, rng.randrange(1, 200), rng.choice([3, 40, 5000]))) for i in range(60)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_long_texts(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, words(rng, 30_000)), (2, "again and " * 20_000), (3, "x" * 200_000), (4, "short")]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_columns_that_clash(spark, tmp_path):
    assert result(spark, tmp_path, ODD, more=("id", "a", "b", "edited", "fingerprint", "place", "group_rows", "need", "next_id", "_next", "to_a", "begin")) == brute(ODD)


@pytest.mark.parametrize("rows", [[], [(5, "a lone document follows itself")], [(5, None)]])
def test_tables_of_no_or_one_row(spark, tmp_path, rows):
    assert result(spark, tmp_path, rows) == brute(rows)


def test_order_and_repeats_are_told(spark):
    """The same k-mers in another order are less alike than with an edit of the same size; repeats count."""
    rng = random.Random(4)
    parts = [words(rng, 40) for _ in range(8)]
    base, swapped = " ".join(parts), " ".join(reversed(parts))
    edit = " ".join([*parts[:-1], words(rng, 10) + " " + " ".join(parts[-1].split()[10:])])
    df = spark.createDataFrame([(base, swapped), (base, edit), ("x y z " * 20, "x y z " * 40), (base, base)], "a string, b string")
    near = [r[0] for r in df.select(ordermin.likeness(ordermin.fingerprint(F.col("a")), ordermin.fingerprint(F.col("b")))).collect()]
    assert near[3] == 1 and near[0] < 0.7 < near[1] < 1 and near[2] < 1


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_fingerprints(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
