"""The Merkle manifest against plain Python, with blocks of the usual and of the least size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = [row[k] for k in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in told])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def around(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i // 3 * 3
        out.append((nodes[start:i], nodes[i + 1 : start + 3]))
        i //= 3
    return out


def brute(rows):
    """Result rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            steps = around(trees[name], i) + around(top, k)
            claimed = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                claimed["text"] = r["text"].replace("\n", "")
            node = leaf(claimed)
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*[x for left, right in steps for x in left + right])
            out.append((r["doc_id"], leaf(r), trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def table_of(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


def result(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(more)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


ODD = [
    (None, "no id", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (5, "x\ny\n", "de", "a", 4),
    (5, "x\ny\n", "de", "a", 4),
    (5, "another text of the id", "de", "a", 4),
    (-7, "é\nü", "fr", "ä", 3),
    (8, "long \n" * 60_000, "en", "lone", 360_000),
    (9, "1:a-", "1", "b", 1),
]


@pytest.mark.parametrize("levels", [6, 1])
def test_equals_plain_python(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = ODD + [(100 + i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 20}", i) for i in range(200)]
    assert result(spark, tmp_path, rows) == brute(table_of(rows))


def test_columns_that_clash(spark, tmp_path):
    more = {c: F.lit("?") for c in ("id", "place", "group_rows", "branch", "node", "path", "claimed", "levels", "block", "_at", "forest", "root")}
    assert result(spark, tmp_path, ODD, **more) == brute(table_of(ODD))


def test_repeated_rows_are_all_kept(spark, tmp_path):
    rows = [(1, "same\n", "en", "s", 5)] * 30
    assert result(spark, tmp_path, rows) == brute(table_of(rows))


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []) == []


def test_levels_stop_at_the_root(spark):
    for n, want in ((1, 0), (2, 1), (3, 1), (4, 2), (9, 2), (10, 3), (27, 3), (28, 4)):
        nodes = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("place"), F.lit(n).cast("long").alias("group_rows"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
        row = merkle.blocks(nodes, ["g"]).first()
        assert len(row["levels"]) == want + 1 and len(row["levels"][-1]) == 1 and row["n_blocks"] == 1
