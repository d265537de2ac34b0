"""Rows cut by bytes, signatures that gate what is read, bounds that skip segments."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import text as T
from tessera.operators import compaction, gating, index, retrieve
from tessera.operators.retrieve import Policy
from tessera.plans import loop
from tessera.plans.loop import Index


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)


def words(rng, n, of):
    return " ".join("w%d" % min(int(rng.expovariate(8 / of)), of) for _ in range(n))


def brute_pieces(text, n):
    data, out = text.encode(), []
    while data:
        at = min(n, len(data))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(data[:at].decode())
        data = data[at:]
    return out


@pytest.mark.parametrize("n", [4, 5, 7, 16])
def test_pieces_by_bytes(spark, n):
    rng = random.Random(n)
    texts = ["", "a", "abcd", "é" * 9, "\U0001f600" * 7, "aé\U0001f600ü" * 5] + ["".join(rng.choice("ab é中\U0001f600") for _ in range(rng.randrange(60))) for _ in range(40)]
    got = docs(spark, texts).select("doc_id", T.utf8_pieces("text", n).alias("p"), F.size(T.utf8_starts(F.encode("text", "UTF-8"), n)).alias("n")).collect()
    assert {r["doc_id"]: r["p"] for r in got} == {i: brute_pieces(t, n) for i, t in enumerate(texts)}
    assert all(r["n"] == len(r["p"]) for r in got)


def test_rows_are_numbered_without_moving_texts(spark):
    rng = random.Random(2)
    d = docs(spark, [None, "", *("word é " * rng.randrange(1, 40) for _ in range(50)), "same", "same"])
    few = index.frames(d, row_bytes=50, seg_docs=7)
    plan = few._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("Exchange")[1:] if "body#" in x.split("\n")[0] or "text#" in x.split("\n")[0]]
    assert not moved and "BroadcastHashJoin" in plan
    rows = sorted(map(tuple, few.collect()))
    assert rows == sorted(map(tuple, index.frames(d, row_bytes=50, seg_docs=7, broadcast_docs=0).collect()))
    by = {}
    for segment, row_ix, doc, _, chunk, body in rows:
        by.setdefault(segment, []).append((row_ix, doc, chunk))
        assert len(body.encode()) <= 50
    for got in by.values():
        assert [r[0] for r in got] == list(range(len(got))) and sorted(got, key=lambda r: r[1:]) == got


def test_bitmaps_have_the_bits_of_their_terms(spark):
    stats = spark.createDataFrame([(s, f"t{k}", 1, 1) for s in range(3) for k in range(s * 50)], "segment_id long, term string, df long, tf_sum long")
    terms = spark.createDataFrame([(q, f"t{k}", 1) for q, k in enumerate(range(0, 120, 3))], "query_id long, term string, qtf long")
    for size in (1, 64, gating.SIGNATURE_BYTES):
        signs = gating.signatures(stats, size)
        assert {r["n"] for r in signs.select(F.octet_length("bitmap").alias("n")).collect()} == {4096}
        got = {(r["segment_id"], r["term"]) for r in gating.maybe_terms(signs, terms, size).collect()}
        assert {(s, f"t{k}") for s in (1, 2) for k in range(0, 120, 3) if k < s * 50} <= got
        if size == gating.SIGNATURE_BYTES:
            assert len(got) <= 52
    with pytest.raises(ValueError):
        gating.probes("term", gating.SIGNATURE_BYTES + 1)


@pytest.mark.parametrize("hurt", ["none", "unlisted", "missing", "stale"])
def test_segments_without_a_sound_signature_are_opened(spark, hurt):
    ix = Index.build(docs(spark, ["banana apple", "banana", "apple", "carrot"]), seg_docs=1)
    stats = index.term_stats(ix.postings)
    signs = gating.signatures(stats)
    listed = gating.signature_map(signs)
    if hurt == "unlisted":
        listed = listed.where("segment_id <> 0")
    if hurt == "missing":
        signs = signs.where("segment_id <> 0")
    if hurt == "stale":
        signs = signs.withColumn("version", F.when(F.col("segment_id") == 0, F.lit(1)).otherwise(F.col("version")))
    told = gating.status(gating.versions(stats), listed, signs)
    assert {r["segment_id"]: r["status"] for r in told.collect()} == {0: hurt if hurt != "none" else "sound", 1: "sound", 2: "sound", 3: "sound"}
    terms = retrieve.query_terms(spark.createDataFrame([(1, "banana apple"), (2, "plum")], "query_id long, text string"))
    want = sorted(map(tuple, retrieve.search(ix.postings, ix.segments, terms).collect()))
    assert sorted(map(tuple, retrieve.search(ix.postings, ix.segments, terms, told=told).collect())) == want
    n = {r["query_id"]: r for r in gating.gate_counts(told, terms).collect()}
    gone = int(hurt != "none")
    assert n[1]["entries_total"] == 4 and n[1]["entries_missing_sig"] == gone and n[2]["entries_decoded"] == gone and n[2]["entries_skipped_sig"] == 4 - gone
    assert n[1]["bloom_probes_total"] == n[1]["bloom_maybe"] + n[1]["bloom_definite_miss"]
    assert n[1]["entries_decoded"] == 3 and n[1]["entries_skipped_sig"] == 1


def test_stored_searches_open_fewer_folders(spark, tmp_path):
    """A term of one segment: one folder is read, by the gate and by the bounds, and the hits are those of plain search."""
    rng = random.Random(3)
    texts = [words(rng, 30, 200) for _ in range(64)]
    texts[37] += " needle needle"
    Index.build(docs(spark, texts), seg_docs=4).write(str(tmp_path / "ix"), pack_segments=1)
    ix = Index.read(spark, str(tmp_path / "ix"))
    terms = retrieve.query_terms(spark.createDataFrame([(1, "needle")], "query_id long, text string"))
    want = sorted(map(tuple, retrieve.search(ix.postings, ix.segments, terms).collect()))
    assert len(want) == 1 and sorted(map(tuple, loop.gated(ix, terms).collect())) == want
    hits, pairs = loop.bounded(ix, terms)
    assert sorted(map(tuple, hits.collect())) == want and [tuple(r) for r in pairs.collect()] == [(1, 9)]
    some = spark.createDataFrame([(9,)], "segment_id long")
    assert all("pack=9" in f for f in ix.postings_of(some).inputFiles()) or ix.postings_of(some).select("pack").distinct().count() == 1


@pytest.mark.parametrize("policy", [Policy(), Policy(max_hits=2), Policy(max_hits=3, ties=False, max_per_doc=1), Policy(entry_cap=5)])
def test_bounds_change_no_result(spark, policy):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 60), 300) for _ in range(200)]
    ix = Index.build(docs(spark, texts), seg_docs=5)
    asked = spark.createDataFrame([(q, words(rng, 3, 300)) for q in range(12)] + [(99, "absent")], "query_id long, text string")
    terms = retrieve.query_terms(asked)
    peaks = gating.maxima(ix.postings)
    hits, pairs = retrieve.bounded_search(lambda _: ix.postings, peaks, ix.segments, terms, policy)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, retrieve.search(ix.postings, ix.segments, terms, policy).collect()))
    if policy == Policy(max_hits=2):
        matching = retrieve.scores(ix.postings, ix.segments, terms).select("query_id", "segment_id").distinct().count()
        assert pairs.count() < 0.7 * matching


def next_fit(sizes, target, most):
    out, group, used = [], -1, None
    for segment, size in sizes:
        if used is None or used + size > target:
            group, used = group + 1, 0
        used += size
        out.append((segment, size, group))
    if group + 1 > most:
        small, more = divmod(len(sizes), most)
        ends = [k for g in range(most) for k in [g] * (small + (g < more))]
        out = [(s, b, g) for (s, b), g in zip(sizes, ends)]
    return out


@pytest.mark.parametrize(("target", "most"), [(1, 500), (20, 500), (50, 500), (50, 4), (10**6, 3)])
def test_groups_are_next_fit(spark, target, most):
    rng = random.Random(target)
    sizes = [(s * 7 - 300 + (s > 90) * 10**12, rng.choice([0, 1, 5, 9, 30, 70])) for s in range(120)]
    df = spark.createDataFrame(sizes, "segment_id long, bytes long").repartition(3)
    got = sorted((r["segment_id"], r["bytes"], r["group_id"]) for r in compaction.greedy_groups(df, target, most).collect())
    assert got == next_fit(sizes, target, most)


def test_even_groups_of_few(spark):
    df = spark.createDataFrame([(s, 1) for s in range(5)], "segment_id long, bytes long")
    for groups, want in ((1, [0] * 5), (2, [0, 0, 0, 1, 1]), (5, [0, 1, 2, 3, 4]), (9, [0, 1, 2, 3, 4])):
        assert [r["group_id"] for r in compaction.even_groups(df, groups).orderBy("segment_id").collect()] == want
    assert compaction.greedy_groups(df.where("false"), 10).count() == 0


def test_compaction_of_a_stored_index(spark, tmp_path):
    """New files answer as the old ones do, which stay; a folder that is not whole has no report."""
    rng = random.Random(12)
    Index.build(docs(spark, [words(rng, 20, 100) for _ in range(40)]), seg_docs=2).write(str(tmp_path / "old"), pack_segments=1)
    old = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "old").rglob("*.parquet"))
    report = compaction.compact_stored(spark, str(tmp_path / "old"), str(tmp_path / "new"), 500, 50).collect()
    assert sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "old").rglob("*.parquet")) == old
    before, after = Index.read(spark, str(tmp_path / "old")), Index.read(spark, str(tmp_path / "new"))
    assert sum(r["n_segments"] for r in report) == 20 and sum(r["n_postings"] for r in report) == before.postings.count()
    assert {r["pack"] for r in after.postings.select("pack").distinct().collect()} == {r["group_id"] for r in report} and 1 < len(report) < 20
    terms = retrieve.query_terms(spark.createDataFrame([(1, "w1 w2"), (2, "w30")], "query_id long, text string"))
    for find in (loop.gated, lambda ix, t: loop.bounded(ix, t)[0]):
        assert sorted(map(tuple, find(after, terms).collect())) == sorted(map(tuple, find(before, terms).collect()))


def test_merge_of_parts(spark, tmp_path):
    """Alike segments count once; two versions of one, or a part that is half there, are errors; empty parts are not."""
    at = lambda name: str(tmp_path / name)
    d = docs(spark, ["banana apple", "banana", "carrot", "apple"])
    Index.build(d.where("doc_id < 3"), seg_docs=1).write(at("a"))
    Index.build(d.where("doc_id > 1"), seg_docs=1).write(at("b"))
    Index.build(d.where("doc_id = 3").withColumn("text", F.lit("plum")), seg_docs=1).write(at("other"))
    merged = Index.merge(spark, [at("a"), at("b"), at("none")], at("out"))
    asked = retrieve.query_terms(spark.createDataFrame([(1, "apple carrot")], "query_id long, text string"))
    plain = Index.build(d, seg_docs=1)
    assert sorted(map(tuple, loop.gated(merged, asked).collect())) == sorted(map(tuple, retrieve.search(plain.postings, plain.segments, asked).collect()))
    assert merged.segments.count() == 4 and merged.rows.count() == 4
    with pytest.raises(ValueError, match="two versions"):
        Index.merge(spark, [at("b"), at("other")], at("bad"))
    (tmp_path / "b" / "peaks" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        Index.merge(spark, [at("a"), at("b")], at("bad"))
    with pytest.raises(ValueError, match="no part"):
        Index.merge(spark, [at("none")], at("bad"))


def test_compaction_makes_no_statistics_anew(spark, tmp_path, monkeypatch):
    """Packs say where postings lie: peaks, signatures and versions are copied. A posting that is lost on the way is found."""
    rng = random.Random(4)
    Index.build(docs(spark, [words(rng, 20, 100) for _ in range(24)]), seg_docs=2).write(str(tmp_path / "old"), pack_segments=1)
    for name in ("maxima", "signatures", "versions"):
        monkeypatch.setattr(gating, name, None)
    compaction.compact_stored(spark, str(tmp_path / "old"), str(tmp_path / "new"), 500, 50)
    before, after = Index.read(spark, str(tmp_path / "old")), Index.read(spark, str(tmp_path / "new"))
    for name in ("rows", "peaks", "signatures", "signature_map"):
        assert sorted(map(tuple, getattr(after, name).collect())) == sorted(map(tuple, getattr(before, name).collect()))
    assert {r["status"] for r in after.status().collect()} == {"sound"}
    write = Index.write

    def forgetful(self, path, **how):
        self.postings = self.postings.where("not (segment_id = 3 and row_ix = 0)")
        write(self, path, **how)

    monkeypatch.setattr(Index, "write", forgetful)
    with pytest.raises(ValueError, match="segment 3 was not written whole"):
        compaction.compact_stored(spark, str(tmp_path / "old"), str(tmp_path / "bad"), 500, 50)


def test_a_gate_for_any_term_lists_no_terms(spark):
    """Postings go by the segments that are opened, without a join by segment and term."""
    ix = Index.build(docs(spark, ["banana apple", "banana", "plum"]), seg_docs=1)
    signs = gating.signatures(index.term_stats(ix.postings))
    told = gating.status(signs.select("segment_id", "version"), gating.signature_map(signs), signs)
    terms = retrieve.query_terms(spark.createDataFrame([(1, "banana")], "query_id long, text string"))
    own = gating.gated_postings(ix.postings, told, terms)
    assert "_through" not in own._jdf.queryExecution().analyzed().toString()
    assert sorted(r["doc_id"] for r in own.collect()) == [0, 1]


def test_a_merge_makes_no_statistics_anew(spark, tmp_path, monkeypatch):
    """A segment's peaks and signature are its part's; a part whose segments others have is not read on."""
    d = docs(spark, ["banana apple", "banana", "carrot"])
    Index.build(d, seg_docs=1).write(str(tmp_path / "a"))
    for name in ("maxima", "signatures", "versions"):
        monkeypatch.setattr(gating, name, None)
    merged = Index.merge(spark, [str(tmp_path / "a")] * 2, str(tmp_path / "out"))
    one = Index.read(spark, str(tmp_path / "a"))
    for name in loop.TABLES:
        want = getattr(one, name)
        assert sorted(map(str, getattr(merged, name).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r["status"] for r in merged.status().collect()} == {"sound"}
