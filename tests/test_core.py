"""Core operators on tiny fixtures with expected values, and properties that must hold."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions import phonetic
from tessera.functions import text as T
from tessera.operators import compaction, evidence, expand, gating, graph, index, lexicon, lineage, ngram, planner, pragmatics, retrieve, solver
from tessera.operators.retrieve import Policy
from tessera.plans.loop import Index, answer, search
from tessera.sources import store, wiki
from tessera.sources.workload import Workload, generate


def docs(spark, texts, parts=2):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(parts)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def scores(spark, texts, question, **how):
    ix = Index.build(docs(spark, texts), **how)
    rows = retrieve.scores(ix.postings, ix.segments, retrieve.query_terms(ask(spark, question))).collect()
    return sorted((r["doc_id"], r["score"]) for r in rows)


def test_scores_of_one_segment(spark):
    texts = ["banana banana banana apple", "banana carrot"]
    assert scores(spark, texts, "banana") == [(0, 768), (1, 256)]
    assert scores(spark, texts, "banana apple") == [(0, 1152), (1, 256)]


def test_scores_depend_on_segments(spark):
    texts = ["banana banana apple", "banana carrot", "carrot apple"]
    assert scores(spark, texts, "banana", seg_docs=1) == [(0, 512), (1, 256)]
    assert scores(spark, texts, "banana") == [(0, 682), (1, 341)]


def test_ties_and_seeds(spark):
    ix = Index.build(docs(spark, ["banana"] * 3))
    terms = retrieve.query_terms(ask(spark, "banana"))
    hits = retrieve.scores(ix.postings, ix.segments, terms)
    assert {r["score"] for r in hits.collect()} == {256}
    assert retrieve.top_k(hits, 1, ties=True).count() == 3 and retrieve.top_k(hits, 1).count() == 1
    orders = {tuple(r["row_ix"] for r in retrieve.top_k(hits, 3, seed=str(s)).orderBy("rank").collect()) for s in range(8)}
    assert len(orders) > 1 and all(sorted(o) == [0, 1, 2] for o in orders)


def test_same_rows_for_any_partitions(spark):
    d, q = generate(spark, Workload())
    seen = set()
    for parts in (1, 5):
        ix = Index.build(d.repartition(parts), seg_docs=16, source_col=None)
        seen.add(tuple(sorted(map(tuple, search(ix, q).collect()))))
    assert len(seen) == 1 and d.where("doc_id >= 62").select("text").distinct().count() == 1


def test_gates_lose_nothing(spark):
    d, q = generate(spark, Workload())
    ix, terms = Index.build(d, seg_docs=8, source_col=None), retrieve.query_terms(q)
    hits = retrieve.scores(ix.postings, ix.segments, terms)
    assert hits.join(retrieve.gate(ix.postings, terms, False), ["query_id", "segment_id"], "left_anti").count() == 0
    true = terms.join(ix.postings, "term").select("query_id", "term", "segment_id").distinct()
    maybe = gating.maybe_segments(gating.signatures(index.term_stats(ix.postings), 64), terms, 64)
    assert true.join(maybe, ["query_id", "term", "segment_id"], "left_anti").count() == 0


def test_compaction_and_files_keep_scores(spark, tmp_path):
    ix = Index.build(docs(spark, ["banana apple", "banana carrot", "carrot", "apple apple"]), seg_docs=1)
    q = ask(spark, "banana apple")
    want = sorted(map(tuple, search(ix, q).collect()))
    ix.write(str(tmp_path / "ix"))
    assert sorted(map(tuple, search(Index.read(spark, str(tmp_path / "ix")), q).select(search(ix, q).columns).collect())) == want
    groups = compaction.even_groups(ix.segments, 3, size_col="row_count")
    assert [r["n"] for r in groups.groupBy("group_id").agg(F.count("*").alias("n")).orderBy("group_id").collect()] == [2, 1, 1]
    assert compaction.compact(ix.rows, groups).count() == 4


def test_reduce_rejects_conflicts(spark):
    a, b, c = (spark.createDataFrame([(1, n)], "k int, v int") for n in (1, 1, 2))
    assert index.reduced([a, b], ["k"]).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        index.reduced([a, c], ["k"]).collect()


def test_caps_and_limits(spark):
    hits = spark.createDataFrame([(0, s, r, d, 100 - r, r + 1) for r, (s, d) in enumerate([(0, 1), (0, 1), (0, 2), (1, 1), (1, 3)])], "query_id long, segment_id long, row_ix long, doc_id long, score long, rank long")
    got = lambda **k: [r["rank"] for r in retrieve.capped(hits, **k).orderBy("rank").collect()]
    assert got(per_doc=1) == [1, 3, 5] and got(per_segment=1) == [1, 4] and got(per_doc=1, per_segment=1) == [1, 5] and got() == [1, 2, 3, 4, 5]
    for bad in ({"max_hits": 0}, {"max_query_terms": 0}, {"novelty": 4}):
        with pytest.raises(ValueError):
            Policy(**bad)
    assert Policy(ties=False, max_per_doc=1).wanted == 80 and Policy(max_per_doc=1).wanted == 10


def test_saturation(spark):
    row = spark.range(1).select(T.saturated_product(F.lit(2**40), F.lit(2**40)).alias("a"), T.xor_fold(F.lit(-1).cast("long")).alias("b"), T.q16_ratio(F.lit(1), F.lit(0)).alias("c"), T.q16_ratio(F.lit(1), F.lit(2)).alias("d")).first()
    assert tuple(row) == (2**63 - 1, 0, 0, 32768)


def phonetic_code(token):
    """The rules, one place after another."""
    word = "".join(c for c in token if c.isascii() and c.isalpha())[: phonetic.MAX_LETTERS].lower()
    word = "s" + word[1:] if word.startswith("x") else word
    out, at = "", 0
    while at < len(word):
        for before, piece, behind, sound in phonetic.RULES:
            ok = {"": True, "^": at == 0, "=": at > 0 and word[at] == word[at - 1]}.get(before)
            ok = bool(re.search(f"(?:{before})$", word[:at])) if ok is None else ok
            m = re.match(f"({piece})(?={behind})", word[at:]) if ok else None
            if m:
                out, at = out + sound, at + len(m[1])
                break
        else:
            at += 1
    return re.sub(r"(.)\1+", r"\1", out)[: phonetic.MAX_CODE] or None


def test_phonetic_codes(spark):
    rng = random.Random(6)
    words = ["Smith", "Schmidt", "Knight", "Phone", "Xavier", "café", "12", "", "mm", "bbb", "lamb", "signed", "sign", "gnome", "judge", "nation", "mission", "laugh", "match", "whale", "ahead", "accept", "xx", "aa", "é", "a" * 100]
    words += ["".join(rng.choice("aeiouybcdghkmnpstwxz") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", phonetic.code_column(F.col("w"))).collect()
    assert [r[1] for r in got[:7]] == ["SM0", "SKMT", "NT", "FN", "SFR", "KF", None]
    assert [(r[0], r[1]) for r in got] == [(w, phonetic_code(w)) for w in words]


def test_morphology_and_expansion(spark):
    lemmas = spark.createDataFrame([("banana", "banana", 1), ("stop", "stop", 2)], "lemma string, lemma_key string, pos_mask long")
    terms = retrieve.query_terms(ask(spark, "bananas stopped"))
    chosen = expand.selected(expand.morphology_candidates(terms, lemmas))
    assert {(r["term"], r["qtf"]) for r in expand.expanded_terms(terms, chosen).collect()} == {("bananas", 1), ("banana", 24), ("stopped", 1), ("stop", 24)}
    ix = Index.build(docs(spark, ["banana banana is a fruit", "nothing here"]), seg_docs=8)
    assert search(ix, ask(spark, "bananas")).count() == 0
    hit = search(ix, ask(spark, "bananas"), lemmas=lemmas).first()
    assert hit["score"] == 24 * 2 * 384  # idf = (3 * 256) div 2
    assert expand.Budget.of(16).total == 0 and expand.selected(expand.morphology_candidates(terms, lemmas), expand.Budget.of(16)).count() == 0


def test_anchors(spark):
    rows = [(1, 0, "user", "banana bread"), (1, 1, "assistant", "ok E0425"), (1, 2, "user", "and then?")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["term"]: r["score"] for r in expand.context_anchors(messages, spark.createDataFrame([(1, 2)], "conv_id long, query_turn long")).collect()}
    assert got == {"banana": 3, "e0425": 2}
    merged = expand.with_anchors(spark.createDataFrame([(1, "banana", 1)], "query_id long, term string, qtf long"), spark.createDataFrame([(1, "banana", 1), (1, "bread", 1)], "query_id long, term string, qtf long"))
    assert sorted(r["term"] for r in merged.collect()) == ["banana", "bread"]


def test_graph_of_one_row(spark):
    postings = spark.createDataFrame([(0, 0, 0, t, 1) for t in "xyz"], "segment_id long, row_ix long, doc_id long, term string, tf long")
    edges = graph.cooccurrence(graph.row_nodes(postings)).collect()
    assert len(edges) == 6 and {(r["weight"], r["hop"], r["symmetric"]) for r in edges} == {(4096, 1, True)}
    entity = spark.createDataFrame([(0, 0, "e")], "segment_id long, row_ix long, node string")
    assert {r["weight"] for r in graph.cooccurrence(graph.row_nodes(postings, entity)).where("seed_kind = 'entity'").collect()} == {8192}


def test_ngrams(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "s long, i long, t string")
    got = {(r["context"], r["next"]): r["cnt"] for r in ngram.counts(ngram.streams(rows, "s", ["i"], "t", 2)).collect()}
    assert got == {("", "a"): 2, ("", "b"): 1, ("a", "b"): 1, ("b", "a"): 1}


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([(0, i, 10 - i, 0, i) for i in range(5)], "query_id long, item_ix long, score long, segment_id long, row_ix long")
    costs = spark.createDataFrame([(0, i, c) for i, c in enumerate([10, 50, 5, 30, 4])], "segment_id long, row_ix long, cost long")
    out = evidence.budgeted(items, costs, 20 + evidence.HEADER + 5 * evidence.ITEM)
    assert [r["cost"] for r in out.where("sketched").orderBy("item_ix").collect()] == [10, 5, 4]


def test_claims(spark):
    items = spark.createDataFrame([("b", 0, 0, 5), ("c", 0, 0, 5)], "bundle_id string, segment_id long, row_ix long, score long")
    claims = spark.createDataFrame([("b", 0, "x"), ("b", 1, ""), ("b", 2, "y"), ("b", 2, "z")], "bundle_id string, claim_id long, text string")
    refs = spark.createDataFrame([("b", 0, 0, 0, 5), ("b", 1, 9, 0, 5), ("b", 1, 0, 0, 6)], "bundle_id string, claim_id long, segment_id long, row_ix long, score long")
    got = sorted(((r["code"], r["bundle_id"], r["claim_id"]) for r in evidence.verify_claims(claims, refs, items).collect()), key=str)
    assert got == [("V000", "c", None), ("V001", "b", 2), ("V010", "b", 1), ("V011", "b", 2), ("V021", "b", 1), ("V022", "b", 1)]


def features(spark, *texts):
    return pragmatics.features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).orderBy("id").collect()


def test_pragmatics_scores(spark):
    r = features(spark, "Thanks!")[0]
    assert [r[c] for c in pragmatics.SCORES] == [30, 175, 165, 700, 545, 500, 100, 200] and r["flags"] == 0 and r["mode"] == "Unknown"


def test_pragmatics_flags(spark):
    bit = {n: 1 << i for i, n in enumerate(pragmatics.FLAGS)}
    got = features(spark, "and why?", "Compare a with b?", "better than or", "what about tea", "", None, "and " + "x" * 90 + "?")
    assert got[0]["flags"] == bit["question"] | bit["follow_up"]
    assert got[1]["flags"] == bit["question"] | bit["compare"]
    assert got[2]["flags"] == 0
    assert got[3]["flags"] == bit["question"] | bit["follow_up"]
    assert got[4]["flags"] == got[5]["flags"] == 0 and got[6]["flags"] == bit["question"]


def test_guided_plan_and_answer(spark):
    ix = Index.build(docs(spark, ["rivers run to the sea", "rivers and hills", "the sea is wide"]))
    rows = {r["id"]: r["answer"] for r in answer(ix, ask(spark, "rivers sea", "nothing that matches")).collect()}
    assert "rivers run to the sea" in rows[0] and set(rows) == {0, 1}
    told = pragmatics.directives(pragmatics.features(spark.createDataFrame([(0, "explain steps?", 2, 1)], "id long, text string, n_items long, n_segments long")))
    assert [r["kind"] for r in planner.guided_plan(told).orderBy("item_ix").collect()] == ["step", "step"]


PUZZLE = "vars: A, B, C\ndomain: 1..3\nexpect_unique: true\nconstraints:\n- all_different(A, B, C)\n- A = 1\n- B = 2"


def test_puzzle():
    r = solver.solve(solver.parse_block(PUZZLE))
    assert (r.status, r.solutions, r.nodes) == ("unique", [{"A": 1, "B": 2, "C": 3}], 9)
    with pytest.raises(solver.PuzzleError):
        solver.parse_block("vars: A\ndomain: 1..3\nconstraints:\nA !=")
    assert solver.solve(solver.parse_block(PUZZLE), max_nodes=3).status == "truncated"
    free = solver.parse_block("vars: x y z\ndomain: {1, 2, 4}\nconstraints:\nif x = 1 then y > z\nx < y")
    want = [v for v in itertools.product([1, 2, 4], repeat=3) if (v[0] != 1 or v[1] > v[2]) and v[0] < v[1]]
    assert [tuple(s[n] for n in "xyz") for s in solver.solve(free, max_solutions=99).solutions] == want


def test_puzzle_sketches():
    s = solver.sketch("variables A, B and C")
    assert s.names == ["A", "B", "C"] and "values" in solver.missing(s)
    s = solver.merged(s, solver.sketch("values 1 to 3, all different, A = 1, if A = 1 then B = 2, exactly one", s.names))
    assert solver.missing(s) is None and solver.solve(solver.compiled(s)).solutions == [{"A": 1, "B": 2, "C": 3}]


XML = """<mediawiki><page><title>Hello</title><ns>0</ns><revision><text xml:space="preserve">hi &amp; there</text></revision></page>
<page><title>Talk:Hello</title><ns>1</ns><revision><text>no</text></revision></page></mediawiki>"""


def test_sources_agree(spark, tmp_path):
    import bz2

    (tmp_path / "a.tsv").write_text("Hello\thi & there\nno tab\n\n")
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml.bz2").write_bytes(bz2.compress(XML.encode()))
    want = [("Hello", "hi & there")]
    assert [tuple(r) for r in wiki.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == want
    assert [tuple(r) for r in wiki.read_xml(spark, str(tmp_path / "a.xml")).collect()] == want
    assert [tuple(r) for r in wiki.read_xml(spark, str(tmp_path / "b.xml.bz2")).collect()] == want


ENTRY = "==English==\n===Noun===\n# A [[time|dark time]].\n====Pronunciation====\n* {{IPA|en|/naɪt/}}\n====Synonyms====\n* [[evening]]\n====Derived terms====\n* [[nightly]]\n* {{m|en|nightfall}}\n==French==\n===Noun===\n# no"


def test_dictionary(spark):
    pages = spark.createDataFrame([("night", ENTRY), ("rien", "==French==\n===Noun===\n# x")], "title string, text string")
    entry = wiki.parse_dictionary(pages).first()
    assert entry["pos_mask"] == 1 and entry["glosses"] == ["A [[time|dark time]]."] and entry["ipa"] == ["/naɪt/"]
    assert [(r["type"], r["target"]) for r in entry["relations"]] == [("synonyms", "evening"), ("derived terms", "nightly"), ("derived terms", "nightfall")]
    t = lexicon.tables(wiki.parse_dictionary(pages))
    assert t["lemmas"].count() == 1 and t["relations"].count() == 3 and t["pronunciations"].first()["meta_codes"][0] == "NT"
    assert {(r["lemma"], r["depth"]) for r in lexicon.neighbourhood(t["lemmas"], t["relations"]).collect()} == {("night", 0), ("evening", 1), ("nightly", 1), ("nightfall", 1)}
    parts = lexicon.segmented(t["lemmas"], t["senses"], t["relations"], 4)
    assert lexicon.shared_owners(parts["lemmas"]).count() == 0 and lexicon.unknown_owners(t["senses"], t["relations"], t["lemmas"]).count() == 0
    assert lexicon.shared_owners(parts["lemmas"].unionByName(parts["lemmas"].withColumn("segment_id", F.col("segment_id") + 1))).count() == 1


def test_store_and_workspace(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    key = s.put("t", a)
    assert s.put("t", a.repartition(2).select("t", "i")) == key and s.get("t", key).count() == 2
    assert store.content_id(a.where("i = 1")) != key
    w = store.Workspace.parse("# note\ndefault_k=5\ndefault_k=7\n")
    assert w.default_k == "7" and store.Workspace.parse(w.text()) == w
    for bad in ("merged_snapshot=x", "nope=1", "nothing"):
        with pytest.raises(ValueError):
            store.Workspace.parse(bad)


def test_lineage(spark, tmp_path):
    log = lineage.steps(spark, [("a", ["x", "x"], ["y"]), ("b", ["y"], ["z"])])
    lineage.append(str(tmp_path / "log"), log)
    back = spark.read.parquet(str(tmp_path / "log"))
    assert {r[0] for r in lineage.closure(spark.createDataFrame([("z",)], "artifact_id string"), back, 2).collect()} == {"x", "y", "z"}
    loops = lineage.steps(spark, [("a", ["x"], ["y"]), ("b", ["y"], ["x", "z"]), ("c", ["q"], ["r"])])
    found = lineage.closure(spark.createDataFrame([("z",)], "artifact_id string"), loops)
    assert {tuple(r) for r in found.collect()} == {("z", 0), ("y", 1), ("x", 2)}
    assert {tuple(r) for r in lineage.closure(spark.createDataFrame([("z",)], "artifact_id string"), loops, 1).collect()} == {("z", 0), ("y", 1)}


def test_streaming_ingest(spark, tmp_path):
    from tessera.streaming import ingest

    d = docs(spark, ["banana apple", "carrot"])
    d.write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.follow(spark, str(tmp_path / "in"), d.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    assert spark.read.parquet(str(tmp_path / "out/postings")).count() == 3
    d.select((F.col("doc_id") + 10).alias("doc_id"), *d.columns[1:]).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows = spark.read.parquet(str(tmp_path / "out/rows"))
    assert rows.count() == rows.select("segment_id", "row_ix").distinct().count() == 4
    hits = search(Index.read(spark, str(tmp_path / "out")), ask(spark, "carrot")).collect()
    assert sorted(r["doc_id"] for r in hits) == sorted(r["doc_id"] for r in rows.where("body = 'carrot'").collect()) and len(hits) == 2


def test_dense_numbers_of_any_ids(spark):
    ids = [5, -(2**62), 2**62, 7, 7, None, 0, 2**62 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
    got = {r["doc_id"]: r["doc_number"] for r in index.dense_numbers(rows).collect()}
    assert got == {v: k for k, v in enumerate(sorted({i for i in ids if i is not None}))}
    assert index.dense_numbers(rows.where("doc_id > 0 and doc_id < 0")).count() == 0


def test_hit_list_takes_the_best_score(spark):
    rows = spark.createDataFrame([(0, 0, 1, 4, 9), (0, 0, 1, 4, 5), (0, 0, 2, 5, 9), (0, 1, 0, 6, 10)], "query_id long, segment_id long, row_ix long, doc_id long, score long")
    got = [(r["doc_id"], r["score"], r["rank"]) for r in retrieve.hit_list(rows, most=2).orderBy("rank").collect()]
    assert got == [(6, 10, 1), (4, 9, 2)]


def test_lexicon_pages_of_one_title_are_told_and_merged_alike(spark):
    from tessera.operators import lexicon

    kind = "title string, pos_mask long, glosses array<string>, relations array<struct<type:string,target:string>>, ipa array<string>"
    pages = spark.createDataFrame([("a", 2, ["two"], [], []), ("a", 1, ["one"], [("synonyms", "b")], []), ("b", 1, [], [], [])], kind)
    assert [(r["title"], r["n_rows"]) for r in lexicon.duplicates(pages, "title").collect()] == [("a", 2)]
    for parts in (1, 3):
        assert [r["gloss"] for r in lexicon.tables(pages.repartition(parts))["senses"].collect()] == ["one"]


def test_gate_of_all_terms_reads_less(spark):
    ix = Index.build(docs(spark, ["banana apple", "banana", "apple", "carrot"]), seg_docs=1)
    terms = retrieve.query_terms(ask(spark, "banana apple"))
    stats = index.term_stats(ix.postings)
    signs = gating.signatures(stats)
    told = gating.status(gating.versions(stats), gating.signature_map(signs), signs)
    read = lambda every: {r["segment_id"] for r in gating.gated_postings(ix.postings, told, terms, every).collect()}
    assert read(False) == {0, 1, 2} and read(True) == {0}


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topk' in q and 'op1_licence' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 60


def test_packs_repeat(spark):
    from tessera.plans import regression

    pack = regression.same(spark, regression.PACKS["turn_pairs"])
    with pytest.raises(AssertionError):
        regression.same(spark, regression.PACKS["turn_pairs"], pack[::-1])


def test_entities(spark):
    pages = spark.createDataFrame([("a &amp; b &lt;&#65;&#x42;&nope; &#xD800;&amp",), ("&#x1F600;&amp;amp;&#0065;&#0;&#x110000;&;&&gt;",), ("",), (None,)], "text string")
    assert [r[0] for r in pages.select(wiki.decoded()).collect()] == ["a & b <AB&nope; \ufffd&amp", "\U0001f600&amp;A\ufffd\ufffd&;&>", "", None]


def test_control_ids():
    assert retrieve.control_id("p", ["a", "b"]) != retrieve.control_id("p", ["b", "a"])
    with pytest.raises(ValueError):
        retrieve.control_id("p", ["a", "a"])


def test_mix64_and_prefixes(spark):
    def plain(x: int) -> int:
        z = (x + T.MIX_STEP) % 2**64
        z = (z ^ z >> 30) * T.MIX_BY[0] % 2**64
        z = (z ^ z >> 27) * T.MIX_BY[1] % 2**64
        z ^= z >> 31
        return z - 2**64 if z >= 2**63 else z

    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345678]
    got = spark.createDataFrame([(i,) for i in ids], "x long").select("x", T.mix64("x")).collect()
    assert {r[0]: r[1] for r in got} == {i: plain(i) for i in ids}
    for text in ("", "abc", "aé€😀b", "😀😀"):
        for n in range(14):
            want = text.encode()[:n].decode("utf-8", "ignore")
            assert spark.createDataFrame([(text,)], "t string").select(T.utf8_prefix("t", n)).first()[0] == want, (text, n)


def test_phonetic_search_equals_brute_force(spark):
    from tessera.plans import loop

    docs = spark.createDataFrame([(1, "a knight rides"), (2, "the nite falls, nite"), (3, "123 _"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "knight"), (8, "99")], "query_id long, text string")
    ix = loop.Index.build(docs, phonetic=True, source_col=None)
    got = {(r["term"], r["doc_id"]): r["tf"] for r in ix.postings.where("term like '~%'").collect()}
    want: dict = {}
    for n, words in ((1, ["a", "knight", "rides"]), (2, ["the", "nite", "falls", "nite"])):
        for w in words:
            if code := phonetic_code(w):
                want["~" + code, n] = want.get(("~" + code, n), 0) + 1
    assert got == want
    plain = loop.search(loop.Index.build(docs, source_col=None), asked).collect()
    assert [r["doc_id"] for r in plain] == [1]
    sounds = {r["doc_id"] for r in loop.search(ix, asked, phonetic=True).collect()}
    assert sounds == {1, 2}
