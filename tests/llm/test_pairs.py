"""Operators 2, 7, 10: each against a brute-force version."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tessera.llm import decontam, graph, lines, simhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(rng, n=80):
    vocabulary = ["w%d" % i for i in range(500)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    out = ["", None, "one", "One", "one two", " \n"]
    for b in base:
        out.append(b)
        for _ in range(rng.randrange(3)):
            words = b.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


def components_of(links, n):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("block", [512, 1])
def test_simhash_components(docs_of, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = near_texts(random.Random(5))
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(texts, extra=True)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert [out[i]["component_id"] for i in range(len(texts))] == components_of(links, len(texts))


@pytest.mark.parametrize("block", [512, 3])
def test_simhash_links_random_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(2):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            values.add(v ^ flips)
    values = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    got = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(rows).collect()}
    want = [(a, b) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 4]
    assert got <= set(want)
    number = {v: i for i, v in enumerate(values)}
    label = lambda pairs: components_of([(number[a], number[b]) for a, b in pairs], len(number))
    assert label(got) == label(want)


def test_simhash_entries_are_of_all_choices_in_a_small_plan(spark):
    rng = np.random.default_rng(8)
    fps = [0, -1, 1 << 62, -(1 << 63), *rng.integers(-(1 << 63), 1 << 63, 40).tolist()]
    out = simhash.entries(spark.createDataFrame([(x,) for x in fps], "fp long"))
    want = set()
    for x in fps:
        part = (x % (1 << 64)).to_bytes(8, "little")
        want |= {(x, int.from_bytes([k, *(part[p] for p in at)], "big")) for k, at in enumerate(itertools.combinations(range(8), 4))}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 70 * len(fps) and set(got) == want
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    size = lambda node: 1 + sum(map(size, each(node.children())))
    steps = lambda plan: sum(map(size, each(plan.expressions()))) + sum(map(steps, each(plan.children())))
    assert steps(out._jdf.queryExecution().optimizedPlan()) < 100


def test_simhash_lists_are_not_broadcast(spark, monkeypatch):
    """2000 fingerprints are under the threshold, the 140000 entries that these become are far over it."""
    rng = np.random.default_rng(6)
    distinct = simhash.durable(spark.createDataFrame([(x,) for x in rng.integers(-(1 << 63), 1 << 63, 2000).tolist()], "fp long").distinct())
    plans, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def durable(df):
        df.collect()  # its plan is then the one that ran
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "durable", durable)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        simhash.links(distinct)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) == 1 and "Join" in plans[0] and "BroadcastHashJoin" not in plans[0].split("== Initial Plan ==")[0]


def test_drop_near_duplicates_broadcasts_no_lists(spark, docs_of, monkeypatch):
    plans, threshold, cut = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), simhash.durable

    def durable(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return cut(df)

    monkeypatch.setattr(simhash, "durable", durable)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        kept = simhash.drop_near_duplicates(docs_of([f"text {k}" for k in range(600)])).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lists = [p for p in plans if "collect_list" in p]
    assert kept > 300 and len(lists) == 1 and "BroadcastHashJoin" not in lists[0]


@pytest.mark.parametrize("repeated", [False, True])
def test_drop_near_duplicates_broadcasts_no_kept_rows(docs_of, repeated):
    rows = docs_of([f"text {k} of words" for k in range(50)])
    out = simhash.drop_near_duplicates(rows.unionByName(rows.where("doc_id < 5")) if repeated else rows)
    kept = [r["doc_id"] for r in out.collect()]  # its plan is then the one that ran
    assert 0 in kept and len(set(kept)) == len(kept)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_drop_near_duplicates_keeps_one(docs_of):
    texts = ["a b c d e f", "a b c d e f", "A b C d e f", "other words stand here now", None, ""]
    rows = docs_of(texts, extra=True)
    out = simhash.drop_near_duplicates(rows.unionByName(rows.where("doc_id = 0")))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 4] and out.columns == rows.columns
    assert simhash.drop_near_duplicates(rows.where("doc_id < 0")).count() == 0


def test_drop_near_duplicates_with_null_and_clashing_ids(spark):
    one, two, three, four = "a b c d e f", "other words stand here now", "rivers run along green hills", "old stones lie by the road"
    rows = [(None, one), (None, one), (None, two), (None, three), (7, three.upper()), (5, four), (5, "what is it that sings at night"), (5, four), (None, None)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, one), (None, two), (7, three.upper()), (5, four), (5, "what is it that sings at night"), (None, None)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert graph.components(edges.where("a < 0")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        at, op = rng.randrange(len(s) + 1), rng.randrange(3)
        if op == 0:
            s.insert(at, rng.choice("abé"))
        elif s:
            s[min(at, len(s) - 1) : min(at, len(s) - 1) + 1] = [] if op == 1 else [rng.choice("abé")]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a" * 50 + "b" + "c" * 50, "a" * 49 + "c" * 51)]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([3, 9, 40])))
        pairs.append((a, mutated(rng, a, rng.randrange(5))))
        pairs.append((a, "".join(rng.choice("abé") for _ in range(len(a)))))
    out = spark.createDataFrame(pairs, "a string, b string").repartition(2).select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect()
    assert all(r["d"] == min(threshold + 1, distance(r["a"], r["b"])) for r in out)


@pytest.mark.parametrize("block", [64, 2])
def test_line_links_are_complete(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 60))).strip() for _ in range(80)]
    some = [m for b in base for m in [b, *(mutated(rng, b, rng.randrange(4)) for _ in range(rng.randrange(4)))]]
    some += [base[0][:20] + chr(97 + k) + base[0][21:] for k in range(26)] + [base[0][:k] + base[0][k + 1 :] for k in range(12)]
    rng.shuffle(some)
    texts = ["\n".join(some[i : i + 5]) for i in range(0, len(some), 5)]
    rows = lines.links(lines.numbered(docs_of(texts), 16, "doc_id", "text"), near_chars=28).collect()
    place = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= 28:
                place.setdefault(line.strip(" "), i * lines.LINE_SPAN + k)
    want = [(place[a], place[b]) for a in place for b in place if a != b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    counts = {}
    for r in rows:
        counts[int(r["a"])] = counts.get(int(r["a"]), 0) + r["n"]
    assert counts == {p: sum(a == p for a, _ in want) for p in {a for a, _ in want}}
    edges = [(int(r["a"]), int(r["b"])) for r in rows if r["b"] is not None]
    assert set(edges) <= set(want)
    number = {p: i for i, p in enumerate(sorted(place.values()))}
    label = lambda pairs: components_of([(number[a], number[b]) for a, b in pairs], len(number))
    assert label(edges) == label(want)


def test_whole_lines_link_short_ones(spark, docs_of, tmp_path):
    from tessera.llm import queries

    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30))) for _ in range(50)] + ["a", "bc", "Are, is anwh reenen."]
    some = [m for b in base for m in [b, b, *(mutated(rng, b, rng.randrange(3)) for _ in range(2))]] + ["Are is anwh reenen."]
    rng.shuffle(some)
    texts = ["\n".join(some[i : i + 4]) for i in range(0, len(some), 4)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["class_id"], r["class_line"], r["n_links"], r["kept"]) for r in queries.op10_lines(spark, str(tmp_path)).collect()}
    places = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line]
    near = lambda a, b: a == b or (min(len(a), len(b)) >= 3 and distance(a, b) <= 2)
    label = components_of([(x, y) for x in range(len(places)) for y in range(x) if near(places[x][2], places[y][2])], len(places))
    distinct = {p[2] for p in places}
    links = {a: sum(a != b and near(a, b) for b in distinct) for a in distinct}
    want = {(i, k): (*places[label[x]][:2], links[line], label[x] == x) for x, (i, k, line) in enumerate(places)}
    assert got == want


def test_signature_is_a_lower_bound(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(40))
        pairs.append((a, mutated(rng, a, rng.randrange(1, 3))))
    out = spark.createDataFrame(pairs, "a string, b string").select(F.bit_count(lines.signature(F.col("a")).bitwiseXOR(lines.signature(F.col("b")))).alias("n")).collect()
    assert max(r["n"] for r in out) <= 4


def test_drop_duplicate_lines(docs_of):
    long = "this is a line of more than thirty characters"
    texts = [long + "\nfirst of its own kind here", "second has other words\n" + long, long + "!", None, "", "short\nshort", "  " + long + "  \n\nanother line that nobody else has"]
    rows = docs_of(texts, extra=True)
    out = {r["doc_id"]: r["text"] for r in lines.drop_duplicates(rows).collect()}
    assert out[0] == texts[0] and out[1] == "second has other words" and 2 not in out
    assert out[3] is None and out[4] == "" and out[5] == "short\nshort" and out[6] == "\nanother line that nobody else has"
    assert lines.drop_duplicates(rows).columns == rows.columns
    assert lines.drop_duplicates(rows.where("doc_id < 0")).count() == 0


ITEMS = ["How many apples does the farmer pick if he picks 12 apples in 3 hours, then 12 more apples in the evening?", "Which river flows through the old town where the two bridges were built before the war?"]


def test_leaks(spark, docs_of):
    benchmark = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    texts = [
        "Some words before. " + ITEMS[0] + " And after.",
        "Some words before. " + ITEMS[0].replace("12", "40").replace("3 hours", "5 hours"),
        "Some words before. " + ITEMS[0].replace("picks 12", "picks 40").replace("then 12", "then 41"),
        ITEMS[1].upper(),
        "nothing to see in this text about rivers",
        " ".join(ITEMS[1].split()[:6]),
        None,
        "",
    ]
    for broadcast in (1 << 20, 0):
        out = decontam.leaks(docs_of(texts, extra=True), benchmark, broadcast_bytes=broadcast)
        got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in out.collect()}
        assert got == {(0, 0): True, (1, 0): False, (3, 1): True}
    kept = decontam.drop_leaks(docs_of(texts), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7]
    assert decontam.leaks(docs_of(texts).where("doc_id < 0"), benchmark).count() == 0
    assert decontam.leaks(docs_of(texts), benchmark.where("item_id < 0")).count() == 0


VARIED = [
    "In which year did Anna Miller walk from Paris to Berlin with her dog Rex and 2 friends?",
    "Who wrote Hamlet?",
    "How old is Bob?",
    "Add 3 to 4.",
    "What is 12 + 30 - 7?",
    "Solve 12 x 3 + 4 = 40 for x and then for y if y is 5.",
    "Why?",
    "A train of 120 m passes a bridge of 300 m in 21 seconds, so how fast does the train go over the bridge?",
]


def test_copies_of_any_case_and_short_items_are_found(docs_of, spark):
    benchmark = spark.createDataFrame(list(enumerate(VARIED)), "item_id long, text string")
    lead = "The rain fell on the hills. "
    texts, want = [], set()
    for form in (str, str.lower, str.upper, str.title):
        for k, item in enumerate(VARIED):
            texts.append(lead + form(item) + "\nAnd then we went home.")
            want.add((len(texts) - 1, k, True))
    changed = {
        0: ["In which year did Carla Jones walk from Rome to Vienna with her dog Bello and 7 friends?", "in which year did anna miller walk from paris to berlin with her dog rex and 9 friends?"],
        2: ["How old is Alice?"],
        5: ["Solve 11 x 7 + 6 = 83 for x and then for y if y is 8."],
        7: ["A train of 90 km passes a bridge of 450 km in 35 minutes, so how fast does the train go over the bridge?"],
    }
    for k, some in changed.items():
        for t in some:
            texts.append(lead + t)
            want.add((len(texts) - 1, k, False))
    texts += ["Who wrote the letter?", "That is why we left.", "How old the house is!", "a train of 12 m passes a bridge of 12 m in 9 seconds", lead * 40, ""]
    for broadcast in (1 << 20, 0):
        out = decontam.leaks(docs_of(texts, extra=True), benchmark, broadcast_bytes=broadcast).collect()
        assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in out} == want
