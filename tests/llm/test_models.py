"""Operators 5, 8, 9 and the pipeline: against brute force, or held-out rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import chat, quality, toxicity


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "runs", "along", "green", "hills", "and", "old", "stones"]) for _ in range(n)) + "."


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by the book, over lists of symbols."""
    grams = Counter(int(g) for t in texts for g in quality.grams([t])[0])
    tables = [grams]
    for order in range(quality.ORDER - 1, 0, -1):
        tables.append(Counter(g % quality.SYMBOLS**order for g in tables[-1]))

    def prob(gram, level):
        if level == quality.ORDER:
            return 1 / quality.SYMBOLS
        table = tables[level]
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else None
        d = (0.5, 0.75, 1.0) if y is None else (min(max(1 - 2 * y * t[2] / t[1], 0.05), 0.95), min(max(2 - 3 * y * t[3] / t[2], 0.05), 1.95), min(max(3 - 4 * y * t[4] / t[3] if t[3] else 1.5, 0.05), 2.95))
        cut = lambda n: 0 if not n else d[min(n, 3) - 1]
        context = gram // quality.SYMBOLS
        own = {g: n for g, n in table.items() if g // quality.SYMBOLS == context}
        total = sum(own.values())
        rest = prob(gram % quality.SYMBOLS ** (quality.ORDER - level - 1), level + 1)
        if not total:
            return rest
        return max(own.get(gram, 0) - cut(own.get(gram, 0)), 0) / total + sum(map(cut, own.values())) / total * rest

    return lambda gram: prob(gram, 0)


def test_kneser_ney_against_the_formula(spark):
    rng = random.Random(1)
    texts = [prose(rng, 12) for _ in range(6)] + ["", None]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    brute = kneser_ney(texts)
    for gram in [int(g) for t in ["the river", "xyz qqq", "Old 12!"] for g in quality.grams([t])[0]]:
        assert math.isclose(model[gram], math.log2(brute(gram)), abs_tol=1e-4)
    total = 2.0 ** model.reshape(-1, quality.SYMBOLS).astype(float)
    assert np.allclose(total.sum(axis=1), 1, atol=1e-3)


def test_word_order_counts(spark, docs_of):
    rng = random.Random(12)
    texts = [("the river runs along green hills and old stones. " * rng.randrange(3, 9)).strip() for _ in range(50)]
    mixed = texts[0].split()
    rng.shuffle(mixed)
    texts += [" ".join(mixed), " ".join(rng.choice(["rivene", "grills", "hiver", "alones", "stoll", "thuns"]) for _ in range(40)) + "."]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 50, 2)], "doc_id long, quality int, toxic int")
    level = {r["doc_id"]: r["log2_perplexity"] for r in quality.judge(docs_of(texts), labels).collect()}
    assert min(level[50], level[51]) > 3 * max(level[i] for i in range(50))


def test_word_weights_against_the_formula(spark):
    rng = random.Random(13)
    texts = [prose(rng, 12) for _ in range(8)] + [""]
    table = type("Sent", (), {"value": quality.packed(quality.train(quality.vocabulary(spark.createDataFrame([(0, t) for t in texts], "fold int, text string"))))})
    rows = spark.createDataFrame([(i % 3 == 0, t) for i, t in enumerate(texts)], "fold boolean, text string").repartition(2)
    found, first, _ = quality.word_weights(rows, table)
    weight = {(r["a"], r["b"], r["c"]): (r["weight"], r["other"]) for r in found.collect()}
    start = int(quality.START)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    for which, some in ((0, texts), (1, [t for i, t in enumerate(texts) if i % 3])):
        lists = [[start, start, *map(int, quality.words([t])[0])] for t in some]
        tables = [Counter(tuple(w[i - 2 : i + 1]) for w in lists for i in range(2, len(w)))]
        for _ in range(2):
            tables.append(Counter(g[1:] for g in tables[-1]))

        def prob(gram, base, level=0):
            if level == 3:
                return base
            own = {g: n for g, n in tables[level].items() if g[:-1] == gram[:-1]}
            d = quality.discounts_of(Counter(tables[level].values()))
            cut = lambda n: 0 if not n else d[min(n, 3) - 1]  # noqa: B023, E731
            rest = prob(gram[1:], base, level + 1)
            total = sum(own.values())
            return (own.get(gram, 0) - cut(own.get(gram, 0))) / total + sum(map(cut, own.values())) / total * rest if total else rest

        for text in (texts[1], "the old river sleeps"):
            value, _, spelt, number = quality.words([text])
            w = [start, start, *map(int, value)]
            cost = quality.spelling(spelt, table.value)[number] / quality.STEPS
            want = sum(math.log2(prob(tuple(w[i - 2 : i + 1]), 2.0 ** -cost[i - 2])) for i in range(2, len(w)))
            keys = [k for i in range(2, len(w)) for k in [(None, None, w[i]), (None, w[i - 1], w[i]), (w[i - 2], w[i - 1], w[i])]] + [(None, None, start), (None, start, start)]
            got = sum(weight.get(tuple(x if x is None else signed(x) for x in k), (0, 0))[which] for k in keys) + len(value) * first[which] - cost.sum()
            assert math.isclose(got, want, abs_tol=1e-6)


def test_quality_keeps_prose_and_drops_noise(spark, docs_of):
    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(60)] + ["%$#@ &&& *** 9983 ##@@ zzxq" * 20 for _ in range(5)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 64, 2)], "doc_id long, quality int, toxic int")
    rows = docs_of(texts, extra=False)
    out = {r["doc_id"]: r["kept"] for r in quality.judge(rows, labels).collect()}
    assert len(out) == len(texts) and sum(out[i] for i in range(60)) >= 50 and not any(out[i] for i in range(60, 65))
    none = labels.where("quality > 5")
    assert all(r["kept"] for r in quality.judge(rows, none).collect())
    assert quality.judge(rows.where("doc_id < 0"), labels).count() == 0


def test_quality_leaves_no_shuffle_files(spark, docs_of):
    """Each pass's files go with it, without a collection of garbage, and the setting is as it was."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    before, held = spark.conf.get(quality.DROPPED, None), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(held.getAllFiles()) if f.getName().startswith("shuffle_")}
    old = files()
    quality.perplexities_kept(docs_of(["the river runs", "old hills", None, "the river"] * 3), labels.select(F.col("doc_id").alias("id")))
    assert not files() - old and spark.conf.get(quality.DROPPED, None) == before


def test_spans_are_the_words(spark):
    texts = ["Old été x", "", "a\ue000b 12,5 " + "z" * 3000, "\n \t"]
    value, row, joined, start, end = quality.spans(texts)
    own, rows, spelt, number = quality.words(texts)
    assert (value == own).all() and (row == rows).all() and row.max() == 3
    assert [spelt[n] for n in number] == [joined[s:e].replace(quality.EDGE_MARK, "") for s, e in zip(start, end)]
    alone = [quality.spans([t])[0].tolist() for t in texts]
    assert sum(alone, []) == value.tolist() and len(quality.powers(quality.BASE, 5)) == 5


def test_toxicity_on_held_out_rows(spark, docs_of):
    rng = random.Random(3)
    texts = [prose(rng, 80) + (" you dreadful grumblewort" if i % 4 == 0 else "") for i in range(240)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = docs_of(texts, extra=True)
    model = toxicity.train(rows, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i in range(160, 240))
    assert scores[240] == scores[241] and all(0 <= s <= 1 for s in scores.values())
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(rows, model).collect() if r["doc_id"] < 240) == [i for i in range(240) if i % 4]
    lone = toxicity.train(rows, labels.where("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(rows, lone).collect()) < 0.5
    assert toxicity.train(rows, labels.where("doc_id > 999")).score("anything") < 0.5


def test_ngram_pieces_meet():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé \n") for _ in range(3000))
    whole = set(toxicity.present(text).tolist())
    old, toxicity.PIECE = toxicity.PIECE, 100
    try:
        assert set(toxicity.present(text).tolist()) == whole
    finally:
        toxicity.PIECE = old


def test_viterbi_by_hand_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    p = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1]))
    model = chat.Model(p(1, chat.STATES)[0], p(chat.STATES, chat.STATES), p(chat.STATES, chat.MARKERS * chat.FEATURES))
    obs = rng.integers(0, chat.MARKERS * chat.FEATURES, 5)

    def score(path):
        s = model.start[path[0]] + model.emit[path[0], obs[0]]
        return s + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(path, path[1:], obs[1:]))

    best = max(itertools.product(range(chat.STATES), repeat=5), key=score)
    assert tuple(model.path(obs)) == best
    rows = spark.createDataFrame([(1, t, rng.choice(["User: a?", "AI: b", "- c", "plain\n1. x", ""])) for t in range(40)] + [(2, 0, "Q: hi"), (2, 1, None)] + [(None, None, f"A: {k}\nso?") for k in range(9)] + [(3, 4, f"- {k}") for k in range(9)], "c long, t long, x string")
    lines = chat.split_lines(rows, "c", "t", rows["x"])
    seen = {}
    for r in chat.observations(lines).collect():
        seen.setdefault(r["conv"], []).append(r)
    first = lambda r: (r["turn"] is not None, r["turn"] or 0, r["tie"], r["line_no"])
    want = []
    for conv, some in seen.items():
        some.sort(key=first)
        for r, state in zip(some, model.path(np.array([r["obs"] for r in some])).tolist()):
            role = chat.ROLES[state // 2]
            want.append((conv, r["turn"], r["tie"], r["line_no"], role, state % 2 == 0, f"<|{role}|>\n" * (state % 2 == 0) + r["body"]))
    want.sort(key=repr)
    assert sorted(map(tuple, chat.parse(lines, model).collect()), key=repr) == want
    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "FAN", 2)
    assert sorted(map(tuple, chat.parse(lines, model).collect()), key=repr) == want


def test_roles_are_recovered(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(2, 7)):
            role = ["user", "assistant"][t % 2]
            rows.append((c, t, role, prose(rng, 8) + ("?" if role == "user" else "\n" + prose(rng, 30))))
    rows += [(60, 0, "user", None), (None, None, "user", "who?"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    lines = chat.split_lines(df, "conv_id", "turn", chat.raw_form(df["role"], df["text"], df["conv_id"]))
    out = chat.parse(lines, chat.train(df)).collect()
    truth = {(c, t): r for c, t, r, _ in rows}
    right = [truth[r["conv"], r["turn"]] == r["role"] for r in out]
    assert sum(right) / len(right) > 0.97
    assert chat.parse(lines.where("conv < 0"), chat.train(df.where("conv_id < -1"))).count() == 0


def test_pipeline_stages(spark, tmp_path, docs_of):
    import corpus_pipeline

    rng = random.Random(7)
    names = ["w%d" % i for i in range(4000)]
    words = lambda n: " ".join(rng.choice(names) for _ in range(n))
    texts = [words(60) + "\n" + words(40) for _ in range(150)]
    for i in range(0, 100, 4):
        texts[i] += " you dreadful grumblewort"
    passage, item = words(60), words(25)
    texts[101] += "\n" + passage
    texts[103] += "\n" + passage
    texts[105] = texts[107]
    texts[109] = texts[111].replace("w1", "w2", 1)
    texts[113] += " " + item
    texts += [None, ""]
    rows = docs_of(texts)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, words(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == rows.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {i for i in range(150) if i not in left[0]} == {i for i in range(0, 100, 4)}
    assert passage in left[1][101] and passage not in left[1][103] and 107 not in left[1] and 105 in left[1]
    assert set(left[2]) <= set(left[1]) and len([i for i in (150, 151) if i in left[2]]) == 1
    assert 113 in left[2] and 113 not in left[3] and set(left[2]) - {113} == set(left[3])
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left[3])


