"""The pipeline's rows against a plain Python version of its stages, on a small table of near-identical texts."""

import hashlib
import random

from tests.llm.test_pairs import brute_fingerprint, components_of, distance, mutated


def brute_lines(texts):
    """Texts without later lines of a class; None where nothing is left of a text that had duplicates."""
    places = [(i, k, line.strip(" ")) for i, t in enumerate(texts) if t is not None for k, line in enumerate(t.split("\n")) if len(line.strip(" ")) >= 16]
    links = [(a, b) for a in range(len(places)) for b in range(a) if places[a][2] == places[b][2] or (min(len(places[a][2]), len(places[b][2])) >= 30 and abs(len(places[a][2]) - len(places[b][2])) <= 2 and distance(places[a][2], places[b][2]) <= 2)]
    label = components_of(links, len(places))
    gone = {places[a][:2] for a in range(len(places)) if label[a] != a}
    out = {}
    for i, t in enumerate(texts):
        left = None if t is None else [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if t is None or len(left) == t.count("\n") + 1 or "".join(left).strip(" \n\r\t"):
            out[i] = None if t is None else "\n".join(left)
    return out


def test_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import queries
    from tokenizers import Tokenizer

    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abcde fgh") for _ in range(rng.randrange(10, 60)))
    base = [[line() for _ in range(rng.randrange(1, 5))] for _ in range(24)]
    texts = [None, "", " ", "one"]
    for b in base:
        texts.append("\n".join(b))
        for _ in range(rng.randrange(3)):
            texts.append("\n".join(mutated(rng, x, rng.choice([0, 0, 1, 3])) for x in b))
    words = " ".join("word%d" % rng.randrange(900) for _ in range(20))
    texts += [f"lead {words} end", f"lead in {words.upper()} and out", "word1 word2 word3 word4 word5 word6"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = brute_lines(texts)
    ids = sorted(kept)
    fps = [brute_fingerprint(kept[i]) for i in ids]
    label = components_of([(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4], len(ids))
    kept = {ids[k]: kept[ids[k]] for k in range(len(ids)) if label[k] == k}
    kept = {i: t for i, t in kept.items() if words not in (t or "").lower()}
    own = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in kept.items():
        tokens = own.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_rows_without_and_with_one_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = lambda: " ".join("v%d" % rng.randrange(5000) for _ in range(30))
    a, b, c, e = words(), words(), words(), words()
    rows = [(5, a), (5, b), (None, c), (None, e), (None, c), (6, a), (7, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    told = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # the copies of a (its line stood earlier), of c and of the missing text go
    assert sorted(got, key=str) == sorted([(5, told(a)), (5, told(b)), (None, told(c)), (None, told(e)), (7, told(""))], key=str)
