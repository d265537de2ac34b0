"""The registered queries on a small folder of tables, each against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from tessera.llm import queries

from tests.llm.test_pairs import brute_fingerprint, components_of

PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    out = [None, "", " \n", "One", "ONE", "é" * 130, "x" * 64, "tab\tand\x0bbreak", words(3), words(4)]
    out += ["Released Under the MIT License, and CC-BY-NC; under the mit license.", "Apache License, Version 2.0", "cc by  nc cc by nc", "under the mit licenses"]
    for _ in range(12):
        base = words(60)
        out += [base, base.upper(), base + " " + words(1), base]
    return out + [words(30) + " you dreadful grumblewort" for _ in range(20)] + [words(30) for _ in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, "no id at all", None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    n = len(texts)
    labels = [(i, 1, int("grumblewort" in (texts[i] or ""))) for i in range(n - 40, n)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def rows_of(spark, folder, query):
    out = query(spark, folder).collect()
    nameless = [r for r in out if r["doc_id"] is None]
    assert len(nameless) == 1
    return {r["doc_id"]: r for r in out if r["doc_id"] is not None}, nameless[0]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_licence_base(spark, folder, texts):
    out, _ = rows_of(spark, folder, queries.op1_licence)
    assert sorted(out) == list(range(len(texts)))
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
        r = out[i]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(at, default=None), max(at, default=None)), text
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base)
        every = [x for x in r["labels"].split(",") if x]
        assert set(base) <= set(every) and every == sorted(set(every)) and 0 <= r["score"] <= 1


def test_sharding_law(spark, folder, texts):
    out, nameless = rows_of(spark, folder, queries.op3_sharding)
    assert sorted(out) == list(range(len(texts)))
    shards = {}
    for r in [*out.values(), nameless]:
        shards.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len(shards) == 24 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for i, text in enumerate(texts):
        data = (text or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


def test_media_digests(spark, folder, texts):
    out, _ = rows_of(spark, folder, queries.op4_media)
    features = {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(data), len(payload), zlib.crc32(payload[-64:]), len(stored))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        # the difference hash, from exact sums of the cells of 8 rows and 9 columns
        height = len(payload) // 64
        sums = [[0] * 9 for _ in range(8)]
        for y in range(8 * height):
            for x in range(9 * 64):
                if payload[y // 8 * 64 + x // 9]:
                    sums[y // height][x // 64] += payload[y // 8 * 64 + x // 9]
        bits = "".join("1" if row[k + 1] > row[k] else "0" for row in sums for k in range(8))
        assert r["feature"] == "%016x" % int(bits, 2)
        assert features.setdefault(data, (r["feature"], r["tile_sha256"])) == (r["feature"], r["tile_sha256"])


def test_token_digests(spark, folder, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    out, _ = rows_of(spark, folder, queries.op6_bpe)
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        told = own.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == want


def test_fingerprints_and_components(spark, folder, texts):
    out, nameless = rows_of(spark, folder, queries.op7_simhash)
    fps = [brute_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert [out[i]["fingerprint"] for i in range(len(texts))] == ["%016x" % f for f in fps]
    assert [out[i]["component_id"] for i in range(len(texts))] == components_of(links, len(texts))
    assert nameless["fingerprint"] == "%016x" % brute_fingerprint("no id at all")


def test_toxicity_learns_from_its_fold_alone(spark, folder, texts, tmp_path):
    out, nameless = rows_of(spark, folder, queries.op8_toxicity)
    held = {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in out.items() if r["held_out"]} == held and nameless["held_out"] is True
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in [*out.values(), nameless])
    assert all(out[i]["predicted"] == int("grumblewort" in (t or "")) for i, t in enumerate(texts))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.withColumn("toxic", labels["toxic"].bitwiseXOR(queries.held_out().cast("int"))).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    again, _ = rows_of(spark, str(tmp_path), queries.op8_toxicity)
    assert {i: r["score"] for i, r in again.items()} == pytest.approx({i: r["score"] for i, r in out.items()}, abs=1e-9)
