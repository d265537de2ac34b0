"""Operators 1, 3, 4, 6: each against a brute-force version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tessera.llm import bpe, common, licence, media, queries, sharding, simhash

ODD = ["", None, "x", " \t\n", "é🎉 日本語", "a" * 70_000, "Under the MIT License. under the mit license", "the the the", "<|endoftext|> hi <|endoftext|>", "cc by nc cc by nc 4.0", "Licensed under the Apache License, Version 2.0."]


def test_licence_base_places(docs_of):
    got = {r["doc_id"]: r for r in licence.scan(docs_of(ODD, extra=True)).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        want = sorted((k, label) for phrase, label in licence.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert got[i]["n_words"] == len(words)
        assert sorted((p["first"], p["label"]) for p in got[i]["phrases"]) == want


def test_licence_automaton_matching_statistics():
    rng = random.Random(3)
    for _ in range(50):
        seqs = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        a = licence.Automaton(seqs)
        text = [rng.choice("abcd").encode() for _ in range(40)]
        ids = [a.vocabulary.get(w, 0) for w in text]
        for i, (state, n) in enumerate(a.statistics(ids)):
            best = max(k for k in range(i + 2) if k == 0 or any(s[j : j + k] == text[i - k + 1 : i + 1] for s in seqs for j in range(len(s))))
            assert n == best
            places = [(q, j + n - 1) for q, s in enumerate(seqs) for j in range(len(s) - n + 1) if n and s[j : j + n] == text[i - n + 1 : i + 1]]
            assert not n or a.places[state] == sorted(places)


def test_licence_spans_survive_edits(docs_of):
    mit = licence.TEMPLATES["mit"].split()
    mit[20] = "zebra"
    texts = ["before " + " ".join(mit) + " after", " ".join(mit[:8]), " ".join(mit + ["gap"] * 30 + mit)]
    got = [r["spans"] for r in licence.scan(docs_of(texts)).orderBy("doc_id").collect()]
    assert [s["label"] for s in got[0]] == ["mit"] and got[0][0]["first"] == 1 and got[0][0]["coverage"] > 0.9
    assert got[1] == [] and len(got[2]) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000])
def test_permutation(n):
    for seed in (1, 2):
        assert sorted(sharding.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


def test_shards(spark, docs_of):
    texts = [*ODD, *(f"text {i % 7}" for i in range(200))]
    rows = docs_of(texts, extra=True)
    rows = rows.unionByName(rows.where("doc_id < 40")).unionByName(rows.where("doc_id = 3"))
    out = sharding.shuffled_shards(rows, 24).collect()
    assert len(out) == len(texts) + 41
    by = {}
    for r in out:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(24)) <= 1
    again = sharding.shuffled_shards(rows.repartition(7), 24).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert sharding.shuffled_shards(rows.where("doc_id < 0"), 24).count() == 0


def test_media_round_trip(docs_of):
    out = {r["doc_id"]: r for r in media.text_media(docs_of(ODD, extra=True)).collect()}
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload).hexdigest()


def test_area_resize_against_sums():
    rng = np.random.default_rng(0)
    for h, w, r, c in [(7, 5, 3, 2), (1, 64, 8, 9), (200, 64, 8, 8), (3, 3, 8, 9)]:
        image = rng.integers(0, 256, (h, w), dtype=np.uint8)
        fine = np.kron(image.astype(np.int64), np.ones((r, c), np.int64))
        want = fine.reshape(r, h, c, w).sum(axis=(1, 3))
        assert (media.cell_sums(image, r, c) == want).all()


def test_image_formats():
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode_image(b"P6 3 2 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode_image(b"P3\n# note\n3 2\n255\n" + b" ".join(b"%d" % x for x in rgb.ravel())) == rgb).all()
    assert (media.decode_image(b"P4 3 1\n\xa0") == [[0, 255, 0]]).all()
    assert (media.decode_image(b"P1 3 1\n1 0 1") == [[0, 255, 0]]).all()
    row = b"".join(bytes(p[::-1]) for p in rgb[1].tolist()) + bytes(3), b"".join(bytes(p[::-1]) for p in rgb[0].tolist()) + bytes(3)
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert (media.decode_image(head + b"".join(row)) == rgb).all()
    with pytest.raises(ValueError):
        media.decode_image(b"P6 3 2 255\n\x00")


def test_resize_of_every_kind():
    rng = np.random.default_rng(3)
    for kind, shape in [(np.uint8, (7, 5)), (np.uint16, (9, 4)), (np.uint8, (6, 5, 3)), (np.uint16, (4, 7, 3))]:
        image = rng.integers(0, np.iinfo(kind).max, shape, dtype=kind, endpoint=True)
        small = media.area_resize(image, 3, 2)
        assert small.dtype == kind and small.shape == (3, 2, *shape[2:])
        bands = image.reshape(*shape[:2], -1).astype(object)
        for k in range(bands.shape[2]):
            fine = np.repeat(np.repeat(bands[:, :, k], 3, axis=0), 2, axis=1).reshape(3, shape[0], 2, shape[1])
            want = fine.sum(axis=(1, 3)) // (shape[0] * shape[1])
            assert (small.reshape(3, 2, -1)[:, :, k] == want).all()
        bright = media.grey(image)
        assert bright.dtype == kind and (image.ndim == 2 or bright[0, 0] == int(image[0, 0].astype(object) @ [299, 587, 114]) // 1000)
        assert len(media.dhash(image)) == 16


def test_levels_and_masks():
    assert (media.decode_image(b"P2 3 1 15\n0 7 15") == [[0, 119, 255]]).all()
    assert (media.decode_image(b"P2 2 1 # deep\n1023\n1023 512") == [[65535, 32800]]).all()
    deep = media.decode_image(b"P5 2 1 65535\n" + (40000).to_bytes(2, "big") + (5).to_bytes(2, "big"))
    assert deep.dtype == np.uint16 and deep.tolist() == [[40000, 5]] and media.area_resize(deep, 1, 1).tolist() == [[20002]]

    def bmp(bits, packing, pixels, masks=b""):
        b4 = lambda n: n.to_bytes(4, "little", signed=n < 0)
        return b"BM" + bytes(8) + b4(54 + len(masks)) + b4(40) + b4(2) + b4(-1) + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + b4(packing) + bytes(20) + masks + pixels

    w = lambda n, size: n.to_bytes(size, "little")
    assert media.decode_image(bmp(16, 0, w(31 << 10, 2) + w(16 << 5 | 31, 2))).tolist() == [[[255, 0, 0], [0, 132, 255]]]
    masks = w(0xFF, 4) + w(0xFF00, 4) + w(0xFF0000, 4)
    assert media.decode_image(bmp(32, 3, w(0x030201, 4) + w(0xFF00FE, 4), masks)).tolist() == [[[1, 2, 3], [254, 0, 255]]]
    for bad in (bmp(8, 1, bytes(8)), bmp(32, 3, bytes(8), bytes(12)), bmp(24, 0, b""), b"P7 1 1", b"P5 1 1 0\n\x00"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_bpe_equals_the_library(docs_of):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aab  \n'll\x1c\x85é🎉1 ") for _ in range(rng.randrange(80))) for _ in range(60)]
    own = Tokenizer.from_file(queries.tokenizer_path())
    out = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(texts, extra=True), queries.tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids
        assert out[i]["decoded"] == own.decode(ids, skip_special_tokens=False)


def test_empty_tables(docs_of):
    none = docs_of(["x"]).where("doc_id < 0")
    assert licence.scan(none).count() == media.text_media(none).count() == bpe.encode_decode(none, queries.tokenizer_path()).count() == 0


def test_workers_give_their_memory_back(spark, docs_of, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    docs, runs, given = docs_of(["one two", "three"]), [], []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: runs.append(run) or spark.createDataFrame([], schema))
    bpe.encode_decode(docs, queries.tokenizer_path())
    simhash.fingerprints(docs)
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["one two", None]})
    assert [sum(out.num_rows for out in run(iter([batch]))) for run in runs] == [2, 2] and len(given) == 2
    stopped = runs[0](iter([batch, batch]))
    next(stopped)
    stopped.close()
    assert len(given) == 3
