"""Byte-level BPE by a pair-occurrence index, and its inverse.

A piece of a partition (``INDEX_BYTES`` of text) is pre-tokenised; its distinct words lie in one
array of symbols, linked to their neighbours. An index maps each adjacent pair's merge rank to all
positions of that pair. Active ranks are taken in ascending order; all positions of a rank merge at
once, and only the lists of the pairs around them change. A merge makes a token younger than all
tokens before it, so the pairs it creates have larger ranks, and one ascending pass is exact.

Nulls count as empty texts (no ids, empty decoded text), repeated rows each give a row, an empty
table gives an empty result, and only the two named columns are read.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, lean, ranges, text_chunks

INDEX_BYTES = 24 << 20
NO_RANK = np.int32(2**31 - 1)
#: The word pattern of the public byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it is visible
    Latin-1, else the next free one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        of_char = printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = {i: bytes(of_char[c] for c in w) for w, i in vocab.items()}
        spelled |= {i: w.encode() for w, i in self.special.items()}
        n = max(spelled) + 1
        parts = [spelled.get(i, b"") for i in range(n)]
        self.byte_len = np.fromiter(map(len, parts), np.int64, n)
        self.byte_start = np.cumsum(self.byte_len) - self.byte_len
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.first = np.zeros(256, np.int32)
        for c, b in of_char.items():
            self.first[b] = vocab[c]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) << 20 | self.right
        self.by_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by_key]
        self.word = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NO_RANK)

    def words(self, text: str) -> list:
        """Words of a text; a special token is a tuple of its id."""
        if self.split is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list = []
        for part in self.split.split(text):
            out += [(self.special[part],)] if part in self.special else self.word.findall(part)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and each word's number of ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        token = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        if not n:
            return token, size
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        end = np.cumsum(size)
        full = size > 0
        after[end[full] - 1] = -1
        before[(end - size)[full]] = -1
        rank = np.full(n, NO_RANK, np.int32)
        pairs = np.flatnonzero(after >= 0).astype(np.int32)
        rank[pairs] = self.rank(token[pairs], token[pairs + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r != NO_RANK], r[r != NO_RANK]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, some in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if key in index:
                    index[key].append(some)
                else:
                    index[key] = [some]
                    heapq.heappush(active, key)

        enter(pairs)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if self.left[r] == self.right[r] and len(at) > 1:
                at = np.sort(at)
                new_run = np.r_[True, after[at[:-1]] != at[1:]]
                first = np.flatnonzero(new_run)
                place = np.arange(len(at)) - first[np.cumsum(new_run) - 1]
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            token[at] = self.made[r]
            follow = after[gone]
            after[at] = follow
            rank[gone] = NO_RANK
            rank[at] = NO_RANK
            token[gone] = -1
            has = follow >= 0
            before[follow[has]] = at[has]
            left = before[at]
            changed = np.concatenate([at[has], left[left >= 0]])
            if len(changed):
                changed = np.unique(changed)
                rank[changed] = self.rank(token[changed], token[after[changed]])
                enter(changed)
        alive = token >= 0
        upto = np.r_[0, np.cumsum(alive)]
        return token[alive], upto[end] - upto[end - size]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and each text's end, from all ids and each text's number of ids."""
        length = self.byte_len[ids]
        upto = np.r_[0, np.cumsum(length)]
        return self.bytes[ranges(self.byte_start[ids], length)], upto[np.cumsum(counts)]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, counts) for pieces of about OUT_BYTES of the texts."""
        known: dict = {}
        rows: list[np.ndarray] = []
        for text in texts:
            words = self.words(text)
            rows.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        spelled = [b"" if isinstance(w, tuple) else w.encode("utf-8") for w in known]
        ids, count = self.encode_words(spelled)
        for place, w in enumerate(known):
            if isinstance(w, tuple):
                start = int(count[:place].sum())
                ids = np.insert(ids, start, w[0])
                count[place] = 1
        known.clear()
        start = np.cumsum(count) - count
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < OUT_BYTES:
                size += len(texts[to])
                to += 1
            words = np.concatenate(rows[at:to])
            per_text = np.fromiter(map(len, rows[at:to]), np.int64, to - at)
            ends = np.r_[0, np.cumsum(count[words])]
            bounds = ends[np.r_[0, np.cumsum(per_text)]]
            yield at, to, ids[ranges(start[words], count[words])], np.diff(bounds)
            at = to


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (array of int) and ``decoded`` (the text made again from the ids) of every row.

    ``tokenizer_path`` is a byte-level BPE file in the JSON format of the tokenizers library, which
    every executor has at that path. Special tokens' strings in a text become their ids, as there.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        bpe = tokenizer(tokenizer_path)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for keys, texts in text_chunks(batch, 0, 1, INDEX_BYTES):
                for a, b, ids, counts in bpe.encode_texts(texts):
                    data, ends = bpe.decode(ids, counts)
                    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                    text_offsets = np.r_[0, ends].astype(np.int32)
                    decoded = pa.StringArray.from_buffers(b - a, pa.py_buffer(text_offsets), pa.py_buffer(data.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], key_type), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), decoded], names=["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(run), f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
