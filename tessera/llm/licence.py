"""Licence scan by a generalised suffix automaton of licence tokens.

The templates' words form one automaton (templates are inserted one after another from the root).
Each text streams through it: after every word the state and the length of the longest suffix of the
text read so far that some template contains are known (matching statistics). A phrase of the base
list stands where that suffix ends in the whole phrase. For the longer templates, matches of at
least ``ANCHOR`` words whose extension ends there (maximal matches) become anchors at the places the
automaton knows for their state; anchors of one template are chained in text order with template
order kept, and a chain that covers at least ``COVERAGE`` of the template is a span of it.

Words outside the templates send the automaton to its root at once, so only runs of licence words
are walked. The automaton has at most two states a template word and is sent with the function.

Defined cases: a null text counts as empty; a text without words has no label and score 0; equal
rows give equal rows; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, text_chunks, utf8

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Characteristic passages of common public licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-1": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
ANCHOR = 3
COVERAGE = 0.8
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """Suffix automaton of several word sequences, with each state's places in the sequences."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in s] for s in sequences]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(self.sequences):
            state = 0
            for end, word in enumerate(sequence):
                state = self._extended(state, word, own)
                own[state].append((number, end))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        places = [set(x) for x in own]
        for state in order:
            places[self.link[state]] |= places[state]
        #: (sequence, last word's place) of every occurrence of the state's words
        self.places = [sorted(x) for x in places]

    def _extended(self, last: int, word: int, own: list) -> int:
        if (there := self.next[last].get(word)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there, own)
        new = self._state({}, self.length[last] + 1, own)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there, own)
        return new

    def _state(self, arrows: dict[int, int], length: int, own: list) -> int:
        self.next.append(arrows)
        self.link.append(0)
        self.length.append(length)
        own.append([])
        return len(self.next) - 1

    def _split(self, at: int, word: int, there: int, own: list) -> int:
        """A copy of ``there`` for its suffixes of up to length(at) + 1 words."""
        short = self._state(dict(self.next[there]), self.length[at] + 1, own)
        self.link[short], self.link[there] = self.link[there], short
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def statistics(self, words: list[int]):
        """(state, matched length) after each word; 0 is a word of no sequence."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            else:
                state = matched = 0
            yield state, matched


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str], anchor: int, coverage: float) -> None:
        self.labels = [*base.values(), *templates]
        texts = [*base, *templates.values()]
        self.automaton = Automaton([t.encode().translate(WORD_BYTES).split() for t in texts])
        self.n_base, self.anchor, self.coverage = len(base), anchor, coverage
        self.sizes = [len(s) for s in self.automaton.sequences]
        # whole base phrases among the suffixes of a state: its own and those of the states it links to
        ends: dict[int, list[tuple[int, int]]] = {}
        for k in range(self.n_base):
            *_, (state, _) = self.automaton.statistics(self.automaton.sequences[k])
            ends.setdefault(state, []).append((self.sizes[k], k))
        self.whole: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.next)):
            mine: list[tuple[int, int]] = []
            while state >= 0:
                mine += ends.get(state, [])
                state = self.automaton.link[state]
            self.whole.append(mine)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Number of words, (place, phrase) of all base phrases, and spans (label, first, last word, coverage)."""
        words = utf8(text).translate(WORD_BYTES).split()
        ids = np.fromiter(map(self.automaton.vocabulary.get, words, _zeros()), np.int32, len(words))
        known = np.flatnonzero(ids)
        found: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        if len(known) >= 2:
            cuts = np.flatnonzero(np.diff(known) > 1) + 1
            starts, ends = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]] + 1
            long = ends - starts >= min(self.anchor, min(self.sizes))
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                self._run(a, ids[a:b].tolist(), found, anchors)
        spans = [s for k, some in anchors.items() for s in self._chains(k, some)]
        return len(words), found, sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def _run(self, at: int, ids: list[int], found: list, anchors: dict) -> None:
        stats = list(self.automaton.statistics(ids))
        for i, (state, matched) in enumerate(stats):
            for size, phrase in self.whole[state]:
                if size <= matched:
                    found.append((at + i - size + 1, phrase))
            # a match that the next word does not extend
            if matched >= self.anchor and (i + 1 == len(stats) or stats[i + 1][1] <= matched):
                for sequence, end in self.automaton.places[state]:
                    if sequence >= self.n_base:
                        anchors.setdefault(sequence, []).append((at + i - matched + 1, end - matched + 1, matched))

    def _chains(self, sequence: int, anchors: list[tuple[int, int, int]]):
        """Disjoint chains of one template's anchors that cover enough of it: heaviest chain first."""
        size = self.sizes[sequence]
        anchors = sorted(anchors)
        group: list[tuple[int, int, int]] = []
        for one in [*anchors, None]:
            if group and (one is None or one[0] > group[-1][0] + 2 * size):
                yield from self._heaviest(sequence, group)
                group = []
            if one is not None:
                group.append(one)

    def _heaviest(self, sequence: int, group: list[tuple[int, int, int]]):
        size = self.sizes[sequence]
        best: list[tuple[int, int, int]] = []  # (covered, before, first word)
        starts = [x[0] for x in group]
        for i, (at, place, n) in enumerate(group):
            mine = (n, -1, at)
            for j in range(bisect_left(starts, at - 2 * size), i):
                a, p, m = group[j]
                gain = min(n, at + n - max(at, a + m), place + n - max(place, p + m))
                if a < at and p < place and gain > 0 and best[j][0] + gain > mine[0] and at - best[j][2] <= 2 * size:
                    mine = (best[j][0] + gain, j, best[j][2])
            best.append(mine)
        order = sorted(range(len(group)), key=lambda i: (-best[i][0], best[i][2], i))
        taken: list[tuple[int, int]] = []
        for i in order:
            covered, _, first = best[i]
            last = group[i][0] + group[i][2] - 1
            if covered < self.coverage * size:
                break
            k = bisect_left(taken, (first, last))
            if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or last < taken[k][0]):
                taken.insert(k, (first, last))
                yield self.labels[sequence], first, last, covered / size


def _zeros():
    while True:
        yield 0


@functools.lru_cache(maxsize=4)
def scanner(base: tuple, templates: tuple, anchor: int, coverage: float) -> Scanner:
    return Scanner(dict(base), dict(templates), anchor, coverage)


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, anchor: int = ANCHOR, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, ``phrases`` (array of (first, last, label): all places of base phrases) and ``spans``
    (array of (label, first, last, coverage): covered template passages) of every row. Words count from 0."""
    key = (tuple((base or BASE).items()), tuple((templates or TEMPLATES).items()), anchor, coverage)
    kind = docs.schema[id_col].dataType
    phrase_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))

    def run(batches):
        own = scanner(*key)
        for batch in batches:
            for keys, texts in text_chunks(batch, 0, 1, OUT_BYTES):
                rows = [own.scan(t) for t in texts]
                phrases = [[{"first": a, "last": a + own.sizes[k] - 1, "label": own.labels[k]} for a, k in found] for _, found, _ in rows]
                spans = [[dict(zip(("label", "first", "last", "coverage"), s)) for s in some] for _, _, some in rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array([r[0] for r in rows], pa.int64()), pa.array(phrases, phrase_type), pa.array(spans, span_type)], names=["id", "n_words", "phrases", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind.simpleString()}, n_words bigint, phrases array<struct<first:bigint,last:bigint,label:string>>, spans array<struct<label:string,first:bigint,last:bigint,coverage:double>>"
    return out.mapInArrow(run, schema).withColumnRenamed("id", id_col)
