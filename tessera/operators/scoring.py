"""A segment's scores as products of matrices: queries by terms, terms by rows; small numpy helpers of ``retrieve`` and ``gating``.

Spark deals the postings by segment and sorts them; a task goes through its segments one by one, so that no table of all
(query, row) pairs is held, sorted or shuffled. The queries come in batches of bounded size, of which each task has a copy;
a segment meets one batch after another, so that its postings are made and read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 2**63 - 1
#: Whole numbers below it are exact as doubles.
EXACT = 2**53
#: Scores, and products of single terms, that are held at once.
CELLS, PAIRS = 1 << 20, 1 << 21


class Batch:
    """The terms of some queries: ``at`` of each is its query's place among ``ids``, ``code`` its term's among ``words``."""

    def __init__(self, terms: pa.Table) -> None:
        terms = terms.combine_chunks().sort_by("query_id")
        ids, words = (pc.unique(terms[c].combine_chunks()) for c in ("query_id", "term"))
        self.ids, self.words = ids, words
        self.at, self.code = (pc.index_in(terms[c], value_set=v).to_numpy().astype(np.int64) for c, v in (("query_id", ids), ("term", words)))
        self.qtf = terms["qtf"].to_numpy().astype(np.int64)
        self.starts = np.searchsorted(self.at, np.arange(len(ids) + 1))
        self.most = int(np.add.reduceat(self.qtf.astype(object), self.starts[:-1]).max()) if len(ids) else 0

    def blocks(self, df: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
        """Ranges of queries whose scores and products are at most CELLS and PAIRS, one query at least."""
        cost = np.concatenate([[0], np.cumsum(df[self.code])])[self.starts]
        a = 0
        while a < len(self.ids):
            b = min(int(np.searchsorted(cost, cost[a] + PAIRS, "right")) - 1, a + CELLS // max(rows, 1))
            b = min(max(b, a + 1), len(self.ids))
            yield a, b
            a = b


def segments_of(batches: Iterator[pa.RecordBatch], key: str = "segment_id") -> Iterator[pa.Table]:
    """The rows of each segment, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if held and held[0].column(key)[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def products(q: Batch, a: int, b: int, ptr: np.ndarray, place: np.ndarray, worth: np.ndarray, heavy: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """Scores of queries a .. b by row: terms that many rows have as one product of matrices, others one by one."""
    mine = slice(q.starts[a], q.starts[b])
    at, code, qtf = q.at[mine] - a, q.code[mine], q.qtf[mine]
    thick = heavy[code] >= 0
    left = np.zeros((b - a, len(dense)))
    np.add.at(left, (at[thick], heavy[code[thick]]), qtf[thick])
    out = left @ dense
    at, code, qtf = at[~thick], code[~thick], qtf[~thick]
    many = ptr[code + 1] - ptr[code]
    each = np.arange(many.sum()) + np.repeat(ptr[code] - np.cumsum(many) + many, many)
    out += np.bincount(np.repeat(at, many) * rows + place[each], np.repeat(qtf, many) * worth[each], (b - a) * rows).reshape(b - a, rows)
    return out


def saturated(q: Batch, a: int, b: int, ptr: np.ndarray, place: np.ndarray, worth: np.ndarray, rows: int) -> np.ndarray:
    """The same where numbers may exceed a long: they stop at the largest."""
    out = np.zeros((b - a, rows), dtype=object)
    for e in range(q.starts[a], q.starts[b]):
        for p in range(ptr[q.code[e]], ptr[q.code[e] + 1]):
            cell = q.at[e] - a, place[p]
            out[cell] = min(LONGEST, out[cell] + min(LONGEST, int(worth[p]) * int(q.qtf[e])))
    return out.astype(np.int64)


def first_of(scores: np.ndarray, least: np.ndarray, k: int, ties: bool) -> np.ndarray:
    """Which scores can be among the best k of their query: those of at least ``least``, without ties the first of these."""
    kept = scores >= np.maximum(least, 1)[:, None]
    if not ties and scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, even = scores > edge, (scores == edge) & kept
        kept &= above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return kept


def row_places(row: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of a segment's postings, in order, as row and document, and of each posting its row's place there."""
    order = np.lexsort((doc, row))
    row, doc = row[order], doc[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])])
    place = np.empty(len(row), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return row[new], doc[new], place


def scored(batches: Iterator[pa.RecordBatch], asked: list[Callable[[], Batch]], schema: pa.Schema, k: int | None, ties: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, segment_id, row_ix, doc_id, score) of postings (segment_id, row_ix, doc_id, term, tf, row_count) sorted by
    segment; with ``k`` without rows that k rows of the task's segments so far are above."""
    best = [np.zeros((len(q().ids), k), dtype=np.int64) if k else None for q in asked]
    for t in segments_of(batches):
        t = t.combine_chunks()
        tf = t["tf"].to_numpy()
        row, doc, place = row_places(t["row_ix"].to_numpy(), t["doc_id"].to_numpy())
        terms = pc.dictionary_encode(t["term"].combine_chunks())
        number = terms.indices.to_numpy()
        for i, each in enumerate(asked):
            q = each()
            code = pc.fill_null(pc.index_in(terms.dictionary, value_set=q.words), -1).to_numpy()[number]
            for at, of, worth in _segment_scores(q, code, place, tf, t["row_count"][0].as_py(), len(row), best[i], ties):
                columns = [q.ids.take(pa.array(at)), pa.array(np.full(len(at), t["segment_id"][0].as_py())), pa.array(row[of]), pa.array(doc[of]), pa.array(worth)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _segment_scores(q: Batch, code: np.ndarray, place: np.ndarray, tf: np.ndarray, row_count: int, rows: int, best: np.ndarray | None, ties: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of a batch in a segment, as places; ``best`` holds each query's best scores so far and is brought up to date."""
    order = np.argsort(code, kind="stable")[np.count_nonzero(code < 0):]
    code, place, tf = code[order], place[order], tf[order]
    df = np.bincount(code, minlength=len(q.words))
    ptr = np.concatenate([[0], np.cumsum(df)])
    idf = (row_count + 1) * 256 // (df + 1)
    exact = int(tf.max(initial=0)) * int(idf.max(initial=0)) * q.most < EXACT
    worth = tf * idf[code] if exact else np.minimum(tf.astype(object) * idf[code], LONGEST)
    heavy, common = np.full(len(df), -1), np.flatnonzero(df * 8 > rows)
    heavy[common] = np.arange(len(common))
    dense = np.zeros((len(common), rows))
    if exact:
        thick = heavy[code] >= 0
        np.add.at(dense, (heavy[code[thick]], place[thick]), worth[thick])
    for a, b in q.blocks(df, rows):
        s = products(q, a, b, ptr, place, worth, heavy, dense, rows) if exact else saturated(q, a, b, ptr, place, worth, rows)
        some = np.arange(b - a)
        if best is not None:
            # most queries have no row here that comes up to their list
            some = np.flatnonzero(s.max(axis=1) >= np.maximum(best[a:b].min(axis=1), 1))
        if not len(some):
            continue
        s = (s if len(some) == b - a else s[some]).astype(np.int64)
        some += a
        if best is None:
            kept = s > 0
        else:
            k = best.shape[1]
            top = np.partition(s, rows - k, axis=1)[:, -k:] if rows > k else s
            both = np.concatenate([best[some], top], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kept = first_of(s, best[some].min(axis=1), k, ties)
        at, of = np.nonzero(kept)
        if len(at):
            yield some[at], of, s[at, of]


class Probes:
    """Query terms in the order in which they are probed: the bits of each term, and each query's terms as ``codes``."""

    def __init__(self, terms: pa.Table) -> None:
        terms = terms.combine_chunks().sort_by([("query_id", "ascending"), ("place", "ascending")])
        self.ids, words = pc.unique(terms["query_id"].combine_chunks()), pc.unique(terms["term"].combine_chunks())
        at, code = (pc.index_in(terms[c], value_set=v).to_numpy() for c, v in (("query_id", self.ids), ("term", words)))
        bits = terms["bits"].to_pylist()
        seen = np.unique(code, return_index=True)[1]
        wide = max((len(bits[i]) for i in seen), default=1)
        self.bits = np.array([bits[i] + bits[i][:1] * (wide - len(bits[i])) for i in seen], dtype=np.int64).reshape(len(words), wide)
        self.n_terms = np.bincount(at, minlength=len(self.ids))
        self.codes = np.full((len(self.ids), int(self.n_terms.max(initial=1))), -1, dtype=np.int64)
        self.codes[at, terms["place"].to_numpy() - 1] = code


def probed(batches: Iterator[pa.RecordBatch], q: Probes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(query_id, segment_id, n_terms, first, run) of bitmaps (segment_id, bitmap) for the queries that have any term there."""
    for batch in batches:
        for segment, bitmap in zip(batch.column("segment_id").to_pylist(), batch.column("bitmap")):
            on = np.unpackbits(np.frombuffer(bitmap.as_buffer(), dtype=np.uint8), bitorder="little")
            # the last word is no term: places that a query does not have
            held = np.append(on[q.bits].all(axis=1), False)[q.codes]
            some = np.flatnonzero(held.any(axis=1))
            if len(some):
                held = held[some]
                run = np.where(held.all(axis=1), held.shape[1], (~held).argmax(axis=1))
                columns = [q.ids.take(pa.array(some)), pa.array(np.full(len(some), segment)), pa.array(q.n_terms[some]), pa.array(held.argmax(axis=1) + 1), pa.array(run)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
