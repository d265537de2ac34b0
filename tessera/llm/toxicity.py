"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the UTF-8 n-grams (4, 6 and 8 bytes) of the lower-cased text that occur in it, hashed to
``BUCKETS``. On a bounded sample of labelled rows (at most ``per_class`` of each label, taken by the
least hash of their ids) document counts by label give each n-gram's log-count ratio r; the
``features`` n-grams with the largest chi-square stay; a logistic regression with an L2 penalty is
fitted to the vectors r * presence, both labels weighing the same. Scoring reads every whole text; only the sample bounds and the table of ``features`` weights
have a fixed size, and the weights are all that is sent to the executors.

Defined cases: a null text counts as empty and gets the score of the intercept; ids labelled more
than once count as toxic if any label says so; rows without a label or with a null label are not
learnt from; with no labelled rows of one kind every score is that of the known odds (0 without any
label); of rows that share a labelled id, one text (that of the least hash) is learnt from; very long
texts are scored whole, piece by piece; an empty table gives an empty result; repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_chunks, utf8

SIZES = (4, 6, 8)
BUCKETS = 1 << 22
PIECE = 1 << 20
#: Present features that one step of the fit looks at together.
BLOCK = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def pieces(text: str | None):
    """Lower-cased UTF-8 of a text with spaces at both ends, in overlapping pieces of bounded size."""
    data = np.frombuffer(b" " + utf8((text or "").lower()).translate(SPACES) + b" ", np.uint8)
    for at in range(0, max(1, len(data) - SIZES[0] + 1), PIECE):
        yield data[at : at + PIECE + SIZES[-1] - 1], at + PIECE + SIZES[-1] - 1 >= len(data)


def hashed(piece: np.ndarray, last: bool) -> np.ndarray:
    """Buckets of all n-grams that begin in a piece."""
    rolling = np.zeros(len(piece), np.uint64)
    out = []
    for n in range(1, SIZES[-1] + 1):
        if n > len(piece):
            break
        rolling = rolling[: len(piece) - n + 1] << np.uint64(8) | piece[n - 1 :]
        if n in SIZES:
            out.append(((rolling + np.uint64(n)) * MULTIPLIER >> np.uint64(42)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def present(text: str | None, slots: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, or distinct slots (those >= 0) of its buckets."""
    found = []
    for piece, last in pieces(text):
        h = hashed(piece, last)
        if slots is not None:
            h = slots[h]
            h = h[h >= 0]
        found.append(np.unique(h))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def counted(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): the sample's documents of each label that hold an n-gram."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for y, text in zip(labels, batch.column(1)):
                counts[y][present(text.as_py())] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[1][at], pa.int64()), pa.array(counts[0][at], pa.int64())], names=["bucket", "toxic", "clean"])

    parts = sample.select("toxic", "text").mapInArrow(run, "bucket int, toxic bigint, clean bigint")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Presence:
    """Which features each row holds, looked at a block of rows at a time: what a step needs besides is bounded by
    ``BLOCK`` of them (or one row's), however many the sample has."""

    def __init__(self, column: np.ndarray, counts: np.ndarray, r: np.ndarray) -> None:
        self.column, self.r, self.ends = column, r, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.cuts = [0]
        while self.cuts[-1] < len(counts):
            at = int(np.searchsorted(self.ends, self.ends[self.cuts[-1]] + BLOCK, "right")) - 1
            self.cuts.append(max(at, self.cuts[-1] + 1))

    def blocks(self):
        for first, last in zip(self.cuts, self.cuts[1:]):
            yield slice(first, last), self.column[self.ends[first] : self.ends[last]], self.ends[first : last + 1] - self.ends[first]

    def forth(self, v: np.ndarray) -> np.ndarray:
        """X v."""
        weights, out = self.r * v, np.empty(len(self.ends) - 1)
        for rows, column, ends in self.blocks():
            sums = np.concatenate([[0.0], np.cumsum(weights[column])])
            out[rows] = sums[ends[1:]] - sums[ends[:-1]]
        return out

    def back(self, u: np.ndarray) -> np.ndarray:
        """X' u."""
        out = np.zeros(len(self.r))
        for rows, column, ends in self.blocks():
            out += np.bincount(column, np.repeat(u[rows], np.diff(ends)), len(out))
        return out * self.r


def fitted(column: np.ndarray, counts: np.ndarray, y: np.ndarray, r: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on r * presence (Nesterov steps).

    ``column`` has the present features of all rows, ``counts`` how many are each row's. Both labels
    weigh the same in total, so 0.5 is the balanced decision.
    """
    n, d, x = len(y), len(r), Presence(column, counts, r)
    weight = np.where(y > 0, n / (2 * max(1.0, y.sum())), n / (2 * max(1.0, (1 - y).sum())))
    power = np.ones(d) / np.sqrt(d)
    top = 1.0
    for _ in range(15):  # largest eigenvalue of X'X
        power = x.back(x.forth(power))
        top = float(np.linalg.norm(power)) or 1.0
        power /= top
    rate = 1 / (0.25 * float(weight.max()) * (top + n) / n + penalty)
    w = v = np.zeros(d)
    b = c = 0.0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.forth(v) + c, -40, 40)))
        off = weight * (p - y)
        w_new = v - rate * (x.back(off) / n + penalty * v)
        b_new = c - rate * float(off.mean())
        m = k / (k + 3)
        v, c = w_new + m * (w_new - w), b_new + m * (b_new - b)
        w, b = w_new, b_new
    return w, b


class Model:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.buckets, self.weights, self.intercept = buckets, weights, intercept
        self._slots: np.ndarray | None = None

    def __getstate__(self):
        return self.buckets, self.weights, self.intercept

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.full(BUCKETS, -1, np.int16)
            self._slots[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return self._slots

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[present(text, self.slots())].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40.0, 40.0))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 16000, penalty: float = 1e-4, steps: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``per_class`` labelled rows of each label (all rows of ``labels`` may be learnt from)."""
    if not 0 < features < 1 << 15:
        raise ValueError("features must be 1 .. 32767")
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col) != 0).cast("int").alias("toxic"))
    odds = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0, np.int64)
    if not odds.get(1) or not odds.get(0):
        return Model(none, np.zeros(0), 40.0 if odds.get(1) else -40.0)
    order = F.xxhash64("id")
    chosen = each.where("toxic = 1").orderBy(order, "id").limit(per_class).unionByName(each.where("toxic = 0").orderBy(order, "id").limit(per_class))
    # at most 2 * per_class ids are sent
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # of rows with one id, the text of the least hash
    sample = sample.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("least")).select("toxic", "least.text").repartition(12)
    sample = sample.persist()
    try:
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = size.get(1, 0), size.get(0, 0)
        if not n1 or not n0:
            return Model(none, np.zeros(0), float(np.log(odds[1] / odds[0])))
        a, b = F.col("toxic"), F.col("clean")
        chi = (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n1 + n0 - a - b) + 1.0)
        best = counted(sample).where(a + b >= 3).orderBy(chi.desc(), "bucket").limit(features).toPandas()
        p, q = best["toxic"].to_numpy() + 1.0, best["clean"].to_numpy() + 1.0
        r = np.log(p / (n1 + 2.0)) - np.log(q / (n0 + 2.0))
        model = Model(best["bucket"].to_numpy(np.int64), np.zeros(len(best)), 0.0)

        def run(batches):
            for batch in batches:
                kept = [present(t.as_py(), model.slots()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int16()))], names=["toxic", "slots"])

        rows = sample.mapInArrow(run, "toxic int, slots array<smallint>").toArrow().combine_chunks()
        y = rows.column("toxic").to_numpy().astype(float)
        slots = rows.column("slots").combine_chunks()
        column, counts = slots.flatten().to_numpy(), np.diff(slots.offsets.to_numpy())
    finally:
        sample.unpersist()
    w, intercept = fitted(column, counts, y, r, penalty, steps)
    out = Model(model.buckets, w * r, intercept)
    del rows, slots, column, counts, model
    give_back()
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for keys, texts in text_chunks(batch, 0, 1, 8 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array([model.score(t) for t in texts], pa.float64())], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, f"id {kind.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores under ``threshold``."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(t))

    return docs.where(scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)
