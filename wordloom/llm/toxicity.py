"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of each word, each pair of neighbours and each pair one or two words
apart, hashed to 2**20 coordinates. Every coordinate has its own learning rate; L1 keeps most weights at
exactly zero, so the model that is broadcast is a short list. The features of a bounded sample of labelled rows
(``max_rows``), each with its whole text, are made in many tasks and learned from in one; scoring takes every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_spans, mix, small_batches, text_chunks, words_of

BITS = 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Letters, digits and all bytes of other characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, pair and skip pair; repeats included."""
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets, IS_WORD)
    h = hash_spans(data, starts, ends)
    top = np.uint64(64 - BITS)
    at, coordinates = [rows], [h >> top]
    for gap in (1, 2, 3):
        same = rows[gap:] == rows[:-gap]
        pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))
        at.append(rows[gap:][same])
        coordinates.append(pair[same] >> top)
    return np.concatenate(at), np.concatenate(coordinates).astype(np.int64)


class Ftrl:
    """w_i = -(z_i - sign(z_i) l1) / ((beta + sqrt(n_i)) / alpha + l2) where |z_i| > l1, else 0."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float, positive: float) -> None:
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        out = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, out, 0.0)

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        bias = i == 1 << BITS
        if bias.any():  # the intercept is not penalised
            w[bias] = (-self.z[i] / ((self.beta + np.sqrt(self.n[i])) / self.alpha))[bias]
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= self.positive if label else 1.0
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(None))
        w[-1] = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        i = np.flatnonzero(w)
        return i, w[i]


def train(rows: list[tuple[np.ndarray, int]], epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0, positive: float = 5.0, least_rows: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights from (distinct coordinates, label) rows, in the order given in each epoch.

    Coordinates of fewer than ``least_rows`` rows are left out; a toxic row counts ``positive`` times.
    """
    model = Ftrl(alpha, beta, l1, l2, positive)
    bias = np.array([1 << BITS])
    in_rows = np.zeros(1 << BITS, np.int32)
    for i, _ in rows:
        in_rows[i] += 1
    rows = [(np.concatenate([i[in_rows[i] >= least_rows], bias]), y) for i, y in rows]
    for _ in range(epochs):
        for i, y in rows:
            model.learn(i, y)
    return model.result()


def text_features(texts: DataFrame) -> DataFrame:
    """(u, y, i): the distinct coordinates of each whole text as 32-bit numbers in bytes; at most 2**20 a text."""

    def run(batches):
        for b in batches:
            for first, offsets, data in text_chunks(b.column(0)):
                row, coordinate = features(data, offsets)
                key = np.unique((row << BITS) | coordinate)
                cuts = np.searchsorted(key >> BITS, np.arange(len(offsets)))
                found = [(key[cuts[i] : cuts[i + 1]] & ((1 << BITS) - 1)).astype("<i4").tobytes() for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(found)), b.column(2).slice(first, len(found)), pa.array(found, pa.binary())], names=["u", "y", "i"])

    return texts.select("text", "u", "y").mapInArrow(run, "u long, y int, i binary")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 10_000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (coordinate, weight) from labelled documents that ``learn`` admits; empty if there are none.

    A document with several labels counts as toxic if one says so; null labels are left out. If more than
    ``max_rows`` ids are labelled, those of lowest hash train. Texts train whole, however long. Of rows that
    repeat an id the one whose text sorts first trains; columns other than doc_id, text and toxic are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    y = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.where(learn).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11))
    n = max(1, y.count())
    y = y.where(F.col("u") < F.lit(float(1 << 53) * min(1.0, 1.5 * max_rows / n + 1e-9))).orderBy("u").limit(max_rows)
    chosen = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(y), "doc_id")
    chosen = chosen.groupBy("doc_id", "u", "y").agg(F.min("text").alias("text"))

    def one_task(batches):
        got = [(u, y, np.frombuffer(i, "<i4")) for b in batches for u, y, i in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda x: x[0])
        i, w = train([(c.astype(np.int64), y) for _, y, c in got]) if got else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64())], names=["i", "w"])

    pdf = text_features(chosen).repartition(1).mapInArrow(one_task, "i long, w double").toPandas()
    return pdf["i"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the intercept's probability; 0.5 without a model.

    Repeated rows are each scored; only the two columns named are read, so others may clash with anything.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        i, w = shared.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[i] = w
        bias = float(dense[-1])
        for b in batches:
            total = np.full(b.num_rows, bias)
            for first, offsets, data in text_chunks(b.column(1)):
                row, coordinate = features(data, offsets)
                used = np.flatnonzero(dense[coordinate])
                key = np.unique((row[used] << BITS) | coordinate[used])
                total[first : first + len(offsets) - 1] += np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
