"""Logistic regression over hashed features by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Weights; the last one is the bias.
SIZE = 1 << 18
#: Labelled rows that a model is fitted on, about: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000


class Ftrl:
    """Per-coordinate updates with L1 and L2 terms; a row is distinct features of one common value.

    The bias, last, has no L1 term. With `positive`, features can only speak for label 1, so texts
    without any that do get the bias alone, however short.
    """

    def __init__(self, size: int = SIZE, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, positive: bool = False):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0.0
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        if self.positive:
            w[:-1] = np.maximum(w[:-1], 0.0)
        return w

    def update(self, features: np.ndarray, value: float, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        x = np.full(len(at), value)
        x[-1] = 1.0
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: Column,
    make_features: Callable[[], Callable[[str], np.ndarray]],
    value: Callable[[int], float],
    rows: int = TRAIN_ROWS,
    epochs: int = 3,
    **rates,
) -> np.ndarray:
    """Weights, bias last. Rows with a null id, text or label, and held-out ones, are not learned from.

    An id that has several labels has the greatest of them.

    The sample has `rows` rows at most, about, whatever the input; so one task can go through it in a
    fixed order, and what comes to the driver is the weights.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col(label).cast("int").alias("label")).where("of IS NOT NULL AND label IS NOT NULL").groupBy("of").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, labels.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    chosen = docs.where(~held_out & drawn & F.col("text").isNotNull()).select("doc_id", "text")
    sample = chosen.join(known, F.col("doc_id") == F.col("of")).select("doc_id", "label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make_features()
        for part in slices(batches):
            found = [features(t).astype("<i4").tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    def learn(pdf):
        model = Ftrl(**rates)
        pdf = pdf.sort_values(["doc_id", "found"])
        order = np.random.default_rng(11)
        found, ys = [np.frombuffer(x, "<i4") for x in pdf["found"]], pdf["label"].tolist()
        for _ in range(epochs):
            for i in order.permutation(len(ys)):
                model.update(found[i], value(len(found[i])), ys[i])
        return type(pdf)({"weights": [model.weights().astype("<f4").tobytes()]})

    made = sample.mapInArrow(read, "doc_id long, label int, found binary").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "weights binary").first()
    return np.frombuffer(made.weights, "<f4") if made else np.zeros(SIZE + 1, np.float32)
