"""Quality of texts by a hashed word n-gram logistic regression."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .ftrl import SIZE, fit, sigmoid

WORD = re.compile(r"\w+|[^\w\s]+")
ACCEPT = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - SIZE.bit_length() + 1)


def features(text: str) -> np.ndarray:
    """Distinct hashed words and pairs of neighbouring words; a word is a run of letters and digits, or one of signs."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words)) + np.uint64(1)
    two = one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:]
    return np.unique(np.concatenate([one, two]) * _MIX >> _SHIFT).astype(np.int64)


def value(n: int) -> float:
    return n**-0.5 if n else 0.0


def score(weights: np.ndarray, text: str) -> float:
    found = features(text)
    return sigmoid(float(weights[found].sum(dtype=np.float64)) * value(len(found)) + float(weights[-1]))


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> np.ndarray:
    return fit(docs, labels, "quality", held_out, lambda: features, value, alpha=1.0, l1=0.02, l2=0.01)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text, …).

    The model is fitted on a bounded sample of labelled rows that are not held out; only texts go
    into a score. Null and empty texts get the score of no features; repeated rows a row each; an
    empty table gives no rows, and without labels every score is a half. Other columns are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = [score(weights.value, t or "") for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= ACCEPT) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
