"""Means and scatter matrices of classes of vectors, added up by task and then by class.

A task sends one row for each class that it meets, however many pixels there are: their number, the
sums' means and the sums of products about them, which can be put together with others' exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Parts of a class that are put together first, so that no task meets what all tasks sent.
PARTS = 32


class Moments:
    """Number, mean and scatter (sum of products about the mean) of vectors."""

    def __init__(self, n: int, mean: np.ndarray, scatter: np.ndarray):
        self.n, self.mean, self.scatter = n, mean, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def add(self, other: Moments) -> None:
        n = self.n + other.n
        d = other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n)
        self.mean, self.n = self.mean + d * (other.n / n), n


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the whole lists, those without a null, which must be of one length."""
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0)
    at = np.flatnonzero(whole)
    chosen = column.take(pa.array(at))
    flat = chosen.flatten()
    sizes = chosen.value_lengths().to_numpy(zero_copy_only=False)
    if len(at) and sizes.min() != sizes.max():
        raise ValueError("pixels have unlike numbers of bands")
    width = int(sizes[0]) if len(at) else 0
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), width)
    if flat.null_count:
        full = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape).all(axis=1)
        at, x = at[full], x[full]
    return at, x


def _rows(found: dict, part: int, of_label: pa.DataType) -> pa.RecordBatch:
    labels = pa.array(list(found), of_label)
    values = list(found.values())
    floats = lambda xs: pa.array([x.ravel() for x in xs], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([labels, pa.array([part] * len(values), pa.int32()), pa.array([v.n for v in values], pa.int64()), floats([v.mean for v in values]), floats([v.scatter for v in values])], ["label", "part", "n", "mean", "scatter"])


def moments(pixels: DataFrame, label: str = "label", bands: str = "bands") -> DataFrame:
    """(label, n, mean, scatter): one row for each class; scatter is the matrix row by row.

    Pixels with a missing band, and those without bands, don't count; pixels of unlike numbers of bands
    are an error. A null label is a class of its own.
    """
    chosen = pixels.select(F.col(label).alias("label"), F.col(bands).cast("array<double>").alias("bands"))
    kind = chosen.schema["label"].dataType
    of_label = to_arrow_type(kind)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict = {}
        for batch in batches:
            at, x = matrix(batch.column(1))
            coded = batch.column(0).take(pa.array(at)).dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                one = Moments.of(x[code == k])
                if name not in found:
                    found[name] = one
                elif len(found[name].mean) != len(one.mean):
                    raise ValueError("pixels have unlike numbers of bands")
                else:
                    found[name].add(one)
        if found:
            yield _rows(found, TaskContext.get().partitionId() % PARTS, of_label)

    def together(table: pa.Table) -> pa.Table:
        found: dict = {}
        for name, part, n, mean, scatter in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True):
            one = Moments(n, np.array(mean), np.array(scatter).reshape(len(mean), len(mean)))
            if name in found and len(found[name].mean) != len(one.mean):
                raise ValueError("pixels have unlike numbers of bands")
            found[name].add(one) if name in found else found.update({name: one})
        return pa.Table.from_batches([_rows(found, part, of_label)])

    schema = f"label {kind.simpleString()}, part int, n long, mean array<double>, scatter array<double>"
    sums = chosen.mapInArrow(add_up, schema)
    merged = sums.groupBy("label", "part").applyInArrow(together, schema).groupBy("label").applyInArrow(together, schema)
    return merged.select(F.col("label").alias(label), "n", "mean", "scatter")
