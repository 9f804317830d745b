"""Profiles of rasters: ranges, counts, and sets of distinct values that stop at a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Distinct values beyond which a raster counts as continuous.
MOST_DISTINCT = 4096
#: Parts of a raster that are put together first, so that no task meets what all tasks sent.
PARTS = 32
#: Values that wait before they are sorted into the sets.
_WAITING = 1 << 19
#: Rasters, and distinct values of them all, that a task holds at once; then it sends them on and begins anew.
_NAMES, _HELD = 50_000, 1 << 20
#: Values of a row on the way, so that batches of rows stay small.
_PIECE = 256
_STATS = "low double, high double, non_finite long, outside long, whole boolean, kinds array<double>"


class Sets:
    """What is known of each raster: its range, counts, and its least distinct values, one more than the bound at most."""

    def __init__(self, most: int):
        self.most, self.names = most, {}
        self.low, self.high = np.zeros(0), np.zeros(0)
        self.non_finite, self.outside = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)
        self.of, self.value = [np.zeros(0, np.int64)], [np.zeros(0)]
        self.waiting = 0

    def full(self, bounds: tuple[int, int]) -> bool:
        """Whether it holds more rasters or values than it may."""
        names, held = bounds
        if self.waiting + len(self.of[0]) > held:
            self.sort()
        return len(self.of[0]) > held // 2 or len(self.names) > names

    def places(self, names: list) -> np.ndarray:
        out = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
        more = len(self.names) - len(self.low)
        if not more:
            return out
        self.low, self.high = np.r_[self.low, np.full(more, np.inf)], np.r_[self.high, np.full(more, -np.inf)]
        self.non_finite, self.outside = (np.r_[x, np.zeros(more, np.int64)] for x in (self.non_finite, self.outside))
        self.whole = np.r_[self.whole, np.ones(more, bool)]
        return out

    def add_values(self, of: np.ndarray, value: np.ndarray) -> None:
        self.of.append(of)
        self.value.append(value)
        self.waiting += len(of)
        if self.waiting > _WAITING:
            self.sort()

    def sort(self) -> None:
        of, value = np.concatenate(self.of), np.concatenate(self.value)
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])][: len(of)]
        of, value = of[new], value[new]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        kept = nth <= self.most
        self.of, self.value, self.waiting = [of[kept]], [value[kept]], 0

    def add_cells(self, names: pa.Array, values: np.ndarray, codes: np.ndarray | None) -> None:
        coded = names.dictionary_encode(null_encoding="encode")
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        finite = np.isfinite(values)
        np.add.at(self.non_finite, at[~finite], 1)
        at, values = at[finite], values[finite]
        if codes is not None:
            np.add.at(self.outside, at[~np.isin(values, codes)], 1)
        np.minimum.at(self.low, at, values)
        np.maximum.at(self.high, at, values)
        self.whole[at[values != np.floor(values)]] = False
        self.add_values(at, values)

    def add_sets(self, batch: pa.RecordBatch) -> None:
        at = self.places(batch.column("raster_id").to_pylist())
        low, high, non_finite, outside, whole = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "non_finite", "outside", "whole"))
        np.minimum.at(self.low, at, low)
        np.maximum.at(self.high, at, high)
        np.add.at(self.non_finite, at, non_finite)
        np.add.at(self.outside, at, outside)
        self.whole[at[~whole]] = False
        kinds = batch.column("kinds")
        self.add_values(np.repeat(at, kinds.value_lengths().to_numpy(zero_copy_only=False)), kinds.flatten().to_numpy(zero_copy_only=False))

    def batch(self, part: int, of_name: pa.DataType, piece: int = 0) -> pa.RecordBatch:
        """A row for each raster; with `piece` more rows for those with more values, of which the first has the counts."""
        self.sort()
        ends = np.searchsorted(self.of[0], np.arange(len(self.names) + 1)).astype(np.int32)
        many = np.maximum(1, -(-np.diff(ends) // piece)) if piece else np.ones(len(self.names), np.int64)
        at = np.repeat(np.arange(len(self.names)), many)
        first = np.r_[True, at[1:] != at[:-1]][: len(at)]
        nth = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        bounds = np.r_[ends[at] + nth * piece, ends[-1:]].astype(np.int32)
        names = pa.array(list(self.names), of_name).take(pa.array(at))
        counts = [np.where(first, x[at], 0) for x in (self.non_finite, self.outside)]
        columns = [names, pa.array(np.full(len(at), part, np.int32)), *map(pa.array, (self.low[at], self.high[at], *counts, self.whole[at])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(self.value[0]))]
        return pa.RecordBatch.from_arrays(columns, ["raster_id", "part", "low", "high", "non_finite", "outside", "whole", "kinds"])

    def but_last(self) -> tuple[Sets, Sets]:
        """What is known of all rasters but the one met last, and of that one."""
        self.sort()
        last, cut = len(self.names) - 1, int(np.searchsorted(self.of[0], len(self.names) - 1))
        done, rest = Sets(self.most), Sets(self.most)
        for out, part, names, values in ((done, slice(None, last), list(self.names)[:last], slice(None, cut)), (rest, slice(last, None), list(self.names)[last:], slice(cut, None))):
            out.names = {x: k for k, x in enumerate(names)}
            out.low, out.high, out.non_finite, out.outside, out.whole = (x[part].copy() for x in (self.low, self.high, self.non_finite, self.outside, self.whole))
            out.of, out.value = [self.of[0][values] - (last if out is rest else 0)], [self.value[0][values].copy()]
        return done, rest


def in_parts(batches: Iterator[pa.RecordBatch], most: int, codes: np.ndarray | None, of_name: pa.DataType, bounds: tuple[int, int], piece: int, part: int = 0) -> Iterator[pa.RecordBatch]:
    """What is known of the rasters of (raster_id, value) rows, sent on whenever it is more than a task may hold."""
    sets = Sets(most)
    for batch in batches:
        sets.add_cells(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), codes)
        if sets.full(bounds):
            yield sets.batch(part, of_name, piece)
            sets = Sets(most)
    yield sets.batch(part, of_name, piece)


def together(batches: Iterator[pa.RecordBatch], most: int, of_name: pa.DataType, bounds: tuple[int, int], piece: int) -> Iterator[pa.RecordBatch]:
    """Rows of in_parts() sorted by raster put together: a raster is whole once the next one comes."""
    sets = Sets(most)
    for batch in batches:
        sets.add_sets(batch)
        if sets.full(bounds) and len(sets.names) > 1:
            done, sets = sets.but_last()
            yield done.batch(0, of_name, piece)
    yield sets.batch(0, of_name, piece)


def profile(cells: DataFrame, most_distinct: int = MOST_DISTINCT, values: bool = False, codes: list[float] | None = None) -> DataFrame:
    """(raster_id, low, high, non_finite, distinct, integer): the distinct count is null above `most_distinct`.

    With `values` also the distinct values in order, where there are not too many; with `codes` also
    `outside`, how many finite values are none of them, however many kinds there are. A task sends a
    raster's least distinct values, one more than `most_distinct` at most, so a continuous raster costs
    no more than one of that many classes. A task holds a bounded number of rasters and values, however
    many there are: it sends what it holds and begins anew, and parts are put together in order of rasters.
    Null values are NoData; a raster of these alone has no row.
    """
    chosen = cells.where("value IS NOT NULL").select("raster_id", F.col("value").cast("double").alias("value"))
    kind = chosen.schema["raster_id"].dataType
    of_name = to_arrow_type(kind)
    known = None if codes is None else np.array(codes, float)
    schema = f"raster_id {kind.simpleString()}, part int, {_STATS}"

    bounds, piece = (_NAMES, _HELD), _PIECE

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_parts(batches, most_distinct, known, of_name, bounds, piece, TaskContext.get().partitionId() % PARTS)

    def some_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return together(batches, most_distinct, of_name, bounds, piece)

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return together(batches, most_distinct, of_name, bounds, 0)

    by_part = chosen.mapInArrow(first, schema).repartition("raster_id", "part").sortWithinPartitions("raster_id").mapInArrow(some_parts, schema)
    merged = by_part.repartition("raster_id").sortWithinPartitions("raster_id").mapInArrow(all_parts, schema)
    many = F.size("kinds")
    some = many > 0
    told = {
        "low": F.when(some, F.col("low")), "high": F.when(some, F.col("high")), "non_finite": F.col("non_finite"),
        "distinct": F.when(many <= most_distinct, many.cast("long")), "integer": F.when(some, F.col("whole")),
    }
    if values:
        told["values"] = F.when(some & (many <= most_distinct), F.col("kinds"))
    if codes is not None:
        told["outside"] = F.col("outside")
    return merged.select("raster_id", *[c.alias(n) for n, c in told.items()])
