"""Exact distances to the nearest source by lower envelopes of parabolas, first down columns, then along rows.

Columns are handled by strips of rows: of a strip the column needs its own sources, and of the strips
above and below only the last and the first one. Along a row each column with a source is a parabola
whose height is the square of the distance down the column; the lowest of all parabolas over each
stretch of the row is found in one pass. The work is linear in rows times columns, wherever sources lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .change import CELL

#: Rows of a strip; one task holds a strip over all columns.
STRIP = 16


def lower_envelope(cols: list[int], heights: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(column, height, first column at which it is lowest) of the parabolas that are lowest anywhere, columns rising.

    Whole numbers throughout, so no border is misplaced; where two are equal the left one stays.
    """
    c, h, start = [], [], []
    for x, g in zip(cols, heights, strict=True):
        f, first = g + x * x, None
        while c:
            # The first column at which the new one is lower than the last one kept.
            first = (f - h[-1] - c[-1] * c[-1]) // (2 * (x - c[-1])) + 1
            if first > start[-1]:
                break
            c.pop()
            h.pop()
            start.pop()
            first = None
        c.append(x)
        h.append(g)
        start.append(-(1 << 62) if first is None else first)
    return c, h, start


def _columns(sources: DataFrame, cells: DataFrame) -> DataFrame:
    """(strip, col, above, below, mask): for every strip of rows with cells and every column with a source, the nearest sources outside it and which of its rows are sources."""
    strip = F.floor(F.col("row") / STRIP)
    own = sources.groupBy(strip.alias("strip"), "col").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.expr(f"bit_or(shiftleft(1, CAST(pmod(row, {STRIP}) AS INT)))").alias("mask"))
    down = Window.partitionBy("col").orderBy("strip")
    linked = own.withColumns({"above": F.lag("last").over(down), "below": F.lead("first").over(down), "next": F.lead("strip").over(down)})
    range_of = cells.agg(F.floor(F.min("row") / STRIP).alias("low"), F.floor(F.max("row") / STRIP).alias("high"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    low, high, s = F.col("low"), F.col("high"), F.col("strip")
    entry = lambda at, above, below, mask: F.struct(at.alias("strip"), above.alias("above"), below.alias("below"), mask.alias("mask"))
    here = F.array(entry(s, F.col("above"), F.col("below"), F.col("mask")))
    after = F.transform(span(F.greatest(s + 1, low), F.least(F.coalesce(F.col("next") - 1, high), high)), lambda k: entry(k, F.col("last"), F.col("below"), F.lit(0)))
    none = F.lit(None).cast("long")
    before = F.when(F.col("above").isNull(), F.transform(span(low, F.least(s - 1, high)), lambda k: entry(k, none, F.col("first"), F.lit(0))))
    before = F.coalesce(before, F.slice(here, 1, 0))
    spread = linked.crossJoin(F.broadcast(range_of)).select("col", "low", "high", F.inline(F.concat(here, after, before)))
    return spread.where("strip BETWEEN low AND high").select("strip", "col", "above", "below", "mask")


def distance_to_source(cells: DataFrame, sources: DataFrame, cell: float, max_distance: float | None = None) -> DataFrame:
    """(row, col, distance) of every cell to the nearest source cell, 0 on a source; with a bound, of cells within it.

    Without sources there are no rows. Repeated cells have a row each, repeated sources do no harm. A
    task holds STRIP rows over all columns: a few numbers for each column with a source.
    """
    far = None if max_distance is None else int(max_distance / cell)

    def along_rows(key: tuple, targets: pa.Table, columns: pa.Table) -> pa.Table:
        top = key[0].as_py() * STRIP
        columns = columns.sort_by("col")
        col = columns.column("col").to_numpy()
        mask = columns.column("mask").to_numpy()
        far_off = 1 << 30
        above, below = (columns.column(c).combine_chunks() for c in ("above", "below"))
        none_above, none_below = (x.is_null().to_numpy(zero_copy_only=False) for x in (above, below))
        above, below = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (above, below))
        row, at = (targets.column(c).to_numpy() for c in CELL)
        d2 = np.full(len(row), -1, np.int64)
        for y in np.unique(row).tolist() if len(col) else []:
            g = np.minimum(np.where(none_above, far_off, y - above), np.where(none_below, far_off, below - y))
            for k in range(STRIP):
                g = np.minimum(g, np.where(mask >> k & 1, abs(y - top - k), far_off))
            near = g < far_off if far is None else g <= far
            c, h, start = (np.array(x, np.int64) for x in lower_envelope(col[near].tolist(), (g[near] * g[near]).tolist()))
            mine = np.flatnonzero(row == y)
            if len(c):
                k = np.searchsorted(start, at[mine], side="right") - 1
                d2[mine] = (at[mine] - c[k]) ** 2 + h[k]
        found = d2 >= 0
        return pa.table({"row": row[found], "col": at[found], "distance": np.sqrt(d2[found]) * cell})

    asked = cells.select(*CELL).withColumn("strip", F.floor(F.col("row") / STRIP))
    told = _columns(sources.select(*CELL), cells)
    out = asked.groupBy("strip").cogroup(told.groupBy("strip")).applyInArrow(along_rows, "row long, col long, distance double")
    return out if max_distance is None else out.where(F.col("distance") <= max_distance)
