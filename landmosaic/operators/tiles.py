"""Whole-array work on square tiles of a raster, each with a margin of its neighbours' cells.

A cell goes to its own tile and, if it lies at an edge, once more to each tile that sees it in its
margin. With tiles of 256 cells and a margin of one that is 1.6 % more cells than the raster has,
moved once; what a cell needs of its surroundings is then in one array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .change import CELL

SIZE = 256
TILE = ["tile_row", "tile_col"]


def with_margin(cells: DataFrame, before: int, after: int, size: int = SIZE) -> DataFrame:
    """Adds tile_row and tile_col: a row for each tile whose own cells, `before` ones above and left of them or `after` ones below and right hold the cell."""
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - after) / size), F.floor((F.col(c) + before) / size)))
    return cells.withColumn("tile_row", tiles("row")).withColumn("tile_col", tiles("col"))


class Tile:
    """One tile as arrays: `values` and which of them are `valid`, with the margin around; NoData is 0 and not valid."""

    def __init__(self, key: tuple, cells: pa.Table, before: int, after: int, size: int = SIZE):
        self.row, self.col = (k.as_py() * size - before for k in key)
        self.before, self.after = before, after
        side = size + before + after
        value = cells.column("value").combine_chunks()
        at = (cells.column("row").to_numpy() - self.row, cells.column("col").to_numpy() - self.col)
        self.valid = np.zeros((side, side), bool)
        self.valid[at] = value.is_valid().to_numpy(zero_copy_only=False)
        filled = value.fill_null(0).to_numpy(zero_copy_only=False)
        self.values = np.zeros((side, side), filled.dtype)
        self.values[at] = filled

    def beside(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and validity of the cells i below and j right of the tile's own cells."""
        own = lambda k: slice(self.before + k, self.values.shape[0] - self.after + k)
        return self.values[own(i), own(j)], self.valid[own(i), own(j)]

    def rows_of(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers of the tile's own cells that are marked."""
        r, c = np.nonzero(where)
        return r + self.row + self.before, c + self.col + self.before


def over_tiles(cells: DataFrame, work: Callable[[Tile], dict[str, np.ndarray]], schema: str, margin: int = 1, size: int = SIZE) -> DataFrame:
    """What `work` makes of each tile of cells (row, col, value) with `margin` cells around it, as columns of the schema."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table(work(Tile(key, table, margin, margin, size)))

    return with_margin(cells.select(*CELL, "value"), margin, margin, size).groupBy(*TILE).applyInArrow(run, schema)


def slope_aspect(dem: DataFrame, cell: float, size: int = SIZE) -> DataFrame:
    """(row, col, slope, aspect) in degrees by Horn's 3 x 3 gradient; flat cells have aspect -1, cells with NoData beside them have no row."""

    def work(tile: Tile) -> dict[str, np.ndarray]:
        around = {(i, j): tile.beside(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        whole = np.logical_and.reduce([valid for _, valid in around.values()])
        v = {k: x[whole] for k, (x, _) in around.items()}
        dx = (v[-1, 1] + 2 * v[0, 1] + v[1, 1] - v[-1, -1] - 2 * v[0, -1] - v[1, -1]) / (8.0 * cell)
        dy = (v[1, -1] + 2 * v[1, 0] + v[1, 1] - v[-1, -1] - 2 * v[-1, 0] - v[-1, 1]) / (8.0 * cell)
        turn = np.degrees(np.arctan2(dy, -dx))
        compass = np.where(turn > 90, 450.0 - turn, 90.0 - turn)
        row, col = tile.rows_of(whole)
        return {"row": row, "col": col, "slope": np.degrees(np.arctan(np.hypot(dx, dy))), "aspect": np.where((dx == 0) & (dy == 0), -1.0, compass)}

    return over_tiles(dem.withColumn("value", F.col("value").cast("double")), work, "row long, col long, slope double, aspect double", size=size)


def smooth(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """The majority of each valid cell's 3 x 3 neighbourhood; ties go to the lowest class."""

    def work(tile: Tile) -> dict[str, np.ndarray]:
        around = [tile.beside(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        centre = around[4]
        best, most = centre[0].copy(), np.zeros(centre[0].shape, np.int8)
        for x, valid in around:
            n = sum((((y == x) & ok).astype(np.int8) for y, ok in around), np.zeros(x.shape, np.int8))
            better = valid & ((n > most) | ((n == most) & (x < best)))
            best[better], most[better] = x[better], n[better]
        row, col = tile.rows_of(centre[1])
        return {"row": row, "col": col, "value": best[centre[1]]}

    return over_tiles(cells, work, f"row long, col long, value {cells.schema['value'].dataType.simpleString()}", size=size)


def _bilinear(t: np.ndarray) -> list[np.ndarray]:
    return [1 - t, t]


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Catmull-Rom weights of the four neighbours, by the part t of the way between the middle two."""
    return [-0.5 * t + t * t - 0.5 * t**3, 1.0 - 2.5 * t * t + 1.5 * t**3, 0.5 * t + 2.0 * t * t - 1.5 * t**3, -0.5 * t * t + 0.5 * t**3]


#: Weights by method, and how far before and after the base cell they reach.
KERNELS = {"bilinear": (_bilinear, 0, 1), "cubic": (_cubic, 1, 2)}


def interpolated(cells: DataFrame, places: DataFrame, method: str, size: int = SIZE) -> DataFrame:
    """(row, col, value) of places (row, col, y, x), which lie at y and x in units of the raster's cells, counted from its first cell's centre.

    Neighbours that are NoData drop out and the rest are weighed anew; a place without any has no row.
    A place moves once, to the tile of the cell before it, and cells move as with_margin() says.
    """
    weights, before, after = KERNELS[method]
    base = lambda c: F.floor(F.floor(c) / size)
    asked = places.select("row", "col", "y", "x", base("y").alias("tile_row"), base("x").alias("tile_col"))
    source = with_margin(cells.select(*CELL, F.col("value").cast("double").alias("value")), before, after, size)

    def work(key: tuple, places: pa.Table, table: pa.Table) -> pa.Table:
        tile = Tile(key, table, before, after, size)
        y, x = (places.column(c).to_numpy() for c in ("y", "x"))
        r, c = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        total, w = np.zeros(len(y)), np.zeros(len(y))
        for i, a in zip(range(-before, after + 1), weights(y - r), strict=True):
            for j, b in zip(range(-before, after + 1), weights(x - c), strict=True):
                at = (r + i - tile.row, c + j - tile.col)
                part = np.where(tile.valid[at], a * b, 0.0)
                total += part * tile.values[at]
                w += part
        some = np.abs(w) > 1e-9
        return pa.table({"row": places.column("row").filter(pa.array(some)), "col": places.column("col").filter(pa.array(some)), "value": total[some] / w[some]})

    return asked.groupBy(*TILE).cogroup(source.groupBy(*TILE)).applyInArrow(work, "row long, col long, value double")
