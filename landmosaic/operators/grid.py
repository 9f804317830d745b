"""Grid operations as joins on cell and block keys; no distance predicate reaches the planner bare."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cell_col, cell_row
from . import tiles
from .change import CELL
from .distance import distance_to_source
from .nearest import inverse_distance, nearest_known
from .polygons import in_polygons
from .tiles import slope_aspect, smooth

__all__ = ["distance_to_source", "in_polygons", "inverse_distance", "nearest_known", "slope_aspect", "smooth"]


def sample(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th cell of every step-th row."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def rasterise_points(points: DataFrame, transform: list[float], width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Mean of the points (x, y, value) in each cell, and one row that counts those outside the grid."""
    placed = points.withColumn("row", cell_row("y", transform)).withColumn("col", cell_col("x", transform))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return placed.where(inside).groupBy(*CELL).agg(F.avg("value").alias("value")), placed.agg(F.count_if(~inside).alias("outside"))


def sample_at_points(points: DataFrame, cells: DataFrame, transform: list[float], name: str) -> DataFrame:
    """Points with the raster's value under them; null outside it or on NoData."""
    placed = points.withColumn("row", cell_row("y", transform)).withColumn("col", cell_col("x", transform))
    return placed.join(cells.select(*CELL, F.col("value").alias(name)), CELL, "left")


def majority(cells: DataFrame, factor: int) -> DataFrame:
    """The most frequent value of each factor x factor block; ties go to the lowest."""
    counts = cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), "value").agg(F.count("*").alias("n"))
    return most_frequent(counts)


def most_frequent(counts: DataFrame) -> DataFrame:
    """(row, col, value) of counts (row, col, value, n)."""
    return counts.groupBy(*CELL).agg((-F.max(F.struct("n", (-F.col("value")).alias("v")))["v"]).alias("value"))


def coarsen(cells: DataFrame, factor: int, how: str = "sum") -> DataFrame:
    """Sum or mean of each block; sums conserve the total."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    return cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(f("value").alias("value"))


def target_grid(cells_extent: tuple[float, float, float, float], cell: float, spark) -> DataFrame:
    """(row, col) of the grid of square cells that covers (left, bottom, right, top)."""
    left, bottom, right, top = cells_extent
    width, height = max(1, math.ceil((right - left) / cell)), max(1, math.ceil((top - bottom) / cell))
    return spark.range(height).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select("row", F.col("col").cast("long").alias("col"))


def regrid(cells: DataFrame, target: DataFrame, source_transform: list[float], target_transform: list[float], method: str, mask: DataFrame | None = None) -> DataFrame:
    """Values of target cells (row, col) at their centres: nearest, or bilinear or cubic from 4 or 16 neighbours.

    Neighbours that are NoData drop out and the rest are weighed anew; a target without any is NoData.
    With `majority` a target takes the most frequent value of the source cells whose centres lie in
    it, ties going to the lowest. The cell sizes may have any ratio. A mask keeps its cells only.
    """
    if mask is not None:
        target = target.join(mask.select(*CELL), CELL, "left_semi")
    sx, sy, tx, ty = source_transform[0], source_transform[4], target_transform[0], target_transform[4]
    fx = (F.lit(target_transform[2]) + (F.col("col") + 0.5) * tx - source_transform[2]) / sx
    fy = (F.lit(target_transform[5]) + (F.col("row") + 0.5) * ty - source_transform[5]) / sy
    source = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    if method == "majority":
        x, y = F.lit(source_transform[2]) + (F.col("col") + 0.5) * sx, F.lit(source_transform[5]) + (F.col("row") + 0.5) * sy
        placed = cells.select(cell_row(y, target_transform).alias("row"), cell_col(x, target_transform).alias("col"), "value")
        return most_frequent(placed.groupBy(*CELL, "value").agg(F.count("*").alias("n"))).join(target.select(*CELL), CELL, "left_semi")
    if method == "nearest":
        at = target.select("row", "col", F.floor(fy).alias("sr"), F.floor(fx).alias("sc"))
        return at.join(source, ["sr", "sc"]).select("row", "col", "value")
    return tiles.interpolated(source.withColumnsRenamed({"sr": "row", "sc": "col"}), target.select("row", "col", (fy - 0.5).alias("y"), (fx - 0.5).alias("x")), method)


def _near(missing: DataFrame, known: DataFrame, reach: int) -> DataFrame:
    """Pairs of a missing and a known cell at most `reach` cells apart on each axis, by blocks of that size."""
    block = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = known.select(F.col("row").alias("kr"), F.col("col").alias("kc"), F.col("value").alias("kv"), F.explode(around).alias("o"))
    spread = spread.select("kr", "kc", "kv", (F.floor(F.col("kr") / reach) + F.col("o.i")).alias("br"), (F.floor(F.col("kc") / reach) + F.col("o.j")).alias("bc"))
    dr, dc = F.col("row") - F.col("kr"), F.col("col") - F.col("kc")
    return missing.select(*CELL, block("row").alias("br"), block("col").alias("bc")).join(spread, ["br", "bc"]).withColumn("d2", dr * dr + dc * dc)


def nearest_fill(known: DataFrame, scope: DataFrame, cell: float, max_distance: float) -> DataFrame:
    """Cells of the scope with their own value, or that of the nearest known cell within the distance.

    Ties go to the first in row order; cells with none in reach stay out. One row is kept for each
    missing cell by partial minima, so pairs aren't shuffled.
    """
    reach = max(1, math.ceil(max_distance / cell))
    own = known.join(scope.select(*CELL), CELL, "left_semi").select(*CELL, "value")
    missing = scope.select(*CELL).join(known.select(*CELL), CELL, "left_anti")
    pairs = _near(missing, known, reach).where(F.sqrt("d2") * cell <= max_distance)
    filled = pairs.groupBy(*CELL).agg(F.min(F.struct("d2", "kr", "kc", "kv")).alias("m")).select(*CELL, F.col("m.kv").alias("value"))
    return own.union(filled)


def tile_starts(length: Column, patch: int, stride: int) -> Column:
    """Starts of overlapping tiles, the last one ending with the row."""
    last = F.greatest(length - patch, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride)), F.array(last.cast("int"))))


def tile_grid(grids: DataFrame, patch: int, stride: int) -> DataFrame:
    """(raster_id, tile_row, tile_col) of grids (raster_id, width, height)."""
    return grids.select("raster_id", F.col("width"), F.explode(tile_starts(F.col("height"), patch, stride)).alias("tile_row")).select("raster_id", "tile_row", F.explode(tile_starts(F.col("width"), patch, stride)).alias("tile_col"))


def centred_tiles(grids: DataFrame, patch: int, stride: int) -> DataFrame:
    """(raster_id, out_row, out_col, tile_row, tile_col) of grids (raster_id, width, height): a patch for each stride x stride block, the block in its middle.

    Patches reach (patch - stride) / 2 cells over the block on all sides, and over the raster's edge at
    its border; tile_row and tile_col are then below 0, in halves if the difference is odd.
    """
    starts = lambda length: F.when(F.col(length) > 0, F.sequence(F.lit(0), (F.col(length) - 1).cast("int"), F.lit(stride)))
    each = grids.select("raster_id", "width", F.explode(starts("height")).alias("r")).select("raster_id", "r", F.explode(starts("width")).alias("c"))
    over = (patch - stride) / 2
    return each.select("raster_id", (F.col("r") / stride).cast("int").alias("out_row"), (F.col("c") / stride).cast("int").alias("out_col"), (F.col("r") - over).alias("tile_row"), (F.col("c") - over).alias("tile_col"))


def centred_patches(cells: DataFrame, patch: int, stride: int, share: float = 0.5) -> DataFrame:
    """(raster_id, out_row, out_col, valid_cells, mean, accepted) of the patch in whose middle each block of a raster (raster_id, row, col, value) lies.

    Cells beyond the edge count as NoData. Each cell goes to the patches that hold it, (patch / stride)
    squared of them; sums are put together by task. The difference of patch and stride must be even.
    Only patches in whose reach some valid cell lies have a row.
    """
    if (patch - stride) % 2:
        raise ValueError("patch and stride must differ by an even number")
    over = (patch - stride) // 2
    blocks = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) + over - patch + 1) / stride)), F.floor((F.col(c) + over) / stride)))
    valid = cells.where("value IS NOT NULL")
    sums = valid.withColumn("out_row", blocks("row")).withColumn("out_col", blocks("col")).groupBy("raster_id", "out_row", "out_col").agg(F.count("*").alias("valid_cells"), F.avg("value").alias("mean"))
    return sums.withColumn("accepted", F.col("valid_cells") / (patch * patch) >= share)


def over_years(cells: DataFrame, how: str = "mean") -> DataFrame:
    """(row, col, year, value): several layers of a year (…, year, value) to one by mean or sum."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    return cells.groupBy(*CELL, "year").agg(f("value").alias("value"))
