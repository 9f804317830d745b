"""Cells in polygons by scanlines: the rows that each edge crosses, crossings in order, columns between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import centre_x, centre_y
from .change import CELL


def _edges(polygons: DataFrame) -> DataFrame:
    """(feature_id, ax, ay, bx, by) of every edge of every ring; a ring that is open is closed."""
    rings = polygons.select("feature_id", F.explode("rings").alias("ring")).where(F.size("ring") > 1)
    ends = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    pairs = F.arrays_zip(F.col("ring").alias("a"), ends.alias("b"))
    each = rings.select("feature_id", F.explode(pairs).alias("e"))
    return each.select("feature_id", *[F.col(f"e.{p}")[k].alias(f"{p}{axis}") for p in "ab" for k, axis in enumerate("xy")]).where("ay <> by")


def _first_centre(at: Column, start: float, step: float) -> Column:
    """The number of the first cell whose centre may lie at or beyond `at`; one too early at most."""
    return (F.floor((at - start) / step - 0.5) - 1).cast("long")


def intervals(polygons: DataFrame, transform: list[float]) -> DataFrame:
    """(feature_id, row, x0, x1): stretches of each row of cells whose centres lie inside.

    A centre is inside if an odd number of edges lie right of it, so rings may be holes or further
    parts. An edge crosses a row if its ends lie on either side of the row's centre line; so an edge
    costs as many rows as it is high, and a ring of any size is no more than its edges.
    """
    edges = _edges(polygons)
    ends = (_first_centre(F.least("ay", "by"), transform[5], transform[4]), _first_centre(F.greatest("ay", "by"), transform[5], transform[4]))
    rows = edges.withColumn("row", F.explode(F.sequence(F.least(*ends), F.greatest(*ends) + 2)))
    y = centre_y("row", transform)
    crossed = rows.where((F.col("ay") > y) != (F.col("by") > y))
    at = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    sorted_rows = crossed.select("feature_id", "row", at.alias("x")).groupBy("feature_id", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda k: F.struct(F.get("xs", k - 1).alias("x0"), F.get("xs", k).alias("x1")))
    return sorted_rows.select("feature_id", "row", F.inline(pairs))


def in_polygons(cells: DataFrame, polygons: DataFrame, transform: list[float]) -> DataFrame:
    """(feature_id, row, col) of cells whose centre lies in a polygon (feature_id, rings: arrays of [x, y]).

    Cells meet the columns of the stretches by (row, col); no cell is tested against an edge.
    """
    found = intervals(polygons, transform)
    ends = (_first_centre(F.col("x0"), transform[2], transform[0]), _first_centre(F.col("x1"), transform[2], transform[0]))
    cols = found.withColumn("col", F.explode(F.sequence(F.least(*ends), F.greatest(*ends) + 2)))
    x = centre_x("col", transform)
    inside = cols.where((x >= F.col("x0")) & (x < F.col("x1"))).select("feature_id", *CELL)
    return inside.join(cells.select(*CELL), CELL, "left_semi").select("feature_id", *CELL)
