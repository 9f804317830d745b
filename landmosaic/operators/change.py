"""Land-cover change: transitions, class areas and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import area_ha

CELL = ["row", "col"]


def pair(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells valid in both rasters: (row, col, source, target)."""
    return before.select(*CELL, F.col("value").alias("source")).join(after.select(*CELL, F.col("value").alias("target")), CELL)


def in_scheme(pairs: DataFrame, scheme: DataFrame, sides: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Rows whose codes are in the scheme on all sides."""
    codes = scheme.select(F.col("code").alias("scheme_code"))
    for side in sides:
        pairs = pairs.join(codes, F.col(side) == F.col("scheme_code"), "left_semi")
    return pairs


def transition_matrix(before: DataFrame, after: DataFrame, cell_m2: float, scheme: DataFrame | None = None) -> DataFrame:
    """(source, target, pixel_count, area_ha); with a scheme only its codes on both sides."""
    pairs = pair(before, after)
    if scheme is not None:
        pairs = in_scheme(pairs, scheme)
    return _matrix(pairs.groupBy("source", "target"), cell_m2)


def _matrix(groups, cell_m2: float) -> DataFrame:
    return groups.agg(F.count("*").alias("pixel_count")).withColumn("area_ha", area_ha("pixel_count", cell_m2))


def combine(rasters: dict[str, DataFrame], cell_m2: float) -> DataFrame:
    """Counts of each combination of any number of rasters' values."""
    names = list(rasters)
    joined = None
    for name in names:
        one = rasters[name].select(*CELL, F.col("value").alias(name))
        joined = one if joined is None else joined.join(one, CELL)
    return _matrix(joined.groupBy(*names), cell_m2)


def class_area(cells: DataFrame, cell_m2: float, scheme: DataFrame | None = None) -> DataFrame:
    """(value, pixel_count, area_m2, area_ha, area_km2, percent); classes of the scheme that are absent count 0."""
    counts = cells.groupBy("value").agg(F.count("*").alias("pixel_count"))
    if scheme is not None:
        counts = counts.join(scheme.select(F.col("code").alias("value")), "value", "right").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))
    every = Window.partitionBy()
    n = F.col("pixel_count")
    return counts.select("value", "pixel_count", (n * cell_m2).alias("area_m2"), area_ha(n, cell_m2).alias("area_ha"), (n * cell_m2 / 1e6).alias("area_km2"), (n * 100.0 / F.sum(n).over(every)).alias("percent"))


def tabulate_area(cells: DataFrame, zones: DataFrame, cell_m2: float) -> DataFrame:
    """(zone, value, pixel_count, area_ha) of cells that lie in a zone raster."""
    joined = cells.join(zones.select(*CELL, F.col("value").alias("zone")), CELL)
    return _matrix(joined.groupBy("zone", "value"), cell_m2)


def adjacent_periods(series: DataFrame) -> DataFrame:
    """(raster_id, year) of dated rasters to (source_id, target_id, year, next_year); one row a raster, so one small window."""
    order = Window.orderBy("year")
    return series.select("raster_id", "year", F.lead("raster_id").over(order).alias("target_id"), F.lead("year").over(order).alias("next_year")).where("target_id IS NOT NULL").withColumnRenamed("raster_id", "source_id")


def period_transitions(cells: DataFrame, series: DataFrame, cell_m2: float) -> DataFrame:
    """Transition matrices of all adjacent periods of a stack of rasters (raster_id, row, col, value)."""
    periods = adjacent_periods(series)
    source = cells.join(periods, cells.raster_id == F.col("source_id")).select("year", "next_year", "target_id", *CELL, F.col("value").alias("source"))
    target = cells.select(F.col("raster_id").alias("target_id"), *CELL, F.col("value").alias("target"))
    return _matrix(source.join(target, ["target_id", *CELL]).groupBy("year", "next_year", "source", "target"), cell_m2)


def class_change(matrix: DataFrame) -> DataFrame:
    """(class, gain, loss, net, swap) in cells from a transition matrix, which is small."""
    n = F.col("pixel_count")
    moved = F.when(F.col("source") != F.col("target"), n).otherwise(0)
    sides = matrix.select(F.col("source").alias("class"), F.lit(0).cast("long").alias("gain"), moved.alias("loss")).union(matrix.select(F.col("target").alias("class"), moved.alias("gain"), F.lit(0).cast("long").alias("loss")))
    sums = sides.groupBy("class").agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    return sums.select("class", "gain", "loss", (F.col("gain") - F.col("loss")).alias("net"), (2 * F.least("gain", "loss")).alias("swap"))


def markov(matrix: DataFrame) -> DataFrame:
    """(source, target, probability): rows of the matrix brought to sum 1."""
    return matrix.select("source", "target", (F.col("pixel_count") / F.sum("pixel_count").over(Window.partitionBy("source"))).alias("probability"))


def project_demand(areas: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(target, demand): class areas (value, area_ha) moved one period on."""
    return probabilities.join(areas.select(F.col("value").alias("source"), "area_ha"), "source").groupBy("target").agg(F.sum(F.col("area_ha") * F.col("probability")).alias("demand_ha"))


def demand_conserved(demand: DataFrame, valid_cells: int | DataFrame) -> DataFrame:
    """(scenario, demand_cells, valid_cells, conserved): whether each scenario's class demands use all valid cells."""
    sums = demand.groupBy("scenario").agg(F.sum("pixel_count").alias("demand_cells"))
    total = valid_cells if isinstance(valid_cells, DataFrame) else None
    out = sums.crossJoin(F.broadcast(total)) if total is not None else sums.withColumn("valid_cells", F.lit(valid_cells).cast("long"))
    return out.withColumn("conserved", F.col("demand_cells") == F.col("valid_cells"))


def reachable_demand(change: DataFrame, allowed: DataFrame) -> DataFrame:
    """Classes whose demand can't be met: growing without an allowed source or shrinking without an allowed target."""
    grow = change.where("net > 0").join(allowed.select(F.col("target").alias("class")).distinct(), "class", "left_anti").select("class", F.lit("no_allowed_source").alias("rule"))
    shrink = change.where("net < 0").join(allowed.select(F.col("source").alias("class")).distinct(), "class", "left_anti").select("class", F.lit("no_allowed_target").alias("rule"))
    return grow.union(shrink)
