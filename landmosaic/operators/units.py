"""From raster cells to scenario and unit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import area_ha, finite, unit_id

#: How a service's cells become one number: depth in mm becomes m³.
AGGREGATIONS = ("sum", "mean", "depth_mm_to_m3")


def valid(cells: DataFrame) -> DataFrame:
    """Cells that hold a finite number."""
    return cells.where(finite("value"))


def scenario_totals(cells: DataFrame, aggregations: dict[str, str], cell_m2: float) -> DataFrame:
    """(scenario, field, valid_cells, total) of cells (scenario, field, row, col, value).

    The job fails for a scenario and field without a valid cell, which are never 0.
    """
    unknown = set(aggregations.values()) - set(AGGREGATIONS)
    if unknown:
        raise ValueError(f"unknown aggregations: {', '.join(sorted(unknown))}")
    how = F.create_map(*[F.lit(x) for pair in sorted(aggregations.items()) for x in pair])
    marked = cells.withColumn("value", F.when(finite("value"), F.col("value")))
    sums = marked.groupBy("scenario", "field").agg(F.count("value").alias("valid_cells"), F.sum("value").alias("s"), F.avg("value").alias("m"))
    kind = F.coalesce(F.try_element_at(how, F.col("field")), F.lit("sum"))
    total = F.when(kind == "mean", F.col("m")).when(kind == "depth_mm_to_m3", F.col("s") * cell_m2 / 1000.0).otherwise(F.col("s"))
    return sums.select("scenario", "field", "valid_cells", F.when(F.col("valid_cells") > 0, total).otherwise(F.raise_error(F.concat(F.lit("no valid pixels: "), "scenario", F.lit(" "), "field")).cast("double")).alias("total"))


def unit_totals(cells: DataFrame, fields: list[str], size: int) -> DataFrame:
    """(scenario, unit_id, a column for each field): sums over size x size cells; units that lack a field go."""
    sums = valid(cells).groupBy("scenario", unit_id("row", "col", size).alias("unit_id")).pivot("field", fields).agg(F.sum("value"))
    return sums.dropna(subset=fields)


def supplement(units: DataFrame, extra: DataFrame, fields: list[str]) -> DataFrame:
    """Units with the attributes of another table by scenario and unit; where both have one, the units' own holds."""
    key = lambda df: (F.upper(F.trim(df["scenario"])), F.trim(df["unit_id"]))
    right = extra.select(key(extra)[0].alias("s2"), key(extra)[1].alias("u2"), *[F.col(f).alias(f"extra_{f}") for f in fields])
    joined = units.join(right, (key(units)[0] == F.col("s2")) & (key(units)[1] == F.col("u2")), "left")
    own = [c for c in units.columns if c not in fields]
    return joined.select(*own, *[(F.coalesce(units[f], F.col(f"extra_{f}")) if f in units.columns else F.col(f"extra_{f}")).alias(f) for f in fields])


def service_table(cells: DataFrame, fields: list[str], size: int | None, aggregations: dict[str, str], cell_m2: float, extra: DataFrame | None = None, extra_fields: list[str] | None = None) -> DataFrame:
    """Scenario-service assembly: a row for each scenario, or for each of its units if a size is given."""
    if size:
        out = unit_totals(cells, fields, size)
    else:
        out = scenario_totals(cells, aggregations, cell_m2).groupBy("scenario").pivot("field", fields).agg(F.first("total")).withColumn("unit_id", F.lit("all"))
    return supplement(out, extra, extra_fields or []) if extra is not None else out


def zonal_metrics(cells: DataFrame, zones: DataFrame, cell_m2: float) -> DataFrame:
    """(zone, cell_count, total, area_ha, volume_m3) of depths in m by zone of (row, col, zone); a zone without a valid cell counts 0.

    Zones are counted first, so one whose cells are all NoData still has its row.
    """
    depth = cells.where(finite("value")).select("row", "col", F.col("value").cast("double").alias("d"))
    sums = zones.select("row", "col", "zone").join(depth, ["row", "col"], "left").groupBy("zone").agg(F.count("d").alias("cell_count"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total"))
    return sums.select("zone", "cell_count", "total", area_ha("cell_count", cell_m2).alias("area_ha"), (F.col("total") * cell_m2).alias("volume_m3"))


def unit_polygons(width: int, height: int, size: int, transform: list[float], spark) -> DataFrame:
    """(unit_id, x0, y0, x1, y1, ring): closed rings of the grid's units; those at the edges are cut off."""
    rows = spark.range((height + size - 1) // size).select(F.col("id").alias("ur"))
    cols = rows.withColumn("uc", F.explode(F.sequence(F.lit(0), F.lit((width + size - 1) // size - 1)))).select("ur", F.col("uc").cast("long").alias("uc"))
    x = lambda c: F.lit(transform[2]) + c * transform[0]
    y = lambda r: F.lit(transform[5]) + r * transform[4]
    c1, r1 = F.least((F.col("uc") + 1) * size, F.lit(width)), F.least((F.col("ur") + 1) * size, F.lit(height))
    boxes = cols.select(F.format_string("r%05d_c%05d", "ur", "uc").alias("unit_id"), x(F.col("uc") * size).alias("x0"), y(F.col("ur") * size).alias("y0"), x(c1).alias("x1"), y(r1).alias("y1"))
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    return boxes.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))
