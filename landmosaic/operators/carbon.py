"""Carbon stocks and subsidence water."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import area_ha, non_negative
from .change import CELL

POOLS = ("c_above", "c_below", "c_soil", "c_dead")


def carbon_stock(cells: DataFrame, pools: DataFrame, cell_m2: float, by: str = "scenario") -> DataFrame:
    """(by, value, area_ha, carbon_t): stock of each class; a null class holds the total of its scenario.

    Cells are counted by class before the pools join. The job fails for a class without a row of pools,
    which missing_pools() lists.
    """
    counts = cells.groupBy(by, "value").agg(F.count("*").alias("n"))
    density = sum((F.col(c) for c in POOLS[1:]), F.col(POOLS[0]))
    joined = counts.join(pools, F.col("value") == F.col("lucode"), "left")
    known = F.col("lucode").isNotNull()
    density = F.when(known, density).otherwise(F.raise_error(F.concat(F.lit("no carbon pools for class "), F.coalesce(F.col("value").cast("string"), F.lit("null")))).cast("double"))
    stocks = joined.select(by, "value", area_ha("n", cell_m2).alias("area_ha"), (area_ha("n", cell_m2) * density).alias("carbon_t"))
    totals = stocks.groupBy(by).agg(F.sum("area_ha").alias("area_ha"), F.sum("carbon_t").alias("carbon_t")).select(by, F.lit(None).cast(stocks.schema["value"].dataType).alias("value"), "area_ha", "carbon_t")
    return stocks.union(totals)


def missing_pools(cells: DataFrame, pools: DataFrame, by: str = "scenario") -> DataFrame:
    """(by, value, pixel_count) of classes that have cells but no row of pools."""
    counts = cells.groupBy(by, "value").agg(F.count("*").alias("pixel_count"))
    return counts.join(pools.select(F.col("lucode").alias("value")), "value", "left_anti").select(by, "value", "pixel_count")


def carbon_change(stocks: DataFrame, baseline: str, by: str = "scenario") -> DataFrame:
    """(by, carbon_t, change_t, change_percent) of totals against the baseline scenario."""
    totals = stocks.where("value IS NULL").select(by, "carbon_t")
    base = totals.where(F.col(by) == baseline).select(F.col("carbon_t").alias("base"))
    return totals.crossJoin(F.broadcast(base)).select(by, "carbon_t", (F.col("carbon_t") - F.col("base")).alias("change_t"), (100 * (F.col("carbon_t") - F.col("base")) / F.nullif("base", F.lit(0.0))).alias("change_percent"))


def water_volume(dem: DataFrame, depth: DataFrame, level: float, cell_m2: float, mask: DataFrame | None = None) -> DataFrame:
    """One row: flooded cells, area and volume where the ground after subsidence lies below the water level."""
    joined = dem.select(*CELL, F.col("value").alias("z")).join(depth.select(*CELL, F.col("value").alias("d")), CELL)
    if mask is not None:
        joined = joined.join(mask.select(*CELL), CELL, "left_semi")
    ground = F.col("z") - F.col("d")
    under = ground < level
    return joined.agg(F.count_if(under).alias("cells"), area_ha(F.count_if(under), cell_m2).alias("area_ha"), (F.coalesce(F.sum(F.when(under, level - ground)), F.lit(0.0)) * cell_m2).alias("volume_m3"))


def composite_carbon(components: DataFrame) -> DataFrame:
    """water, vegetation, sediment and composite carbon in t for each site and year."""
    v = lambda name: non_negative(name, name)
    water = v("water_volume_m3") * v("water_carbon_density_g_c_m3") / 1e6
    plants = v("vegetation_area_ha") * v("vegetation_density_t_c_ha")
    mud = v("sediment_area_ha") * v("sediment_density_t_c_ha")
    return components.select("site_id", "year", water.alias("water_t"), plants.alias("vegetation_t"), mud.alias("sediment_t"), (water + plants + mud).alias("composite_t"))


def replaced_total(invest: Column, invest_water: Column, composite: Column) -> Column:
    """Land carbon with its water part replaced by the composite; fails if that part exceeds the whole."""
    return F.when(invest_water <= invest, invest - invest_water + composite).otherwise(F.raise_error(F.lit("the water part exceeds the total")).cast("double"))


def composite_from_cells(dem: DataFrame, depth: DataFrame, level: float, cell_m2: float, densities: tuple[float, float, float], plants: DataFrame, mud: DataFrame, max_plant_depth: float) -> DataFrame:
    """One row of water, vegetation and sediment carbon from rasters; plants only in water no deeper than the bound."""
    ground = F.col("z") - F.col("d")
    water = dem.select(*CELL, F.col("value").alias("z")).join(depth.select(*CELL, F.col("value").alias("d")), CELL).where(ground < level).select(*CELL, (level - ground).alias("deep"))
    flagged = water.join(plants.select(*CELL, F.lit(1).alias("p")), CELL, "left").join(mud.select(*CELL, F.lit(1).alias("m")), CELL, "left")
    ha = cell_m2 / 1e4
    sums = flagged.agg(F.sum("deep").alias("deep"), F.count_if((F.col("p") == 1) & (F.col("deep") <= max_plant_depth)).alias("plants"), F.count("m").alias("mud"))
    parts = [F.coalesce("deep", F.lit(0.0)) * cell_m2 * densities[0] / 1e6, F.col("plants") * ha * densities[1], F.col("mud") * ha * densities[2]]
    return sums.select(parts[0].alias("water_t"), parts[1].alias("vegetation_t"), parts[2].alias("sediment_t"), (parts[0] + parts[1] + parts[2]).alias("composite_t"))


def class_evidence(cells: DataFrame, code: int, cell_m2: float) -> DataFrame:
    """One row: cells and m² of one class."""
    return cells.agg(F.count_if(F.col("value") == code).alias("cells"), (F.count_if(F.col("value") == code) * cell_m2).alias("area_m2"))


def density_statistics(samples: DataFrame) -> DataFrame:
    """(lucode, n, mean, stddev, low, high): density evidence with a 95 % interval of the mean."""
    s = samples.groupBy("lucode").agg(F.count("*").alias("n"), F.avg("density").alias("mean"), F.stddev_samp("density").alias("stddev"))
    half = F.lit(1.96) * F.col("stddev") / F.sqrt("n")
    return s.select("lucode", "n", "mean", "stddev", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
