"""Data-quality rules: each gives its violations as rows (rule, entity), and verdicts roll them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import driver_kind, finite, method_allowed
from .ordering import preceding


def violations(df: DataFrame, entity: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, entity) for each row and rule whose condition holds; one pass for all rules."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(F.explode(found).alias("rule"), entity.cast("string").alias("entity"))


def verdict(violated: DataFrame) -> DataFrame:
    """One row: violations and completed or failed."""
    return violated.agg(F.count("*").alias("violations"), F.when(F.count("*") == 0, "completed").otherwise("failed").alias("verdict"))


def raster_rules(
    described: DataFrame, categorical: bool = False, low: float | None = None, high: float | None = None, cell_m: float | None = None, codes: list[int] | None = None,
    bands: int | None = None, least_bands: int | None = None, band_names: list[str] | None = None, sensor: str | None = None, depth: bool = False,
) -> DataFrame:
    """Of described rasters (grid metadata and profile), by what the caller expects of them.

    Columns band_count, band_names (array), tags (map) and outside (of a profile by the same codes) are read by the rules on them only.
    """
    t = F.col("transform")
    rules = {
        "crs_missing": F.col("crs").isNull() | (F.col("crs") == ""),
        "empty_grid": (F.col("width") <= 0) | (F.col("height") <= 0),
        "not_projected_metres": ~F.coalesce(F.col("is_projected"), F.lit(False)) | ~F.lower(F.coalesce("linear_units", F.lit(""))).isin("m", "metre", "meter", "metres", "meters"),
        "nodata_missing": F.col("nodata").isNull(),
        "cell_not_square": F.abs(F.abs(F.get(t, F.lit(0))) - F.abs(F.get(t, F.lit(4)))) > 1e-9,
        "non_finite_values": F.col("non_finite") > 0,
        "no_valid_cells": F.col("low").isNull(),
    }
    if categorical:
        rules["not_integer"] = ~F.col("integer")
    if low is not None:
        rules["below_range"] = F.col("low") < low
    if high is not None:
        rules["above_range"] = F.col("high") > high
    if cell_m is not None:
        near = lambda k: F.abs(F.abs(F.get(t, F.lit(k))) - cell_m) <= max(1e-8, 1e-8 * cell_m)
        rules["cell_size_differs"] = ~F.coalesce(near(0) & near(4), F.lit(False))
    if codes is not None:
        rules["unknown_codes"] = F.col("outside") > 0
        rules["nodata_is_a_code"] = F.col("nodata").isin([float(c) for c in codes])
    count = F.coalesce("band_count", F.lit(0)) if bands is not None or least_bands is not None else None
    if bands is not None:
        rules["band_count_differs"] = count != bands
    if least_bands is not None:
        rules["too_few_bands"] = count < least_bands
    if band_names is not None:
        told = F.filter(F.transform("band_names", F.lower), lambda x: x.isNotNull() & (x != ""))
        rules["band_names_differ"] = (F.size(told) > 0) & (told != F.array(*[F.lit(n.lower()) for n in band_names]))
    if sensor is not None:
        tag = F.coalesce(F.try_element_at("tags", F.lit("sensor")), F.try_element_at("tags", F.lit("platform")))
        rules["sensor_differs"] = (tag != "") & (F.lower(tag) != sensor.lower())
    if depth:
        rules["depth_unknown"] = F.col("low").isNull()
        rules["depth_negative"] = F.col("low") < -1e-9
    return violations(described, F.col("raster_id"), rules)


def vector_rules(features: DataFrame, types: tuple[str, ...] = ("Polygon",)) -> DataFrame:
    """Of features of parse_features(): every ring of every part must be closed and have four points or more."""
    rings = F.col("rings")
    return violations(features, F.col("feature_id"), {"not_finite": ~F.col("finite"), "type_not_allowed": ~F.col("type").isin(*types), "ring_open": F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1)), "too_few_points": F.exists(rings, lambda r: F.size(r) < 4)})


def pool_rules(pools: DataFrame, columns: tuple[str, ...] = ("c_above", "c_below", "c_soil", "c_dead")) -> DataFrame:
    """Of a carbon pool table read as text."""
    value = lambda c: F.col(c).try_cast("double")
    rules = {"lucode_not_integer": F.col("lucode").try_cast("int").isNull(), "lucode_repeated": F.count("*").over(Window.partitionBy("lucode")) > 1}
    for c in columns:
        rules[f"{c}_blank"] = F.coalesce(F.trim(c), F.lit("")) == ""
        rules[f"{c}_not_a_number"] = (F.coalesce(F.trim(c), F.lit("")) != "") & ~F.coalesce(finite(value(c)), F.lit(False))
        rules[f"{c}_negative"] = value(c) < 0
    marked = pools.select("*", *[c.alias(f"_{k}") for k, c in rules.items()])
    return violations(marked, F.col("lucode"), {k: F.col(f"_{k}") for k in rules})


def code_coverage(cells: DataFrame, known: DataFrame, code: str = "lucode") -> DataFrame:
    """(value): codes in a raster that a table lacks."""
    return cells.select("value").distinct().join(known.select(F.col(code).alias("value")), "value", "left_anti")


def category_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(layer, category, missing_in): whole categories that only one of two tables (layer, category) has."""
    lost = expected.join(actual, ["layer", "category"], "left_anti").withColumn("missing_in", F.lit("actual"))
    return lost.union(actual.join(expected, ["layer", "category"], "left_anti").withColumn("missing_in", F.lit("expected")))


def threat_coverage(threats: DataFrame, columns: DataFrame) -> DataFrame:
    """(threat): named threats without a sensitivity column (name) of exactly their name."""
    named = threats.where(F.trim("threat") != "")
    return named.join(columns.select("name"), F.trim("threat") == F.col("name"), "left_anti").select("threat")


#: The arguments that each model must have.
REQUIRED_ARGUMENTS = {
    "annual_water_yield": ["lulc_path", "precipitation_path", "eto_path", "depth_to_root_rest_layer_path", "pawc_path", "watersheds_path", "biophysical_table_path", "seasonality_constant"],
    "habitat_quality": ["lulc_cur_path", "threats_table_path", "sensitivity_table_path", "half_saturation_constant"],
    "sediment_delivery_ratio": ["lulc_path", "dem_path", "erosivity_path", "erodibility_path", "watersheds_path", "biophysical_table_path"],
    "nutrient_delivery_ratio": ["lulc_path", "dem_path", "runoff_proxy_path", "watersheds_path", "biophysical_table_path"],
}
#: The constants that must be positive, by model.
POSITIVE_ARGUMENTS = {"annual_water_yield": ["seasonality_constant"], "habitat_quality": ["half_saturation_constant"]}
#: The columns that the models' tables must have; of threats the case counts.
REQUIRED_HEADERS = {
    ("annual_water_yield", "biophysical"): ["lucode", "root_depth", "kc", "lulc_veg"],
    ("habitat_quality", "threats"): ["threat", "max_dist", "weight", "decay", "cur_path"],
    ("habitat_quality", "sensitivity"): ["lulc", "habitat"],
    ("sediment_delivery_ratio", "biophysical"): ["lucode"],
    ("nutrient_delivery_ratio", "biophysical"): ["lucode"],
}


def header_rules(tables: DataFrame) -> DataFrame:
    """Of (entity, model, table, headers array): a violation header_missing for each column that the model's table lacks."""
    rows = [(m, t, h) for (m, t), hs in REQUIRED_HEADERS.items() for h in hs]
    need = tables.sparkSession.createDataFrame(rows, "model string, table string, header string")
    met = tables.join(need, ["model", "table"])
    there = F.when(F.col("table") == "threats", F.array_contains("headers", F.col("header"))).otherwise(F.array_contains(F.transform("headers", F.lower), F.col("header")))
    return violations(met, F.concat_ws(":", "entity", "table", "header"), {"header_missing": ~F.coalesce(there, F.lit(False))})


def driver_coverage(declared: DataFrame, drivers: DataFrame) -> DataFrame:
    """(driver): declared extra drivers that the driver table lacks."""
    return declared.select("driver").distinct().join(drivers.select("driver"), "driver", "left_anti")


def resampling_rules(drivers: DataFrame) -> DataFrame:
    """Drivers (driver, method) whose resampling doesn't suit their kind."""
    return violations(drivers, F.col("driver"), {"method_not_allowed": ~method_allowed(driver_kind("driver"), "method")})


def grid_equality(grids: DataFrame, master: str) -> DataFrame:
    """(raster_id, same_size, same_crs, same_transform) against the master grid, with a tolerance on the transform."""
    m = grids.where(F.col("raster_id") == master).select(F.col("width").alias("mw"), F.col("height").alias("mh"), F.col("crs").alias("mc"), F.col("transform").alias("mt"))
    cell = F.abs(F.get("mt", F.lit(0)))
    close = F.forall(F.zip_with("transform", "mt", lambda a, b: F.abs(a - b) <= F.greatest(F.greatest(F.lit(1e-9), cell * 1e-8), 1e-10 * F.greatest(F.abs(a), F.abs(b)))), lambda x: x)
    joined = grids.where(F.col("raster_id") != master).crossJoin(F.broadcast(m))
    return joined.select("raster_id", ((F.col("width") == F.col("mw")) & (F.col("height") == F.col("mh"))).alias("same_size"), (F.col("crs") == F.col("mc")).alias("same_crs"), close.alias("same_transform"))


def datum_rule(datums: DataFrame) -> DataFrame:
    """Entities (entity, dem_datum, level_datum) whose vertical datums are missing or differ."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("dem_datum", "level_datum"))
    return violations(datums, F.col("entity"), {"datum_missing": (a == "") | (b == ""), "datum_differs": (a != "") & (b != "") & (a != b)})


def criteria_rules(table: DataFrame, fields: list[str], unit: str) -> DataFrame:
    """Non-numeric cells, and unit ids that are blank or repeat."""
    bad = {f"{c}_not_finite": ~F.coalesce(finite(F.col(c).try_cast("double")), F.lit(False)) for c in fields}
    marked = table.withColumn("_n", F.count("*").over(Window.partitionBy(unit)))
    return violations(marked, F.col(unit), bad | {"unit_blank": F.coalesce(F.trim(F.col(unit).cast("string")), F.lit("")) == "", "unit_repeated": F.col("_n") > 1})


def contract_rules(contracts: DataFrame) -> DataFrame:
    """Extraction contracts (project, driver, unit, sign, aligned, declared)."""
    return violations(contracts, F.col("project"), {"driver_not_depth": F.col("driver") != "subsidence_depth", "unit_not_metres": F.col("unit") != "m", "sign_not_positive_down": F.col("sign") != "positive_down", "not_aligned": ~F.col("aligned"), "driver_not_declared": ~F.col("declared")})


def unit_interval_rules(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Of (entity, metric, value): metrics of those names that aren't finite numbers from 0 to 1."""
    return violations(metrics.where(F.col("metric").isin(names)), F.concat_ws(":", "entity", "metric"), {"not_in_unit_interval": ~F.coalesce(finite("value") & F.col("value").between(0, 1), F.lit(False))})


def simulation_verdict(evidence: DataFrame, overall: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(entity, seeds, verdict) of (entity, seed, fom): fewer than two seeds leave it pending, a bad value fails.

    With `overall` (entity, fom) and `classes` (entity, class, f1, iou) these must be there and hold
    numbers from 0 to 1 as well.
    """
    unit = lambda c: F.coalesce(finite(c) & F.col(c).between(0, 1), F.lit(False))
    s = evidence.groupBy("entity").agg(F.countDistinct("seed").alias("seeds"), F.count_if(~unit("fom")).alias("bad"))
    for name, table, ok in (("overall", overall, lambda: unit("fom")), ("classes", classes, lambda: unit("f1") & unit("iou"))):
        if table is not None:
            good = table.groupBy("entity").agg(F.count("*").alias("given"), F.count_if(~ok()).alias(f"bad_{name}"))
            wrong = F.coalesce(F.col(f"bad_{name}"), F.lit(1))
            s = s.join(good.drop("given"), "entity", "left").select("entity", "seeds", (F.col("bad") + wrong).alias("bad"))
    return s.select("entity", "seeds", F.when(F.col("bad") > 0, "failed").when(F.col("seeds") < 2, "pending_validation").otherwise("completed").alias("verdict"))


def service_rules(runs: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Of (model, scenario, status, outputs, units, total, observed)."""
    off = F.abs(F.col("total") - F.col("observed")) / F.greatest(F.abs("observed"), F.lit(1e-12))
    return violations(runs, F.concat_ws(":", "model", "scenario"), {"not_completed": F.col("status") != "completed", "no_outputs": F.col("outputs") < 1, "units_missing": F.coalesce("units", F.lit("")) == "", "total_off": off > tolerance})


def score_rules(ranges: DataFrame, max_ratio: float = 0.1) -> DataFrame:
    """Of (entity, low, high, method, cr, max_shift)."""
    return violations(ranges, F.col("entity"), {"range_unordered": ~((F.col("low") >= 0) & (F.col("low") <= F.col("high")) & (F.col("high") <= 1)), "ahp_inconsistent": (F.col("method") == "ahp") & ~F.coalesce(F.col("cr") <= max_ratio, F.lit(False)), "sensitivity_missing": F.col("max_shift").isNull(), "shift_negative": F.col("max_shift") < 0})


def water_rules(evidence: DataFrame) -> DataFrame:
    """Of (entity, mode, cells, volume, carbon): what each mode must have."""
    ok = lambda c: F.coalesce(finite(c) & (F.col(c) >= 0), F.lit(False))
    wrong = F.when(F.col("mode") == "classify", ~ok("cells")).when(F.col("mode") == "volume", ~ok("volume")).when(F.col("mode") == "composite", ~ok("volume") | ~ok("carbon")).otherwise(F.lit(True))
    return violations(evidence, F.col("entity"), {"evidence_incomplete": wrong})


def map_rules(maps: DataFrame) -> DataFrame:
    """Of (map_id, expected, actual, legend, extent, resolution, reviewed)."""
    return violations(maps, F.col("map_id"), {"layer_missing": F.size(F.array_except("expected", "actual")) > 0, "legend_wrong": F.col("legend") != 1, "extent_wrong": (F.size("extent") != 4) | ~F.forall("extent", finite), "resolution_wrong": ~(F.col("resolution") > 0), "not_reviewed": ~F.coalesce("reviewed", F.lit(False))})


def roll_up(sections: DataFrame, required: list[str]) -> DataFrame:
    """One row: the worst of the required sections' verdicts (section, verdict); an absent one fails."""
    need = sections.sparkSession.createDataFrame([(s,) for s in required], "section string")
    level = F.when(F.col("verdict") == "completed", 0).when(F.col("verdict") == "pending_validation", 1).otherwise(2)
    worst = need.join(sections, "section", "left").agg(F.max(F.coalesce(level, F.lit(2))).alias("w"))
    return worst.select(F.element_at(F.array(F.lit("completed"), F.lit("pending_validation"), F.lit("failed")), F.col("w") + 1).alias("verdict"))


def argument_rules(arguments: DataFrame, required: DataFrame, positive: DataFrame) -> DataFrame:
    """Of model arguments (model, arg, value): required ones (model, arg) that lack, and given constants (model, arg) that must be positive."""
    lost = required.join(arguments.where(F.coalesce(F.trim("value"), F.lit("")) != ""), ["model", "arg"], "left_anti").select(F.lit("argument_missing").alias("rule"), F.concat_ws(":", "model", "arg").alias("entity"))
    given = arguments.where(F.coalesce(F.trim("value"), F.lit("")) != "").join(positive.select("model", "arg"), ["model", "arg"], "left_semi")
    bad = violations(given, F.concat_ws(":", "model", "arg"), {"not_positive": ~F.coalesce(F.col("value").try_cast("double") > 0, F.lit(False))})
    return lost.union(bad)


def model_rules(stacks: DataFrame) -> DataFrame:
    """Of datastacks (entity, model, arg, value) of known models: arguments they lack, and constants that aren't positive."""
    spark = stacks.sparkSession
    listed = lambda table: spark.createDataFrame([(m, a) for m, names in table.items() for a in names], "of_model string, arg string")
    entities = stacks.select("entity", "model").distinct()
    each = lambda table: entities.join(listed(table), F.col("model") == F.col("of_model")).select(F.col("entity").alias("model"), "arg")
    return argument_rules(stacks.select(F.col("entity").alias("model"), "arg", "value"), each(REQUIRED_ARGUMENTS), each(POSITIVE_ARGUMENTS))


def sensitivity_evidence(rows: DataFrame) -> DataFrame:
    """One row (available, maximum_rank_shift): available if there are rows and no shift is negative or null."""
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("max_rank_shift") >= 0, F.lit(False))).alias("good"), F.max("max_rank_shift").alias("m"))
    ok = (F.col("n") > 0) & (F.col("n") == F.col("good"))
    return s.select(ok.alias("available"), F.when(ok, F.col("m")).alias("maximum_rank_shift"))


def output_rules(described: DataFrame, equality: DataFrame) -> DataFrame:
    """Simulated class maps: integer, with a CRS and on the reference grid."""
    joined = described.join(equality, "raster_id", "left")
    return violations(joined, F.col("raster_id"), {"not_integer": ~F.col("integer"), "crs_missing": F.coalesce("crs", F.lit("")) == "", "off_grid": ~(F.col("same_size") & F.col("same_crs") & F.col("same_transform"))})


def aggregation_advice(services: DataFrame) -> DataFrame:
    """Services (field, unit, aggregation) that are summed though their unit speaks against it."""
    unit, how = F.lower("unit"), F.lower("aggregation")
    return violations(services, F.col("field"), {"depth_in_mm_summed": (unit == "mm") & (how == "sum"), "index_summed": unit.isin("index", "unitless") & (how == "sum")})


def year_rules(snapshots: DataFrame) -> DataFrame:
    """Snapshots (raster_id, year): years out of range, repeated or out of the order of `ordinal`."""
    marked = snapshots.select("*", F.count("*").over(Window.partitionBy("year")).alias("_n"), F.lag("year").over(Window.orderBy("ordinal")).alias("_before"))
    return violations(marked, F.col("raster_id"), {"year_out_of_range": ~F.col("year").between(1900, 2200), "year_repeated": F.col("_n") > 1, "not_chronological": F.col("year") < F.col("_before")})


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def point_grid_audit(points: DataFrame, apart: int = 2) -> DataFrame:
    """One row for points (x, y, w): their number, repeated ones, rows, columns, whether the grid is full, spacings, the widest step, and what is odd about w.

    `missing` counts values that aren't finite numbers, `odd_magnitude` those whose power of ten is
    `apart` or more from the median power of all that aren't 0. Steps along a row are found by ranges of
    (y, x), so no task holds a row; powers of ten are a few numbers.
    """
    kinds = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    steps = preceding(kinds, ["y"], "x", "before").withColumn("step", F.col("x") - F.col("before"))
    s = steps.agg(F.sum("n").alias("points"), F.count_if(F.col("n") > 1).alias("repeated"), F.countDistinct("y").alias("rows"), F.countDistinct("x").alias("columns"), F.countDistinct("step").alias("spacings"), F.max("step").alias("widest"), F.count("*").alias("places"))
    w = F.col("w").cast("double")
    sound = F.coalesce(finite(w), F.lit(False))
    powers = points.groupBy(sound.alias("sound"), F.when(sound & (w != 0), F.floor(F.log10(F.abs(w)))).alias("power")).agg(F.count("*").alias("n"))
    upto = powers.where("power IS NOT NULL").withColumns({"upto": F.sum("n").over(Window.orderBy("power")), "all": F.sum("n").over(Window.partitionBy())})
    median = upto.agg(F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("power"))).alias("median"))
    odd = powers.crossJoin(F.broadcast(median)).agg(F.coalesce(F.sum(F.when(~F.col("sound"), F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.abs(F.col("power") - F.col("median")) >= apart, F.col("n"))), F.lit(0)).alias("odd_magnitude"))
    return s.crossJoin(F.broadcast(odd)).select("points", "repeated", "rows", "columns", (F.col("places") == F.col("rows") * F.col("columns")).alias("full"), "spacings", "widest", "missing", "odd_magnitude")
