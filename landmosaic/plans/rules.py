"""Queries of data-quality rules."""

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import quality
from ..sources import tables as S
from .registry import query


def _grids(t):
    """A grid record for each part, some of them faulty."""
    k = F.col("p_partkey")
    return t("part").select(
        k.cast("string").alias("raster_id"), F.when(k % 11 != 0, "EPSG:32650").alias("crs"), F.when(k % 13 == 0, 0).otherwise(100).alias("width"), F.lit(100).alias("height"),
        F.array(F.when(k % 17 == 0, 31.0).otherwise(30.0), F.lit(0.0), F.lit(5e5), F.lit(0.0), F.lit(-30.0), F.when(k % 19 == 0, 3.7e6 + 1).otherwise(3.7e6 + 1e-10)).alias("transform"),
        F.when(k % 7 != 0, 0.0).alias("nodata"), F.lit(True).alias("is_projected"), F.when(k % 23 == 0, "degree").otherwise("Metre").alias("linear_units"),
    )


def _part_cells(t):
    return t("lineitem").select(F.col("l_partkey").cast("string").alias("raster_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity") - (F.col("l_partkey") % 2) * F.col("l_discount")).alias("value"))


PROFILE = "c AS (SELECT CAST(l_partkey AS VARCHAR) AS raster_id, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity - (l_partkey % 2) * l_discount END AS v FROM lineitem), pf AS (SELECT raster_id, min(v) AS low, max(v) AS high, count(*) - count(v) AS non_finite, count(DISTINCT v) AS distinct, coalesce(bool_and(v = floor(v)), NULL) AS integer FROM c GROUP BY ALL)"


@query("a9_raster_profile", f"WITH {PROFILE}, vs AS (SELECT raster_id, list_sort(list(DISTINCT v)) AS values FROM c WHERE v IS NOT NULL GROUP BY ALL) SELECT pf.*, array_to_string(list_transform(values, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ' ') AS cents FROM pf LEFT JOIN vs USING (raster_id)", "low high")
def _(t):
    found = S.profile(_part_cells(t), values=True)
    cents = F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("long").cast("string")), " ")
    return found.withColumn("cents", cents).drop("values")


@query("s3_describe_rasters", f"WITH {PROFILE} SELECT CAST(p_partkey AS VARCHAR) AS raster_id, CASE WHEN p_partkey % 11 <> 0 THEN 'EPSG:32650' END AS crs, CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 100 END AS INTEGER) AS width, low, high, non_finite FROM part LEFT JOIN pf ON raster_id = CAST(p_partkey AS VARCHAR)", "low high")
def _(t):
    return S.describe(_part_cells(t), _grids(t)).select("raster_id", "crs", "width", "low", "high", "non_finite")


@query("q1_raster_rules", f"""WITH {PROFILE}, d AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS entity, pf.* FROM part LEFT JOIN pf ON raster_id = CAST(p_partkey AS VARCHAR))
SELECT 'crs_missing' AS rule, entity FROM d WHERE k % 11 = 0 UNION ALL SELECT 'empty_grid', entity FROM d WHERE k % 13 = 0 UNION ALL SELECT 'not_projected_metres', entity FROM d WHERE k % 23 = 0 UNION ALL SELECT 'nodata_missing', entity FROM d WHERE k % 7 = 0
UNION ALL SELECT 'cell_not_square', entity FROM d WHERE k % 17 = 0 UNION ALL SELECT 'non_finite_values', entity FROM d WHERE non_finite > 0 UNION ALL SELECT 'no_valid_cells', entity FROM d WHERE low IS NULL UNION ALL SELECT 'not_integer', entity FROM d WHERE NOT integer UNION ALL SELECT 'below_range', entity FROM d WHERE low < 2 UNION ALL SELECT 'above_range', entity FROM d WHERE high > 48""")
def _(t):
    return quality.raster_rules(S.describe(_part_cells(t), _grids(t)), True, 2.0, 48.0)


@query("q1_contract_rules", f"""WITH {PROFILE}, d AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS entity, pf.* FROM part LEFT JOIN pf ON raster_id = CAST(p_partkey AS VARCHAR)),
u AS (SELECT DISTINCT raster_id FROM c WHERE v IS NOT NULL AND v NOT IN (SELECT x::DOUBLE FROM range(0, 45) r(x))), b AS (SELECT *, k % 5 AS n FROM d)
SELECT 'cell_size_differs' AS rule, entity FROM b WHERE k % 17 = 0 UNION ALL SELECT 'unknown_codes', raster_id FROM u UNION ALL SELECT 'nodata_is_a_code', entity FROM b WHERE k % 7 <> 0 UNION ALL SELECT 'band_count_differs', entity FROM b WHERE n <> 3
UNION ALL SELECT 'too_few_bands', entity FROM b WHERE n < 2 UNION ALL SELECT 'band_names_differ', entity FROM b WHERE n = 2 UNION ALL SELECT 'sensor_differs', entity FROM b WHERE k % 6 = 1 UNION ALL SELECT 'depth_unknown', entity FROM b WHERE low IS NULL UNION ALL SELECT 'depth_negative', entity FROM b WHERE low < -1e-9""")
def _(t):
    k = F.col("p_partkey")
    more = t("part").select(k.cast("string").alias("id"), (k % 5).alias("band_count"), F.when(k % 5 == 2, F.array(F.lit("Blue"), F.lit("nir"))).otherwise(F.array(F.lit("RED"), F.lit(""), F.lit("nir"))).alias("band_names"), F.when(k % 6 == 1, F.create_map(F.lit("platform"), F.lit("GF-1"))).when(k % 6 == 2, F.create_map(F.lit("sensor"), F.lit("landsat-8"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("tags"))
    described = _grids(t).join(S.profile(_part_cells(t), codes=list(range(45))), "raster_id", "left").join(more, F.col("raster_id") == F.col("id"))
    found = quality.raster_rules(described, cell_m=30.0, codes=list(range(45)), bands=3, least_bands=2, band_names=["red", "nir"], sensor="Landsat-8", depth=True)
    return found.where(~F.col("rule").isin("crs_missing", "empty_grid", "not_projected_metres", "nodata_missing", "cell_not_square", "non_finite_values", "no_valid_cells"))


@query("j17_grid_equality", "SELECT CAST(p_partkey AS VARCHAR) AS raster_id, p_partkey % 13 <> 0 AS same_size, CASE WHEN p_partkey % 11 <> 0 THEN true END AS same_crs, p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AS same_transform FROM part WHERE p_partkey <> 1")
def _(t):
    return quality.grid_equality(_grids(t), "1")


@query("q16_output_rules", f"""WITH {PROFILE}, d AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS entity, pf.* FROM part LEFT JOIN pf ON raster_id = CAST(p_partkey AS VARCHAR))
SELECT 'not_integer' AS rule, entity FROM d WHERE NOT integer UNION ALL SELECT 'crs_missing', entity FROM d WHERE k % 11 = 0 UNION ALL SELECT 'off_grid', entity FROM d WHERE k <> 1 AND (k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0)""")
def _(t):
    grids = _grids(t)
    return quality.output_rules(S.describe(_part_cells(t), grids), quality.grid_equality(grids, "1"))


@query("j4_code_coverage", "SELECT DISTINCT l_linenumber AS value FROM lineitem WHERE l_linenumber NOT IN (SELECT lucode FROM pools WHERE lucode < 4)")
def _(t):
    return quality.code_coverage(t("lineitem").select(F.col("l_linenumber").alias("value")), t.pools.where("lucode < 4").withColumn("lucode", F.col("lucode").cast("int")))


@query("u4_set_difference", "SELECT s_nationkey AS nation FROM supplier WHERE s_nationkey % 2 = 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey % 3 = 0")
def _(t):
    return t("supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("nation")).subtract(t("customer").where("c_nationkey % 3 = 0").select("c_nationkey"))


@query("u2_union_of_labels", "SELECT CAST(t1 AS VARCHAR) AS label FROM g UNION SELECT CAST(p1 AS VARCHAR) FROM g")
def _(t):
    return t.g.select(F.col("t1").cast("string").alias("label")).union(t.g.select(F.col("p1").cast("string"))).distinct()


@query("u5_repeated_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return quality.repeated_keys(t("lineitem"), ["l_partkey", "l_suppkey"])


@query("j5_category_coverage", "WITH e AS (SELECT DISTINCT c_mktsegment AS layer, CAST(c_nationkey AS VARCHAR) AS category FROM customer WHERE c_nationkey % 4 <> 0), a AS (SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey % 3 <> 0) SELECT *, 'actual' AS missing_in FROM (FROM e EXCEPT FROM a) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)")
def _(t):
    c = t("customer").select(F.col("c_mktsegment").alias("layer"), F.col("c_nationkey").cast("string").alias("category"), "c_nationkey").distinct()
    return quality.category_coverage(c.where("c_nationkey % 4 <> 0").drop("c_nationkey"), c.where("c_nationkey % 3 <> 0").drop("c_nationkey"))


@query("j15_threat_coverage", "SELECT ' ' || c_name AS threat FROM customer WHERE c_acctbal <= 0")
def _(t):
    return quality.threat_coverage(t("customer").select(F.concat(F.lit(" "), "c_name").alias("threat")), t("customer").where("c_acctbal > 0").select(F.col("c_name").alias("name")))


@query("j15_header_rules", "SELECT 'header_missing' AS rule, s_suppkey || ':threats:decay' AS entity FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'header_missing', s_suppkey || ':threats:weight' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'header_missing', s_suppkey || ':sensitivity:habitat' FROM supplier WHERE s_suppkey % 5 = 0")
def _(t):
    k = F.col("s_suppkey")
    names = lambda *xs: F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]))
    threats = names("threat", "max_dist", F.when(k % 6 == 0, "Weight").otherwise("weight"), F.when(k % 4 != 0, "decay"), "cur_path")
    sensitivity = names("LULC", F.when(k % 5 != 0, "Habitat"))
    one = lambda name, headers: t("supplier").select(k.alias("entity"), F.lit("habitat_quality").alias("model"), F.lit(name).alias("table"), headers.alias("headers"))
    return quality.header_rules(one("threats", threats).union(one("sensitivity", sensitivity)))


@query("j16_driver_coverage", "SELECT DISTINCT o_custkey AS driver FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return quality.driver_coverage(t("orders").select(F.col("o_custkey").alias("driver")), t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("driver")))


@query("p11_resampling_policy", "WITH d AS (SELECT p_partkey, ['aspect', 'soil_type', 'slope', ' Slope_Class '][CAST(p_partkey % 4 AS INT) + 1] AS driver, ['nearest', 'majority', 'bilinear', 'cubic', 'mode'][CAST(p_partkey // 4 % 5 AS INT) + 1] AS method FROM part) SELECT 'method_not_allowed' AS rule, driver AS entity FROM d WHERE CASE lower(trim(driver)) WHEN 'aspect' THEN method <> 'nearest' WHEN 'slope' THEN method NOT IN ('nearest', 'bilinear', 'cubic') ELSE method NOT IN ('nearest', 'majority') END")
def _(t):
    pick = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), (F.expr(e) + 1).cast("int"))
    return quality.resampling_rules(t("part").select(pick(["aspect", "soil_type", "slope", " Slope_Class "], "p_partkey % 4").alias("driver"), pick(["nearest", "majority", "bilinear", "cubic", "mode"], "p_partkey div 4 % 5").alias("method")))


@query("q2_vector_rules", "SELECT 'ring_open' AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'not_finite', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'type_not_allowed', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0")
def _(t):
    k = F.col("s_suppkey")
    point = lambda x, y: F.array(F.lit(float(x)), y if not isinstance(y, (int, float)) else F.lit(float(y)))
    ring = F.array(point(0, 0), point(1, 0), point(1, F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))), point(0, F.when(k % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.0))))
    features = t("supplier").select(k.alias("feature_id"), F.when(k % 3 == 0, "Point").otherwise("Polygon").alias("type"), ring.alias("ring"))
    # The first ring is sound, what may be wrong is the second one.
    square = F.expr("array(array(0.0D, 0.0D), array(9.0D, 0.0D), array(9.0D, 9.0D), array(0.0D, 0.0D))")
    return quality.vector_rules(features.withColumn("finite", F.forall("ring", lambda p: F.forall(p, E.finite))).withColumn("rings", F.array(square, F.col("ring"))))


@query("q3_pool_rules", "WITH p AS (SELECT s_suppkey AS k, s_nationkey AS lucode FROM supplier) SELECT 'lucode_repeated' AS rule, CAST(lucode AS VARCHAR) AS entity FROM p WHERE lucode IN (SELECT lucode FROM p GROUP BY lucode HAVING count(*) > 1) UNION ALL SELECT 'c_above_blank', CAST(lucode AS VARCHAR) FROM p WHERE k % 5 = 0 UNION ALL SELECT 'c_below_not_a_number', CAST(lucode AS VARCHAR) FROM p WHERE k % 7 = 0 UNION ALL SELECT 'c_soil_negative', CAST(lucode AS VARCHAR) FROM p WHERE k % 11 = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.pool_rules(t("supplier").select(F.col("s_nationkey").cast("string").alias("lucode"), F.when(k % 5 == 0, " ").otherwise("1.5").alias("c_above"), F.when(k % 7 == 0, "abc").otherwise("2").alias("c_below"), F.when(k % 11 == 0, "-1").otherwise("3").alias("c_soil"), F.lit("0").alias("c_dead")))


@query("q4_datum_rule", "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'datum_missing' ELSE 'datum_differs' END AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.datum_rule(t("supplier").select(k.alias("entity"), F.when(k % 5 != 0, "CGVD 28 ").alias("dem_datum"), F.when(k % 3 == 0, "egm96").otherwise("cgvd 28").alias("level_datum")))


@query("q5_criteria_rules", "SELECT 'spend_not_finite' AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier WHERE s_suppkey % 9 = 0")
def _(t):
    return quality.criteria_rules(t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("spend")), ["spend"], "s_suppkey")


@query("q6_contract_rules", "SELECT r AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier, (VALUES ('unit_not_metres', 4), ('not_aligned', 6), ('driver_not_declared', 10)) x(r, n) WHERE s_suppkey % n = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.contract_rules(t("supplier").select(k.alias("project"), F.lit("subsidence_depth").alias("driver"), F.when(k % 4 == 0, "mm").otherwise("m").alias("unit"), F.lit("positive_down").alias("sign"), (k % 6 != 0).alias("aligned"), (k % 10 != 0).alias("declared")))


@query("q7_metric_rules", "SELECT 'not_in_unit_interval' AS rule, CAST(l_orderkey AS VARCHAR) || ':f1' AS entity FROM lineitem WHERE l_linenumber = 1 AND l_discount * 12 > 1")
def _(t):
    return quality.unit_interval_rules(t("lineitem").select(F.col("l_orderkey").alias("entity"), F.when(F.col("l_linenumber") == 1, "f1").otherwise("other").alias("metric"), (F.col("l_discount") * 12).alias("value")), ["oa", "f1", "iou"])


@query("q8_simulation_verdict", "WITH e AS (SELECT s_nationkey AS entity, s_suppkey AS seed, s_acctbal / 9900 AS fom FROM supplier) SELECT entity, count(DISTINCT seed) AS seeds, CASE WHEN count(*) FILTER (NOT fom BETWEEN 0 AND 1) > 0 THEN 'failed' WHEN count(DISTINCT seed) < 2 THEN 'pending_validation' ELSE 'completed' END AS verdict FROM e GROUP BY ALL")
def _(t):
    return quality.simulation_verdict(t("supplier").select(F.col("s_nationkey").alias("entity"), F.col("s_suppkey").alias("seed"), (F.col("s_acctbal") / 9900).alias("fom")))


@query("q8_simulation_evidence", "WITH e AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 2 END AS seeds, s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 AS bad FROM supplier) SELECT entity, CAST(seeds AS BIGINT) AS seeds, CASE WHEN bad THEN 'failed' WHEN seeds < 2 THEN 'pending_validation' ELSE 'completed' END AS verdict FROM e")
def _(t):
    k = F.col("s_suppkey")
    runs = t("supplier").select(k.alias("entity"), F.explode(F.when(k % 5 == 0, F.array(F.lit(11))).otherwise(F.array(F.lit(11), F.lit(29)))).alias("seed"), F.lit(0.2).alias("fom"))
    overall = t("supplier").select(k.alias("entity"), F.when(k % 7 == 0, float("nan")).otherwise(0.21).alias("fom"))
    classes = t("supplier").where(k % 11 != 0).select(k.alias("entity"), F.explode(F.array(F.lit(1), F.lit(2))).alias("class"), F.lit(0.8).alias("f1"), F.when(k % 13 == 0, 1.2).otherwise(0.7).alias("iou"))
    return quality.simulation_verdict(runs, overall, classes)


@query("q9_service_rules", "SELECT r AS rule, CAST(s_suppkey AS VARCHAR) || ':' || CAST(s_nationkey AS VARCHAR) AS entity FROM supplier, (VALUES ('not_completed', 8), ('no_outputs', 9), ('units_missing', 10), ('total_off', 11)) x(r, n) WHERE s_suppkey % n = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.service_rules(t("supplier").select(k.alias("model"), F.col("s_nationkey").alias("scenario"), F.when(k % 8 == 0, "failed").otherwise("completed").alias("status"), F.when(k % 9 == 0, 0).otherwise(2).alias("outputs"), F.when(k % 10 != 0, "t").alias("units"), F.when(k % 11 == 0, 101.0).otherwise(100.0).alias("total"), F.lit(100.0).alias("observed")))


@query("q10_score_rules", "SELECT r AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier, (VALUES ('range_unordered', 8), ('ahp_inconsistent', 9), ('sensitivity_missing', 10)) x(r, n) WHERE s_suppkey % n = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.score_rules(t("supplier").select(k.alias("entity"), F.when(k % 8 == 0, 0.9).otherwise(0.1).alias("low"), F.lit(0.8).alias("high"), F.lit("ahp").alias("method"), F.when(k % 9 == 0, 0.3).otherwise(0.05).alias("cr"), F.when(k % 10 != 0, 1).alias("max_shift")))


@query("q11_water_rules", "SELECT 'evidence_incomplete' AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier WHERE s_suppkey % 4 = 3 OR s_suppkey % 4 = 1 AND s_acctbal < 0 OR s_suppkey % 4 = 2 AND s_suppkey % 3 = 0")
def _(t):
    k = F.col("s_suppkey")
    mode = F.element_at(F.array(*map(F.lit, ("classify", "volume", "composite", "other"))), (k % 4 + 1).cast("int"))
    return quality.water_rules(t("supplier").select(k.alias("entity"), mode.alias("mode"), F.lit(3.0).alias("cells"), F.when(k % 4 == 1, F.col("s_acctbal")).otherwise(1.0).alias("volume"), F.when(k % 3 != 0, 1.0).alias("carbon")))


@query("q12_map_rules", "SELECT r AS rule, CAST(s_suppkey AS VARCHAR) AS entity FROM supplier, (VALUES ('layer_missing', 8), ('legend_wrong', 9), ('extent_wrong', 10), ('resolution_wrong', 11), ('not_reviewed', 12)) x(r, n) WHERE s_suppkey % n = 0")
def _(t):
    k = F.col("s_suppkey")
    one = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    return quality.map_rules(t("supplier").select(k.alias("map_id"), F.array(F.lit("lulc"), F.lit("dem")).alias("expected"), one(8, F.array(F.lit("dem")), F.array(F.lit("dem"), F.lit("lulc"))).alias("actual"), one(9, 0.5, 1.0).alias("legend"), one(10, F.array(F.lit(0.0)), F.array(*[F.lit(0.0)] * 4)).alias("extent"), one(11, 0.0, 300.0).alias("resolution"), one(12, F.lit(None).cast("boolean"), F.lit(True)).alias("reviewed")))


#: A section for each region: the worst of its nations' suppliers.
SECTIONS = "s AS (SELECT lower(r_name) AS section, max(CASE WHEN s_acctbal < -990 THEN 2 WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


@query("q13_verdict", f"WITH {SECTIONS}, r(i, section) AS (VALUES (1, 'africa'), (1, 'asia'), (2, 'europe'), (3, 'america'), (4, 'asia'), (4, 'maps')) SELECT i AS project, ['completed', 'pending_validation', 'failed'][CAST(max(coalesce(level, 2)) AS INT) + 1] AS verdict FROM r LEFT JOIN s USING (section) GROUP BY i")
def _(t):
    level = F.when(F.col("s_acctbal") < -990, 2).when(F.col("s_acctbal") < 0, 1).otherwise(0)
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    worst = places.groupBy(F.lower("r_name").alias("section")).agg(F.max(level).alias("level"))
    sections = worst.select("section", F.element_at(F.array(*map(F.lit, ("completed", "pending_validation", "failed"))), F.col("level") + 1).alias("verdict"))
    out = None
    for i, required in enumerate((["africa", "asia"], ["europe"], ["america"], ["asia", "maps"]), 1):
        one = quality.roll_up(sections, required).select(F.lit(i).alias("project"), "verdict")
        out = one if out is None else out.union(one)
    return out


@query("q13_rule_verdict", "SELECT count(*) AS violations, CASE WHEN count(*) = 0 THEN 'completed' ELSE 'failed' END AS verdict FROM supplier WHERE s_acctbal < 0")
def _(t):
    return quality.verdict(quality.violations(t("supplier"), F.col("s_suppkey"), {"negative_balance": F.col("s_acctbal") < 0}))


@query("q14_argument_rules", "SELECT 'argument_missing' AS rule, CAST(s_nationkey AS VARCHAR) || ':' || s_name AS entity FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'not_positive', CAST(s_nationkey AS VARCHAR) || ':' || s_name FROM supplier WHERE s_suppkey % 6 <> 0 AND s_acctbal <= 0")
def _(t):
    a = t("supplier").select(F.col("s_nationkey").alias("model"), F.col("s_name").alias("arg"), F.when(F.col("s_suppkey") % 6 == 0, " ").otherwise(F.col("s_acctbal").cast("string")).alias("value"))
    return quality.argument_rules(a, a.select("model", "arg"), a.select("model", "arg"))


@query("q14_model_rules", "WITH a(model, arg) AS (VALUES ('habitat_quality', 'lulc_cur_path'), ('habitat_quality', 'threats_table_path'), ('habitat_quality', 'sensitivity_table_path'), ('habitat_quality', 'half_saturation_constant'), ('nutrient_delivery_ratio', 'lulc_path'), ('nutrient_delivery_ratio', 'dem_path'), ('nutrient_delivery_ratio', 'runoff_proxy_path'), ('nutrient_delivery_ratio', 'watersheds_path'), ('nutrient_delivery_ratio', 'biophysical_table_path')), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'habitat_quality' ELSE 'nutrient_delivery_ratio' END AS model, s_acctbal FROM supplier) SELECT 'argument_missing' AS rule, k || ':' || arg AS entity FROM s JOIN a USING (model) WHERE arg LIKE '%path' AND (k + length(arg)) % 5 = 0 UNION ALL SELECT 'not_positive', k || ':half_saturation_constant' FROM s WHERE model = 'habitat_quality' AND s_acctbal <= 0")
def _(t):
    k = F.col("s_suppkey")
    names = lambda m: F.array(*map(F.lit, quality.REQUIRED_ARGUMENTS[m]))
    each = t("supplier").select(k.alias("entity"), F.when(k % 2 == 0, "habitat_quality").otherwise("nutrient_delivery_ratio").alias("model"), "s_acctbal", F.explode(F.when(k % 2 == 0, names("habitat_quality")).otherwise(names("nutrient_delivery_ratio"))).alias("arg"))
    value = F.when(~F.col("arg").endswith("path"), F.col("s_acctbal").cast("string")).when((F.col("entity") + F.length("arg")) % 5 != 0, "a")
    return quality.model_rules(each.select("entity", "model", "arg", value.alias("value")))


@query("q15_sensitivity_evidence", "SELECT min(l_linenumber) >= 0 AS available, CASE WHEN min(l_linenumber) >= 0 THEN max(l_linenumber) END AS maximum_rank_shift FROM lineitem")
def _(t):
    return quality.sensitivity_evidence(t("lineitem").select(F.col("l_linenumber").alias("max_rank_shift")))


@query("q17_aggregation_advice", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'depth_in_mm_summed' ELSE 'index_summed' END AS rule, s_name AS entity FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 2 = 0")
def _(t):
    k = F.col("s_suppkey")
    return quality.aggregation_advice(t("supplier").select(F.col("s_name").alias("field"), F.element_at(F.array(*map(F.lit, ("mm", "Index", "t"))), (k % 3 + 1).cast("int")).alias("unit"), F.when(k % 2 == 0, "sum").otherwise("mean").alias("aggregation")))


W = "CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_orderkey % 43 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 47 = 0 THEN l_quantity * 1000 WHEN l_orderkey % 53 = 0 THEN 0 ELSE -l_quantity END"


@query("q19_point_grid_audit", f"""WITH p AS (SELECT CAST(l_suppkey AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, {W} AS w FROM lineitem), k AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, x - lag(x) OVER (PARTITION BY y ORDER BY x) AS step FROM k),
m AS (SELECT floor(log10(abs(w))) AS power FROM p WHERE w <> 0 AND NOT isnan(w)), o AS (SELECT quantile_disc(power, 0.5) AS median FROM m)
SELECT CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (n > 1) AS repeated, count(DISTINCT y) AS rows, count(DISTINCT x) AS columns, count(*) = count(DISTINCT x) * count(DISTINCT y) AS full, count(DISTINCT step) AS spacings, max(step) AS widest,
  (SELECT count(*) FROM p WHERE w IS NULL OR isnan(w)) AS missing, (SELECT count(*) FROM m, o WHERE abs(power - median) >= 2) AS odd_magnitude FROM s""")
def _(t):
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("double")
    w = F.when(k % 41 == 0, None).when(k % 43 == 0, F.lit(float("nan"))).when(k % 47 == 0, q * 1000).when(k % 53 == 0, F.lit(0.0)).otherwise(-q)
    return quality.point_grid_audit(t("lineitem").select(F.col("l_suppkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), w.alias("w")))


@query("o3_year_rules", "WITH y AS (SELECT n_nationkey AS ordinal, n_name AS raster_id, CAST(1890 + n_nationkey * 20 % 220 AS INTEGER) AS year FROM nation), m AS (SELECT *, count(*) OVER (PARTITION BY year) AS n, lag(year) OVER (ORDER BY ordinal) AS b FROM y) SELECT 'year_out_of_range' AS rule, raster_id AS entity FROM m WHERE NOT year BETWEEN 1900 AND 2200 UNION ALL SELECT 'year_repeated', raster_id FROM m WHERE n > 1 UNION ALL SELECT 'not_chronological', raster_id FROM m WHERE year < b")
def _(t):
    return quality.year_rules(t("nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("raster_id"), (F.lit(1890) + F.col("n_nationkey") * 20 % 220).cast("int").alias("year")))
