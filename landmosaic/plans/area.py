"""Queries of change, accuracy and carbon."""

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.expressions import non_negative
from ..operators import accuracy, carbon, change
from ..operators.ordering import shared_dir
from ..operators.stats import melt
from ..schemas import class_scheme
from ..sources import rasters
from .registry import CELL_M2, query

HA = "pixel_count * 0.09 AS area_ha"
CONFUSION = """c AS (SELECT CAST(t1 AS VARCHAR) AS reference, CAST(p1 AS VARCHAR) AS prediction, count(*) AS n FROM g GROUP BY ALL),
l AS (SELECT DISTINCT reference AS label FROM c UNION SELECT DISTINCT prediction FROM c),
m AS (SELECT a.label AS reference, b.label AS prediction, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.reference = a.label AND c.prediction = b.label),
k AS (SELECT label, CAST(sum(CASE WHEN reference = label THEN n ELSE 0 END) AS BIGINT) AS support, CAST(sum(CASE WHEN prediction = label THEN n ELSE 0 END) AS BIGINT) AS predicted,
  CAST(sum(CASE WHEN reference = label AND prediction = label THEN n ELSE 0 END) AS BIGINT) AS correct FROM l, m GROUP BY label),
s AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE correct / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE correct / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * correct / (support + predicted) END AS f1, CASE WHEN support + predicted - correct = 0 THEN 0.0 ELSE correct / (support + predicted - correct) END AS iou FROM k)"""
MATRIX = "mx AS (SELECT t0 AS source, t1 AS target, count(*) AS pixel_count FROM g GROUP BY ALL)"
CHANGE = MATRIX + """, ch AS (SELECT class, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(loss) AS BIGINT) AS loss FROM (
  SELECT target AS class, CASE WHEN source <> target THEN pixel_count ELSE 0 END AS gain, 0 AS loss FROM mx
  UNION ALL SELECT source, 0, CASE WHEN source <> target THEN pixel_count ELSE 0 END FROM mx) GROUP BY class)"""


@query("a1_transition_matrix", f"SELECT t0 AS source, t1 AS target, count(*) AS pixel_count, {HA} FROM g WHERE t0 <> 6 AND t1 <> 6 GROUP BY ALL", "area_ha")
def _(t):
    scheme = class_scheme(t.spark).where("code <> 6")
    return change.transition_matrix(t.cells("t0"), t.cells("t1"), CELL_M2, scheme)


@query("j1_common_cells", "SELECT a.row, a.col, a.t0 AS source, b.t1 AS target FROM g a JOIN g b ON a.row = b.row AND a.col = b.col WHERE a.k % 7 <> 0 AND b.k % 11 <> 0")
def _(t):
    return change.pair(t.cells("t0", "k").where("k % 7 <> 0"), t.cells("t1", "k").where("k % 11 <> 0"))


@query("j1_bucketed_transitions", "SELECT t0 AS source, t1 AS target, count(*) AS pixel_count, count(*) * 0.09 AS area_ha FROM g GROUP BY ALL", "area_ha")
def _(t):
    """Two rasters stored in buckets by cell: their join shuffles neither."""
    told = []
    for layer in ("t0", "t1"):
        name = f"raster_{uuid4().hex}"
        path = f"{shared_dir(t.spark)}/{name}"
        rasters.write_raster(t.cells(layer), name, path, 8)
        told.append(rasters.read_raster(t.spark, name, path, "bigint", 8))
    return change.transition_matrix(*told, CELL_M2)


@query("p2_in_scheme", "SELECT row, col, t0 AS source, t1 AS target FROM g WHERE t0 <> 6 AND t1 <> 6")
def _(t):
    return change.in_scheme(change.pair(t.cells("t0"), t.cells("t1")), class_scheme(t.spark).where("code <> 6"))


@query("a1_combine", f"SELECT t0, t1, p1, count(*) AS pixel_count, {HA} FROM g GROUP BY ALL", "area_ha")
def _(t):
    return change.combine({n: t.cells(n) for n in ("t0", "t1", "p1")}, CELL_M2)


@query("a2_class_area", "WITH n AS (SELECT x AS value, count(g.k) AS pixel_count FROM range(1, 8) r(x) LEFT JOIN g ON g.t0 = x GROUP BY ALL) SELECT value, pixel_count, pixel_count * 900.0 AS area_m2, pixel_count * 0.09 AS area_ha, pixel_count * 0.0009 AS area_km2, pixel_count * 100.0 / sum(pixel_count) OVER () AS percent FROM n", "area_m2 area_ha area_km2 percent")
def _(t):
    from ..schemas import SIX_CLASSES

    return change.class_area(t.cells("t0"), CELL_M2, class_scheme(t.spark, SIX_CLASSES | {7: "wetland"}))


@query("a3_tabulate_area", f"SELECT p1 AS zone, t0 AS value, count(*) AS pixel_count, {HA} FROM g GROUP BY ALL", "area_ha")
def _(t):
    return change.tabulate_area(t.cells("t0"), t.cells("p1"), CELL_M2)


@query("j9_period_transitions", f"""SELECT 2020 AS year, 2025 AS next_year, CAST(t0 AS DOUBLE) AS source, CAST(t1 AS DOUBLE) AS target, count(*) AS pixel_count, {HA} FROM g GROUP BY ALL
UNION ALL SELECT 2025, 2030, CAST(t1 AS DOUBLE), CAST(p1 AS DOUBLE), count(*) AS pixel_count, {HA} FROM g GROUP BY ALL""", "area_ha")
def _(t):
    series = t.spark.createDataFrame([("t0", 2020), ("t1", 2025), ("p1", 2030)], "raster_id string, year int")
    return change.period_transitions(t.stack(), series, CELL_M2)


@query("w6_next_period", "SELECT o_orderpriority AS source_id, year, lead(o_orderpriority) OVER w AS target_id, lead(year) OVER w AS next_year FROM (SELECT o_orderpriority, CAST(2000 + substr(o_orderpriority, 1, 1)::INT * 5 AS INTEGER) AS year FROM orders GROUP BY ALL) WINDOW w AS (ORDER BY year) QUALIFY target_id IS NOT NULL")
def _(t):
    dated = t("orders").select(F.col("o_orderpriority").alias("raster_id"), (2000 + F.substring("o_orderpriority", 1, 1).cast("int") * 5).alias("year")).distinct()
    return change.adjacent_periods(dated)


@query("a43_class_change", f"WITH {CHANGE} SELECT class, gain, loss, gain - loss AS net, 2 * least(gain, loss) AS swap FROM ch")
def _(t):
    return change.class_change(change.transition_matrix(t.cells("t0"), t.cells("t1"), CELL_M2))


@query("a39_markov", f"WITH {MATRIX} SELECT source, target, pixel_count / sum(pixel_count) OVER (PARTITION BY source) AS probability FROM mx", "probability")
def _(t):
    return change.markov(change.transition_matrix(t.cells("t0"), t.cells("t1"), CELL_M2))


@query("a39_demand", f"WITH {MATRIX}, p AS (SELECT source, target, pixel_count / sum(pixel_count) OVER (PARTITION BY source) AS probability FROM mx), a AS (SELECT t1 AS source, count(*) * 0.09 AS area_ha FROM g GROUP BY t1) SELECT target, sum(area_ha * probability) AS demand_ha FROM p JOIN a USING (source) GROUP BY target", "demand_ha")
def _(t):
    return change.project_demand(change.class_area(t.cells("t1"), CELL_M2), change.markov(change.transition_matrix(t.cells("t0"), t.cells("t1"), CELL_M2)))


@query("a40_demand_conserved", "WITH d AS (SELECT scenario, count(*) AS demand_cells FROM g GROUP BY scenario), n AS (SELECT count(*) // 4 AS valid_cells FROM g) SELECT scenario, demand_cells, valid_cells, demand_cells = valid_cells AS conserved FROM d, n")
def _(t):
    demand = t.g.groupBy("scenario", "t1").agg(F.count("*").alias("pixel_count"))
    return change.demand_conserved(demand, t.g.agg(F.expr("count(*) div 4").alias("valid_cells")))


@query("q18_reachable_demand", f"WITH {CHANGE} SELECT class, 'no_allowed_source' AS rule FROM ch WHERE gain > loss AND class NOT IN (2, 3) UNION ALL SELECT class, 'no_allowed_target' FROM ch WHERE gain < loss AND class NOT IN (1, 3)")
def _(t):
    allowed = t.spark.createDataFrame([(1, 2), (3, 3)], "source long, target long")
    return change.reachable_demand(change.class_change(change.transition_matrix(t.cells("t0"), t.cells("t1"), CELL_M2)), allowed)


@query("a10_confusion", f"WITH {CONFUSION} SELECT * FROM m")
def _(t):
    return accuracy.confusion(t.g, "t1", "p1")


@query("a10_confusion_wide", "SELECT CAST(t1 AS VARCHAR) AS reference, " + ", ".join(f"count(*) FILTER (p1 = {k}) AS \"{k}\"" for k in range(1, 7)) + " FROM g GROUP BY t1")
def _(t):
    return accuracy.confusion_wide(t.g, [str(k) for k in range(1, 7)], "t1", "p1")


@query("a11_class_metrics", f"WITH {CONFUSION} SELECT * FROM s", "precision recall f1 iou")
def _(t):
    return accuracy.class_metrics(accuracy.confusion(t.g, "t1", "p1"))


@query("a11_label_metrics", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS r, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT r AS label FROM c UNION SELECT p FROM c),
k AS (SELECT label, CAST(sum(CASE WHEN r = label THEN n ELSE 0 END) AS BIGINT) AS support, CAST(sum(CASE WHEN p = label THEN n ELSE 0 END) AS BIGINT) AS predicted, CAST(sum(CASE WHEN r = label AND p = label THEN n ELSE 0 END) AS BIGINT) AS correct FROM l, c GROUP BY label)
SELECT *, coalesce(correct / nullif(predicted, 0), 0.0) AS precision, coalesce(correct / nullif(support, 0), 0.0) AS recall, coalesce(2.0 * correct / nullif(support + predicted, 0), 0.0) AS f1, coalesce(correct / nullif(support + predicted - correct, 0), 0.0) AS iou FROM k""", "precision recall f1 iou")
def _(t):
    return accuracy.class_metrics(accuracy.confusion(t("labels"), "quality", "toxic"))


@query("a12_a13_overall_metrics", f"""WITH {CONFUSION}, o AS (SELECT sum(support) AS n, sum(correct) AS hits, avg(f1) AS macro_f1, avg(iou) AS macro_iou, sum(support * predicted) AS chance, sum(abs(support - predicted)) AS off FROM s)
SELECT CAST(n AS BIGINT) AS n, hits / n AS overall_accuracy, macro_f1, macro_iou, (hits / n - chance / (n * n)) / (1 - chance / (n * n)) AS kappa, off / (2 * n) AS quantity_disagreement, 1 - hits / n - off / (2 * n) AS allocation_disagreement FROM o""", "overall_accuracy macro_f1 macro_iou kappa quantity_disagreement allocation_disagreement")
def _(t):
    return accuracy.overall_metrics(accuracy.confusion(t.g, "t1", "p1"))


@query("a12_producer_user", f"WITH {CONFUSION} SELECT label, recall AS producers_accuracy, precision AS users_accuracy FROM s", "producers_accuracy users_accuracy")
def _(t):
    return accuracy.producer_user(accuracy.confusion(t.g, "t1", "p1"))


FOM = "count(*) FILTER (t1 <> t0) AS observed_change, count(*) FILTER (s <> t0) AS predicted_change, count(*) FILTER (t1 <> t0 AND s = t1) AS correct_change, CASE WHEN count(*) FILTER (t1 <> t0 OR s <> t0) = 0 THEN 1.0 ELSE count(*) FILTER (t1 <> t0 AND s = t1) / count(*) FILTER (t1 <> t0 OR s <> t0) END AS figure_of_merit"
SEEDS = "runs AS (SELECT *, p1 AS s, 11 AS seed FROM g UNION ALL SELECT *, CASE WHEN k % 3 = 0 THEN t1 ELSE p1 END, 29 FROM g UNION ALL SELECT *, CASE WHEN k % 7 = 0 THEN t1 ELSE t0 END, 47 FROM g WHERE k % 10 <> 1)"


def _runs(t):
    """Three simulations told apart by seed, one of them with its own NoData."""
    one = F.struct(F.lit(11).alias("seed"), F.col("p1").alias("value"))
    two = F.struct(F.lit(29).alias("seed"), F.expr("CASE WHEN k % 3 = 0 THEN t1 ELSE p1 END").alias("value"))
    three = F.struct(F.lit(47).alias("seed"), F.expr("CASE WHEN k % 10 = 1 THEN NULL WHEN k % 7 = 0 THEN t1 ELSE t0 END").alias("value"))
    return t.g.select("row", "col", F.inline(F.array(one, two, three))).where("value IS NOT NULL")


@query("a14_figure_of_merit", f"SELECT {FOM.replace('s <>', 'p1 <>').replace('s = t1', 'p1 = t1')} FROM g", "figure_of_merit")
def _(t):
    return accuracy.figure_of_merit(t.cells("t0"), t.cells("t1"), t.cells("p1"))


@query("a15_merit_by_seed", f"WITH {SEEDS} SELECT seed, {FOM} FROM runs GROUP BY seed", "figure_of_merit")
def _(t):
    return accuracy.figure_of_merit(t.cells("t0"), t.cells("t1"), _runs(t), ["seed"])


@query("a15_merit_spread", f"WITH {SEEDS}, f AS (SELECT seed, {FOM} FROM runs GROUP BY seed) SELECT count(*) AS seeds, avg(figure_of_merit) AS mean_fom, stddev_pop(figure_of_merit) AS stddev_fom FROM f", "mean_fom stddev_fom")
def _(t):
    return accuracy.merit_spread(accuracy.figure_of_merit(t.cells("t0"), t.cells("t1"), _runs(t), ["seed"]))


@query("a16_ensemble", f"WITH {SEEDS}, c AS (SELECT row, col, s, count(*) AS n FROM runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, s) AS rn, sum(n) OVER (PARTITION BY row, col) AS runs FROM c) SELECT row, col, s AS consensus, n / runs AS agreement, 1 - n / runs AS uncertainty FROM r WHERE rn = 1", "agreement uncertainty")
def _(t):
    return accuracy.ensemble(_runs(t))


@query("a17_consistency", "WITH d AS (SELECT v AS x, v * (1 + (k % 3 - 1) * 0.001) AS y FROM g) SELECT count(*) AS common_cells, sum(x) AS total_a, sum(y) AS total_b, abs(sum(x) - sum(y)) / greatest(abs(sum(y)), 1e-12) AS relative_difference, sqrt(avg((x - y) * (x - y))) AS rmse, max(abs(x - y)) AS max_difference, abs(sum(x) - sum(y)) / greatest(abs(sum(y)), 1e-12) <= 0.001 AS passed FROM d", "total_a total_b relative_difference rmse max_difference", 3)
def _(t):
    other = t.g.select("row", "col", (F.col("v") * (1 + (F.col("k") % 3 - 1) * 0.001)).alias("value"))
    return accuracy.consistency(t.cells("v"), other)


@query("a45_adjusted_area", f"""WITH {CONFUSION}, a AS (SELECT CAST(p1 AS VARCHAR) AS prediction, count(*) * 0.09 AS area_ha FROM g GROUP BY ALL),
p AS (SELECT reference, prediction, n / sum(n) OVER (PARTITION BY prediction) AS p, sum(n) OVER (PARTITION BY prediction) AS n_i FROM m),
j AS (SELECT p.*, area_ha, (SELECT sum(area_ha) FROM a) AS all_ha FROM p JOIN a USING (prediction))
SELECT reference AS label, sum(p * area_ha) AS area_ha, 1.96 * max(all_ha) * sqrt(sum((area_ha / all_ha) * (area_ha / all_ha) * p * (1 - p) / (n_i - 1))) AS ci95_ha FROM j GROUP BY reference""", "area_ha ci95_ha")
def _(t):
    mapped = t.g.groupBy(F.col("p1").cast("string").alias("label")).agg((F.count("*") * 0.09).alias("area_ha"))
    return accuracy.adjusted_area(accuracy.confusion(t.g, "t1", "p1"), mapped)


STOCK = """n AS (SELECT scenario, t1 AS value, count(*) * 0.09 AS area_ha FROM g GROUP BY ALL), st AS (SELECT scenario, value, area_ha, area_ha * (c_above + c_below + c_soil + c_dead) AS carbon_t FROM n JOIN pools ON value = lucode),
ct AS (SELECT scenario, value, area_ha, carbon_t FROM st UNION ALL SELECT scenario, NULL, sum(area_ha), sum(carbon_t) FROM st GROUP BY scenario)"""


@query("a18_carbon_stock", f"WITH {STOCK} SELECT * FROM ct", "area_ha carbon_t")
def _(t):
    return carbon.carbon_stock(t.cells("t1", "scenario"), t.pools, CELL_M2)


@query("j3_pool_lookup", "SELECT scenario, t1 AS value, count(*) AS pixel_count FROM g WHERE t1 NOT IN (SELECT lucode FROM pools WHERE c_soil > 15) GROUP BY ALL")
def _(t):
    return carbon.missing_pools(t.cells("t1", "scenario"), t.pools.where("c_soil > 15"))


@query("a19_carbon_change", f"WITH {STOCK} SELECT scenario, carbon_t, carbon_t - b AS change_t, 100 * (carbon_t - b) / b AS change_percent FROM ct, (SELECT carbon_t AS b FROM ct WHERE value IS NULL AND scenario = 'ND') WHERE value IS NULL", "carbon_t change_t change_percent")
def _(t):
    return carbon.carbon_change(carbon.carbon_stock(t.cells("t1", "scenario"), t.pools, CELL_M2), "ND")


WATER = "w AS (SELECT *, 200000.0 - (v - (k % 50) * 1000.0) AS deep FROM g WHERE v - (k % 50) * 1000.0 < 200000.0)"


def _dem_depth(t):
    return t.cells("v"), t.g.select("row", "col", ((F.col("k") % 50) * 1000.0).alias("value"))


@query("a20_water_volume", f"WITH {WATER} SELECT count(*) AS cells, count(*) * 0.09 AS area_ha, coalesce(sum(deep), 0) * 900.0 AS volume_m3 FROM w WHERE t0 <> 2", "area_ha volume_m3", 1)
def _(t):
    return carbon.water_volume(*_dem_depth(t), 200_000.0, CELL_M2, t.cells("t0").where("value <> 2"))


@query("a21_composite_carbon", """SELECT s_suppkey AS site_id, s_nationkey AS year, s_w * 10 / 1e6 AS water_t, 2.0 * s_nationkey AS vegetation_t, 3.0 * 20 AS sediment_t, s_w * 10 / 1e6 + 2.0 * s_nationkey + 60 AS composite_t FROM (SELECT *, abs(s_acctbal) * 1000 AS s_w FROM supplier)""", "water_t vegetation_t sediment_t composite_t")
def _(t):
    lit = lambda x, n: F.lit(float(x)).alias(n)
    sites = t("supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("year"), (F.abs("s_acctbal") * 1000).alias("water_volume_m3"), lit(10, "water_carbon_density_g_c_m3"), F.col("s_nationkey").cast("double").alias("vegetation_area_ha"), lit(2, "vegetation_density_t_c_ha"), lit(3, "sediment_area_ha"), lit(20, "sediment_density_t_c_ha"))
    return carbon.composite_carbon(sites)


@query("a21_composite_from_cells", f"WITH {WATER}, s AS (SELECT coalesce(sum(deep), 0) AS deep, count(*) FILTER (t0 = 4 AND deep <= 50000) AS plants, count(*) FILTER (t1 = 5) AS mud FROM w) SELECT deep * 900.0 * 0.001 / 1e6 AS water_t, plants * 0.09 * 10 AS vegetation_t, mud * 0.09 * 100 AS sediment_t, deep * 900.0 * 0.001 / 1e6 + plants * 0.09 * 10 + mud * 0.09 * 100 AS composite_t FROM s", "water_t vegetation_t sediment_t composite_t")
def _(t):
    return carbon.composite_from_cells(*_dem_depth(t), 200_000.0, CELL_M2, (0.001, 10.0, 100.0), t.cells("t0").where("value = 4"), t.cells("t1").where("value = 5"), 50_000.0)


@query("a22_replaced_total", "SELECT c_custkey, abs(c_acctbal) + 500 - abs(c_acctbal) / 2 + 10 AS total_t FROM customer", "total_t")
def _(t):
    x = F.abs("c_acctbal")
    return t("customer").select("c_custkey", carbon.replaced_total(x + 500, x / 2, non_negative(F.lit(10.0), "composite")).alias("total_t"))


@query("a23_class_evidence", "SELECT count(*) FILTER (t1 = 5) AS cells, count(*) FILTER (t1 = 5) * 900.0 AS area_m2 FROM g", "area_m2")
def _(t):
    return carbon.class_evidence(t.cells("t1"), 5, CELL_M2)


@query("a38_density_statistics", "SELECT l_linenumber AS lucode, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS stddev, avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS low, avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)) AS high FROM lineitem GROUP BY ALL", "mean stddev low high")
def _(t):
    return carbon.density_statistics(t("lineitem").select(F.col("l_linenumber").alias("lucode"), F.col("l_quantity").alias("density")))


@query("a38_rank_stability", """WITH d AS (SELECT scenario, variant, sum(0.09 * (c_above + c_below + c_soil + c_dead) * f) AS carbon_t FROM g JOIN pools ON t1 = lucode, (VALUES ('low', 0.8), ('central', 1.0), ('high', 1.25)) x(variant, f) GROUP BY ALL)
SELECT scenario, variant, carbon_t, CAST(row_number() OVER (PARTITION BY variant ORDER BY round(carbon_t, 6) DESC, scenario) AS INTEGER) AS rank FROM d""", "carbon_t")
def _(t):
    from pyspark.sql import Window

    totals = carbon.carbon_stock(t.cells("t1", "scenario"), t.pools, CELL_M2).where("value IS NULL")
    c = F.col("carbon_t")
    variants = melt(totals.select("scenario", (c * 0.8).alias("low"), c.alias("central"), (c * 1.25).alias("high")), ["scenario"], ["low", "central", "high"])
    ranked = variants.select("scenario", F.col("field").alias("variant"), F.col("value").alias("carbon_t"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc(F.round("carbon_t", 6)), "scenario")))
