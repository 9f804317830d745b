"""Queries of grid operations, units and per-cell classification."""

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import classify, grid, units
from .registry import CELL_M2, TRANSFORM, query

X = "500000.0 + (col + 0.5) * 30"
Y = "3700000.0 - (row + 0.5) * 30"


@query("p7_cell_centres", f"SELECT row, col, {X} AS x, {Y} AS y, CAST(floor(({X} - 500000.0) / 30) AS BIGINT) AS back_col, CAST(floor(({Y} - 3700000.0) / -30) AS BIGINT) AS back_row FROM g", "x y")
def _(t):
    xy = t.g.select("row", "col", E.centre_x("col", TRANSFORM).alias("x"), E.centre_y("row", TRANSFORM).alias("y"))
    return xy.select("*", E.cell_col("x", TRANSFORM).alias("back_col"), E.cell_row("y", TRANSFORM).alias("back_row"))


@query("p8_sample", "SELECT row, col, v AS value FROM g WHERE row % 5 = 0 AND col % 5 = 0", "value")
def _(t):
    return grid.sample(t.cells("v"), 5)


@query("p9_remap", "SELECT row, col, CASE t0 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 2 WHEN 5 THEN 2 END AS value FROM g")
def _(t):
    return t.g.select("row", "col", E.remap("t0", {1: 3, 2: 4, 3: 5, 4: 2, 5: 2}).alias("value"))


@query("j2_sample_at_points", "WITH p AS (SELECT c_custkey AS point_id, 500000.0 + c_custkey % 90 * 31 AS x, 3700000.0 - c_custkey // 90 * 33 AS y FROM customer) SELECT point_id, CAST(floor((y - 3700000.0) / -30) AS BIGINT) AS row, CAST(floor((x - 500000.0) / 30) AS BIGINT) AS col, t0 AS prediction FROM p LEFT JOIN g ON row = floor((y - 3700000.0) / -30) AND col = floor((x - 500000.0) / 30)")
def _(t):
    points = t("customer").selectExpr("c_custkey AS point_id", "500000.0D + c_custkey % 90 * 31 AS x", "3700000.0D - c_custkey div 90 * 33 AS y")
    return grid.sample_at_points(points, t.cells("t0"), TRANSFORM, "prediction").select("point_id", "row", "col", "prediction")


#: Points of lineitem, and a grid that nine tenths of their extent fill.
POINTS = "e AS (SELECT max(l_partkey) * 9 // 300 AS h, max(l_suppkey) * 36 // 30 AS w FROM lineitem), p AS (SELECT CAST(floor(l_partkey / 30.0) AS BIGINT) AS row, CAST(floor(l_suppkey * 40 / 30.0) AS BIGINT) AS col, l_quantity AS q, h, w FROM lineitem, e)"


def _rasterised(t):
    line = t("lineitem")
    h, w = line.agg(F.expr("max(l_partkey) * 9 div 300"), F.expr("max(l_suppkey) * 36 div 30")).first()
    return grid.rasterise_points(line.selectExpr("500000.0D + l_suppkey * 40 AS x", "3700000.0D - l_partkey AS y", "l_quantity AS value"), TRANSFORM, w or 0, h or 0)


@query("a8_rasterise_points", f"WITH {POINTS} SELECT row, col, avg(q) AS value FROM p WHERE row < h AND col < w GROUP BY ALL", "value")
def _(t):
    return _rasterised(t)[0]


@query("a8_points_outside", f"WITH {POINTS} SELECT count(*) FILTER (NOT (row < h AND col < w)) AS outside FROM p")
def _(t):
    return _rasterised(t)[1]


@query("a6_majority", "WITH c AS (SELECT row // 3 AS row, col // 3 AS col, t0 AS value, count(*) AS n FROM g GROUP BY ALL) SELECT row, col, value FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1")
def _(t):
    return grid.majority(t.cells("t0"), 3)


@query("a41_coarsen_sum", "SELECT row // 4 AS row, col // 4 AS col, sum(v) AS value FROM g GROUP BY ALL", "value", 3)
def _(t):
    return grid.coarsen(t.cells("v"), 4, "sum")


@query("a41_coarsen_mean", "SELECT row // 4 AS row, col // 4 AS col, avg(v) AS value FROM g GROUP BY ALL", "value", 3)
def _(t):
    return grid.coarsen(t.cells("v"), 4, "mean")


@query("a44_over_years", "SELECT row, col, year, avg(v) AS value FROM (SELECT row // 10 AS row, col, 2020 + k % 3 AS year, v FROM g) GROUP BY ALL", "value")
def _(t):
    return grid.over_years(t.g.selectExpr("row div 10 AS row", "col", "2020 + k % 3 AS year", "v AS value"))


TARGET = [50.0, 0.0, 500_000.0, 0.0, -50.0, 3_700_000.0]
TG = "tg AS (SELECT r.row, c.x AS col, (r.row + 0.5) * 50 / 30 AS fy, (c.x + 0.5) * 50 / 30 AS fx FROM (SELECT unnest(range(0, CAST(ceil((max(o_orderkey) // 100 + 1) * 30 / 50.0) AS BIGINT))) AS row FROM orders) r, range(60) c(x))"


def _target(t):
    """Cells of 50 m over the whole grid."""
    height = (t("orders").agg(F.max("o_orderkey")).first()[0] or 0) // 100 + 1
    return grid.target_grid((500_000.0, 3_700_000.0 - height * 30.0, 503_000.0, 3_700_000.0), 50.0, t.spark)


@query("j14_regrid_nearest", f"WITH {TG} SELECT tg.row, tg.col, t0 AS value FROM tg JOIN g ON g.row = floor(fy) AND g.col = floor(fx)")
def _(t):
    return grid.regrid(t.cells("t0"), _target(t), TRANSFORM, TARGET, "nearest")


@query("j14_regrid_bilinear", f"""WITH {TG}, p AS (SELECT row, col, floor(fy - 0.5) AS r0, floor(fx - 0.5) AS c0, fy - 0.5 - floor(fy - 0.5) AS v, fx - 0.5 - floor(fx - 0.5) AS u FROM tg),
n AS (SELECT p.row, p.col, (CASE WHEN i.x = 0 THEN 1 - p.v ELSE p.v END) * (CASE WHEN j.x = 0 THEN 1 - p.u ELSE p.u END) AS w, g.v AS value FROM p, range(2) i(x), range(2) j(x), g WHERE g.row = r0 + i.x AND g.col = c0 + j.x)
SELECT row, col, sum(w * value) / sum(w) AS value FROM n GROUP BY ALL HAVING abs(sum(w)) > 1e-9""", "value", 3)
def _(t):
    return grid.regrid(t.cells("v"), _target(t), TRANSFORM, TARGET, "bilinear")


@query("j14_regrid_cubic", f"""WITH {TG}, p AS (SELECT row, col, floor(fy - 0.5) AS r0, floor(fx - 0.5) AS c0, fy - 0.5 - floor(fy - 0.5) AS v, fx - 0.5 - floor(fx - 0.5) AS u FROM tg),
w AS (SELECT *, [-0.5*u+u*u-0.5*u*u*u, 1-2.5*u*u+1.5*u*u*u, 0.5*u+2*u*u-1.5*u*u*u, -0.5*u*u+0.5*u*u*u] AS wu, [-0.5*v+v*v-0.5*v*v*v, 1-2.5*v*v+1.5*v*v*v, 0.5*v+2*v*v-1.5*v*v*v, -0.5*v*v+0.5*v*v*v] AS wv FROM p),
n AS (SELECT w.row, w.col, wv[CAST(i.x + 2 AS INT)] * wu[CAST(j.x + 2 AS INT)] AS w, g.v AS value FROM w, range(-1, 3) i(x), range(-1, 3) j(x), g WHERE g.row = r0 + i.x AND g.col = c0 + j.x)
SELECT row, col, sum(w * value) / sum(w) AS value FROM n GROUP BY ALL HAVING abs(sum(w)) > 1e-9""", "value", 2)
def _(t):
    return grid.regrid(t.cells("v"), _target(t), TRANSFORM, TARGET, "cubic")


@query("j14_regrid_majority", "WITH c AS (SELECT CAST(floor((row + 0.5) * 30 / 50) AS BIGINT) AS row, CAST(floor((col + 0.5) * 30 / 50) AS BIGINT) AS col, t0 AS value, count(*) AS n FROM g GROUP BY ALL) SELECT row, col, value FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1")
def _(t):
    return grid.regrid(t.cells("t0"), _target(t), TRANSFORM, TARGET, "majority")


@query("j14_regrid_masked", f"WITH {TG} SELECT tg.row, tg.col, t0 AS value FROM tg JOIN g ON g.row = floor(fy) AND g.col = floor(fx) WHERE (tg.row + tg.col) % 3 = 0")
def _(t):
    target = _target(t)
    return grid.regrid(t.cells("t0"), target, TRANSFORM, TARGET, "nearest", target.where("(row + col) % 3 = 0"))


KNOWN = "kn AS (SELECT row AS kr, col AS kc, v AS kv FROM g WHERE k % 37 = 0)"
PAIRS = f"{KNOWN}, mi AS (SELECT row, col FROM g WHERE k % 37 <> 0), pr AS (SELECT row, col, kr, kc, kv, (row - kr) * (row - kr) + (col - kc) * (col - kc) AS d2 FROM mi JOIN kn ON kr BETWEEN row - 3 AND row + 3 AND kc BETWEEN col - 3 AND col + 3)"


def _known(t):
    return t.g.where("k % 37 = 0").select("row", "col", F.col("v").alias("value"))


@query("j12_nearest_fill", f"WITH {PAIRS}, b AS (SELECT row, col, kv AS value FROM pr WHERE sqrt(d2) * 30 <= 90 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d2, kr, kc) = 1) SELECT row, col, value FROM b UNION ALL SELECT kr, kc, kv FROM kn", "value")
def _(t):
    return grid.nearest_fill(_known(t), t.cells("v"), 30.0, 90.0)


#: Sources lie in every 20th row, 97 columns apart: far ones need several rounds, and some are within no fixed reach.
FAR = "kn AS (SELECT row AS kr, col AS kc, v AS kv FROM g WHERE row % 20 = 3 AND k % 97 = 5)"


@query("j13_distance_to_source", f"WITH {FAR} SELECT row, col, sqrt(min((row - kr) * (row - kr) + (col - kc) * (col - kc))) * 30 AS distance FROM g, kn GROUP BY ALL", "distance")
def _(t):
    return grid.distance_to_source(t.cells("t0"), t.g.where("row % 20 = 3 AND k % 97 = 5").select("row", "col"), 30.0)


@query("j13_distance_within", f"WITH {KNOWN} SELECT row, col, sqrt(min((row - kr) * (row - kr) + (col - kc) * (col - kc))) * 30 AS distance FROM g JOIN kn ON kr BETWEEN row - 4 AND row + 4 AND kc BETWEEN col - 4 AND col + 4 GROUP BY ALL HAVING sqrt(min((row - kr) * (row - kr) + (col - kc) * (col - kc))) * 30 <= 120", "distance")
def _(t):
    return grid.distance_to_source(t.cells("t0"), _known(t), 30.0, 120.0)


@query("m8_inverse_distance", f"""WITH {KNOWN}, pr AS (SELECT row, col, kr, kc, kv, (row - kr) * (row - kr) + (col - kc) * (col - kc) AS d2 FROM g JOIN kn ON kr BETWEEN row - 60 AND row + 60),
b AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d2, kr, kc) <= 12)
SELECT row, col, coalesce(max(kv) FILTER (d2 = 0), sum(kv / d2) FILTER (d2 > 0) / sum(1.0 / d2) FILTER (d2 > 0)) AS value FROM b GROUP BY ALL""", "value", 3)
def _(t):
    return grid.inverse_distance(_known(t), t.cells("v"))


NEAR = "nb AS (SELECT g.row - i.x AS row, g.col - j.x AS col, i.x AS i, j.x AS j, v, t1 FROM g, range(-1, 2) i(x), range(-1, 2) j(x))"


@query("w7_slope_aspect", f"""WITH {NEAR}, s AS (SELECT row, col, sum(j * CASE WHEN i = 0 THEN 2 ELSE 1 END * v) / 240 AS dx, sum(i * CASE WHEN j = 0 THEN 2 ELSE 1 END * v) / 240 AS dy FROM nb GROUP BY ALL HAVING count(*) = 9), a AS (SELECT *, degrees(atan2(dy, -dx)) AS turn FROM s)
SELECT row, col, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN -1 WHEN turn < 0 THEN 90 - turn WHEN turn > 90 THEN 450 - turn ELSE 90 - turn END AS aspect FROM a""", "slope aspect")
def _(t):
    return grid.slope_aspect(t.cells("v"), 30.0)


@query("p14_northness_eastness", "SELECT k, CASE WHEN k % 11 <> 0 THEN cos(radians(CAST(k % 360 AS DOUBLE))) END AS northness, CASE WHEN k % 11 <> 0 THEN sin(radians(CAST(k % 360 AS DOUBLE))) END AS eastness FROM g", "northness eastness")
def _(t):
    aspects = t.g.select("k", F.when(F.col("k") % 11 == 0, F.lit(-1.0)).otherwise((F.col("k") % 360).cast("double")).alias("aspect"))
    return aspects.select("k", E.northness("aspect").alias("northness"), E.eastness("aspect").alias("eastness"))


@query("w8_smooth", f"WITH {NEAR}, c AS (SELECT row, col, t1 AS value, count(*) AS n FROM nb GROUP BY ALL), b AS (SELECT row, col, value FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1) SELECT b.* FROM b SEMI JOIN g ON g.row = b.row AND g.col = b.col")
def _(t):
    return grid.smooth(t.cells("t1"))


#: Diamonds over the whole grid, each with a hole and a further part 1500 m beside it.
SHAPES = "d AS (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders), p AS (SELECT s_suppkey AS f, 500000.0 + s_suppkey * 28 % 1400 AS x, 3700000.0 - s_suppkey * 7919 % h * 30 AS y, 203.3 + s_suppkey % 7 * 10 AS r FROM supplier, d)"


@query("j10_in_polygons", f"WITH {SHAPES}, c AS (SELECT f, r, row, col, abs({X} - x) + abs({Y} - y) AS one, abs({X} - x - 1500) + abs({Y} - y) AS two FROM g JOIN p ON {Y} BETWEEN y - r AND y + r) SELECT f AS feature_id, row, col FROM c WHERE one < r AND one > r / 2 OR two < r / 3")
def _(t):
    h = (t("orders").agg(F.max("o_orderkey")).first()[0] or 0) // 100 + 1
    a = t("supplier").selectExpr("s_suppkey AS feature_id", "500000.0D + s_suppkey * 28 % 1400 AS x", f"3700000.0D - s_suppkey * 7919 % {h} * 30 AS y", "203.3D + s_suppkey % 7 * 10 AS r")
    diamond = lambda x, r: f"array(array({x} - {r}, y), array({x}, y + {r}), array({x} + {r}, y), array({x}, y - {r}), array({x} - {r}, y))"
    shapes = a.selectExpr("feature_id", f"array({diamond('x', 'r')}, {diamond('x', 'r / 2')}, {diamond('(x + 1500)', 'r / 3')}) AS rings")
    return grid.in_polygons(t.cells("t0"), shapes, TRANSFORM)


@query("a7_zonal_metrics", "SELECT t0 AS zone, count(d) AS cell_count, coalesce(sum(d), 0) AS total, count(d) * 0.09 AS area_ha, coalesce(sum(d), 0) * 900 AS volume_m3 FROM (SELECT t0, CASE WHEN k % 9 <> 0 AND t0 <> 4 THEN v / 1000 END AS d FROM g) GROUP BY t0", "total area_ha volume_m3", 3)
def _(t):
    k = F.col("k")
    depth = t.g.select("row", "col", F.when(F.col("t0") == 4, None).when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("v") / 1000).alias("value"))
    return units.zonal_metrics(depth, t.g.select("row", "col", F.col("t0").alias("zone")), CELL_M2)


@query("j11_mask_extraction", "SELECT row, col, v AS value FROM g WHERE t1 = 4", "value")
def _(t):
    return t.cells("v").join(t.cells("t1").where("value = 4").select("row", "col"), ["row", "col"], "left_semi")


@query("p16_depth_bands", "SELECT CAST(floor(v / 50000) AS BIGINT) AS band, count(*) AS cells, count(*) * 0.09 AS area_ha FROM g WHERE v >= 20000 GROUP BY ALL", "area_ha")
def _(t):
    bands = t.g.where("v >= 20000").groupBy(F.floor(F.col("v") / 50_000).alias("band")).agg(F.count("*").alias("cells"))
    return bands.withColumn("area_ha", E.area_ha("cells", CELL_M2))


FIELDS = "f AS (SELECT scenario, 'price' AS field, row, col, v AS value FROM g UNION ALL SELECT scenario, 'depth', row, col, CASE WHEN k % 9 <> 0 THEN v / 1000 END FROM g UNION ALL SELECT scenario, 'class', row, col, CAST(t1 AS DOUBLE) FROM g WHERE row % 40 <> 7)"


def _services(t):
    layer = lambda n, e: F.struct(F.lit(n).alias("field"), F.expr(e).alias("value"))
    layers = F.array(layer("price", "v"), layer("depth", "CASE WHEN k % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v / 1000 END"), layer("class", "CASE WHEN row % 40 = 7 THEN NULL ELSE CAST(t1 AS DOUBLE) END"))
    return t.g.select("scenario", "row", "col", F.inline(layers)).select("scenario", "field", "row", "col", "value")


HOW = {"price": "sum", "depth": "depth_mm_to_m3", "class": "mean"}


@query("a4_scenario_totals", f"WITH {FIELDS} SELECT scenario, field, count(value) AS valid_cells, CASE field WHEN 'price' THEN sum(value) WHEN 'depth' THEN sum(value) * 900 / 1000 ELSE avg(value) END AS total FROM f GROUP BY scenario, field", "total", 3)
def _(t):
    return units.scenario_totals(_services(t), HOW, CELL_M2)


UNITS = "u AS (SELECT scenario, printf('r%05d_c%05d', row // 10, col // 10) AS unit_id, sum(value) FILTER (field = 'price') AS price, sum(value) FILTER (field = 'depth') AS depth, sum(value) FILTER (field = 'class') AS class FROM f GROUP BY ALL)"


@query("a5_unit_totals", f"WITH {FIELDS}, {UNITS} SELECT * FROM u WHERE price IS NOT NULL AND depth IS NOT NULL AND class IS NOT NULL", "price depth class", 3)
def _(t):
    return units.unit_totals(_services(t), ["price", "depth", "class"], 10)


@query("j6_supplement", f"WITH {FIELDS}, {UNITS} SELECT u.scenario, u.unit_id, price, depth, class, x.extra FROM u LEFT JOIN (SELECT printf('r%05d_c%05d', k // 10, k % 10) AS unit_id, k * 1.5 AS extra FROM (SELECT s_suppkey AS k FROM supplier)) x ON x.unit_id = u.unit_id AND u.scenario = 'ND' WHERE price IS NOT NULL AND depth IS NOT NULL AND class IS NOT NULL", "price depth class extra", 3)
def _(t):
    extra = t("supplier").select(F.lit(" nd ").alias("scenario"), F.concat(F.format_string("r%05d_c%05d", F.expr("s_suppkey div 10"), F.col("s_suppkey") % 10), F.lit(" ")).alias("unit_id"), (F.col("s_suppkey") * 1.5).alias("extra"))
    return units.supplement(units.unit_totals(_services(t), ["price", "depth", "class"], 10), extra, ["extra"])


@query("s11_service_table", f"WITH {FIELDS} SELECT scenario, sum(value) FILTER (field = 'price') AS price, sum(value) FILTER (field = 'depth') * 0.9 AS depth, avg(value) FILTER (field = 'class') AS class, 'all' AS unit_id FROM f GROUP BY scenario", "price depth class", 3)
def _(t):
    return units.service_table(_services(t), ["price", "depth", "class"], None, HOW, CELL_M2)


@query("u1_union_of_units", f"WITH {FIELDS} SELECT DISTINCT printf('r%05d_c%05d', row // 10, col // 10) AS unit_id FROM f")
def _(t):
    s = _services(t)
    one = lambda f: s.where(F.col("field") == f).select(E.unit_id("row", "col", 10).alias("unit_id"))
    return one("price").union(one("depth")).union(one("class")).distinct()


@query("u3_valid_in_all", "SELECT row, col FROM g WHERE k % 9 <> 0 AND row % 40 <> 7")
def _(t):
    s = units.valid(_services(t))
    one = lambda f: s.where(F.col("field") == f).select("row", "col")
    return one("price").intersect(one("depth")).intersect(one("class"))


@query("w9_tiles", "WITH r AS (SELECT p_size + 40 AS len, p_partkey AS raster_id FROM part), s AS (SELECT raster_id, len, unnest(list_sort(list_distinct(list_append(range(0, greatest(len - 32, 0) + 1, 24), greatest(len - 32, 0))))) AS tile_row FROM r) SELECT raster_id, CAST(tile_row AS INTEGER) AS tile_row, CAST(unnest(list_sort(list_distinct(list_append(range(0, greatest(len - 32, 0) + 1, 24), greatest(len - 32, 0))))) AS INTEGER) AS tile_col FROM s")
def _(t):
    return grid.tile_grid(t("part").select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") + 40).alias("width"), (F.col("p_size") + 40).alias("height")), 32, 24)


@query("w9_centred_tiles", "WITH r AS (SELECT p_partkey AS raster_id, p_size AS h, p_size + 7 AS w FROM part) SELECT raster_id, CAST(y.x AS INTEGER) AS out_row, CAST(z.x AS INTEGER) AS out_col, y.x * 4 - 6.0 AS tile_row, z.x * 4 - 6.0 AS tile_col FROM r, range(100) y(x), range(100) z(x) WHERE y.x * 4 < h AND z.x * 4 < w", "tile_row tile_col")
def _(t):
    return grid.centred_tiles(t("part").select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") + 7).alias("width"), F.col("p_size").alias("height")), 16, 4)


@query("w9_centred_patches", "WITH b AS (SELECT DISTINCT row // 4 AS y, col // 4 AS x FROM (SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col FROM orders)), r AS (SELECT max(row) // 4 AS h FROM g), a AS (SELECT y.x AS y, x.x AS x FROM r, range(1000000) y(x), range(27) x(x) WHERE y.x <= h + 1) SELECT 't1' AS raster_id, a.y AS out_row, a.x AS out_col, count(*) AS valid_cells, avg(t1) AS mean, count(*) / 100.0 >= 0.5 AS accepted FROM a JOIN g ON g.row BETWEEN a.y * 4 - 3 AND a.y * 4 + 6 AND g.col BETWEEN a.x * 4 - 3 AND a.x * 4 + 6 GROUP BY ALL", "mean")
def _(t):
    return grid.centred_patches(t.g.select(F.lit("t1").alias("raster_id"), "row", "col", F.col("t1").alias("value")), 10, 4)


TILE = "p AS (SELECT (row // 16) * 12 AS tr, (col // 16) * 12 AS tc, row % 16 AS dy, col % 16 AS dx, t0, k % 13 <> 0 AS ok FROM g), w AS (SELECT tr + dy AS row, tc + dx AS col, t0, CASE WHEN ok THEN greatest((0.5 - 0.5 * cos(2 * pi() * dy / 15)) * (0.5 - 0.5 * cos(2 * pi() * dx / 15)), 0.05) ELSE 0 END AS w FROM p)"


def _patches(t):
    prob = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda c: F.when(c == F.col("t0"), F.lit(0.5)).otherwise(F.lit(0.1)))
    return t.g.select((F.expr("row div 16") * 12).alias("tile_row"), (F.expr("col div 16") * 12).alias("tile_col"), (F.col("row") % 16).alias("dy"), (F.col("col") % 16).alias("dx"), prob.alias("prob"), (F.col("k") % 13 != 0).alias("valid"))


@query("a36_mosaic", f"WITH {TILE}, c AS (SELECT row, col, CAST(c.x AS INTEGER) AS class, sum(w * CASE WHEN t0 = c.x + 1 THEN 0.5 ELSE 0.1 END) / sum(w) AS p FROM w, range(6) c(x) WHERE w > 0 GROUP BY ALL) SELECT row, col, class, p AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(p, 9) DESC, class) = 1", "confidence")
def _(t):
    return classify.mosaic(_patches(t), 16)


@query("w10_blend_weight", "SELECT k, greatest((0.5 - 0.5 * cos(2 * pi() * (row % 16) / 15)) * (0.5 - 0.5 * cos(2 * pi() * (col % 16) / 15)), 0.05) AS weight FROM g", "weight")
def _(t):
    return t.g.select("k", classify.blend_weight(F.col("row") % 16, F.col("col") % 16, 16).alias("weight"))


@query("m9_accept_patches", "SELECT (row // 16) * 12 AS tile_row, (col // 16) * 12 AS tile_col, avg(CASE WHEN k % 13 <> 0 THEN 1.0 ELSE 0.0 END) AS valid_share, avg(CASE WHEN k % 13 <> 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS accepted FROM g GROUP BY ALL", "valid_share")
def _(t):
    return classify.accept_patches(_patches(t))


@query("p10_low_confidence", "SELECT vec_id, 1 / (1 + abs(embedding[1]::DOUBLE)) < 0.9 AS low FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", E.low_confidence(1 / (1 + F.abs(F.get("embedding", F.lit(0)).cast("double"))), 0.9).alias("low"))


@query("p4_normalise_bands", "SELECT vec_id, CAST(band AS INTEGER) AS band, (x * 2 + 0.5 - band % 4 / 4.0) / (0.5 + band % 3) AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS band, unnest(embedding)::DOUBLE AS x FROM embeddings)", "value")
def _(t):
    n = t("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    normed = t("embeddings").select("vec_id", E.normalise_bands(F.transform("embedding", lambda x: x.cast("double")), 2.0, 0.5, [k % 4 / 4 for k in range(n)], [0.5 + k % 3 for k in range(n)]).alias("n"))
    return normed.select("vec_id", F.posexplode("n").alias("band", "value"))


INDEX = "(SELECT vec_id, abs(embedding[1]::DOUBLE) AS blue, abs(embedding[2]::DOUBLE) AS green, abs(embedding[3]::DOUBLE) AS red, abs(embedding[4]::DOUBLE) AS nir, abs(embedding[5]::DOUBLE) AS swir FROM embeddings)"


@query("p15_indices", f"SELECT vec_id, (nir - red) / nullif(nir + red, 0) AS ndvi, (green - nir) / nullif(green + nir, 0) AS ndwi, (green - swir) / nullif(green + swir, 0) AS mndwi, (swir - nir) / nullif(swir + nir, 0) AS ndbi FROM {INDEX}", "ndvi ndwi mndwi ndbi")
def _(t):
    band = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    named = t("embeddings").select("vec_id", *[band(k).alias(n) for k, n in enumerate(("blue", "green", "red", "nir", "swir"))])
    return named.select("vec_id", *[E.spectral_index(n).alias(n) for n in E.INDICES])


@query("m10_softmax", "WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, max(exp(x)) / sum(exp(x)) AS top FROM l GROUP BY vec_id", "top")
def _(t):
    p = E.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return t("embeddings").select("vec_id", F.array_max(p).alias("top"))


def _pixels(t):
    return t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("bands"))


LONG = "l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS band, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("a35_signatures", f"WITH {LONG} SELECT label, CAST(band AS INTEGER) AS band, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS stddev FROM l GROUP BY ALL", "mean stddev")
def _(t):
    return classify.signatures(_pixels(t))


@query("a35_covariances", f"WITH {LONG} SELECT a.label, CAST(a.band AS INTEGER) AS band_a, CAST(b.band AS INTEGER) AS band_b, covar_samp(a.x, b.x) AS covariance FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.band <= b.band GROUP BY ALL", "covariance")
def _(t):
    return classify.covariances(_pixels(t))


@query("m4_minimum_distance", f"WITH {LONG}, m AS (SELECT label AS class, band, avg(x) AS m FROM l GROUP BY ALL), d AS (SELECT vec_id, class, sum((x - m) * (x - m)) AS distance2 FROM l JOIN m USING (band) GROUP BY ALL) SELECT vec_id, class, distance2 FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance2, class) = 1", "distance2")
def _(t):
    return classify.minimum_distance(_pixels(t), classify.class_means(_pixels(t)), ["vec_id"])


@query("m5_maximum_likelihood")
def _(t):
    return classify.maximum_likelihood(_pixels(t), _pixels(t), ["vec_id"])


@query("m6_expansion_samples", "SELECT row, col, CAST(t1 = 2 AS INTEGER)::DOUBLE AS label, v AS price, CAST(p1 AS DOUBLE) AS zone FROM g WHERE t0 <> 2", "price label")
def _(t):
    return classify.expansion_samples(t.cells("t0"), t.cells("t1"), {"price": t.cells("v"), "zone": t.g.select("row", "col", F.col("p1").cast("double").alias("value"))}, 2)


@query("m7_development_probability")
def _(t):
    samples = classify.expansion_samples(t.cells("t0"), t.cells("t1"), {"price": t.cells("v"), "zone": t.g.select("row", "col", F.col("p1").cast("double").alias("value"))}, 2)
    return classify.development_probability(samples, ["price", "zone"])


@query("a42_preview_quality", "WITH c AS (SELECT l_suppkey AS image_id, l_linenumber % 3 AS r, l_linenumber % 2 AS gg, 0 AS b, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT image_id, max(n) AS top, coalesce(sum(n) FILTER (r = 0 AND gg = 0), 0) AS black, sum(n) AS n FROM c GROUP BY ALL) SELECT image_id, top / n AS single_colour_share, black / n AS black_share, top / n < 0.98 AND black / n < 0.95 AS passed FROM s", "single_colour_share black_share")
def _(t):
    return classify.preview_quality(t("lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("r"), (F.col("l_linenumber") % 2).alias("g"), F.lit(0).alias("b")))
