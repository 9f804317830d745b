"""Queries of sources and sinks, over files that the given tables are written to or held in."""

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from ..operators import units
from ..operators.ordering import numbered, shared_dir
from ..sources import tables as S
from .registry import TRANSFORM, query


def _place(spark) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/table-{uuid4().hex}"


@query("s1_s7_table_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "s_acctbal")
def _(t):
    path = _place(t.spark)
    S.write_table(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    return S.read_table(t.spark, path, schema)


@query("o1_ordered_sink", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place FROM supplier")
def _(t):
    """Rows numbered as the files hold them: by file name, then by place in the file."""
    path = _place(t.spark)
    S.write_table(t("supplier").select("s_suppkey", "s_acctbal", (-F.col("s_acctbal")).alias("falling")), path, ["falling", "s_suppkey"])
    read = t.spark.read.schema("falling double, s_acctbal double, s_suppkey long").option("header", True).csv(path)
    placed = read.select("s_suppkey", F.element_at(F.split("_metadata.file_name", "-"), 2).alias("file"), F.monotonically_increasing_id().alias("at"))
    return numbered(placed, [], [F.col("file"), F.col("at")], "place").select("s_suppkey", "place")


@query("s1_numeric_columns", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0", "s_acctbal")
def _(t):
    table = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("s_acctbal"))
    return S.numeric(table, ["s_acctbal"], ["s_suppkey", "s_acctbal"])[0]


@query("s2_block_scan", "SELECT 't0' AS raster_id, row // 64 AS block_row, col // 64 AS block_col, count(*) AS valid_cells, sum(t0) * 1.0 AS total FROM g GROUP BY ALL UNION ALL SELECT 't1', row // 64, col // 64, count(*), sum(t1) FROM g GROUP BY ALL UNION ALL SELECT 'p1', row // 64, col // 64, count(*), sum(p1) FROM g GROUP BY ALL", "total")
def _(t):
    return S.blocks(t.stack(), 64)


@query("s2_pruned_raster", "SELECT row, col, CAST(t1 AS DOUBLE) AS value FROM g", "value")
def _(t):
    path = _place(t.spark)
    S.write_cells(t.stack(), path)
    return t.spark.read.parquet(path).where("raster_id = 't1'").select("row", "col", "value")


def _lines(t):
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", k % 100 * 30, F.expr("o_orderkey div 100 * 30"), -F.col("o_custkey"))
    return t("orders").select(F.when(k % 50 == 0, "# comment").when(k % 51 == 0, "  ").when(k % 52 == 0, "; note").when(k % 53 == 0, "x y z").when(k % 54 == 0, F.regexp_replace(line, " ", " , ")).otherwise(line).alias("value"))


@query("s5_point_text", "SELECT o_orderkey % 100 * 30.0 AS x, o_orderkey // 100 * 30.0 AS y, -1.0 * o_custkey AS w, o_custkey / 1000 AS value FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 51 <> 0 AND o_orderkey % 52 <> 0 AND o_orderkey % 53 <> 0", "x y w value")
def _(t):
    return S.parse_points(_lines(t))[0]


@query("s5_bad_lines", "SELECT count(*) AS bad FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 51 <> 0 AND o_orderkey % 52 <> 0 AND o_orderkey % 53 = 0")
def _(t):
    return S.parse_points(_lines(t))[1].agg(F.count("*").alias("bad"))


@query("s5_strict_points", "SELECT o_orderkey % 100 * 30.0 AS x, o_orderkey // 100 * 30.0 AS y, -1.0 * o_custkey AS w, o_custkey / 1000 AS value FROM orders WHERE o_orderkey % 53 <> 0", "x y w value")
def _(t):
    k = F.col("o_orderkey")
    sound = t("orders").where(k % 53 != 0).select(F.concat_ws(",", k % 100 * 30, F.expr("o_orderkey div 100 * 30"), -F.col("o_custkey")).alias("value"))
    return S.parse_points(sound, strict=True)[0]


@query("p3_depth_metres", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN -c_acctbal / 1000 END AS depth_m FROM customer", "depth_m")
def _(t):
    d = E.depth_m("c_acctbal")
    return t("customer").select("c_custkey", F.when(d >= 0, d).alias("depth_m"))


@query("p13_non_negative", "SELECT c_custkey, abs(c_acctbal) AS balance FROM customer", "balance")
def _(t):
    return t("customer").select("c_custkey", E.non_negative(F.abs("c_acctbal"), "balance").alias("balance"))


@query("p1_valid_cells", "SELECT row, col, v AS value FROM g WHERE k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0", "value")
def _(t):
    k = F.col("k")
    return units.valid(t.g.select("row", "col", F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(None)).otherwise(F.col("v")).alias("value")))


@query("p12_unit_conversions", "SELECT k, v * 900 / 10000 AS ha, v * 900 / 1000 AS m3, v / 1e6 AS t, v * 10 AS mg_ha FROM g", "ha m3 t mg_ha")
def _(t):
    v = F.col("v")
    return t.g.select("k", E.area_ha(v, 900.0).alias("ha"), (v * 900 / 1000).alias("m3"), (v / 1e6).alias("t"), (v * 10).alias("mg_ha"))


def _polygons(t):
    size = t("orders").agg(F.max("o_orderkey")).first()[0]
    return units.unit_polygons(100, size // 100 + 1, 15, TRANSFORM, t.spark)


POLYGONS = "d AS (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders), u AS (SELECT r.x AS ur, c.x AS uc, h FROM d, range(100000) r(x), range(7) c(x) WHERE r.x < (h + 14) // 15)"


@query("s9_unit_polygons", f"WITH {POLYGONS} SELECT printf('r%05d_c%05d', ur, uc) AS unit_id, 500000.0 + uc * 15 * 30 AS x0, 3700000.0 - ur * 15 * 30 AS y0, 500000.0 + least((uc + 1) * 15, 100) * 30 AS x1, 3700000.0 - least((ur + 1) * 15, h) * 30 AS y1 FROM u", "x0 y0 x1 y1")
def _(t):
    return _polygons(t).drop("ring")


@query("s4_geojson_round_trip", f"WITH {POLYGONS} SELECT printf('r%05d_c%05d', ur, uc) AS feature_id, 'Polygon' AS type, true AS finite, 5 AS points, 500000.0 + uc * 15 * 30 AS x0 FROM u", "x0")
def _(t):
    path = _place(t.spark)
    S.to_geojson(_polygons(t)).write.text(path)
    features = S.parse_features(t.spark.read.text(path))
    return features.select("feature_id", "type", "finite", F.size("ring").alias("points"), F.element_at(F.element_at("ring", 1), 1).alias("x0"))


@query("s4_collection_by_ranges", f"WITH {POLYGONS} SELECT printf('r%05d_c%05d', ur, uc) AS feature_id, 'Polygon' AS type, true AS finite, 500000.0 + uc * 15 * 30 AS x0, 3700000.0 - ur * 15 * 30 AS y0 FROM u", "x0 y0")
def _(t):
    """One file that is a collection of all features, read by ranges of 4 KB."""
    path = _place(t.spark)
    lines = S.to_geojson(_polygons(t)).select(F.concat(F.lit(","), "value").alias("value"))
    head = t.spark.createDataFrame([('{"type": "FeatureCollection", "features": [{"type": "Note", "says": "}]{\\""}',)], "value string")
    # Written in order by one task: the file is one text.
    head.union(lines).union(t.spark.createDataFrame([("]}",)], "value string")).coalesce(1).write.text(path)
    features = S.read_features(t.spark, path, 4096)
    corner = F.element_at(F.element_at("rings", 1), 1)
    return features.select("feature_id", "type", "finite", corner[0].alias("x0"), corner[1].alias("y0"))


@query("s4_multi_polygons", "SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, CASE WHEN s_suppkey % 3 = 0 THEN 'MultiPolygon' WHEN s_suppkey % 3 = 1 THEN 'Polygon' ELSE 'Point' END AS type, CASE WHEN s_suppkey % 3 < 2 THEN 2 END AS rings, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 0.5 WHEN s_suppkey % 3 = 1 THEN 0.25 END AS last_x, true AS finite FROM supplier", "last_x")
def _(t):
    k = F.col("s_suppkey")
    square = "[[{0},0],[{0},1],[1,1],[{0},0]]"
    ring = lambda x: F.concat(*[F.lit(p) if p != "{0}" else x for p in square.replace("{0}", "|{0}|").split("|")])
    number = k.cast("string")
    shape = F.when(k % 3 == 0, F.concat(F.lit("[["), ring(number), F.lit("],["), ring(F.concat(number, F.lit(".5"))), F.lit("]]"))).when(k % 3 == 1, F.concat(F.lit("["), ring(number), F.lit(","), ring(F.lit("0.25")), F.lit("]"))).otherwise(F.concat(F.lit("["), number, F.lit(",2]")))
    kind = F.when(k % 3 == 0, "MultiPolygon").when(k % 3 == 1, "Polygon").otherwise("Point")
    texts = t("supplier").select(F.concat(F.lit('{"type":"Feature","id":"'), number, F.lit('","geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}")).alias("value"))
    found = S.parse_features(texts)
    return found.select("feature_id", "type", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("rings"), F.element_at(F.element_at("rings", -1), 1)[0].alias("last_x"), "finite")


@query("s6_evidence_metrics", """WITH f AS (SELECT c_mktsegment AS section, min_by(c_custkey, printf('%05d', c_custkey)) AS k FROM customer GROUP BY ALL) SELECT section, metric, CASE metric WHEN 'balance' THEN c_acctbal WHEN 'nation' THEN c_nationkey END AS value FROM f JOIN customer ON k = c_custkey, (VALUES ('balance'), ('nation'), ('name')) m(metric)""", "value")
def _(t):
    text = F.to_json(F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")))
    return S.metrics(t("customer").select(F.format_string("%05d", "c_custkey").alias("path"), F.col("c_mktsegment").alias("section"), text.alias("text")))


@query("s10_file_inventory")
def _(t):
    files = S.inventory(t.spark, f"{t.dir}/supplier.parquet", "input").union(S.inventory(t.spark, f"{t.dir}/orders.parquet", "input"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "type", "bytes", "sha256", "stage")


@query("s10_directory_digest")
def _(t):
    one = lambda name: S.inventory(t.spark, f"{t.dir}/{name}.parquet", "input", t.dir)
    return S.directory_digest(one("supplier").union(one("orders")))


@query("s8_metadata_sink", "SELECT 'spend' AS field, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier", "low high")
def _(t):
    path = _place(t.spark)
    S.write_metadata(t("supplier").agg(F.lit("spend").alias("field"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high")), path)
    return t.spark.read.schema("field string, low double, high double").json(path)
