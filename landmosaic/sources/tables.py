"""Sources and sinks: tables, point text, GeoJSON, evidence, file inventories, and cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import depth_m, finite
from ..operators.ordering import cut
from ..schemas import require
from .profiles import profile
from .ranges import RANGE_BYTES, digests, feature_texts, files, known_store, named

__all__ = ["profile"]


def read_table(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """A CSV table with a header, by an explicit schema; a missing column or an empty table raises."""
    header = spark.read.option("header", True).csv(path).columns
    found = [h.lstrip("﻿") for h in header]
    missing = set(required or schema.names) - set(found)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    kinds = {f.name: f for f in schema}
    df = spark.read.schema(T.StructType([kinds.get(h, T.StructField(h, T.StringType())) for h in found])).option("header", True).csv(path)
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df.select(schema.names)


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header and columns in alphabetical order; with an order its files, by name, hold the rows in that order."""
    rows = df.orderBy(*order) if order else df
    rows.select(sorted(df.columns)).write.option("header", True).csv(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """The side table of a result, as JSON."""
    metadata.write.json(path)


def numeric(df: DataFrame, columns: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are finite numbers, cast; and (column, raw) of the cells that aren't."""
    require(df, required)
    cast = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}
    good = None
    for x in cast.values():
        ok = F.coalesce(finite(x), F.lit(False))
        good = ok if good is None else good & ok
    bad = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), F.coalesce(finite(x), F.lit(False)).alias("ok")) for c, x in cast.items()])))
    return df.where(good).withColumns(cast), bad.where("NOT ok").drop("ok")


def blocks(cells: DataFrame, size: int = 256) -> DataFrame:
    """(raster_id, block_row, block_col, valid_cells, total): a scan by blocks, which is one partial aggregate."""
    return cells.where(finite("value")).groupBy("raster_id", F.floor(F.col("row") / size).alias("block_row"), F.floor(F.col("col") / size).alias("block_col")).agg(F.count("*").alias("valid_cells"), F.sum("value").alias("total"))


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells by raster, so a reader of one raster reads its files only; rows of a raster stay in order of blocks."""
    cells.repartition("raster_id", F.floor(F.col("row") / 256)).sortWithinPartitions("raster_id", "row", "col").write.partitionBy("raster_id").parquet(path)


def describe(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Grid metadata of each raster beside the profile of its cells."""
    return grids.join(profile(cells), "raster_id", "left")


def parse_points(lines: DataFrame, x: int = 0, y: int = 1, w: int = 2, delimiter: str | None = None, unit: str = "mm", negative_down: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(x, y, w, value) of point lines (value), with value the depth in m; and the lines that are no points.

    Blank lines and those that begin with #, // or ; are passed over. A depth below 0 is no point.
    If it is strict, a job that meets a line that is no point fails.
    """
    text = F.trim("value")
    data = lines.where((text != "") & ~text.rlike(r"^(#|//|;)"))
    parts = F.split(text, r"\s*" + delimiter + r"\s*" if delimiter else r"[,\s]+")
    number = lambda k: F.get("parts", F.lit(k)).try_cast("double")
    cast = data.withColumn("parts", parts).select(F.col("value").alias("line"), number(x).alias("x"), number(y).alias("y"), number(w).alias("w"))
    ready = cast.withColumn("value", depth_m("w", unit, negative_down))
    good = F.coalesce(finite("x") & finite("y") & finite("w") & (F.col("value") >= 0), F.lit(False))
    if strict:
        checked = F.when(good, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("no point: "), "line")).cast("double"))
        return ready.select(checked.alias("x"), "y", "w", "value"), ready.where(F.lit(False)).select("line")
    return ready.where(good).drop("line"), ready.where(~good).select("line")


def read_points(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    return parse_points(spark.read.text(path), **options)


def parse_features(texts: DataFrame, value: str = "value") -> DataFrame:
    """(feature_id, type, ring, rings, finite) of GeoJSON texts, each a FeatureCollection or one feature.

    `rings` holds all rings of a polygon or of all parts of a multi-polygon, `ring` the first one;
    both are null for other types. Coordinates count as finite if all their numbers are.
    """
    geometry = "struct<type: string, coordinates: string>"
    feature = f"struct<id: string, properties: map<string, string>, geometry: {geometry}>"
    whole = F.from_json(value, f"struct<type: string, id: string, properties: map<string, string>, geometry: {geometry}, features: array<{feature}>>")
    parsed = texts.select(whole.alias("g"))
    each = parsed.select(F.explode(F.coalesce("g.features", F.array(F.struct(F.col("g.id").alias("id"), F.col("g.properties").alias("properties"), F.col("g.geometry").alias("geometry"))))).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one, many = F.from_json(text, "array<array<array<double>>>"), F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    sound = F.forall("rings", lambda r: F.forall(r, lambda p: F.forall(p, finite)))
    told = each.select(F.coalesce("f.id", F.try_element_at("f.properties", F.lit("unit_id"))).alias("feature_id"), kind.alias("type"), F.get(rings, F.lit(0)).alias("ring"), rings.alias("rings"), F.coalesce(F.forall(point, finite), F.lit(False)).alias("at"))
    return told.select("feature_id", "type", "ring", "rings", (F.coalesce(sound, F.lit(False)) | F.col("at")).alias("finite"))


def read_features(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Features of the GeoJSON files below a path, read by ranges of bytes."""
    return parse_features(feature_texts(spark, path, range_bytes))


def to_geojson(polygons: DataFrame) -> DataFrame:
    """(value): a GeoJSON feature for each (unit_id, ring)."""
    return polygons.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("unit_id").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"))).alias("value"))


def metrics(reports: DataFrame) -> DataFrame:
    """(section, metric, value) of JSON reports (path, section, text): of each section the first path counts."""
    first = reports.groupBy("section").agg(F.min_by("text", "path").alias("text"))
    flat = first.select("section", F.explode(F.from_json("text", "map<string, string>")).alias("metric", "raw"))
    return flat.select("section", "metric", F.col("raw").try_cast("double").alias("value"))


def inventory(spark: SparkSession, path: str, stage: str, root: str | None = None) -> DataFrame:
    """(path, type, bytes, sha256, stage) of the files below a path, of any size; with a root, paths are relative to it.

    The type is the name's ending in lower case, or `file`. Tasks read files as streams; in a store that
    Arrow doesn't know, Spark reads them whole, which ends at 2 GB.
    """
    listed = files(spark, path, empty=True)
    first = listed.first()
    if first is None or known_store(first.uri):
        found = digests(listed.repartition(F.col("uri")))
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        some = read.select(named(F.col("_metadata.file_path")).alias("uri"), F.sha2("content", 256).alias("sha256"))
        found = listed.join(some, "uri", "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    name = F.substring_index(plain, "/", -1)
    ending = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    told = F.substring_index(plain, root.rstrip("/") + "/", -1) if root else plain
    return found.select(told.alias("path"), F.when(ending != "", ending).otherwise("file").alias("type"), F.col("length").alias("bytes"), "sha256", F.lit(stage).alias("stage"))


def directory_digest(files: DataFrame) -> DataFrame:
    """(files, bytes, digest) of inventory() rows with relative paths: one SHA-256 over each path and digest, in order of the paths' parts.

    The rows are sorted by ranges, and one task goes through them as a stream, as such a digest must.
    """
    ranged = cut(files.select(F.split("path", "/").alias("parts"), "path", "bytes", "sha256").orderBy("parts").select("path", "bytes", "sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, many, size = hashlib.sha256(), 0, 0
        for b in batches:
            for name, n, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest.update(name.encode() + sha.encode())
                many, size = many + 1, size + n
        yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["files", "bytes", "digest"])

    return ranged.coalesce(1).mapInArrow(run, "files long, bytes long, digest string")
