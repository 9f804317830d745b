"""Rasters stored in buckets of cells, so that rasters of one grid meet without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.change import CELL

BUCKETS = 64


def write_raster(cells: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Stores cells (row, col, value) as a table of `buckets` files sorted by cell, at a path that all tasks share.

    Rasters of one grid must have the same number of buckets; then joins by cell of any number of them
    read bucket by bucket.
    """
    stored = cells.select(*CELL, "value").repartition(buckets, *CELL)
    stored.write.format("parquet").bucketBy(buckets, *CELL).sortBy(*CELL).option("path", path).saveAsTable(name)


def read_raster(spark: SparkSession, name: str, path: str, kind: str = "double", buckets: int = BUCKETS) -> DataFrame:
    """Cells of a raster that write_raster() stored; a session that doesn't know the table is told where it is."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (row BIGINT, col BIGINT, value {kind}) USING parquet CLUSTERED BY (row, col) SORTED BY (row, col) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
