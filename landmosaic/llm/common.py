"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import cut, shared_dir, stored

__all__ = ["SLICE", "bucketed", "cut", "held_out", "shared_dir", "slices", "small_batches", "stored", "table"]

#: Documents whose texts are Python strings at the same time, within one Arrow batch.
SLICE = 256


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As stored(), as a table in buckets by `key`: joins by it move the other side only."""
    spark = df.sparkSession
    name, many = f"bucketed_{uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(many, key).write.format("parquet").bucketBy(many, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs run inside send so many rows at once to Python workers, so that neither side holds many texts; then as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def held_out(doc_id: str, parts: int, rest: int):
    """crc32 of the id as text leaves `rest` when divided by `parts`."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == rest, F.lit(False))
