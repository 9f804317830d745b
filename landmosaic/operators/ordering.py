"""Running totals and ranks over a whole table, without one task that sees it all."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table in the shared folder; for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, by: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows of the same `by` up to this one, which `order` must put in one order.

    Rows are dealt to ranges of (by, order). Each range is summed up alone, and the ranges' totals, a
    few numbers for each partition, are added as offsets. The ranges are checkpointed: two looks at
    them see the same.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()).withColumn("_amount", amount))
    keys = [F.col(c).alias(f"_of_{c}") for c in by]
    before = Window.partitionBy(*[f"_of_{c}" for c in by]).orderBy("_of_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, F.col("_range").alias("_of_range")).agg(F.sum("_amount").alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    on = [F.col("_range") == F.col("_of_range"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(name, F.sum("_amount").over(within)).join(offsets, on)
    return summed.withColumn(name, F.col(name) + F.col("_offset")).select(*df.columns, name)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the row's number, from 1, among those of the same `by`."""
    return running_total(df, by, order, F.lit(1).cast("long"), name)


def preceding(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the next lower `value` among the rows of the same `by`, null for the lowest; values must be distinct there.

    Rows are dealt to ranges of (by, value); the lowest row of a range takes the highest of the range before.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_of_range")).agg(F.max(value).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*[f"_of_{c}" for c in by]).orderBy("_of_range"))).drop("_end")
    on = [F.col("_range") == F.col("_of_range"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    within = F.lag(value).over(Window.partitionBy("_range", *by).orderBy(value))
    return ranged.withColumn(name, within).join(before, on).withColumn(name, F.coalesce(name, "_before")).select(*df.columns, name)
