"""All queries by name, and their SQL for DuckDB over the same tables.

Each query applies an operator to a given table, or to the land grid that the orders table makes: an
order is a cell, its key the place, its customer the class, its price a surface.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_M2 = 900.0
#: (x step, 0, x of the edge, 0, y step, y of the edge)
TRANSFORM = [30.0, 0.0, 500_000.0, 0.0, -30.0, 3_700_000.0]

#: The same grid in SQL, and each of its layers without NoData.
GRID_SQL = """
g AS (
  SELECT o_orderkey AS k, o_orderkey // 100 AS row, o_orderkey % 100 AS col, 1 + o_custkey % 6 AS t0,
    CASE WHEN o_orderkey % 5 = 0 THEN 1 + (o_custkey + 1 + (o_orderkey // 5) % 5) % 6 ELSE 1 + o_custkey % 6 END AS t1,
    CASE WHEN o_orderkey % 4 = 0 THEN 1 + (o_custkey + 1 + (o_orderkey // 4) % 5) % 6 ELSE 1 + o_custkey % 6 END AS p1,
    o_totalprice AS v, ['ND', 'UD', 'EP', 'RE'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS scenario
  FROM orders WHERE o_orderkey % 97 <> 0
),
units AS (
  SELECT o_custkey AS unit_id, CAST(count(*) AS DOUBLE) AS orders, sum(o_totalprice) AS spend, max(o_totalprice) AS peak, avg(o_totalprice) AS mean,
    ['ND', 'UD', 'EP', 'RE'][CAST(o_custkey % 4 AS INTEGER) + 1] AS scenario
  FROM orders GROUP BY o_custkey
),
pools(lucode, c_above, c_below, c_soil, c_dead) AS (VALUES (1, 3.0, 1.0, 40.0, 0.5), (2, 0.0, 0.0, 20.0, 0.0), (3, 2.0, 4.0, 50.0, 0.5), (4, 60.0, 15.0, 90.0, 5.0), (5, 0.0, 0.0, 10.0, 0.0), (6, 0.5, 0.5, 15.0, 0.0))
"""


@dataclass
class Tables:
    """The given tables and what is derived from them, lazily."""

    spark: SparkSession
    dir: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def g(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        moved = lambda n: F.expr(f"CASE WHEN o_orderkey % {n} = 0 THEN 1 + (o_custkey + 1 + (o_orderkey div {n}) % 5) % 6 ELSE 1 + o_custkey % 6 END")
        scenario = F.element_at(F.array(*map(F.lit, ("ND", "UD", "EP", "RE"))), (k % 4 + 1).cast("int"))
        return self("orders").where(k % 97 != 0).select(
            k.alias("k"), F.expr("o_orderkey div 100").alias("row"), (k % 100).alias("col"), (1 + c % 6).alias("t0"), moved(5).alias("t1"), moved(4).alias("p1"), F.col("o_totalprice").alias("v"), scenario.alias("scenario")
        )

    def cells(self, layer: str, *also: str) -> DataFrame:
        return self.g.select("row", "col", *also, F.col(layer).alias("value"))

    def stack(self) -> DataFrame:
        """Three layers as one table of rasters, from one scan."""
        layers = F.array(*[F.struct(F.lit(n).alias("raster_id"), F.col(n).cast("double").alias("value")) for n in ("t0", "t1", "p1")])
        return self.g.select("row", "col", F.inline(layers)).select("raster_id", "row", "col", "value")

    @property
    def units(self) -> DataFrame:
        """Customers as units with four services each."""
        p = F.col("o_totalprice")
        sums = self("orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count("*").cast("double").alias("orders"), F.sum(p).alias("spend"), F.max(p).alias("peak"), F.avg(p).alias("mean"))
        return sums.withColumn("scenario", F.element_at(F.array(*map(F.lit, ("ND", "UD", "EP", "RE"))), (F.col("unit_id") % 4 + 1).cast("int")))

    @property
    def pools(self) -> DataFrame:
        rows = [(1, 3.0, 1.0, 40.0, 0.5), (2, 0.0, 0.0, 20.0, 0.0), (3, 2.0, 4.0, 50.0, 0.5), (4, 60.0, 15.0, 90.0, 5.0), (5, 0.0, 0.0, 10.0, 0.0), (6, 0.5, 0.5, 15.0, 0.0)]
        return self.spark.createDataFrame(rows, "lucode long, c_above double, c_below double, c_soil double, c_dead double")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Places to which both sides round measures, as sums come in any order.
PLACES = 6


def query(name: str, sql: str | None = None, measures: str = "", places: int = PLACES):
    """Registers a function of Tables under a name, with its SQL; `measures` are columns to round."""

    def add(make: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(Tables(spark, sf_dir))
            # adding 0 makes -0.0 a plain 0
            return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in measures.split()}) if measures else df

        _QUERIES[name] = run
        if sql:
            body = sql.strip()
            told = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
            body = f"{told}{GRID_SQL}, {body[len(told) :]}" if told else f"WITH {GRID_SQL} {body}"
            changed = ", ".join(f"round(CAST({c} AS DOUBLE), {places}) + CAST(0 AS DOUBLE) AS {c}" for c in measures.split())
            _SQL[name] = f"SELECT * REPLACE ({changed}) FROM ({body})" if measures else body
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import area, cells, inference, rules, scores, sources_sinks  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


__all__ = ["CELL_M2", "PLACES", "TRANSFORM", "Tables", "oracle_sql", "queries", "query", "T"]
