"""Data model: a raster is a table of cells; a missing row or a null value is NoData."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CELLS = T.StructType([T.StructField("raster_id", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])
GRIDS = T.StructType(
    [
        T.StructField("raster_id", T.StringType()),
        T.StructField("crs", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("transform", T.ArrayType(T.DoubleType())),
        T.StructField("nodata", T.DoubleType()),
        T.StructField("is_projected", T.BooleanType()),
        T.StructField("linear_units", T.StringType()),
    ]
)
CARBON_POOLS = T.StructType([T.StructField("lucode", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("c_above", "c_below", "c_soil", "c_dead"))])
SCORES = T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("scenario", T.StringType())])

#: Land classes of the six-class scheme.
SIX_CLASSES = {1: "cropland", 2: "built_up", 3: "grassland", 4: "forest", 5: "water", 6: "bare_land"}


def class_scheme(spark: SparkSession, names: dict[int, str] = SIX_CLASSES) -> DataFrame:
    """(code, name): a dimension of a few rows, so joins with it may be broadcast."""
    return spark.createDataFrame(sorted(names.items()), "code long, name string")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself; raises before any job if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
