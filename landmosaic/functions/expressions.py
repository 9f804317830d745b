"""Column expressions that operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def area_ha(count: Column | str, cell_m2: float) -> Column:
    return col(count) * F.lit(cell_m2 / 10_000.0)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def min_max(x: Column | str, low: Column, high: Column, benefit: bool = True) -> Column:
    """Score from 0 to 1, clipped; 0.5 where the bounds are equal."""
    x = col(x)
    part = (x - low) if benefit else (high - x)
    raw = part / F.nullif(high - low, F.lit(0.0))
    return F.when(F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def was_clipped(x: Column | str, low: Column, high: Column) -> Column:
    x = col(x)
    return (x < low) | (x > high)


def depth_m(w: Column | str, unit: str = "mm", negative_down: bool = True) -> Column:
    """Subsidence depth in metres, positive downward."""
    x = col(w) / 1000.0 if unit == "mm" else col(w)
    return -x if negative_down else x


def centre_x(column: Column | str, transform: list[float]) -> Column:
    return F.lit(transform[2]) + (col(column) + 0.5) * transform[0]


def centre_y(row: Column | str, transform: list[float]) -> Column:
    return F.lit(transform[5]) + (col(row) + 0.5) * transform[4]


def cell_col(x: Column | str, transform: list[float]) -> Column:
    return F.floor((col(x) - transform[2]) / transform[0]).cast("long")


def cell_row(y: Column | str, transform: list[float]) -> Column:
    return F.floor((col(y) - transform[5]) / transform[4]).cast("long")


def unit_id(row: Column | str, column: Column | str, size: int) -> Column:
    """Name of the square analysis unit of size x size cells that a cell lies in."""
    return F.format_string("r%05d_c%05d", F.floor(col(row) / size).cast("long"), F.floor(col(column) / size).cast("long"))


def normalise_bands(bands: Column | str, scale: float, offset: float, means: list[float], stds: list[float]) -> Column:
    stats = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(means, stds, strict=True)])
    return F.zip_with(col(bands), stats, lambda x, t: (x * scale + offset - t["m"]) / t["s"])


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / array_sum(shifted))


def remap(x: Column | str, pairs: dict[int, int]) -> Column:
    """Codes by a small map; codes outside it are null."""
    table = F.create_map(*[F.lit(v) for pair in sorted(pairs.items()) for v in pair])
    return F.try_element_at(table, col(x).cast("int"))


def low_confidence(confidence: Column | str, threshold: float) -> Column:
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return col(confidence) < threshold


def northness(aspect: Column | str) -> Column:
    """Cosine of the aspect; flat cells (-1) have none."""
    return F.cos(F.radians(F.nullif(col(aspect), F.lit(-1.0))))


def eastness(aspect: Column | str) -> Column:
    return F.sin(F.radians(F.nullif(col(aspect), F.lit(-1.0))))


def normalised_difference(a: Column | str, b: Column | str) -> Column:
    return (col(a) - col(b)) / F.nullif(col(a) + col(b), F.lit(0.0))


#: Spectral indices as the normalised difference of two bands.
INDICES = {"ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "mndwi": ("green", "swir"), "ndbi": ("swir", "nir")}


def spectral_index(name: str) -> Column:
    """NDVI, NDWI, MNDWI or NDBI of columns named by band; null where both bands are 0."""
    return normalised_difference(*INDICES[name])


def driver_kind(name: Column | str) -> Column:
    """Circular for aspects, categorical for classes and types, else continuous."""
    n = F.lower(F.trim(col(name)))
    return F.when(n == "aspect", "circular").when(n.endswith("_class") | n.endswith("_type"), "categorical").otherwise("continuous")


def method_allowed(kind: Column | str, method: Column | str) -> Column:
    k, m = col(kind), F.lower(F.trim(col(method)))
    return F.when(k == "categorical", m.isin("nearest", "majority")).when(k == "circular", m == "nearest").otherwise(m.isin("nearest", "bilinear", "cubic"))


def non_negative(x: Column | str, name: str) -> Column:
    """The value; the job fails where it is not a finite number of at least 0."""
    x = col(x)
    return F.when(finite(x) & (x >= 0), x).otherwise(F.raise_error(F.lit(f"{name} must be finite and non-negative")).cast("double"))


def hann_weight(i: Column | str, size: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0) * F.pi() * col(i) / F.lit(float(size - 1)))


def md5_order(seed: int, *parts: Column | str) -> Column:
    """A key whose order is a fixed shuffle, the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def md5_below(n: Column, seed: int, *parts: Column | str) -> Column:
    """A fixed draw from 0 to n - 1."""
    return F.conv(F.substring(md5_order(seed, *parts), 1, 8), 16, 10).cast("long") % n
