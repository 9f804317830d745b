"""Per-cell classification of multi-band pixels and the data path around a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expressions import hann_weight
from .change import CELL
from .moments import matrix, moments
from .ordering import cut

#: Added to each variance before a covariance matrix is inverted.
RIDGE = 1e-9
#: Bytes of classes that are compared with the pixels in one pass.
BLOCK_BYTES = 8 << 20


def signatures(pixels: DataFrame, label: str = "label", bands: str = "bands") -> DataFrame:
    """(label, band, n, mean, stddev) of training pixels; no stddev of a single one."""
    found = moments(pixels, label, bands).select(label, "n", "scatter", F.size("mean").alias("d"), F.posexplode("mean").alias("band", "mean"))
    variance = F.get("scatter", F.col("band") * (F.col("d") + 1)) / F.nullif(F.col("n") - 1, F.lit(0))
    return found.select(label, "band", "n", "mean", F.sqrt(variance).alias("stddev"))


def covariances(pixels: DataFrame, label: str = "label", bands: str = "bands") -> DataFrame:
    """(label, band_a, band_b, covariance) for band_a <= band_b; null for a class of one pixel."""
    found = moments(pixels, label, bands).select(label, "n", F.size("mean").alias("d"), F.posexplode("scatter").alias("at", "s"))
    one = found.select(label, F.floor(F.col("at") / F.col("d")).cast("int").alias("band_a"), (F.col("at") % F.col("d")).alias("band_b"), (F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))).alias("covariance"))
    return one.where("band_a <= band_b")


def class_means(pixels: DataFrame, label: str = "label", bands: str = "bands") -> DataFrame:
    """(label, means): one row for each class."""
    return moments(pixels, label, bands).select(label, F.col("mean").alias("means"))


def _best(pixels: DataFrame, key: list[str], bands: str, classes: DataFrame, label: str, score: Callable, name: str, low: bool) -> DataFrame:
    """key, class and `name`: the class with the best score; of equal ones the smaller label if low is best, else the larger.

    Classes (label and columns for `score`) come to the pixels in blocks of some BLOCK_BYTES, in order of
    their labels; each block is one pass over the pixels that keeps the best so far, so no task and no
    driver holds more than a block. A pixel with a missing band, or of another number of bands than a
    class, has none of it.
    """
    spark = pixels.sparkSession
    kind = classes.schema[label].dataType
    of_label = to_arrow_type(kind)
    chosen = pixels.select(*key, F.col(bands).cast("array<double>").alias("bands"), F.lit(None).cast(kind).alias("class"), F.lit(None).cast("double").alias(name))
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    at_bands = len(key)

    def compared(df: DataFrame, block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                known = part.column(at_bands + 2)
                best = known.fill_null(np.inf if low else -np.inf).to_numpy(zero_copy_only=False).copy()
                some = known.is_valid().to_numpy(zero_copy_only=False).copy()
                which = np.full(part.num_rows, -1)
                at, x = matrix(part.column(at_bands))
                for k, (_, *told) in enumerate(sent.value):
                    if len(told[0]) != x.shape[1]:
                        continue
                    found = score(x, *told)
                    wins = at[(found < best[at] if low else found >= best[at]) | ~some[at]]
                    best[wins], which[wins], some[wins] = found[np.searchsorted(at, wins)], k, True
                told = pa.array([None if w < 0 else sent.value[w][0] for w in which.tolist()], of_label)
                label = pc.if_else(pa.array(which < 0), part.column(at_bands + 1), told)
                yield pa.RecordBatch.from_arrays([*part.columns[: at_bands + 1], label, pa.array(best, pa.float64(), mask=~some)], [*key, "bands", "class", name])

        return df.mapInArrow(run, given)

    block, size, out, passes = [], 0, chosen, 0
    for r in classes.orderBy(label).toLocalIterator():
        told = tuple(np.array(x) if isinstance(x, list) else x for x in r)
        block.append(told)
        size += sum(x.nbytes for x in told if isinstance(x, np.ndarray))
        if size >= BLOCK_BYTES:
            out, block, size, passes = compared(cut(out) if passes else out, block), [], 0, passes + 1
    if block:
        out = compared(cut(out) if passes else out, block)
    return out.select(*key, "class", name)


def minimum_distance(pixels: DataFrame, means: DataFrame, key: list[str], label: str = "label", bands: str = "bands") -> DataFrame:
    """key, class, distance2: the class with the nearest mean; ties to the smaller label; any number of classes, in blocks."""

    def far(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return ((x - mean) ** 2).sum(axis=1)

    return _best(pixels, key, bands, means.select(label, "means"), label, far, "distance2", True)


def _gaussians(training: DataFrame, label: str, bands: str) -> DataFrame:
    """(label, means, whiten, logdet) of each class: |(x - means) whiten| is the Mahalanobis distance of x; whiten is row by row."""
    kind = training.schema[label].dataType.simpleString()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, logs = [], []
            for n, mean, scatter in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                variances, axes = np.linalg.eigh(np.array(scatter).reshape(len(mean), len(mean)) / max(1, n - 1))
                variances = np.maximum(variances, 0.0) + RIDGE
                logs.append(float(np.log(variances).sum()))
                told.append((axes / np.sqrt(variances)).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(told, pa.list_(pa.float64())), pa.array(logs, pa.float64())], [label, "means", "whiten", "logdet"])

    return moments(training, label, bands).mapInArrow(fitted, f"`{label}` {kind}, means array<double>, whiten array<double>, logdet double")


def maximum_likelihood(pixels: DataFrame, training: DataFrame, key: list[str], label: str = "label", bands: str = "bands") -> DataFrame:
    """key, class, score: the Gaussian class of the highest log density over all bands; ties to the larger label.

    Means and scatter are added up over all training pixels, and each class's matrix is inverted in a
    task, with RIDGE added to the diagonal. Any number of classes, in blocks. A pixel with a missing band
    has no class and no score.
    """

    def density(x: np.ndarray, means: np.ndarray, whiten: np.ndarray, logdet: float) -> np.ndarray:
        z = (x - means) @ whiten.reshape(len(means), len(means))
        return -0.5 * (logdet + (z * z).sum(axis=1))

    return _best(pixels, key, bands, _gaussians(training, label, bands), label, density, "score", False)


def accept_patches(tiles: DataFrame, share: float = 0.5) -> DataFrame:
    """(tile_row, tile_col, valid_share, accepted) of tile pixels with a flag `valid`."""
    s = tiles.groupBy("tile_row", "tile_col").agg(F.avg(F.col("valid").cast("double")).alias("valid_share"))
    return s.withColumn("accepted", F.col("valid_share") >= share)


def blend_weight(dy: Column | str, dx: Column | str, size: int) -> Column:
    """Weight of a tile's pixel: Hann windows on both axes, floored at 0.05."""
    return F.greatest(hann_weight(dy, size) * hann_weight(dx, size), F.lit(0.05))


def mosaic(patches: DataFrame, size: int) -> DataFrame:
    """(row, col, class, confidence) from overlapping tiles (tile_row, tile_col, dy, dx, prob array, valid).

    Probabilities are averaged with the blend weight; the highest is the class, ties (to 9 places) to the smaller.
    """
    w = F.when(F.col("valid"), blend_weight("dy", "dx", size)).otherwise(0.0)
    long = patches.select((F.col("tile_row") + F.col("dy")).alias("row"), (F.col("tile_col") + F.col("dx")).alias("col"), w.alias("w"), F.posexplode("prob").alias("class", "p")).where("w > 0")
    sums = long.groupBy(*CELL, "class").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
    best = sums.groupBy(*CELL).agg(F.max(F.struct(F.round("p", 9).alias("r"), (-F.col("class")).alias("c"), "p")).alias("m"))
    return best.select(*CELL, (-F.col("m.c")).alias("class"), F.col("m.p").alias("confidence"))


def expansion_samples(before: DataFrame, after: DataFrame, drivers: dict[str, DataFrame], code: int) -> DataFrame:
    """Cells valid in both maps with drivers, and whether they newly became the class."""
    joined = before.select(*CELL, F.col("value").alias("b")).join(after.select(*CELL, F.col("value").alias("a")), CELL).where(F.col("b") != code)
    for name, cells in drivers.items():
        joined = joined.join(cells.select(*CELL, F.col("value").alias(name)), CELL)
    return joined.select(*CELL, (F.col("a") == code).cast("double").alias("label"), *drivers)


def development_probability(samples: DataFrame, drivers: list[str], trees: int = 20, seed: int = 7) -> DataFrame:
    """(row, col, probability) of development by a random forest over the drivers."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=drivers, outputCol="features").transform(samples)
    model = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=seed, labelCol="label", featuresCol="features").fit(ready)
    p = vector_to_array("probability")
    return model.transform(ready).select(*CELL, F.when(F.size(p) > 1, F.try_element_at(p, F.lit(2))).otherwise(F.lit(0.0)).alias("probability"))


def preview_quality(pixels: DataFrame) -> DataFrame:
    """(image_id, single_colour_share, black_share, passed) of preview pixels (image_id, r, g, b)."""
    counts = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    sums = counts.groupBy("image_id").agg(F.max("n").alias("top"), F.sum(F.when((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0), F.col("n")).otherwise(0)).alias("black"), F.sum("n").alias("n"))
    single, black = F.col("top") / F.col("n"), F.col("black") / F.col("n")
    return sums.select("image_id", single.alias("single_colour_share"), black.alias("black_share"), ((single < 0.98) & (black < 0.95)).alias("passed"))
