"""Agreement between class maps, simulations and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .change import CELL


def confusion(samples: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """(reference, prediction, n): zero-filled over all labels of either side; labels are text, nulls drop out.

    The labels come from the counts, so the samples are read once.
    """
    counts = samples.select(F.col(reference).cast("string").alias("reference"), F.col(prediction).cast("string").alias("prediction")).where("reference IS NOT NULL AND prediction IS NOT NULL").groupBy("reference", "prediction").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("reference", "prediction")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("reference")).crossJoin(labels.select(F.col("label").alias("prediction")))
    return grid.join(counts, ["reference", "prediction"], "left").select("reference", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(samples: DataFrame, labels: list[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """A row for each reference label and a column for each given prediction label."""
    return samples.select(F.col(reference).cast("string").alias("reference"), F.col(prediction).cast("string").alias("prediction")).groupBy("reference").pivot("prediction", labels).count().fillna(0)


def _ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, support, predicted, correct, precision, recall, f1, iou) from a confusion table."""
    hit = F.when(F.col("reference") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = matrix.select(F.col("reference").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("correct")).union(
        matrix.select(F.col("prediction").alias("label"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long"))
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    s, p, c = F.col("support"), F.col("predicted"), F.col("correct")
    return sums.select("label", "support", "predicted", "correct", _ratio(c, p).alias("precision"), _ratio(c, s).alias("recall"), _ratio(2.0 * c, s + p).alias("f1"), _ratio(c, s + p - c).alias("iou"))


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """One row: n, overall_accuracy, macro_f1, macro_iou, kappa, quantity and allocation disagreement."""
    per = class_metrics(matrix)
    total = per.agg(F.sum("support").alias("n"), F.sum("correct").alias("hits"), F.avg("f1").alias("macro_f1"), F.avg("iou").alias("macro_iou"), F.sum(F.col("support") * F.col("predicted")).alias("chance"), F.sum(F.abs(F.col("support") - F.col("predicted"))).alias("off"))
    n = F.col("n")
    agree, chance = F.col("hits") / n, F.col("chance") / (n * n)
    quantity = F.col("off") / (2 * n)
    return total.select("n", agree.alias("overall_accuracy"), "macro_f1", "macro_iou", F.when(chance == 1, F.lit(1.0)).otherwise((agree - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"), quantity.alias("quantity_disagreement"), (1 - agree - quantity).alias("allocation_disagreement"))


def producer_user(matrix: DataFrame) -> DataFrame:
    """(label, producers_accuracy, users_accuracy)."""
    return class_metrics(matrix).select("label", F.col("recall").alias("producers_accuracy"), F.col("precision").alias("users_accuracy"))


def figure_of_merit(baseline: DataFrame, reference: DataFrame, simulated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correct change over the union of observed and simulated change; 1 if nothing changed in either.

    `simulated` may hold several runs told apart by the columns in `by`; each counts the cells where it
    and both others are valid.
    """
    by = by or []
    joined = baseline.select(*CELL, F.col("value").alias("b")).join(reference.select(*CELL, F.col("value").alias("r")), CELL).join(simulated.select(*by, *CELL, F.col("value").alias("s")), CELL)
    observed, predicted = F.col("r") != F.col("b"), F.col("s") != F.col("b")
    counts = joined.groupBy(*by).agg(F.count_if(observed).alias("observed_change"), F.count_if(predicted).alias("predicted_change"), F.count_if(observed & (F.col("s") == F.col("r"))).alias("correct_change"), F.count_if(observed | predicted).alias("either"))
    return counts.select(*by, "observed_change", "predicted_change", "correct_change", F.when(F.col("either") == 0, F.lit(1.0)).otherwise(F.col("correct_change") / F.col("either")).alias("figure_of_merit"))


def merit_spread(per_seed: DataFrame) -> DataFrame:
    """One row: seeds, mean and population standard deviation; null below two seeds."""
    return per_seed.agg(F.count("*").alias("seeds"), F.avg("figure_of_merit").alias("mean_fom"), F.when(F.count("*") >= 2, F.stddev_pop("figure_of_merit")).alias("stddev_fom"))


def ensemble(simulated: DataFrame) -> DataFrame:
    """(row, col, consensus, agreement, uncertainty) over simulations; ties go to the lowest class."""
    counts = simulated.groupBy(*CELL, "value").agg(F.count("*").alias("n"))
    best = counts.groupBy(*CELL).agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m"), F.sum("n").alias("runs"))
    share = F.col("m.n") / F.col("runs")
    return best.select(*CELL, (-F.col("m.v")).alias("consensus"), share.alias("agreement"), (1 - share).alias("uncertainty"))


def consistency(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """One row: totals, relative difference, RMSE, largest difference and whether two runs agree."""
    joined = a.select(*CELL, F.col("value").alias("x")).join(b.select(*CELL, F.col("value").alias("y")), CELL)
    d = F.col("x") - F.col("y")
    sums = joined.agg(F.count("*").alias("common_cells"), F.sum("x").alias("total_a"), F.sum("y").alias("total_b"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_difference"))
    relative = F.abs(F.col("total_a") - F.col("total_b")) / F.greatest(F.abs("total_b"), F.lit(1e-12))
    return sums.select("common_cells", "total_a", "total_b", relative.alias("relative_difference"), "rmse", "max_difference", (relative <= tolerance).alias("passed"))


def adjusted_area(matrix: DataFrame, mapped: DataFrame) -> DataFrame:
    """(label, area_ha, ci95_ha): stratified estimate of true class areas; mapped (label, area_ha) by map class.

    Strata are map classes; the variance is that of the stratified estimator of a proportion.
    """
    row = Window.partitionBy("prediction")
    shares = matrix.select("reference", "prediction", (F.col("n") / F.nullif(F.sum("n").over(row), F.lit(0))).alias("p"), F.sum("n").over(row).alias("n_i"))
    every = Window.partitionBy()
    areas = mapped.select(F.col("label").alias("prediction"), "area_ha", F.sum("area_ha").over(every).alias("all_ha"))
    w = F.col("area_ha") / F.col("all_ha")
    joined = shares.join(areas, "prediction")
    sums = joined.groupBy(F.col("reference").alias("label")).agg(F.sum(F.col("p") * F.col("area_ha")).alias("area_ha"), (F.lit(1.96) * F.max("all_ha") * F.sqrt(F.sum(w * w * F.col("p") * (1 - F.col("p")) / F.nullif(F.col("n_i") - 1, F.lit(0))))).alias("ci95_ha"))
    return sums
