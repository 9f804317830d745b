"""Multi-criteria scores, AHP weights and weight sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import array_sum, min_max, total, was_clipped
from .ordering import numbered

#: Saaty's random consistency index by matrix size from 1.
RANDOM_INDEX = [0.0, 0.0, 0.58, 0.9, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49]


@dataclass(frozen=True)
class Criterion:
    """A service field with its weight; with bounds it is scored against them, else against the project's own range."""

    field: str
    weight: float
    benefit: bool = True
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError(f"{self.field}: bounds must rise")


def normalised_weights(criteria: list[Criterion]) -> list[float]:
    if any(c.weight < 0 for c in criteria) or not (s := sum(c.weight for c in criteria)):
        raise ValueError("weights must be non-negative and not all zero")
    return [c.weight / s for c in criteria]


def with_bounds(table: DataFrame, criteria: list[Criterion]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The table with its own ranges, one row wide, beside each row; and each criterion's bounds."""
    own = [c for c in criteria if c.low is None or c.high is None]
    if own:
        ranges = table.agg(*[f(c.field).alias(f"{n}_{c.field}") for c in own for n, f in (("low", F.min), ("high", F.max))])
        table = table.crossJoin(F.broadcast(ranges))
    return table, [(F.lit(float(c.low)), F.lit(float(c.high))) if c not in own else (F.col(f"low_{c.field}"), F.col(f"high_{c.field}")) for c in criteria]


def score(table: DataFrame, criteria: list[Criterion], keep: list[str]) -> DataFrame:
    """keep, value_*, norm_* and score: the weighted sum of Min-Max scores."""
    weights = normalised_weights(criteria)
    ranged, bounds = with_bounds(table, criteria)
    normed = ranged.select(*keep, *[F.col(c.field).alias(f"value_{c.field}") for c in criteria], *[min_max(c.field, lo, hi, c.benefit).alias(f"norm_{c.field}") for c, (lo, hi) in zip(criteria, bounds, strict=True)])
    return normed.withColumn("score", total([F.col(f"norm_{c.field}") * w for c, w in zip(criteria, weights, strict=True)]))


def score_metadata(table: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """(field, weight, low, high, clipped): the weights and bounds in use and how many values lie outside them."""
    ranged, bounds = with_bounds(table, criteria)
    stats = ranged.agg(*[x for k, (c, (lo, hi)) in enumerate(zip(criteria, bounds, strict=True)) for x in (F.max(lo).alias(f"l{k}"), F.max(hi).alias(f"h{k}"), F.count_if(was_clipped(c.field, lo, hi)).alias(f"c{k}"))])
    rows = F.array(*[F.struct(F.lit(c.field).alias("field"), F.lit(w).alias("weight"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high"), F.col(f"c{k}").alias("clipped")) for k, (c, w) in enumerate(zip(criteria, normalised_weights(criteria), strict=True))])
    return stats.select(F.inline(rows))


def _variants(table: DataFrame, criteria: list[Criterion], delta: float, order: str) -> tuple[DataFrame, Column]:
    """Scores of all rows, and an array of (criterion, direction, perturbed_weight, changed) of each row."""
    if not 0 < delta < 1:
        raise ValueError("delta must lie between 0 and 1")
    base = normalised_weights(criteria)
    variants = []
    for k, c in enumerate(criteria):
        for direction, factor in (("decrease", 1 - delta), ("increase", 1 + delta)):
            changed = [w * (factor if i == k else 1) for i, w in enumerate(base)]
            s = sum(changed)
            variants.append((c.field, direction, [w / s for w in changed], changed[k] / s))
    score_of = lambda ws: total([F.col(f"norm_{c.field}") * w for c, w in zip(criteria, ws, strict=True)])
    rows = F.array(*[F.struct(F.lit(f).alias("criterion"), F.lit(d).alias("direction"), F.lit(p).alias("perturbed_weight"), score_of(ws).alias("changed")) for f, d, ws, p in variants])
    return score(table, criteria, [order]), rows


def _changes() -> list[Column]:
    moved = F.abs(F.col("changed") - F.col("score"))
    return [F.max("perturbed_weight").alias("perturbed_weight"), F.avg(moved).alias("mean_change"), F.max(moved).alias("max_change")]


def score_changes(table: DataFrame, criteria: list[Criterion], delta: float, order: str) -> DataFrame:
    """(criterion, direction, perturbed_weight, mean_change, max_change) as of sensitivity(), in one pass without ranks."""
    scored, rows = _variants(table, criteria, delta, order)
    return scored.select("score", F.inline(rows)).groupBy("criterion", "direction").agg(*_changes())


def sensitivity(table: DataFrame, criteria: list[Criterion], delta: float, order: str) -> DataFrame:
    """How scores and ranks move if one weight is a part `delta` smaller or larger and all are brought to sum 1.

    Ranks go by falling score, ties by `order`. They are exact over the whole table, and numbered by ranges of scores.
    """
    scored, rows = _variants(table, criteria, delta, order)
    first = numbered(scored, [], [F.desc("score"), F.col(order)], "r0")
    ranked = numbered(first.select(order, "score", "r0", F.inline(rows)), ["criterion", "direction"], [F.desc("changed"), F.col(order)], "r1")
    shift = F.abs(F.col("r1") - F.col("r0"))
    return ranked.groupBy("criterion", "direction").agg(*_changes(), F.count_if(shift > 0).alias("rank_changes"), F.max(shift).cast("long").alias("max_rank_shift"))


def judgement_rows(judgements: DataFrame) -> DataFrame:
    """(panel_id, n, m): each panel's matrix of (panel_id, i, j, judgement) as an array of rows."""
    rows = judgements.groupBy("panel_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "judgement"))), lambda x: x["judgement"]).alias("r"))
    return rows.groupBy("panel_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("m"))


def ahp(judgements: DataFrame, steps: int = 1000, tolerance: float = 1e-12) -> DataFrame:
    """(panel_id, n, weights, lambda_max, ci, cr) by power iteration, one row for each panel of up to 10 criteria.

    A panel's iteration ends when no weight moves by the tolerance; the job fails for more than 10 criteria.
    """
    times = lambda m, w: F.transform(m, lambda r: array_sum(F.zip_with(r, w, lambda a, b: a * b)))
    unit = lambda v: F.transform(v, lambda x: x / array_sum(v))
    start = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda _: F.lit(1.0) / F.col("n"))
    moved = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    state = F.struct(start.alias("w"), F.lit(False).alias("done"))
    step = lambda s: F.transform(F.array(unit(times(F.col("m"), s["w"]))), lambda w: F.struct(w.alias("w"), (moved(w, s["w"]) < tolerance).alias("done")))[0]
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(s["done"], s).otherwise(step(s)))["w"]
    out = judgement_rows(judgements).withColumn("weights", weights)
    ratios = F.zip_with(times(F.col("m"), F.col("weights")), "weights", lambda a, w: a / w)
    n = F.col("n")
    out = out.withColumn("lambda_max", array_sum(ratios) / n)
    ci = F.when(n > 2, (F.col("lambda_max") - n) / (n - 1)).otherwise(F.lit(0.0))
    index = F.when(n > len(RANDOM_INDEX), F.raise_error(F.lit("at most 10 criteria")).cast("double")).otherwise(F.try_element_at(F.array(*map(F.lit, RANDOM_INDEX)), n.cast("int")))
    return out.withColumn("ci", ci).select("panel_id", "n", "weights", "lambda_max", "ci", F.when(index > 0, F.col("ci") / index).otherwise(F.lit(0.0)).alias("cr"))


def ahp_violations(judgements: DataFrame, max_ratio: float = 0.1) -> DataFrame:
    """(panel_id, rule): matrices that aren't positive, reciprocal, square with a unit diagonal; of sound ones, those not consistent."""
    j = judgements
    swapped = j.select("panel_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("judgement").alias("back"))
    pairs = j.join(swapped, ["panel_id", "i", "j"], "left")
    v, b = F.col("judgement"), F.col("back")
    rules = {"not_square": b.isNull(), "not_positive": v <= 0, "diagonal_not_one": (F.col("i") == F.col("j")) & (F.abs(v - 1) > 1e-4), "not_reciprocal": F.abs(v * b - 1) > 1e-4}
    cells = pairs.select("panel_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    sound = j.join(cells.select("panel_id").distinct(), "panel_id", "left_anti")
    return cells.union(ahp(sound).where(F.col("cr") > max_ratio).select("panel_id", F.lit("inconsistent"))).distinct()
