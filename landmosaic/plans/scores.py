"""Queries of scoring."""

from pyspark.sql import functions as F

from ..operators import scoring, stats
from ..operators.ordering import numbered
from ..operators.scoring import Criterion
from .registry import query

CRITERIA = [Criterion("spend", 0.4), Criterion("peak", 0.3), Criterion("mean", 0.3, benefit=False)]
NORM = "b AS (SELECT min(spend) ls, max(spend) hs, min(peak) lp, max(peak) hp, min(mean) lm, max(mean) hm FROM units), n AS (SELECT unit_id, scenario, spend, peak, mean, (spend - ls) / (hs - ls) AS ns, (peak - lp) / (hp - lp) AS np, (hm - mean) / (hm - lm) AS nm FROM units, b)"


@query("m1_service_score", f"WITH {NORM} SELECT unit_id, scenario, spend AS value_spend, peak AS value_peak, mean AS value_mean, ns AS norm_spend, np AS norm_peak, nm AS norm_mean, 0.4 * ns + 0.3 * np + 0.3 * nm AS score FROM n", "value_spend value_peak value_mean norm_spend norm_peak norm_mean score")
def _(t):
    return scoring.score(t.units, CRITERIA, ["unit_id", "scenario"])


FIXED = [Criterion("spend", 2.0, low=500_000.0, high=2_000_000.0), Criterion("peak", 1.0, benefit=False)]


@query("p6_fixed_bounds", "SELECT unit_id, spend AS value_spend, peak AS value_peak, greatest(0, least(1, (spend - 500000) / 1500000)) AS norm_spend, (hp - peak) / (hp - lp) AS norm_peak, 2.0 / 3 * greatest(0, least(1, (spend - 500000) / 1500000)) + (hp - peak) / (hp - lp) / 3 AS score FROM units, (SELECT min(peak) lp, max(peak) hp FROM units)", "value_spend value_peak norm_spend norm_peak score")
def _(t):
    return scoring.score(t.units, FIXED, ["unit_id"])


@query("p5_constant_criterion", "SELECT unit_id, spend AS value_spend, 1.0 AS value_one, (spend - ls) / (hs - ls) AS norm_spend, 0.5 AS norm_one, 0.5 * (spend - ls) / (hs - ls) + 0.25 AS score FROM units, (SELECT min(spend) ls, max(spend) hs FROM units)", "value_spend value_one norm_spend norm_one score")
def _(t):
    return scoring.score(t.units.withColumn("one", F.lit(1.0)), [Criterion("spend", 1.0), Criterion("one", 1.0)], ["unit_id"])


@query("s8_score_metadata", "SELECT 'spend' AS field, 2.0 / 3 AS weight, 500000.0 AS low, 2000000.0 AS high, count(*) FILTER (spend < 500000 OR spend > 2000000) AS clipped FROM units UNION ALL SELECT 'peak', 1.0 / 3, min(peak), max(peak), 0 FROM units", "weight low high")
def _(t):
    return scoring.score_metadata(t.units, FIXED)


SENSITIVITY = f"""{NORM}, x(criterion, direction, ws, wp, wm) AS (VALUES ('spend', 'decrease', 0.36, 0.3, 0.3), ('spend', 'increase', 0.44, 0.3, 0.3), ('peak', 'decrease', 0.4, 0.27, 0.3), ('peak', 'increase', 0.4, 0.33, 0.3), ('mean', 'decrease', 0.4, 0.3, 0.27), ('mean', 'increase', 0.4, 0.3, 0.33)),
s AS (SELECT criterion, direction, unit_id, CASE criterion WHEN 'spend' THEN ws WHEN 'peak' THEN wp ELSE wm END / (ws + wp + wm) AS w, 0.4 * ns + 0.3 * np + 0.3 * nm AS score, (ws * ns + wp * np + wm * nm) / (ws + wp + wm) AS changed FROM n, x)"""


@query("a34_weight_sensitivity", f"WITH {SENSITIVITY} SELECT criterion, direction, max(w) AS perturbed_weight, avg(abs(changed - score)) AS mean_change, max(abs(changed - score)) AS max_change FROM s GROUP BY ALL", "perturbed_weight mean_change max_change")
def _(t):
    return scoring.score_changes(t.units, CRITERIA, 0.1, "unit_id")


@query("w2_rank_shifts", f"WITH {SENSITIVITY}, r AS (SELECT criterion, direction, row_number() OVER (PARTITION BY criterion, direction ORDER BY score DESC, unit_id) AS r0, row_number() OVER (PARTITION BY criterion, direction ORDER BY changed DESC, unit_id) AS r1 FROM s) SELECT criterion, direction, count(*) FILTER (r0 <> r1) AS rank_changes, max(abs(r1 - r0)) AS max_rank_shift FROM r GROUP BY ALL")
def _(t):
    return scoring.sensitivity(t.units, CRITERIA, 0.1, "unit_id").select("criterion", "direction", "rank_changes", "max_rank_shift")


@query("w2_ordinal_rank", "SELECT scenario, unit_id, row_number() OVER (PARTITION BY scenario ORDER BY orders DESC, unit_id) AS rank FROM units")
def _(t):
    return numbered(t.units.select("scenario", "unit_id", "orders"), ["scenario"], [F.desc("orders"), F.col("unit_id")], "rank").drop("orders")


def _judgements(t):
    """A panel of three criteria for each supplier, mostly not consistent."""
    k = F.col("s_suppkey")
    upper = [F.lit(1.0), 1.0 + k % 5, 1.0 / (1 + k % 7), 1.0 / (1.0 + k % 5), F.lit(1.0), 1.0 + k % 3, 1.0 + k % 7, 1.0 / (1 + k % 3), F.lit(1.0)]
    cells = t("supplier").select(k.alias("panel_id"), F.posexplode(F.array(*[x.cast("double") for x in upper])).alias("at", "judgement"))
    return cells.select("panel_id", F.expr("CAST(at div 3 + 1 AS INT)").alias("i"), (F.col("at") % 3 + 1).cast("int").alias("j"), "judgement")


#: Of 3 x 3 reciprocal matrices the weights are the rows' geometric means, and the largest eigenvalue is 1 + u + 1 / u.
PANELS = "k AS (SELECT s_suppkey AS panel_id, 1.0 + s_suppkey % 5 AS a, 1.0 / (1 + s_suppkey % 7) AS b, 1.0 + s_suppkey % 3 AS c FROM supplier), w AS (SELECT *, pow(a * b, 1 / 3.0) AS x, pow(c / a, 1 / 3.0) AS y, pow(1 / (b * c), 1 / 3.0) AS z, pow(b / (a * c), 1 / 3.0) AS u FROM k), p AS (SELECT *, 1 + u + 1 / u AS lambda_max, (u + 1 / u - 2) / 2 / 0.58 AS cr FROM w)"


@query("m2_ahp_weights", f"WITH {PANELS} SELECT panel_id, 3 AS n, x / (x + y + z) AS w1, y / (x + y + z) AS w2, z / (x + y + z) AS w3, lambda_max, cr FROM p", "w1 w2 w3 lambda_max cr")
def _(t):
    a = scoring.ahp(_judgements(t))
    return a.select("panel_id", F.col("n").cast("int").alias("n"), *[F.element_at("weights", k).alias(f"w{k}") for k in range(1, 4)], "lambda_max", "cr")


@query("m3_ahp_violations", f"WITH {PANELS} SELECT panel_id, r AS rule FROM p, (VALUES ('not_reciprocal'), ('not_positive'), ('inconsistent')) x(r) WHERE panel_id % 4 = 0 AND r = 'not_reciprocal' OR panel_id % 8 = 0 AND r = 'not_positive' OR panel_id % 4 <> 0 AND r = 'inconsistent' AND cr > 0.1")
def _(t):
    first = (F.col("i") == 1) & (F.col("j") == 2)
    broken = F.when(first & (F.col("panel_id") % 8 == 0), -1.0).when(first & (F.col("panel_id") % 4 == 0), 50.0).otherwise(F.col("judgement"))
    return scoring.ahp_violations(_judgements(t).withColumn("judgement", broken))


@query("j7_paired_scenarios", "WITH p AS (SELECT o_custkey // 4 AS unit_id, scenario, sum(v) AS spend FROM g JOIN orders ON k = o_orderkey GROUP BY ALL) SELECT p.scenario, p.unit_id, 'spend' AS field, p.spend AS value, r.spend AS base FROM p LEFT JOIN p r ON r.scenario = 'ND' AND r.unit_id = p.unit_id", "value base", 3)
def _(t):
    return stats.pair_scenarios(_by_scenario(t), ["spend"], "ND")


@query("a24_scenario_means", "WITH m AS (SELECT scenario, avg(spend) AS spend, avg(peak) AS peak FROM units GROUP BY scenario), l AS (SELECT scenario, 'spend' AS field, spend AS mean FROM m UNION ALL SELECT scenario, 'peak', peak FROM m) SELECT l.scenario, l.field, l.mean, l.mean - r.mean AS delta FROM l JOIN l r ON r.field = l.field AND r.scenario = 'ND'", "mean delta", 3)
def _(t):
    return stats.scenario_means(t.units, ["spend", "peak"], "ND")


def _by_scenario(t):
    table = t("orders").where("o_orderkey % 97 <> 0").select(F.expr("o_custkey div 4").alias("unit_id"), F.element_at(F.array(*map(F.lit, ("ND", "UD", "EP", "RE"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("scenario"), "o_totalprice")
    return table.groupBy("scenario", "unit_id").agg(F.sum("o_totalprice").alias("spend"), F.max("o_totalprice").alias("peak"))


PAIRED = "WITH p AS (SELECT o_custkey // 4 AS unit_id, scenario, sum(v) AS spend, max(v) AS peak FROM g JOIN orders ON k = o_orderkey GROUP BY ALL), l AS (SELECT scenario, unit_id, 'spend' AS field, spend AS value FROM p UNION ALL SELECT scenario, unit_id, 'peak', peak FROM p)"


@query("a25_paired_deltas", PAIRED + " SELECT l.scenario, l.field, count(r.value) AS paired_units, count(*) - count(r.value) AS unpaired_units, coalesce(avg(l.value - r.value), 0) AS paired_mean_delta FROM l LEFT JOIN l r ON r.scenario = 'ND' AND r.unit_id = l.unit_id AND r.field = l.field GROUP BY ALL", "paired_mean_delta", 3)
def _(t):
    return stats.paired_deltas(_by_scenario(t), ["spend", "peak"], "ND")


@query("w5_best_candidate", "WITH c AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) AS modelled, abs(abs(s_acctbal) - 5000) AS absolute_error FROM supplier) SELECT *, absolute_error / 5000 AS relative_error, row_number() OVER (PARTITION BY s_nationkey ORDER BY absolute_error, s_suppkey) = 1 AS selected FROM c", "modelled absolute_error relative_error")
def _(t):
    return stats.best_candidate(t("supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("modelled")), "modelled", 5000.0, ["s_nationkey"], "s_suppkey")


@query("o2_top_candidate", "SELECT s_suppkey, abs(abs(s_acctbal) - 5000) AS absolute_error FROM supplier ORDER BY absolute_error, s_suppkey LIMIT 1", "absolute_error")
def _(t):
    return t("supplier").select("s_suppkey", F.abs(F.abs("s_acctbal") - 5000.0).alias("absolute_error")).orderBy("absolute_error", "s_suppkey").limit(1)
