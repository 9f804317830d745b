"""Scenario comparison, rank correlation with Monte-Carlo inference, and factor analysis."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..functions.shuffle import placed, replicated
from . import bootstrap
from .ordering import cut, numbered, running_total


def scenario_means(table: DataFrame, fields: list[str], reference: str) -> DataFrame:
    """(scenario, field, mean, delta) against the reference scenario; fails if that is absent."""
    long = melt(table, ["scenario"], fields)
    means = long.groupBy("scenario", "field").agg(F.avg("value").alias("mean"))
    base = means.where(F.col("scenario") == reference).select(F.col("field").alias("of"), F.col("mean").alias("base"))
    joined = means.join(F.broadcast(base), F.col("field") == F.col("of"), "left")
    return joined.select("scenario", "field", "mean", F.when(F.col("base").isNotNull(), F.col("mean") - F.col("base")).otherwise(F.raise_error(F.lit("the reference scenario is absent")).cast("double")).alias("delta"))


def pair_scenarios(table: DataFrame, fields: list[str], reference: str, unit: str = "unit_id") -> DataFrame:
    """(scenario, unit, field, value, base): each unit's value beside its value in the reference scenario, null where that lacks it."""
    long = melt(table, ["scenario", unit], fields)
    base = long.where(F.col("scenario") == reference).select(F.col(unit).alias("u"), F.col("field").alias("f"), F.col("value").alias("base"))
    return long.join(base, (F.col(unit) == F.col("u")) & (F.col("field") == F.col("f")), "left").select("scenario", unit, "field", "value", "base")


def paired_deltas(table: DataFrame, fields: list[str], reference: str, unit: str = "unit_id") -> DataFrame:
    """(scenario, field, paired_units, unpaired_units, paired_mean_delta): unit by unit; 0 where none pairs."""
    return pair_scenarios(table, fields, reference, unit).groupBy("scenario", "field").agg(F.count("base").alias("paired_units"), F.count_if(F.col("base").isNull()).alias("unpaired_units"), F.coalesce(F.avg(F.col("value") - F.col("base")), F.lit(0.0)).alias("paired_mean_delta"))


def melt(table: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, value): a row for each field."""
    return table.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")).select(*keys, "x.field", "x.value")


def average_ranks(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds rank: the mean of the places that equal values take.

    Distinct values are counted first, and the counts are added up by ranges of values.
    """
    counts = running_total(long.groupBy(*by, value).agg(F.count("*").alias("ties")), by, [F.col(value)], F.col("ties"), "upto")
    ranks = counts.select(*[F.col(c).alias(f"of_{c}") for c in (*by, value)], (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("rank"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, value)]
    return long.join(ranks, on).drop(*[f"of_{c}" for c in (*by, value)])


def pearson(x: Column | str, y: Column | str) -> Column:
    """An aggregate; null for fewer than two rows or no variance.

    Whether there is variance is told by the extremes: partial means put together are off in the last
    place, so that a constant may get a deviation of 1e-16.
    """
    x, y = col(x), col(y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pairs_of(fields: list[str]) -> list[tuple[str, str]]:
    return list(combinations(fields, 2))


def _ranked(table: DataFrame, fields: list[str], unit: str) -> DataFrame:
    """(unit, a column of ranks for each field)."""
    ranks = average_ranks(melt(table, [unit], fields), ["field"])
    return ranks.groupBy(unit).pivot("field", fields).agg(F.first("rank"))


def _pair_rows(fields: list[str]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(a).alias("service_a"), F.lit(b).alias("service_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs_of(fields)]))


def rank_pairs(table: DataFrame, fields: list[str], unit: str) -> DataFrame:
    """(service_a, service_b, x, y): the ranks of each unit in every pair of fields, i before j."""
    return _ranked(table, fields, unit).select(_pair_rows(fields))


def spearman(table: DataFrame, fields: list[str], unit: str) -> DataFrame:
    """(service_a, service_b, n, rho, relation) of every pair of fields."""
    out = rank_pairs(table, fields, unit).groupBy("service_a", "service_b").agg(F.count("*").alias("n"), pearson("x", "y").alias("rho"))
    relation = F.when(F.col("rho").isNull(), "undefined").when(F.col("rho") > 0, "synergy").when(F.col("rho") < 0, "tradeoff").otherwise("neutral")
    return out.withColumn("relation", relation)


def permutation_p(table: DataFrame, fields: list[str], unit: str, permutations: int, seed: int) -> DataFrame:
    """(service_a, service_b, p): two-sided, of the correlation of ranks under shuffled units.

    A replicate is a keyed permutation of the units' places, told by a formula; so a unit meets the one
    that it is paired with by one join. Means and variances don't change, so a replicate is one sum of
    products for each pair. Units are numbered once.
    """
    ranks = cut(_ranked(table, fields, unit))
    base = cut(placed(ranks, numbered(ranks, [], [F.col(unit)], "i")).select("i", "n", *fields))
    other = base.select(F.col("i").alias("at"), *[F.col(f).alias(f"y_{f}") for f in fields])
    pairs = pairs_of(fields)
    joined = replicated(base, range(1, permutations + 1), seed).join(other, F.col("j") == F.col("at"))
    by_rep = joined.groupBy("rep").agg(*[F.sum(F.col(a) * F.col(f"y_{b}")).alias(f"xy_{k}") for k, (a, b) in enumerate(pairs)])
    sums = by_rep.select(F.inline(F.array(*[F.struct(F.lit(a).alias("service_a"), F.lit(b).alias("service_b"), F.col(f"xy_{k}").alias("xy")) for k, (a, b) in enumerate(pairs)])))
    # Ranks are halves and their products exact, so equal correlations compare equal.
    seen = ranks.select(_pair_rows(fields)).groupBy("service_a", "service_b").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy0"), (F.sum("x") * F.sum("y") / F.count("*")).alias("centre"), pearson("x", "y").alias("rho"))
    met = sums.join(F.broadcast(seen), ["service_a", "service_b"])
    extreme = F.abs(F.col("xy") - F.col("centre")) >= F.abs(F.col("xy0") - F.col("centre"))
    return met.groupBy("service_a", "service_b").agg(F.when((F.max("n") >= 3) & F.max("rho").isNotNull(), (F.count_if(extreme) + 1) / (F.count("*") + 1)).alias("p"))


def bootstrap_ci(table: DataFrame, fields: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """(service_a, service_b, replicates, low, high): 95 % interval of rho from units drawn with replacement.

    Draws are hashes of replicate and place; every replicate is ranked anew, from how often each unit is drawn.
    """
    units = cut(numbered(table.select(unit, *fields), [], [F.col(unit)], "i").withColumn("i", F.col("i") - 1))
    found = bootstrap.rhos(table.sparkSession, _ranked(units, fields, "i"), units.count(), fields, replicates, seed)
    rhos = found.withColumn("rho", F.round("rho", 9)).where("rho IS NOT NULL")
    sorted_rhos = rhos.groupBy("service_a", "service_b").agg(F.array_sort(F.collect_list("rho")).alias("s"), F.count("*").alias("replicates"))
    at = lambda q: F.element_at("s", (F.floor(F.lit(q) * (F.col("replicates") - 1)) + 1).cast("int"))
    return sorted_rhos.select("service_a", "service_b", "replicates", at(0.025).alias("low"), at(0.975).alias("high"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", tie: list[str] | None = None) -> DataFrame:
    """Adds fdr: each p times the tests over its rank, no larger than that of any larger p. Nulls get none."""
    known = tests.where(F.col(p).isNotNull())
    asc = Window.orderBy(p, *(tie or []))
    ranked = known.withColumn("rn", F.row_number().over(asc)).withColumn("m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.withColumn("fdr", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rn")).over(down))).drop("rn", "m")
    return adjusted.unionByName(tests.where(F.col(p).isNull()).withColumn("fdr", F.lit(None).cast("double")))


def quantile_strata(table: DataFrame, field: str, bins: int, out: str) -> DataFrame:
    """Adds a stratum Q1, Q2, ... by linear quantiles of a field; its value as text if it has few distinct ones.

    A value's stratum is the number of distinct quantiles up to it, the largest value's that of the
    last interval. Values are counted first and the quantiles read off their running totals.
    """
    counts = cut(running_total(table.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("double").alias("x")).agg(F.count("*").alias("n")), [], [F.col("x")], F.col("n"), "upto"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    exact = F.col("q") / bins * (F.col("total") - 1)
    asked = whole.select("total", "kinds", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("q")).select("kinds", "q", F.floor(exact).alias("at"), (exact - F.floor(exact)).alias("part"), F.least(F.floor(exact) + 1, F.col("total") - 1).alias("next"))
    # A few rows: each quantile lies between two places of the sorted values.
    found = counts.join(F.broadcast(asked), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("next")))
    holds = lambda p: F.max(F.when((F.col("upto") > F.col(p)) & (F.col("upto") - F.col("n") <= F.col(p)), F.col("x")))
    ends = found.groupBy("kinds", "q", "part").agg(holds("at").alias("low"), holds("next").alias("high"))
    edges = ends.groupBy("kinds").agg(F.array_sort(F.collect_set(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))).alias("edges"))
    x = F.col(field)
    place = F.size(F.filter("edges", lambda e: e <= x))
    label = F.concat(F.lit("Q"), F.least(place, F.size("edges") - 1).cast("string"))
    return table.crossJoin(F.broadcast(edges)).withColumn(out, F.when((F.col("kinds") > bins) & x.isNotNull(), label).otherwise(x.cast("string"))).drop("edges", "kinds")


def factor_q(samples: DataFrame, target: str, factors: list[str]) -> DataFrame:
    """(factor, n, q): the part of the target's variance that lies between a factor's strata.

    Fails on a blank stratum or a target without variance. Strata are combined from partial sums.
    """
    y = F.col(target).cast("double")
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("stratum")) for f in factors]))
    strata = samples.select(y.alias("y"), rows).groupBy("factor", "stratum").agg(F.count("*").alias("n"), F.var_pop("y").alias("v"), F.avg("y").alias("m"))
    checked = strata.withColumn("n", F.when(F.coalesce(F.trim("stratum"), F.lit("")) != "", F.col("n")).otherwise(F.raise_error(F.lit("blank stratum")).cast("long")))
    within = checked.groupBy("factor").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"))
    whole = samples.agg(F.var_pop(y).alias("whole"))
    q = 1 - F.col("within") / (F.col("n") * F.col("whole"))
    return within.crossJoin(F.broadcast(whole)).select("factor", "n", F.when(F.col("whole") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).otherwise(F.raise_error(F.lit("the target has no variance")).cast("double")).alias("q"))


def factor_interactions(samples: DataFrame, target: str, factors: list[str]) -> DataFrame:
    """(factor_a, factor_b, q, relation) of strata crossed with each other."""
    pairs = pairs_of(factors)
    crossed = samples.select(F.col(target), *factors, *[F.concat_ws("|", a, b).alias(f"{a}|{b}") for a, b in pairs])
    joint = factor_q(crossed, target, [*factors, *[f"{a}|{b}" for a, b in pairs]])
    single = joint.select(F.col("factor").alias("f"), F.col("q").alias("fq"))
    table = F.inline(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("factor"), F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b")) for a, b in pairs]))
    named = samples.sparkSession.range(1).select(table).join(joint, "factor")
    both = named.join(single.withColumnRenamed("fq", "qa"), F.col("factor_a") == F.col("f")).drop("f").join(single.withColumnRenamed("fq", "qb"), F.col("factor_b") == F.col("f")).drop("f")
    q, high, both_q = F.col("q"), F.greatest("qa", "qb"), F.col("qa") + F.col("qb")
    close = F.abs(q - both_q) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(q), F.abs(both_q)))
    relation = F.when(q <= high, "weaken_or_non_enhance").when(close, "independent").when(q < both_q, "bi_factor_enhancement").otherwise("nonlinear_enhancement")
    return both.select("factor_a", "factor_b", "q", relation.alias("relation"))


def factor_permutation_p(samples: DataFrame, target: str, factors: list[str], unit: str, permutations: int, seed: int) -> DataFrame:
    """(factor, p): one-sided, of q under shuffled targets.

    The whole variance stays, so a replicate is one sum by stratum, of the targets that a keyed
    permutation of the places brings there. Targets are taken in cents, as whole numbers, so equal q
    compare equal.
    """
    y = F.round(F.col(target) * 100).cast("long")
    chosen = samples.select(unit, y.alias("y"), *factors)
    base = cut(placed(chosen, numbered(chosen, [], [F.col(unit)], "i")).drop(unit))
    targets = base.select(F.col("i").alias("at"), F.col("y").alias("y2"))
    joined = replicated(base.select("i", "n", *factors), range(permutations + 1), seed).join(targets, F.col("j") == F.col("at"))
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("stratum")) for f in factors]))
    strata = joined.select("rep", "y2", rows).groupBy("factor", "rep", "stratum").agg(F.sum("y2").alias("s"), F.count("*").alias("n"))
    between = strata.groupBy("factor", "rep").agg(F.round(F.sum(F.col("s").cast("double") * F.col("s") / F.col("n")), 0).alias("b"))
    seen = between.where("rep = 0").select(F.col("factor").alias("f"), F.col("b").alias("b0"))
    met = between.where("rep > 0").join(F.broadcast(seen), F.col("factor") == F.col("f"))
    return met.groupBy("factor").agg(((F.count_if(F.col("b") >= F.col("b0")) + 1) / (F.count("*") + 1)).alias("p"))


def best_candidate(candidates: DataFrame, modelled: str, observed: float, by: list[str], ordinal: str) -> DataFrame:
    """Adds absolute_error, relative_error and selected: the candidate closest to the observation; ties by ordinal, which tells candidates apart.

    A candidate without a value is never selected. The best of each group is a minimum, put together by task, and is joined back.
    """
    error = F.abs(F.col(modelled) - observed)
    scored = candidates.withColumn("absolute_error", error).withColumn("relative_error", error / abs(observed))
    best = scored.where("absolute_error IS NOT NULL").groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min(F.struct("absolute_error", ordinal)).alias("_best"))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    mine = F.coalesce((F.col("absolute_error") == F.col("_best.absolute_error")) & F.col(ordinal).eqNullSafe(F.col(f"_best.{ordinal}")), F.lit(False))
    return scored.join(best, on, "left").withColumn("selected", mine).select(*scored.columns, "selected")


def driver_diagnostics(table: DataFrame, drivers: list[str]) -> DataFrame:
    """(driver, low, high, mean, stddev, nodata_share)."""
    long = melt(table, [], drivers)
    return long.groupBy(F.col("field").alias("driver")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), (F.count_if(F.col("value").isNull()) / F.count("*")).alias("nodata_share"))


def correlation_matrix(table: DataFrame, drivers: list[str]) -> DataFrame:
    """(driver_a, driver_b, r) of every pair of drivers, in one pass."""
    long = table.select(F.inline(F.array(*[F.struct(F.lit(a).alias("driver_a"), F.lit(b).alias("driver_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs_of(drivers)])))
    return long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("driver_a", "driver_b").agg(pearson("x", "y").alias("r"))


def inflation(table: DataFrame, drivers: list[str]) -> DataFrame:
    """(driver, vif): diagonal of the inverse of the drivers' correlation matrix, which is a few numbers."""
    import numpy as np

    r = np.eye(len(drivers))
    for row in correlation_matrix(table, drivers).collect():
        i, j = drivers.index(row.driver_a), drivers.index(row.driver_b)
        r[i, j] = r[j, i] = row.r if row.r is not None else 0.0
    return table.sparkSession.createDataFrame([(d, float(v)) for d, v in zip(drivers, np.diag(np.linalg.pinv(r)), strict=True)], "driver string, vif double")
