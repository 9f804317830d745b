"""Queries of rank correlation, Monte-Carlo inference and factor analysis."""

from pyspark.sql import functions as F

from ..functions import shuffle
from ..operators import stats
from .registry import query

SERVICES = ["spend", "peak", "mean"]
SEED = 20260713
#: Replicates in the registered queries; operators take any number.
REPLICATES = 999
RANKS = """u AS (SELECT l_suppkey AS unit_id, sum(l_quantity) AS spend, max(l_extendedprice) AS peak, CAST(count(*) AS DOUBLE) AS mean FROM lineitem GROUP BY ALL),
r AS (SELECT unit_id, spend, peak, mean, rank() OVER (ORDER BY spend) + (count(*) OVER (PARTITION BY spend) - 1) / 2.0 AS rs, rank() OVER (ORDER BY peak) + (count(*) OVER (PARTITION BY peak) - 1) / 2.0 AS rp, rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0 AS rm FROM u),
pr AS (SELECT unit_id, 'spend' AS service_a, 'peak' AS service_b, rs AS x, rp AS y FROM r UNION ALL SELECT unit_id, 'spend', 'mean', rs, rm FROM r UNION ALL SELECT unit_id, 'peak', 'mean', rp, rm FROM r)"""
RHO = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


def _suppliers(t):
    """Suppliers as units, by what they deliver."""
    return t("lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.sum("l_quantity").alias("spend"), F.max("l_extendedprice").alias("peak"), F.count("*").cast("double").alias("mean"))


@query("w1_average_ranks", "SELECT l_suppkey, l_quantity AS value, l_linenumber, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS rank FROM lineitem", "rank")
def _(t):
    return stats.average_ranks(t("lineitem").select("l_suppkey", F.col("l_quantity").alias("value"), "l_linenumber"), ["l_linenumber"])


@query("a26_pearson", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r, CAST(NULL AS DOUBLE) AS r_constant FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(stats.pearson("l_quantity", "l_extendedprice"), 6).alias("r"), stats.pearson("l_quantity", F.lit(1.0)).alias("r_constant"))


@query("a27_spearman", f"WITH {RANKS} SELECT service_a, service_b, count(*) AS n, {RHO} AS rho, CASE WHEN {RHO} IS NULL THEN 'undefined' WHEN {RHO} > 0 THEN 'synergy' WHEN {RHO} < 0 THEN 'tradeoff' ELSE 'neutral' END AS relation FROM pr GROUP BY ALL", "rho")
def _(t):
    return stats.spearman(_suppliers(t), SERVICES, "unit_id")


def _walked(rows: str, replicates: str) -> str:
    """w: (rep, i, v) of rows with a place i and their number n, v the place that i goes to."""
    again = shuffle.sql("(SELECT rep, i, n, v FROM go WHERE rep > 0 AND (step = 0 OR v >= n))", SEED)
    return f"""go AS (SELECT rep.x AS rep, i, n, i AS v, 0 AS step FROM {rows}, {replicates} rep(x) UNION ALL SELECT rep, i, n, v, 1 FROM ({again})),
w AS (SELECT rep, i, v FROM go WHERE rep = 0 OR step = 1 AND v < n)"""


SHUFFLED = f"""{RANKS}, o AS (SELECT r.*, row_number() OVER (ORDER BY unit_id) - 1 AS i, count(*) OVER () AS n FROM r),
{_walked("o", f"range(1, {REPLICATES + 1})")},
s AS (SELECT w.rep, a.rs, a.rp, a.rm, b.rp AS yp, b.rm AS ym FROM w JOIN o a ON a.i = w.i JOIN o b ON b.i = w.v),
xy AS (SELECT 'spend' AS service_a, 'peak' AS service_b, rep, sum(rs * yp) AS xy FROM s GROUP BY rep UNION ALL SELECT 'spend', 'mean', rep, sum(rs * ym) FROM s GROUP BY rep UNION ALL SELECT 'peak', 'mean', rep, sum(rp * ym) FROM s GROUP BY rep),
ob AS (SELECT service_a, service_b, sum(x * y) AS xy0, sum(x) * sum(y) / count(*) AS centre FROM pr GROUP BY ALL),
pv AS (SELECT service_a, service_b, (count(*) FILTER (abs(xy - centre) >= abs(xy0 - centre)) + 1) / (count(*) + 1) AS p FROM xy JOIN ob USING (service_a, service_b) GROUP BY ALL)"""


@query("j8_service_pairs", f"WITH {RANKS} SELECT service_a, service_b, count(*) AS n, sum(x * y) AS xy FROM pr GROUP BY ALL", "xy")
def _(t):
    pairs = stats.rank_pairs(_suppliers(t), SERVICES, "unit_id")
    return pairs.groupBy("service_a", "service_b").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"))


@query("a28_permutation_p", f"WITH RECURSIVE {SHUFFLED} SELECT * FROM pv", "p")
def _(t):
    return stats.permutation_p(_suppliers(t), SERVICES, "unit_id", REPLICATES, SEED)


@query("a29_bootstrap_ci", f"""WITH {RANKS}, n AS (SELECT *, row_number() OVER (ORDER BY unit_id) - 1 AS i, count(*) OVER () AS n FROM u),
d AS (SELECT rep.x AS rep, i AS place, ('0x' || substr(md5(concat_ws('|', '{SEED}', rep.x, i)), 1, 8))::BIGINT % n AS draw FROM n, range(1, {REPLICATES + 1}) rep(x)),
w AS (SELECT rep, place, spend, peak, mean FROM d JOIN n ON draw = i),
k AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY spend) + (count(*) OVER (PARTITION BY rep, spend) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY rep ORDER BY peak) + (count(*) OVER (PARTITION BY rep, peak) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY rep ORDER BY mean) + (count(*) OVER (PARTITION BY rep, mean) - 1) / 2.0 AS rm FROM w),
q AS (SELECT 'spend' AS service_a, 'peak' AS service_b, rep, rs AS x, rp AS y FROM k UNION ALL SELECT 'spend', 'mean', rep, rs, rm FROM k UNION ALL SELECT 'peak', 'mean', rep, rp, rm FROM k),
h AS (SELECT service_a, service_b, rep, round({RHO}, 9) AS rho FROM q GROUP BY ALL),
l AS (SELECT service_a, service_b, list_sort(list(rho)) AS s, count(*) AS replicates FROM h WHERE rho IS NOT NULL GROUP BY ALL)
SELECT service_a, service_b, replicates, s[CAST(floor(0.025 * (replicates - 1)) AS INT) + 1] AS low, s[CAST(floor(0.975 * (replicates - 1)) AS INT) + 1] AS high FROM l""", "low high")
def _(t):
    return stats.bootstrap_ci(_suppliers(t), SERVICES, "unit_id", REPLICATES, SEED)


@query("w3_benjamini_hochberg", f"WITH RECURSIVE {SHUFFLED}, k AS (SELECT *, row_number() OVER (ORDER BY p, service_a, service_b) AS rn, count(*) OVER () AS m FROM pv) SELECT service_a, service_b, p, least(1, min(p * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM k", "p fdr")
def _(t):
    return stats.benjamini_hochberg(stats.permutation_p(_suppliers(t), SERVICES, "unit_id", REPLICATES, SEED), tie=["service_a", "service_b"])


@query("a30_population_variance", "SELECT l_returnflag, var_pop(l_quantity) AS variance FROM lineitem GROUP BY ALL", "variance")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.var_pop("l_quantity").alias("variance"))


EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM lineitem)"
STRATA = f"""{EDGES}, s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_returnflag, l_linestatus, 'Q' || CAST(least(len(list_filter(edges, lambda x: x <= l_quantity)), len(edges) - 1) AS VARCHAR) AS quantity_class, CAST(l_discount AS VARCHAR) AS discount FROM lineitem, e)"""


def _samples(t):
    table = stats.quantile_strata(t("lineitem"), "l_quantity", 5, "quantity_class")
    return table.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), "l_returnflag", "l_linestatus", "quantity_class", F.col("l_discount").cast("string").alias("discount"))


@query("w4_quantile_strata", f"WITH {STRATA} SELECT l_orderkey, l_linenumber, quantity_class FROM s")
def _(t):
    return _samples(t).select("l_orderkey", "l_linenumber", "quantity_class")


FACTORS = ["l_returnflag", "l_linestatus", "quantity_class"]
LADDER = "CASE WHEN q <= greatest(qa, qb) THEN 'weaken_or_non_enhance' WHEN abs(q - qa - qb) <= greatest(1e-9, 1e-9 * greatest(abs(q), abs(qa + qb))) THEN 'independent' WHEN q < qa + qb THEN 'bi_factor_enhancement' ELSE 'nonlinear_enhancement' END"
Q = f"""{STRATA}, f AS (SELECT y, 'l_returnflag' AS factor, l_returnflag AS stratum FROM s UNION ALL SELECT y, 'l_linestatus', l_linestatus FROM s UNION ALL SELECT y, 'quantity_class', quantity_class FROM s
  UNION ALL SELECT y, 'l_returnflag|l_linestatus', l_returnflag || '|' || l_linestatus FROM s UNION ALL SELECT y, 'l_returnflag|quantity_class', l_returnflag || '|' || quantity_class FROM s UNION ALL SELECT y, 'l_linestatus|quantity_class', l_linestatus || '|' || quantity_class FROM s),
h AS (SELECT factor, stratum, count(*) AS n, var_pop(y) AS v FROM f GROUP BY ALL), q AS (SELECT factor, CAST(sum(n) AS BIGINT) AS n, greatest(0, least(1, 1 - sum(n * v) / (sum(n) * (SELECT var_pop(y) FROM s)))) AS q FROM h GROUP BY factor)"""


@query("a31_factor_q", f"WITH {Q} SELECT factor, n, q FROM q WHERE NOT contains(factor, '|')", "q")
def _(t):
    return stats.factor_q(_samples(t), "y", FACTORS)


@query("a32_factor_interactions", f"WITH {Q}, j AS (SELECT q.*, split_part(factor, '|', 1) AS factor_a, split_part(factor, '|', 2) AS factor_b FROM q WHERE contains(factor, '|')), k AS (SELECT j.factor_a, j.factor_b, j.q, a.q AS qa, b.q AS qb FROM j JOIN q a ON a.factor = factor_a JOIN q b ON b.factor = factor_b) SELECT factor_a, factor_b, q, {LADDER} AS relation FROM k", "q")
def _(t):
    return stats.factor_interactions(_samples(t), "y", FACTORS)


@query("a33_factor_permutation_p", f"""WITH RECURSIVE s AS (SELECT s_suppkey AS id, CAST(round(s_acctbal * 100) AS BIGINT) AS y, CAST(s_nationkey % 5 AS VARCHAR) AS zone, CAST(s_suppkey % 3 AS VARCHAR) AS belt FROM supplier),
n AS (SELECT s.*, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM s),
{_walked("n", f"range(0, {REPLICATES + 1})")},
m AS (SELECT w.rep, a.zone, a.belt, b.y FROM w JOIN n a ON a.i = w.i JOIN n b ON b.i = w.v),
t AS (SELECT 'zone' AS factor, rep, zone AS stratum, sum(y) AS sy, count(*) AS c FROM m GROUP BY ALL UNION ALL SELECT 'belt', rep, belt, sum(y), count(*) FROM m GROUP BY ALL),
b AS (SELECT factor, rep, round(sum(CAST(sy AS DOUBLE) * sy / c), 0) AS b FROM t GROUP BY ALL)
SELECT b.factor, (count(*) FILTER (b.b >= o.b) + 1) / (count(*) + 1) AS p FROM b JOIN b o ON o.factor = b.factor AND o.rep = 0 WHERE b.rep > 0 GROUP BY b.factor""", "p")
def _(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", (F.col("s_nationkey") % 5).cast("string").alias("zone"), (F.col("s_suppkey") % 3).cast("string").alias("belt"))
    return stats.factor_permutation_p(s, "s_acctbal", ["zone", "belt"], "id", REPLICATES, SEED)


@query("a37_driver_diagnostics", "WITH l AS (SELECT 'l_quantity' AS driver, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_discount > 0 THEN l_discount END FROM lineitem) SELECT driver, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_pop(x) AS stddev, count(*) FILTER (x IS NULL) / count(*) AS nodata_share FROM l GROUP BY ALL", "low high mean stddev nodata_share")
def _(t):
    return stats.driver_diagnostics(t("lineitem").select("l_quantity", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount")), ["l_quantity", "l_discount"])


@query("a37_correlation_matrix", "SELECT 'l_quantity' AS driver_a, 'l_discount' AS driver_b, corr(l_quantity, l_discount) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem", "r")
def _(t):
    return stats.correlation_matrix(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("a37_inflation", "SELECT d AS driver, 1 / (1 - r * r) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice')) x(d)", "vif", 4)
def _(t):
    return stats.inflation(t("lineitem"), ["l_quantity", "l_extendedprice"])
