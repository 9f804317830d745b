"""Small tables with results known by hand."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from landmosaic.operators import accuracy, carbon, change, classify, grid, quality, scoring, stats, units
from landmosaic.operators.scoring import Criterion
from landmosaic.plans import registry
from landmosaic.sources import tables as S


def cells(spark, rows):
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None], "row long, col long, value double")


@pytest.fixture(scope="module")
def criteria(spark):
    return spark.createDataFrame([("A", "ND", 100.0, 30.0, 0.7), ("B", "EP", 50.0, 60.0, 0.9)], "unit_id string, scenario string, carbon double, water double, habitat double")


WEIGHTS = [Criterion("carbon", 0.4), Criterion("water", 0.3), Criterion("habitat", 0.3)]


def test_score(criteria):
    got = {r.unit_id: r.score for r in scoring.score(criteria, WEIGHTS, ["unit_id"]).collect()}
    assert got == pytest.approx({"A": 0.4, "B": 0.6})


def test_sensitivity(criteria):
    got = {(r.criterion, r.direction): r for r in scoring.sensitivity(criteria, WEIGHTS, 0.1, "unit_id").collect()}
    assert got["carbon", "decrease"].perturbed_weight == pytest.approx(0.375)
    assert got["carbon", "decrease"].mean_change == pytest.approx(0.025)
    assert got["carbon", "increase"].perturbed_weight == pytest.approx(0.423076923)
    assert got["water", "increase"].mean_change == pytest.approx(0.011650485)
    assert all(r.max_rank_shift == 0 for r in got.values())


def test_ahp(spark):
    m = [[1, 2, 2], [0.5, 1, 1], [0.5, 1, 1]]
    j = spark.createDataFrame([("p", i, k, float(m[i][k])) for i in range(3) for k in range(3)], "panel_id string, i int, j int, judgement double")
    r = scoring.ahp(j).first()
    assert r.weights == pytest.approx([0.5, 0.25, 0.25]) and r.lambda_max == pytest.approx(3) and r.cr == pytest.approx(0, abs=1e-9)
    assert scoring.ahp_violations(j).count() == 0


def test_tradeoffs(criteria):
    got = {(r.service_a, r.service_b): (r.rho, r.relation) for r in stats.spearman(criteria, ["carbon", "water", "habitat"], "unit_id").collect()}
    assert got["carbon", "water"] == (pytest.approx(-1), "tradeoff") and got["water", "habitat"] == (pytest.approx(1), "synergy")
    p = stats.permutation_p(criteria, ["carbon", "water"], "unit_id", 9, 1).first().p
    assert p is None


def test_factors(spark):
    rows = [(0.2, "water", "low", "wet"), (0.3, "water", "low", "dry"), (0.7, "forest", "high", "wet"), (0.8, "forest", "high", "dry")]
    df = spark.createDataFrame(rows, "y double, lulc string, slope string, rain string")
    q = {r.factor: r.q for r in stats.factor_q(df, "y", ["lulc", "slope", "rain"]).collect()}
    assert q == pytest.approx({"lulc": 0.961538, "slope": 0.961538, "rain": 0.038462}, abs=1e-6)
    joint = {(r.factor_a, r.factor_b): (r.q, r.relation) for r in stats.factor_interactions(df, "y", ["lulc", "slope", "rain"]).collect()}
    assert joint["lulc", "slope"] == (pytest.approx(0.961538, abs=1e-6), "weaken_or_non_enhance")
    assert joint["lulc", "rain"] == (pytest.approx(1), "independent")
    with pytest.raises(PySparkException):
        stats.factor_q(df.withColumn("lulc", F.lit(" ")), "y", ["lulc"]).collect()


def test_best_candidate(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 100.0), ("c", 110.0)], "z string, m double").withColumn("all", F.lit(1))
    got = {r.z: (r.absolute_error, r.relative_error, r.selected) for r in stats.best_candidate(df, "m", 100.0, ["all"], "z").collect()}
    assert got == {"a": (10.0, 0.1, False), "b": (0.0, 0.0, True), "c": (10.0, 0.1, False)}


def test_accuracy(spark):
    df = spark.createDataFrame([("1", "1"), ("1", "1"), ("1", "2"), ("2", "2"), ("2", "2"), ("2", "1"), ("2", None)], "reference string, prediction string")
    matrix = accuracy.confusion(df)
    assert {(r.reference, r.prediction): r.n for r in matrix.collect()} == {("1", "1"): 2, ("1", "2"): 1, ("2", "1"): 1, ("2", "2"): 2}
    o = accuracy.overall_metrics(matrix).first()
    assert (o.overall_accuracy, o.kappa, o.macro_f1, o.macro_iou) == pytest.approx((2 / 3, 1 / 3, 2 / 3, 0.5))
    assert all(r.precision == r.recall == r.f1 == pytest.approx(2 / 3) for r in accuracy.class_metrics(matrix).collect())


def test_figure_of_merit(spark):
    base = cells(spark, [[1.0, 1.0], [1.0, 1.0]])
    ref = cells(spark, [[2.0, 2.0], [1.0, 1.0]])
    one = cells(spark, [[2.0, 1.0], [2.0, 1.0]])
    assert accuracy.figure_of_merit(base, ref, one).first().figure_of_merit == pytest.approx(1 / 3)
    assert accuracy.figure_of_merit(base, base, base).first().figure_of_merit == 1.0
    seeds = one.withColumn("seed", F.lit(1)).union(one.withColumn("seed", F.lit(2)))
    s = accuracy.merit_spread(accuracy.figure_of_merit(base, ref, seeds, ["seed"])).first()
    assert (s.seeds, s.stddev_fom) == (2, 0.0)


def test_consistency(spark):
    a, b = cells(spark, [[10.0, 20.0], [30.0, 40.0]]), cells(spark, [[10.0, 20.0], [30.0, 40.05]])
    r = accuracy.consistency(a, b).first()
    assert r.relative_difference == pytest.approx(0.00049975, rel=1e-4) and r.rmse == pytest.approx(0.025) and r.max_difference == pytest.approx(0.05) and r.passed


def test_water_and_carbon(spark):
    dem, depth = cells(spark, [[100.0] * 10] * 10), cells(spark, [[2.0] * 10] * 10)
    assert carbon.water_volume(dem, depth, 99.0, 900.0).first().volume_m3 == pytest.approx(90_000)
    c = carbon.composite_from_cells(dem, depth, 99.0, 900.0, (1000.0, 10.0, 100.0), dem, dem, 1.2).first()
    assert (c.water_t, c.vegetation_t, c.sediment_t, c.composite_t) == pytest.approx((90, 90, 900, 1080))
    assert carbon.composite_from_cells(dem, depth, 99.0, 900.0, (1000.0, 10.0, 100.0), dem, dem, 0.5).first().vegetation_t == 0
    parts = "site_id string, year int, water_volume_m3 double, water_carbon_density_g_c_m3 double, vegetation_area_ha double, vegetation_density_t_c_ha double, sediment_area_ha double, sediment_density_t_c_ha double"
    assert carbon.composite_carbon(spark.createDataFrame([("a", 1, 1000.0, 10.0, 2.0, 5.0, 3.0, 20.0)], parts)).first().composite_t == pytest.approx(70.01)
    with pytest.raises(PySparkException):
        carbon.composite_carbon(spark.createDataFrame([("a", 1, -1.0, 10.0, 2.0, 5.0, 3.0, 20.0)], parts)).collect()
    assert spark.range(1).select(carbon.replaced_total(F.lit(1000.0), F.lit(100.0), F.lit(200.0)).alias("x")).first().x == 1100


def test_majority_and_fill(spark):
    blocks = cells(spark, [[float(1 + (j // 3) + 2 * (i // 3)) for j in range(6)] for i in range(6)])
    assert {(r.row, r.col): r.value for r in grid.majority(blocks, 3).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    known = cells(spark, [[2.0, None], [None, None]])
    scope = cells(spark, [[None, 1.0], [None, None]])
    assert [tuple(r) for r in grid.nearest_fill(known, scope, 30.0, 45.0).collect()] == [(0, 1, 2.0)]


def test_totals_never_zero_fill(spark):
    bad = spark.createDataFrame([("ND", "f", 0, 0, None), ("ND", "f", 0, 1, math.nan)], "scenario string, field string, row long, col long, value double")
    with pytest.raises(PySparkException, match="no valid pixels"):
        units.scenario_totals(bad, {"f": "sum"}, 900.0).collect()
    good = spark.createDataFrame([(s, "f", i, j, v) for s, v in (("ND", 1.0), ("UD", 2.0)) for i in range(4) for j in range(4)], "scenario string, field string, row long, col long, value double")
    got = units.unit_totals(good, ["f"], 2)
    assert sorted((r.scenario, r.f) for r in got.collect()) == [("ND", 4.0)] * 4 + [("UD", 8.0)] * 4


def test_paired(spark):
    df = spark.createDataFrame([("ND", "a", 1.0), ("ND", "b", 2.0), ("UD", "a", 2.0), ("UD", "b", 4.0)], "scenario string, unit_id string, score double")
    m = {r.scenario: (r.mean, r.delta) for r in stats.scenario_means(df, ["score"], "ND").collect()}
    p = {r.scenario: (r.paired_units, r.paired_mean_delta) for r in stats.paired_deltas(df, ["score"], "ND").collect()}
    assert m["UD"] == (3.0, 1.5) and p["UD"] == (2, 1.5)
    with pytest.raises(PySparkException):
        stats.scenario_means(df, ["score"], "XX").collect()


def test_points(spark):
    lines = spark.createDataFrame([("# …",), ("0 0 -1000",), ("30 0 -2000",), ("",), ("x y z",)], "value string")
    good, bad = S.parse_points(lines)
    assert sorted((r.x, r.value) for r in good.collect()) == [(0.0, 1.0), (30.0, 2.0)] and [r.line for r in bad.collect()] == ["x y z"]


def test_change(spark):
    a, b = cells(spark, [[1.0, 1.0], [2.0, None]]), cells(spark, [[1.0, 2.0], [2.0, 2.0]])
    m = change.transition_matrix(a, b, 900.0)
    assert {(r.source, r.target): (r.pixel_count, r.area_ha) for r in m.collect()} == {(1, 1): (1, 0.09), (1, 2): (1, 0.09), (2, 2): (1, 0.09)}
    assert {r["class"]: (r.gain, r.loss, r.net, r.swap) for r in change.class_change(m).collect()} == {1: (0, 1, -1, 0), 2: (1, 0, 1, 0)}
    assert sum(r.percent for r in change.class_area(a, 900.0).collect()) == pytest.approx(100)


def test_slope_of_a_plane(spark):
    got = grid.slope_aspect(cells(spark, [[30.0 * j for j in range(5)] for _ in range(5)]), 30.0).collect()
    assert len(got) == 9 and all(r.slope == pytest.approx(45) and r.aspect == pytest.approx(270) for r in got)


def test_maximum_likelihood(spark):
    rows = [(i, i % 2, [float(i % 2 * 10) + (i * 7 % 5) * 0.1, float(i * 3 % 7) * 0.1]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, bands array<double>")
    assert all(r["class"] == r.id % 2 for r in classify.maximum_likelihood(df, df, ["id"]).collect())
    assert all(r["class"] == r.id % 2 for r in classify.minimum_distance(df, classify.class_means(df), ["id"]).collect())


def test_all_bands_count(spark, tmp_path):
    rows = [(i, i % 2, [float((i * (b + 3) + i * i // (b + 2)) % 7) + (40.0 * (i % 2) if b == 11 else 0.0) for b in range(12)]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["m5_maximum_likelihood"](spark, str(tmp_path)).collect()
    x, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    scores = []
    for k in (0, 1):
        d, c = x - x[label == k].mean(axis=0), np.cov(x[label == k].T) + np.eye(12) * 1e-9
        scores.append(-0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)))
    assert {r.vec_id: r["class"] for r in got} == dict(enumerate(label.tolist()))
    assert [r.score for r in sorted(got)] == pytest.approx(np.max(scores, axis=0).tolist())
    cov = {(r.label, r.band_a, r.band_b): r.covariance for r in registry.queries()["a35_covariances"](spark, str(tmp_path)).collect()}
    assert len(cov) == 2 * 12 * 13 // 2 and cov[1, 3, 11] == pytest.approx(np.cov(x[label == 1].T)[3, 11], abs=1e-6)


def test_any_number_of_classes(spark):
    n = 1_200
    df = spark.createDataFrame([(2 * k + i, k, [10.0 * k + i, float(i)]) for k in range(n) for i in (0, 1)], "id long, label long, bands array<double>")
    for got in (classify.minimum_distance(df, classify.class_means(df), ["id"]), classify.maximum_likelihood(df, df, ["id"])):
        assert {r.id: r["class"] for r in got.collect()} == {i: i // 2 for i in range(2 * n)}
    lost = spark.createDataFrame([(1, None), (2, [1.0, None])], "id long, bands array<double>")
    assert [(r["class"], r.score) for r in classify.maximum_likelihood(lost, df.where("label < 3"), ["id"]).collect()] == [(None, None)] * 2


def test_verdicts(spark):
    s = spark.createDataFrame([("a", "completed"), ("b", "pending_validation")], "section string, verdict string")
    assert quality.roll_up(s, ["a"]).first().verdict == "completed"
    assert quality.roll_up(s, ["a", "b"]).first().verdict == "pending_validation"
    assert quality.roll_up(s, ["a", "c"]).first().verdict == "failed"


def test_empty_tables(spark):
    none = cells(spark, [[None]])
    assert change.transition_matrix(none, none, 900.0).count() == 0
    assert accuracy.confusion(spark.createDataFrame([], "reference string, prediction string")).count() == 0
    assert carbon.water_volume(none, none, 1.0, 900.0).first().volume_m3 == 0


def test_quantile_strata_begin_at_one(spark):
    df = spark.createDataFrame([(float(k),) for k in range(10)] + [(None,)], "x double")
    got = {r.x: r.s for r in stats.quantile_strata(df, "x", 4, "s").collect()}
    edges = np.unique(np.quantile(np.arange(10.0), np.linspace(0, 1, 5)))
    assert [got[float(k)] for k in range(10)] == [f"Q{min(4, int(np.searchsorted(edges, k, side='right')))}" for k in range(10)] and got[None] is None
    assert {r.s for r in stats.quantile_strata(df.where("x < 3"), "x", 4, "s").collect()} == {"0.0", "1.0", "2.0"}
    assert stats.quantile_strata(df.limit(0), "x", 4, "s").count() == 0


def test_running_totals_over_ranges(spark):
    from landmosaic.operators.ordering import numbered, running_total

    df = spark.range(500).selectExpr("id", "id % 3 AS g", "CAST(id * 7919 % 101 AS INT) AS v").repartition(7)
    got = {(r.g, r.id): r.n for r in numbered(df, ["g"], [F.desc("v"), F.col("id")], "n").collect()}
    for g in range(3):
        order = sorted((k for k in range(500) if k % 3 == g), key=lambda k: (-(k * 7919 % 101), k))
        assert [got[g, k] for k in order] == list(range(1, len(order) + 1))
    assert running_total(df, [], [F.col("id")], F.col("v"), "t").agg(F.max("t")).first()[0] == sum(k * 7919 % 101 for k in range(500))
    assert numbered(df.limit(0), [], [F.col("id")], "n").count() == 0


def test_neighbours_however_far(spark):
    """The nearest of a few sources far off; 12 neighbours where a fixed reach has fewer."""
    rng = np.random.default_rng(3)
    places = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 400, 20), rng.integers(0, 400, 20), rng.random(20), strict=True)]
    known = spark.createDataFrame(places, "row long, col long, value double")
    todo = [(0, 0), (5, 399), (200, 200), (399, 1), places[0][:2]]
    todo_df = spark.createDataFrame([(*c, None) for c in todo], "row long, col long, value double")
    near = lambda c: sorted(((c[0] - r) ** 2 + (c[1] - k) ** 2, r, k, v) for r, k, v in places)
    got = {(r.row, r.col): r.distance for r in grid.distance_to_source(todo_df, known, 30.0).collect()}
    assert got == {c: pytest.approx(near(c)[0][0] ** 0.5 * 30) for c in todo}
    values = {(r.row, r.col): r.value for r in grid.inverse_distance(known, todo_df).collect()}
    for c in todo:
        best = near(c)[:12]
        assert values[c] == pytest.approx(best[0][3] if best[0][0] == 0 else sum(v / d for d, *_, v in best) / sum(1 / d for d, *_ in best))
    assert grid.distance_to_source(todo_df, known.limit(0), 30.0).count() == 0


def test_holes_and_parts(spark):
    square = lambda a, b: [[a, a], [a, b], [b, b], [b, a], [a, a]]
    shapes = spark.createDataFrame([("x", [[[float(v) for v in p] for p in r] for r in (square(0, 9), square(3, 6), square(12, 14))])], "feature_id string, rings array<array<array<double>>>")
    df = cells(spark, [[1.0] * 20] * 20)
    got = {(r.row, r.col) for r in grid.in_polygons(df, shapes, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]).collect()}
    inside = lambda r, c, a, b: a <= r < b and a <= c < b
    assert got == {(r, c) for r in range(20) for c in range(20) if inside(r, c, 0, 9) and not inside(r, c, 3, 6) or inside(r, c, 12, 14)}


def test_missing_pools_and_bad_points_stop_the_job(spark):
    df = cells(spark, [[1.0, 2.0]]).withColumn("scenario", F.lit("ND"))
    pools = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0)], "lucode double, c_above double, c_below double, c_soil double, c_dead double")
    with pytest.raises(PySparkException):
        carbon.carbon_stock(df, pools, 900.0).collect()
    assert [(r.value, r.pixel_count) for r in carbon.missing_pools(df, pools).collect()] == [(2.0, 1)]
    lines = spark.createDataFrame([("1 2 -3",), ("# note",), ("1 x 2",)], "value string")
    assert S.parse_points(lines)[0].count() == 1
    with pytest.raises(PySparkException):
        S.parse_points(lines, strict=True)[0].collect()


def test_all_nodata_zone_counts_nothing(spark):
    depth = cells(spark, [[1.0, float("nan")], [2.5, None]])
    zones = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (0, 1, "b"), (1, 1, "b")], "row long, col long, zone string")
    got = {r.zone: tuple(r)[1:] for r in units.zonal_metrics(depth, zones, 900.0).collect()}
    assert got == {"a": (2, 3.5, pytest.approx(0.18), 3150.0), "b": (0, 0.0, 0.0, 0.0)}


def test_inconsistent_judgements(spark):
    m = np.array([[1, 5, 1 / 4], [1 / 5, 1, 3], [4, 1 / 3, 1]])
    j = spark.createDataFrame([("p", i, k, float(m[i][k])) for i in range(3) for k in range(3)], "panel_id string, i int, j int, judgement double")
    r = scoring.ahp(j).first()
    values, vectors = np.linalg.eig(m)
    at = int(np.argmax(values.real))
    w = np.abs(vectors[:, at].real)
    assert r.weights == pytest.approx(list(w / w.sum())) and r.lambda_max == pytest.approx(values[at].real)
    assert [x.rule for x in scoring.ahp_violations(j).collect()] == ["inconsistent"]


def test_maximum_likelihood_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, [float(x) for x in rng.normal(k % 2, 1 + k % 2, 2)]) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, label long, bands array<double>")
    got = {r.id: (r["class"], r.score) for r in classify.maximum_likelihood(df, df, ["id"]).collect()}
    for k, _, x in rows:
        best = []
        for label in (0, 1):
            a = np.array([b for _, y, b in rows if y == label])
            c = np.cov(a.T)
            det = c[0, 0] * c[1, 1] - c[0, 1] ** 2
            d = np.array(x) - a.mean(axis=0)
            q = (c[1, 1] * d[0] ** 2 - 2 * c[0, 1] * d[0] * d[1] + c[0, 0] * d[1] ** 2) / det
            best.append((-0.5 * (math.log(det) + q), label))
        assert got[k] == (max(best)[1], pytest.approx(max(best)[0], abs=1e-6))


def test_development_probability_follows_its_driver(spark):
    df = spark.range(400).selectExpr("id AS row", "0L AS col", "CAST(id % 20 AS DOUBLE) AS near", "CAST(id % 20 < 6 AS DOUBLE) AS label")
    one, two = ({r.row: r.probability for r in classify.development_probability(df, ["near"]).collect()} for _ in range(2))
    assert one == two and all((p > 0.5) == (k % 20 < 6) for k, p in one.items())


def test_a_constant_has_no_correlation(spark):
    """However its rows are dealt to tasks: means of 49 or 98 rows put together are not exactly the constant."""
    for tasks, each in ((7, 49), (3, 98), (7, 161), (3, 196)):
        df = spark.range(tasks * each).select((F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 2).alias("z")).repartition(tasks)
        r = df.agg(stats.pearson("x", F.lit(1.0)).alias("flat"), stats.pearson(F.lit(1.0), "x").alias("turned"), stats.pearson("x", F.col("x") * 2 + 1).alias("line")).first()
        assert r.flat is None and r.turned is None and r.line == pytest.approx(1)
    assert spark.range(1).agg(stats.pearson("id", "id").alias("r")).first().r is None
