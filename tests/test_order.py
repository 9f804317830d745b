"""Keyed permutations, ranges, best candidates and patches against plain forms."""

from itertools import combinations

import duckdb
import numpy as np
import pytest


from landmosaic.functions import shuffle
from landmosaic.operators import grid, ordering, quality, stats


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 99, 100, 101, 1000])
def test_permutations_are_one_to_one(n):
    seen = set()
    for rep in range(1, 30):
        out = shuffle.permuted(np.arange(n), n, np.full(n, rep), 77)
        assert sorted(out.tolist()) == list(range(n))
        seen.add(tuple(out.tolist()))
    assert n < 7 or len(seen) == 29
    assert n < 100 or np.abs(np.corrcoef(np.arange(n), shuffle.permuted(np.arange(n), n, np.full(n, 5), 77))[0, 1]) < 0.35


def test_permutations_are_fair():
    """Each place goes everywhere about as often; pairs of places meet as by chance."""
    n, reps = 20, 4000
    places = np.tile(np.arange(n), reps)
    out = shuffle.permuted(places, n, np.repeat(np.arange(1, reps + 1), n), 3).reshape(reps, n)
    counts = np.stack([np.bincount(out[:, k], minlength=n) for k in range(n)])
    assert ((counts - reps / n) ** 2 / (reps / n)).sum() < 1.6 * (n - 1) ** 2
    rho = [np.corrcoef(out[:, a], out[:, b])[0, 1] for a, b in combinations(range(n), 2)]
    assert np.mean(rho) == pytest.approx(-1 / (n - 1), abs=0.02) and np.abs(rho).max() < 0.2


def test_the_same_in_sql():
    con = duckdb.connect()
    for n, rep in ((7, 3), (100, 1), (1001, 999)):
        rows = f"(SELECT unnest(range({n})) AS i, i AS v, CAST({n} AS BIGINT) AS n, CAST({rep} AS BIGINT) AS rep)"
        step = {i: v for _, i, _, v in con.execute(shuffle.sql(rows, 20260713)).fetchall()}
        told = shuffle.permuted(np.arange(n), n, np.full(n, rep), 20260713)
        assert len(step) == n and sum(v < n for v in step.values()) > n / 2 and all(told[i] == v for i, v in step.items() if v < n)


def test_replicates(spark):
    df = spark.createDataFrame([(k, 50, float(k)) for k in range(50)], "i long, n long, x double").repartition(3)
    rows = shuffle.replicated(df, range(4), 9).collect()
    assert len(rows) == 200 and all(r.j == r.i for r in rows if r.rep == 0)
    for rep in (1, 2, 3):
        assert sorted(r.j for r in rows if r.rep == rep) == list(range(50))
    assert shuffle.replicated(df.limit(0), range(4), 9).count() == 0


def test_permutation_p_is_by_all_pairs(spark):
    """Against the same replicates by hand; a strong link is found, an absent one isn't."""
    rng = np.random.default_rng(8)
    x, noise = rng.random(40), rng.random(40)
    df = spark.createDataFrame([(k, float(x[k]), float(x[k] + 0.2 * noise[k]), float(rng.random())) for k in range(40)], "unit_id long, a double, b double, c double")
    got = {(r.service_a, r.service_b): r.p for r in stats.permutation_p(df, ["a", "b", "c"], "unit_id", 199, 5).collect()}
    assert got["a", "b"] == pytest.approx(1 / 200) and got["a", "c"] > 0.01
    rows = df.orderBy("unit_id").collect()
    rank = {f: np.argsort(np.argsort([r[f] for r in rows])) + 1.0 for f in "abc"}
    for f, g in combinations("abc", 2):
        centre = rank[f].sum() * rank[g].sum() / 40
        seen = abs(rank[f] @ rank[g] - centre)
        hits = sum(abs(rank[f] @ rank[g][shuffle.permuted(np.arange(40), 40, np.full(40, rep), 5)] - centre) >= seen for rep in range(1, 200))
        assert got[f, g] == pytest.approx((hits + 1) / 200)


def test_preceding(spark):
    rows = [(g, float(v)) for g in ("a", None, "b") for v in np.random.default_rng(2).permutation(60)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.v): r.p for r in ordering.preceding(df, ["g"], "v", "p").collect()}
    assert got == {(g, v): (v - 1 if v and g != "c" else None) for g, v in rows}


def test_best_candidates_with_gaps(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 15.0), ("x", 3, None), (None, 4, 11.0), ("y", 5, None)], "g string, k int, m double")
    got = {r.k: r.selected for r in stats.best_candidate(df, "m", 10.0, ["g"], "k").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_point_grids(spark):
    rows = [(float(x), float(y), 10.0 + x) for x in range(6) for y in range(4)] + [(0.0, 0.0, 5000.0), (9.0, 1.0, None), (9.5, 1.0, float("inf")), (9.75, 1.0, 0.0)]
    r = quality.point_grid_audit(spark.createDataFrame(rows, "x double, y double, w double")).first()
    assert (r.points, r.repeated, r.rows, r.columns, r.full, r.spacings, r.widest, r.missing, r.odd_magnitude) == (28, 1, 4, 9, False, 4, 4.0, 2, 1)
    none = quality.point_grid_audit(spark.createDataFrame([], "x double, y double, w double")).first()
    assert none.missing == 0 and none.odd_magnitude == 0


@pytest.mark.parametrize(("patch", "stride"), [(4, 2), (3, 3), (7, 1)])
def test_centred_patches(spark, patch, stride):
    rng = np.random.default_rng(6)
    cells = {(r, c): float(rng.integers(0, 9)) for r in range(9) for c in range(7) if rng.random() < 0.8}
    df = spark.createDataFrame([("a", *at, v) for at, v in cells.items()] + [("a", 0, 0, None)] * ((0, 0) not in cells), "raster_id string, row long, col long, value double")
    tiles = {(r.out_row, r.out_col): (r.tile_row, r.tile_col) for r in grid.centred_tiles(spark.createDataFrame([("a", 7, 9)], "raster_id string, width int, height int"), patch, stride).collect()}
    assert len(tiles) == -(-9 // stride) * -(-7 // stride)
    got = {(r.out_row, r.out_col): (r.valid_cells, r["mean"], r.accepted) for r in grid.centred_patches(df, patch, stride).collect()}
    for at, (top, left) in tiles.items():
        inside = [v for (r, c), v in cells.items() if top <= r < top + patch and left <= c < left + patch]
        assert got.get(at, (0, None, False)) == ((len(inside), pytest.approx(np.mean(inside)), len(inside) / patch**2 >= 0.5) if inside else (0, None, False))


def test_score_changes_need_no_ranks(spark):
    from landmosaic.operators import scoring
    from landmosaic.operators.scoring import Criterion

    df = spark.createDataFrame([(k, float(k * 7 % 11), float(k * 5 % 13)) for k in range(20)], "unit_id long, a double, b double")
    told = [Criterion("a", 0.6), Criterion("b", 0.4, benefit=False)]
    names = ["criterion", "direction", "perturbed_weight", "mean_change", "max_change"]
    whole = {tuple(r[n] for n in names[:2]): tuple(r[n] for n in names[2:]) for r in scoring.sensitivity(df, told, 0.1, "unit_id").collect()}
    assert {tuple(r[n] for n in names[:2]): pytest.approx(tuple(r[n] for n in names[2:])) for r in scoring.score_changes(df, told, 0.1, "unit_id").collect()} == whole
