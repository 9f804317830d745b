"""Grid operators against plain loops, with gaps, ties, tile borders and empty tables."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.operators import distance, grid, nearest, polygons, tiles

RNG = np.random.default_rng(12)


def table(spark, cells, kind="double"):
    return spark.createDataFrame([(*at, v) for at, v in cells.items()], f"row long, col long, value {kind}")


def gappy(rows, cols, make, share=0.85, shift=(0, 0)):
    return {(r + shift[0], c + shift[1]): make(r, c) for r in range(rows) for c in range(cols) if RNG.random() < share}


def test_margins_add_little(spark):
    df = spark.range(512 * 512).selectExpr("id div 512 AS row", "id % 512 AS col", "1.0D AS value")
    assert tiles.with_margin(df, 1, 1).count() <= 1.05 * 512 * 512
    assert tiles.with_margin(df, 1, 2).count() <= 1.05 * 512 * 512
    plan = grid.slope_aspect(df, 30.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("size", [4, 256])
def test_slope_and_aspect(spark, size):
    cells = gappy(13, 11, lambda r, c: float((r * 7 + c * c * 3) % 23) if c < 8 else 5.0, 0.93, (-3, 2))
    cells[0, 5] = None
    got = {(r.row, r.col): (r.slope, r.aspect) for r in tiles.slope_aspect(table(spark, cells), 10.0, size).collect()}
    want = {}
    for r, c in cells:
        v = [[cells.get((r + i, c + j)) for j in (-1, 0, 1)] for i in (-1, 0, 1)]
        if any(x is None for row in v for x in row):
            continue
        dx = (v[0][2] + 2 * v[1][2] + v[2][2] - v[0][0] - 2 * v[1][0] - v[2][0]) / 80
        dy = (v[2][0] + 2 * v[2][1] + v[2][2] - v[0][0] - 2 * v[0][1] - v[0][2]) / 80
        turn = math.degrees(math.atan2(dy, -dx))
        aspect = -1.0 if dx == dy == 0 else 450 - turn if turn > 90 else 90 - turn
        want[r, c] = (pytest.approx(math.degrees(math.atan(math.hypot(dx, dy)))), pytest.approx(aspect))
    assert got == want and any(a == -1.0 for _, a in got.values())


@pytest.mark.parametrize(("size", "kind"), [(4, "int"), (256, "double"), (3, "long")])
def test_smoothing_keeps_to_the_majority(spark, size, kind):
    cells = gappy(12, 12, lambda r, c: int(RNG.integers(1, 4)), 0.8, (-5, -5))
    df = table(spark, {at: float(v) if kind == "double" else v for at, v in cells.items()}, kind)
    got = {(r.row, r.col): r.value for r in tiles.smooth(df, size).collect()}
    for r, c in cells:
        near = [cells[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in cells]
        assert got[r, c] == min(near, key=lambda v: (-near.count(v), v))
    assert len(got) == len(cells) and tiles.smooth(df.limit(0), size).count() == 0


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
@pytest.mark.parametrize("size", [4, 256])
def test_interpolation(spark, method, size):
    cells = gappy(14, 9, lambda r, c: float(RNG.random()), 0.7)
    places = {(k, 0): (float(RNG.uniform(-3, 16)), float(RNG.uniform(-3, 11))) for k in range(200)} | {(900, 0): (2.0, 3.0)}
    df = spark.createDataFrame([(*at, *yx) for at, yx in places.items()], "row long, col long, y double, x double")
    got = {(r.row, r.col): r.value for r in tiles.interpolated(table(spark, cells), df, method, size).collect()}
    bend = lambda t: [-0.5 * t + t * t - 0.5 * t**3, 1 - 2.5 * t * t + 1.5 * t**3, 0.5 * t + 2 * t * t - 1.5 * t**3, -0.5 * t * t + 0.5 * t**3]
    want = {}
    for at, (y, x) in places.items():
        r, c = math.floor(y), math.floor(x)
        offsets = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
        wy, wx = ([1 - y + r, y - r], [1 - x + c, x - c]) if method == "bilinear" else (bend(y - r), bend(x - c))
        parts = [(a * b, cells[r + i, c + j]) for i, a in zip(offsets, wy, strict=True) for j, b in zip(offsets, wx, strict=True) if (r + i, c + j) in cells]
        w = sum(p for p, _ in parts)
        if abs(w) > 1e-9:
            want[at] = pytest.approx(sum(p * v for p, v in parts) / w)
    assert got == want


def test_lower_envelope():
    for _ in range(200):
        cols = sorted(RNG.choice(40, RNG.integers(1, 12), replace=False).tolist())
        heights = [int(x) ** 2 for x in RNG.integers(0, 30, len(cols))]
        c, h, start = distance.lower_envelope(cols, heights)
        for x in range(-5, 45):
            k = max(i for i, s in enumerate(start) if s <= x)
            assert (x - c[k]) ** 2 + h[k] == min((x - a) ** 2 + b for a, b in zip(cols, heights, strict=True))


@pytest.mark.parametrize(("layout", "bound"), [("spread", None), ("corner", None), ("one", None), ("column", None), ("spread", 90.0)])
def test_distances(spark, layout, bound):
    cells = gappy(70, 50, lambda r, c: 1.0, 0.5, (-20, -7))
    sources = {
        "spread": [(int(r), int(c)) for r, c in zip(RNG.integers(-40, 90, 40), RNG.integers(-30, 80, 40), strict=True)],
        "corner": [(1000 + r, 2000 + c) for r in range(5) for c in range(5)],
        "one": [(3, 4)],
        "column": [(r, 10) for r in range(-20, 50, 3)],
    }[layout]
    src = spark.createDataFrame([*sources, sources[0]], "row long, col long")
    got = {(r.row, r.col): r.distance for r in grid.distance_to_source(table(spark, cells), src, 30.0, bound).collect()}
    want = {(r, c): 30 * math.sqrt(min((r - a) ** 2 + (c - b) ** 2 for a, b in sources)) for r, c in cells}
    assert got == {at: pytest.approx(d) for at, d in want.items() if bound is None or d <= bound}
    assert grid.distance_to_source(table(spark, cells), src.limit(0), 30.0).count() == 0
    assert grid.distance_to_source(table(spark, cells).limit(0), src, 30.0).count() == 0


def plain_nearest(cell, known, k):
    return sorted(((cell[0] - r) ** 2 + (cell[1] - c) ** 2, r, c, v) for (r, c), v in known.items())[:k]


@pytest.mark.parametrize("layout", ["spread", "cluster far off", "two clusters", "few", "one row"])
def test_nearest_known(spark, layout, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_POINTS", 40)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "BLOCKS_PER_TASK", 3)
    cells = gappy(40, 30, lambda r, c: 1.0, 0.4, (-10, 5))
    one = lambda n, r0, r1, c0, c1: {(int(r), int(c)): float(RNG.random()) for r, c in zip(RNG.integers(r0, r1, n), RNG.integers(c0, c1, n), strict=True)}
    known = {"spread": one(300, -20, 50, -10, 60), "cluster far off": one(400, 5000, 5040, 300, 340), "two clusters": one(200, -300, -280, 0, 20) | one(200, 300, 320, 0, 20), "few": one(5, 0, 9, 0, 9), "one row": {(0, c): float(c) for c in range(0, 400, 2)}}[layout]
    df = table(spark, known | {(4, 4): None})
    if (4, 4) in known:
        del known[4, 4]
    got = {}
    for r in nearest.nearest_known(df, table(spark, cells), 12).collect():
        got.setdefault((r.row, r.col), []).append((r.d2, r.kr, r.kc, r.kv))
    assert {at: sorted(x) for at, x in got.items()} == {at: plain_nearest(at, known, 12) for at in cells}
    values = {(r.row, r.col): r.value for r in grid.inverse_distance(df, table(spark, cells)).collect()}
    for at in cells:
        best = plain_nearest(at, known, 12)
        assert values[at] == pytest.approx(best[0][3] if best[0][0] == 0 else sum(v / d for d, *_, v in best) / sum(1 / d for d, *_ in best))
    assert nearest.nearest_known(df.limit(0), table(spark, cells), 12).count() == 0


def test_pairs_grow_with_cells_however_far_the_cluster():
    """As many pairs for each cell with a small cluster and with one of 100 times as many points, near and far off."""
    cells = np.stack(np.meshgrid(np.arange(64), np.arange(64), indexing="ij"), axis=-1).reshape(-1, 2)
    for off in (0, 300, 20_000):
        looked = []
        for side in (40, 400):
            points = np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), axis=-1).reshape(-1, 2) + off
            d2, at, n = nearest.search(cells, points, 12)
            looked.append(n / len(cells))
            for k in (0, 2000, 4095):
                want = sorted(((p - cells[k]) ** 2).sum() for p in points)[:12] if side == 40 else None
                assert want is None or d2[k].tolist() == want
        assert max(looked) < 1500 and looked[1] < 2.5 * looked[0]


def plain_inside(rings, x, y):
    hits = 0
    for ring in rings:
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            hits += (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]
    return hits % 2 == 1


def test_cells_in_polygons(spark):
    cells = gappy(30, 30, lambda r, c: 1.0, 0.9)
    shapes = [("star", [[[float(5 + 4 * math.cos(k * 2.4)), float(9 + 8 * math.sin(k * 2.4))] for k in range(11)]])]
    shapes += [("holed", [[[0.0, 0.0], [0.0, 20.0], [20.0, 20.0], [20.0, 0.0], [0.0, 0.0]], [[5.0, 5.0], [5.0, 15.0], [15.0, 15.0], [15.0, 5.0], [5.0, 5.0]]])]
    shapes += [("on centres", [[[1.5, 1.5], [1.5, 6.5], [6.5, 6.5], [6.5, 1.5]]]), ("flat", [[[1.0, 2.0], [9.0, 2.0], [1.0, 2.0]]]), ("away", [[[99.0, 99.0], [101.0, 99.0], [99.0, 101.0]]]), ("none", []), ("point", [[[1.0, 1.0]]])]
    df = spark.createDataFrame(shapes, "feature_id string, rings array<array<array<double>>>")
    for t in ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.7, 0.0, -2.0, 0.0, -0.8, 22.0]):
        got = {(r.feature_id, r.row, r.col) for r in grid.in_polygons(table(spark, cells), df, t).collect()}
        assert got == {(f, r, c) for f, rings in shapes for r, c in cells if plain_inside(rings, t[2] + (c + 0.5) * t[0], t[5] + (r + 0.5) * t[4])}
    assert grid.in_polygons(table(spark, cells).limit(0), df, t).count() == 0


def test_a_ring_of_many_points(spark):
    """A circle of 100,000 points over 300 x 300 cells."""
    ring = [[150.0 + 120 * math.cos(k * math.tau / 100_000), 150.0 + 120 * math.sin(k * math.tau / 100_000)] for k in range(100_000)]
    df = spark.createDataFrame([("circle", [ring])], "feature_id string, rings array<array<array<double>>>")
    cells = spark.range(90_000).selectExpr("id div 300 AS row", "id % 300 AS col", "1 AS value")
    began = time.time()
    n = grid.in_polygons(cells, df, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]).count()
    want = sum(1 for r in range(300) for c in range(300) if math.hypot(r - 149.5, c - 149.5) < 120)
    assert abs(n - want) <= 4 and time.time() - began < 60
    stretches = polygons.intervals(df, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]).agg(F.count("*").alias("n"), F.max(F.col("x1") - F.col("x0")).alias("w")).first()
    assert stretches.n == 240 and stretches.w == pytest.approx(240, abs=0.01)
