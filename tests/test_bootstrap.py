"""Intervals by units drawn with replacement, against the plain form: draw, rank, correlate."""

import hashlib
import math
from itertools import combinations

import numpy as np
import pytest

from landmosaic.operators import bootstrap, stats

FIELDS = ["a", "b", "c"]
SEED = 7


def places(values):
    """Mean places of equal values; nulls first, NaN last and equal to NaN."""
    keys = [(0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v) for v in values]
    order = sorted(keys)
    return np.array([order.index(k) + (order.count(k) + 1) / 2 for k in keys])


def plain(rows, replicates):
    found = {pair: [] for pair in combinations(FIELDS, 2)}
    for rep in range(1, replicates + 1):
        drawn = [rows[int(hashlib.md5(f"{SEED}|{rep}|{i}".encode()).hexdigest()[:8], 16) % len(rows)] for i in range(len(rows))]
        ranks = {f: places([r[1 + k] for r in drawn]) for k, f in enumerate(FIELDS)}
        for a, b in found:
            if np.ptp(ranks[a]) and np.ptp(ranks[b]):
                found[a, b].append(round(float(np.corrcoef(ranks[a], ranks[b])[0, 1]), 9))
    at = lambda s, q: sorted(s)[math.floor(q * (len(s) - 1))]
    return {pair: (len(s), at(s, 0.025), at(s, 0.975)) for pair, s in found.items() if s}


def units(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=n).round(2).tolist()
    b = [None if k % 11 == 3 else math.nan if k % 13 == 5 else float(x) for k, x in enumerate(rng.integers(0, 5, n))]
    return [(k * 3, a[k], b[k], a[k] + float(rng.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize(("n", "replicates", "block", "width", "held"), [(37, 20, 4, 6, 3), (60, 9, 1 << 14, 128, 2048), (50, 17, 8, 5, 1), (2, 12, 1, 4, 2), (1, 5, 4, 4, 4)])
def test_by_draws(spark, monkeypatch, n, replicates, block, width, held):
    for name, value in (("BLOCK", block), ("WIDTH", width), ("_HELD", held), ("_DRAWS", 100)):
        monkeypatch.setattr(bootstrap, name, value)
    rows = units(n)
    table = spark.createDataFrame(rows, "unit long, a double, b double, c double").repartition(3)
    got = {(r.service_a, r.service_b): (r.replicates, r.low, r.high) for r in stats.bootstrap_ci(table, FIELDS, "unit", replicates, SEED).collect()}
    asked = plain(rows, replicates)
    assert got.keys() == asked.keys()
    for pair, seen in asked.items():
        assert got[pair] == pytest.approx(seen, abs=2e-9)


def test_no_units_and_a_constant(spark):
    schema = "unit long, a double, b double, c double"
    assert stats.bootstrap_ci(spark.createDataFrame([], schema), FIELDS, "unit", 9, SEED).collect() == []
    rows = [(k, 1.0, float(k % 7), float(k)) for k in range(40)]
    got = stats.bootstrap_ci(spark.createDataFrame(rows, schema), FIELDS, "unit", 9, SEED).collect()
    assert [(r.service_a, r.service_b, r.replicates) for r in got] == [("b", "c", 9)]


def test_draws_move_in_few_rows(spark):
    """Draws are no rows: 500,000 of them come in a few lists, and a unit's row has all replicates of a part."""
    n, width = 2000, 125
    codes = bootstrap.drawn(spark, n, 250, width, SEED).cache()
    assert codes.count() <= 8 and sum(len(r.codes) for r in codes.collect()) == 250 * n
    counted = bootstrap.weights(codes, n, width).collect()
    assert len(counted) == 2 * n
    for part in (0, 1):
        assert (np.sum([r.w for r in counted if r.part == part], axis=0) == n).all()


def test_a_task_sends_one_row_for_equal_values(spark):
    weighted = spark.createDataFrame([(k % 2, 20001, [1, 2]) for k in range(20_000)], "part long, q0 long, w array<int>").coalesce(1)
    got = bootstrap.summed(weighted, ["q0"], 2, 1).collect()
    assert sorted((r.part, r.field, r.q, r.w) for r in got) == [(0, 0, 20001, [10_000, 20_000]), (1, 0, 20001, [10_000, 20_000])]
