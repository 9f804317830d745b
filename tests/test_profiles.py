"""Raster profiles, moments and class blocks against plain forms."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from landmosaic.operators import classify, moments
from landmosaic.sources import profiles


def plain(values, most, codes):
    finite = sorted({v for v in values if math.isfinite(v)})
    every = [v for v in values if math.isfinite(v)]
    few = len(finite) <= most
    return (
        finite[0] if finite else None, finite[-1] if finite else None, len(values) - len(every), len(finite) if few else None,
        all(v == math.floor(v) for v in finite) if finite else None, finite if finite and few else None, sum(v not in codes for v in every),
    )


@pytest.mark.parametrize("waiting", [10, 1 << 19])
def test_profile(spark, monkeypatch, waiting):
    monkeypatch.setattr(profiles, "_WAITING", waiting)
    rng = np.random.default_rng(3)
    rasters = {"classes": rng.integers(1, 6, 400).astype(float).tolist(), "just": [float(k % 20) for k in range(300)], "over": [k % 21 + 0.5 for k in range(300)], "wild": rng.random(500).tolist(), "odd": [math.nan, math.inf, -math.inf, -0.0, 0.0, 2.0], "none": [math.nan], None: [1.0, 1.0]}
    rows = [(name, v) for name, vs in rasters.items() for v in vs] + [("absent", None), ("odd", None)]
    df = spark.createDataFrame(rows, "raster_id string, value double").repartition(5)
    codes = [float(k) for k in range(10)]
    got = {r.raster_id: tuple(r)[1:] for r in profiles.profile(df, 20, True, codes).collect()}
    assert got == {name: plain(vs, 20, codes) for name, vs in rasters.items()}
    assert profiles.profile(df.limit(0), values=True).count() == 0


@pytest.mark.parametrize(("names", "held", "piece"), [(1, 1 << 20, 256), (50_000, 8, 3), (3, 50, 7)])
def test_profile_in_parts(spark, monkeypatch, names, held, piece):
    """Tasks that hold few rasters or values, and rows of few values, give the same; counts are counted once."""
    for name, value in (("_NAMES", names), ("_HELD", held), ("_PIECE", piece)):
        monkeypatch.setattr(profiles, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = np.random.default_rng(6)
        rasters = {f"r{k}": (rng.integers(0, 8 + 9 * (k % 4), 60) / 2).tolist() + [math.nan] * (k % 3) for k in range(12)} | {None: [1.0, 1.0, math.inf], "none": [math.nan]}
        rows = [(name, v) for name, vs in rasters.items() for v in vs]
        df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "raster_id string, value double").repartition(5)
        codes = [float(k) for k in range(10)]
        got = profiles.profile(df, 20, True, codes).collect()
        assert len(got) == len(rasters) and {r.raster_id: tuple(r)[1:] for r in got} == {name: plain(vs, 20, codes) for name, vs in rasters.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_a_task_holds_is_bounded():
    """Of ten times the rasters a task holds and sends no more at once, and loses none."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for many in (500, 5000):
        ids = rng.permutation(np.repeat(np.arange(many), 4))
        values = rng.integers(0, 3, len(ids)).astype(float)
        batches = [pa.RecordBatch.from_arrays([pa.array(map(str, ids[k : k + 100].tolist())), pa.array(values[k : k + 100])], ["raster_id", "value"]) for k in range(0, len(ids), 100)]
        parts = list(profiles.in_parts(batches, 20, None, pa.string(), (300, 1 << 20), 256))
        assert len(parts) > 1 and max(b.num_rows for b in parts) <= 400
        ordered = pa.Table.from_batches(parts).sort_by("raster_id").combine_chunks().to_batches(max_chunksize=100)
        done = list(profiles.together(ordered, 20, pa.string(), (300, 1 << 20), 0))
        assert max(b.num_rows for b in done) <= 400
        got = {n: k for b in done for n, k in zip(b["raster_id"].to_pylist(), b["kinds"].to_pylist(), strict=True)}
        assert sum(b.num_rows for b in done) == many and got == {str(k): sorted(set(values[ids == k])) for k in range(many)}


def test_a_task_sends_no_more_than_the_bound():
    import pyarrow as pa

    sets = profiles.Sets(100)
    for k in range(20):
        sets.add_cells(pa.array(["a"] * 5000), np.random.default_rng(k).random(5000), None)
    batch = sets.batch(0, pa.string())
    assert len(batch["kinds"][0]) == 101 and batch["low"][0].as_py() == batch["kinds"][0][0].as_py()


def test_moments_are_added_up(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k % 3), [float(x) for x in rng.normal(k % 3, 2, 5)]) for k in range(200)] + [(7, [1.0, 2.0, 3.0, 4.0, 5.0]), (0, [1.0, None, 3.0, 4.0, 5.0]), (1, None), (2, [])]
    df = spark.createDataFrame(rows, "label int, bands array<double>").repartition(7)
    got = {r.label: r for r in moments.moments(df).collect()}
    for label in (0, 1, 2, 7):
        x = np.array([b for y, b in rows if y == label and b and None not in b])
        r = got[label]
        assert r.n == len(x) and r.mean == pytest.approx(x.mean(axis=0)) and np.array(r.scatter).reshape(5, 5) == pytest.approx((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    cov = {(r.label, r.band_a, r.band_b): r.covariance for r in classify.covariances(df).collect()}
    x = np.array([b for y, b in rows if y == 2 and b])
    assert len(cov) == 4 * 15 and cov[2, 1, 3] == pytest.approx(np.cov(x.T)[1, 3]) and cov[7, 0, 0] is None
    assert {r.stddev for r in classify.signatures(df).where("label = 7").collect()} == {None}
    with pytest.raises(PySparkException, match="unlike numbers of bands"):
        moments.moments(df.union(spark.createDataFrame([(0, [1.0])], df.schema))).collect()
    assert moments.moments(df.limit(0)).count() == 0


def test_what_is_shuffled_is_a_row_a_class_and_task(spark):
    df = spark.range(5000).select((F.col("id") % 4).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3) * k).alias("bands")).repartition(6)
    out = moments.moments(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and out.count() == 4


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_blocks_of_classes(spark, monkeypatch, size):
    """Of many classes in blocks of any size the same wins; ties to the smaller label, or to the larger by density."""
    monkeypatch.setattr(classify, "BLOCK_BYTES", size)
    rng = np.random.default_rng(5)
    centres = {f"c{k:02d}": [float(x) for x in rng.integers(0, 6, 3)] for k in range(12)} | {"c90": [1.0, 1.0, 1.0], "c91": [1.0, 1.0, 1.0]}
    means = spark.createDataFrame(list(centres.items()), "label string, means array<double>")
    rows = [(k, [float(x) for x in rng.integers(0, 6, 3)]) for k in range(60)] + [(60, [1.0, 1.0, 1.0]), (61, None), (62, [1.0, None, 2.0]), (60, [1.0, 1.0, 1.0])]
    pixels = spark.createDataFrame(rows, "id long, bands array<double>")
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    want = sorted((k, *(min((far(x, c), n) for n, c in centres.items())[::-1] if x and None not in x else (None, None))) for k, x in rows)
    got = sorted((r.id, r["class"], r.distance2) for r in classify.minimum_distance(pixels, means, ["id"]).collect())
    assert got == want
