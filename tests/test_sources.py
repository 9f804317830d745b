"""Files by ranges and as streams, and rasters in buckets, against plain reading."""

import hashlib
import json
import random
from pathlib import Path

import pytest

from landmosaic.operators import change
from landmosaic.sources import ranges, rasters
from landmosaic.sources import tables as S

RNG = random.Random(9)


def feature(k):
    says = "".join(RNG.choice('ab{}[]"\\,: \n\té') for _ in range(RNG.randint(0, 40)))
    ring = [[k, 0], [k, 1], [k + 1, 1], [k, 0]]
    return {"type": "Feature", "id": str(k), "properties": {"says": says, "more": [{"type": "Feature", "deep": {}}]}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_collections_by_ranges(spark, tmp_path, indent, size):
    """Brackets, quotes and backslashes in strings, features within features, ranges of any size."""
    many = 3 if size == 1 else 40
    told = {"type": "FeatureCollection", "crs": {"properties": {"name": "x{"}}, "features": [feature(k) for k in range(many)], "bbox": [1, 2]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.geojson").write_text(json.dumps(told, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "single one.json").write_text(json.dumps(feature(900)), encoding="utf-8")
    (tmp_path / "none.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}), encoding="utf-8")
    (tmp_path / "empty.json").write_text("", encoding="utf-8")
    if size == 1:
        (tmp_path / "a" / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": "\\\"}"}]}), encoding="utf-8")
        (tmp_path / "single one.json").unlink()
        (tmp_path / "none.json").unlink()
    got = [json.loads(r.value) for r in ranges.feature_texts(spark, str(tmp_path), size).collect()]
    want = [{"type": "Feature", "id": "\\\"}"}] if size == 1 else [*told["features"], feature_of(tmp_path / "single one.json")]
    key = lambda f: json.dumps(f, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    if size > 1:
        rows = S.read_features(spark, str(tmp_path), size).collect()
        assert len(rows) == many + 1 and all(r.finite and r.type == "Polygon" for r in rows)


def feature_of(path: Path):
    return json.loads(path.read_text(encoding="utf-8"))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    features = ",".join(json.dumps(feature(k)) for k in range(3000))
    (tmp_path / "big.json").write_text('{"type":"FeatureCollection","features":[' + features + "]}", encoding="utf-8")
    df = ranges.feature_texts(spark, str(tmp_path), 1 << 16)
    assert df.count() == 3000 and df.rdd.getNumPartitions() > 5


def test_states_of_ranges():
    text = json.dumps({"a": ['x"\\', {"b": "}{"}], "c": "\\\\"}).encode()
    for cut in range(len(text) + 1):
        state, depth = ranges.OUTSIDE, 0
        for part in (text[:cut], text[cut:]):
            state, more = ranges.scan(part, state)
            depth += more
        assert (state, depth) == (ranges.OUTSIDE, 0)


def test_inventories(spark, tmp_path):
    data = {"a/x.TXT": b"one", "a.b": b"two", "a/b/c d+%20.csv": b"", "none": b"three", ".hidden.gz": b"\xef\xbb\xbf\n\r\n", "big.bin": bytes(range(256)) * 20_000}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    seen = {n: c for n, c in data.items() if not n.startswith(".")}
    files = S.inventory(spark, str(tmp_path), "input", str(tmp_path))
    kinds = {"a/x.TXT": "txt", "a.b": "b", "a/b/c d+%20.csv": "csv", "none": "file", "big.bin": "bin"}
    assert {r.path: (r.type, r.bytes, r.sha256, r.stage) for r in files.collect()} == {n: (kinds[n], len(c), hashlib.sha256(c).hexdigest(), "input") for n, c in seen.items()}
    whole = hashlib.sha256()
    for path in sorted(p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")):
        whole.update(path.relative_to(tmp_path).as_posix().encode() + hashlib.sha256(path.read_bytes()).hexdigest().encode())
    r = S.directory_digest(files).first()
    assert (r.files, r.bytes, r.digest) == (len(seen), sum(map(len, seen.values())), whole.hexdigest())
    none = S.directory_digest(files.limit(0)).first()
    assert (none.files, none.bytes, none.digest) == (0, 0, hashlib.sha256().hexdigest())


def test_bucketed_rasters_meet_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one = spark.range(2000).selectExpr("id div 50 AS row", "id % 50 AS col", "CAST(id % 4 AS DOUBLE) AS value")
        two = one.where("(row + col) % 7 <> 0").selectExpr("row", "col", "(value + row) % 3 AS value")
        told = []
        for name, df in (("raster_one", one), ("raster_two", two)):
            rasters.write_raster(df, name, f"{tmp_path}/{name}", 4)
            spark.sql(f"DROP TABLE {name}")
            told.append(rasters.read_raster(spark, name, f"{tmp_path}/{name}", buckets=4))
        pairs = change.pair(*told)
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = {(r.source, r.target): r.pixel_count for r in change.transition_matrix(*told, 900.0).collect()}
        assert got == {(r.source, r.target): r.pixel_count for r in change.transition_matrix(one, two, 900.0).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
