"""The pipeline's stages on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from landmosaic.llm import simhash, suffix

WORDS = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))
    rows = [(k, prose(80) + (" you idiot " if k % 4 == 0 else " ") + prose(40), "en", f"s{k % 3}") for k in range(200)]
    rows += [(200, rows[1][1], "en", "s1"), (201, rows[1][1] + " more", "en", "s1"), (202, "12345 !!!", "en", None), (203, None, "en", "s1"), (204, "é" * 150, "en", "s1"), (205, "x" + "é" * 150, "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    path = str(tmp_path_factory.mktemp("sf"))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language_id", "toxicity", "simhash", "suffix_dedup", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = P.language_id(spark, docs.withColumn("kept_id", F.lit(1)), sf)
    assert kept.columns == P.COLUMNS and ids(docs) - ids(kept) == {202, 203}
    clean = P.toxic_filter(spark, docs, sf)
    gone = ids(docs) - ids(clean)
    toxic = {k for k in range(200) if k % 4 == 0}
    assert len(gone & toxic) > 45 and not gone - toxic
    single = P.near_duplicates(spark, docs.union(docs), sf)
    assert not {200} & ids(single) and {1, 2, 3} <= ids(single) and single.count() == len(ids(single))
    cut = P.suffix_dedup(spark, docs, sf)
    assert cut.columns == P.COLUMNS and cut.count() == docs.count()
    want = suffix.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    for r in cut.collect():
        n, removed, _, _ = want[r.doc_id]
        assert len(r.text.encode()) <= n - removed and r.n_chars == len(r.text)
    packed = P.pack(spark, docs, sf)
    assert ids(packed) == ids(docs)


def test_rows_of_one_id_are_told_apart(spark, sf):
    """One id or none over unlike texts: each row is judged by its own text."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))
    base = prose(200)
    junk = " ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) for _ in range(40))
    rows = [(1007, prose(90)), (1007, prose(50) + " you idiot " + prose(40)), (1007, junk), (None, base), (None, base), (None, base + " now"), (None, prose(90)), (None, None), (None, ""), (None, "42")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(P.COLUMNS)
    mine = spark.createDataFrame([(i, t, None if t == junk else "en", None, len(t or "")) for i, t in rows], docs.schema)
    texts = lambda df: sorted(r.text for r in df.where("doc_id = 1007 OR doc_id IS NULL").collect() if r.text)
    told = P.language_id(spark, docs.union(mine), sf)
    assert texts(told) == sorted(t for k, (_, t) in enumerate(rows) if k not in (2, 7, 8, 9))
    clean = P.toxic_filter(spark, told, sf)
    assert texts(clean) == sorted(rows[k][1] for k in (0, 3, 4, 5, 6))
    single = P.near_duplicates(spark, clean, sf)
    assert rows[0][1] in texts(single) and rows[6][1] in texts(single) and len(texts(single)) == 3
    for _, stage in P.STAGES:
        assert stage(spark, mine.limit(0), sf).count() == 0


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def alike_groups(texts, words=5, least=0.8):
    """Components of all pairs of likeness `least` or more, by brute force."""
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] != texts[b] and simhash.likeness(texts[a], texts[b], words) >= least:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in range(len(texts))}


@pytest.mark.parametrize(("rounds", "longest"), [(1, 2048), (2, 8)])
def test_no_link_is_left_out(spark, monkeypatch, rounds, longest):
    """Likeness at and about 0.8, long and short texts, shared lines: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "LIST", longest)
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    line, texts = words(12), ["a b", "A  b", "a b c", "", "x"]
    for n in (9, 20, 60, 200):
        base = words(n)
        for k in range(24):
            text = list(base)
            for _ in range(k % max(2, n // 25) + 1):
                text[rng.randrange(len(text))] = rng.choice(words(1))
            texts.append(" ".join(text + (line if k % 5 == 0 else [])))
    texts += [" ".join(words(6) + line) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.group for r in simhash.groups(df, "id", "text", 5, 0.8, rounds).collect()}
    assert got == alike_groups(texts)


def test_long_texts_are_told_apart_without_reading_them():
    """Parities lose no likeness of 0.8 whatever the lengths, and tell long texts of likeness 0.7 from such."""
    rng = np.random.default_rng(5)
    bound = lambda x, y: (len(x) + len(y)) * 0.2 / 1.8 + 1e-6
    hashes = lambda n: rng.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)
    for size in (3, 500, 520, 3000, 4100, 40_000):
        for cut in (0.0, 0.02, 0.1, 0.19):
            x = hashes(size)
            y = x[: size - int(size * cut)]
            assert simhash.apart(simhash.parities(x), simhash.parities(y)) == simhash.apart(simhash.parities(y), simhash.parities(x)) <= bound(x, y)
    for size in (3000, 40_000):
        x = hashes(size)
        y = np.r_[x[: int(size * 0.82)], hashes(int(size * 0.18))]
        assert simhash.apart(simhash.parities(x), simhash.parities(y)) > bound(x, y)


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Near copies that are unlike one another make no row for each pair, and those that one text joins are joined."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    texts = []
    for many, whole in ((240, False), (40, True)):
        base = words(60)
        for k in range(many):
            at = 5 + k % 50
            texts.append(" ".join(base[:at] + words(1) + base[at + 1 :]))
        texts += [" ".join(base)] * whole
    made, cut = [], simhash.cut

    def counted(df):
        out = cut(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.group for r in simhash.groups(df, "id", "text").collect()}
    assert got == alike_groups(texts)
    assert max(made) < 20 * len(texts)
