"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from landmosaic.llm import phrases

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    """(lang, words) to occurrences, and words by language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(AZ)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    return f, n


def brute_force(rows, support, longest, cover, top):
    f, n = counted(rows, longest)
    out = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < support:
            continue
        longer = [w for (x, w), b in f.items() if x == lang and len(w) > len(words) and b >= support and 100 * b >= cover * a and any(w[k : k + len(words)] == words for k in range(len(w) - len(words) + 1))]
        if longer:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def made(seed, docs=300):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "épsilon", "zeta", "x y", "\x1f", "日本"]
    common = ["alpha beta gamma", "delta zeta", "beta Gamma delta zeta", "one two three four five"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r", ";", "\x0b", "!"]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(p + rng.choice(marks) for p in parts)))
    return [*rows, ("en", None), ("en", ""), (None, " \t"), ("fr", "only")]


def tabled(spark, rows):
    return spark.createDataFrame([(k if k % 7 else None, t, lang, "seen", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)


@pytest.mark.parametrize(("seed", "top"), [(1, 2000), (2, 5)])
def test_is_counting(spark, seed, top):
    rows = made(seed)
    got = phrases.collocations(tabled(spark, rows), support=12, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows, 12, 4, 80, top)


@pytest.mark.parametrize(("sample", "support"), [(1, 1), (1000, 2), (3, 40)])
def test_any_sample_will_do(spark, monkeypatch, sample, support):
    """A sample of all documents, of hardly any, and one that proposes too little; bitmaps of any size: the second pass closes it."""
    rows = made(3)
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    docs = tabled(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text", "doc_id")
    got = phrases.frequent_phrases(docs, 12, 4, sample, support).collect()
    f, n = counted(rows, 4)
    assert {(r.lang, r.phrase): r.n for r in got if r["size"]} == {(lang, " ".join(w)): a for (lang, w), a in f.items() if a >= 12}
    assert {r.lang: r.n for r in got if not r["size"] and r.n} == {k: v for k, v in n.items() if v}
    assert len(got) == len({(r.lang, r.phrase) for r in got})


def test_passes_count_less_than_all():
    """What the proposal leaves out isn't counted, what the sample failed to propose is; by one part of documents."""
    langs, texts = pa.array(["en"] * 3), pa.array(["a b c d", "a b c d x", "a b y"])
    every = {}
    for batch in phrases.occurrences(langs, texts, 4):
        every |= dict(zip(batch["h"].to_pylist(), batch["n"].to_pylist(), strict=True))
    assert sorted(every.values()) == [1] * 7 + [2] * 7 + [3] * 3
    none, whole = (phrases.Proposal(np.full(1 << 17, x, np.uint8)) for x in (0, 255))
    sizes = lambda *bits: [(b.num_rows, sum(b["n"].to_pylist())) for b in phrases.occurrences(langs, texts, 4, *bits)]
    assert sizes(none) == [(6, 12)] and len(sizes(whole)) == 4
    # Nothing may be frequent: only the words of each language are told.
    assert sizes(whole, none) == [(1, 12)]
    # Nothing was proposed: all longer phrases of words that may be frequent are told.
    assert sizes(none, whole) == [(1, 12), (6, 12), (5, 9), (4, 6), (2, 3)]


def test_long_counts_are_exact(spark):
    big = 4 * 10**12 + 1
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 3 * big), ("en", "a b c", 3, big - 10**12), ("en", "c", 1, big), ("en", "b c", 2, big - 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(df, 80).collect()}
    assert got["a b"] == (big, big + 1, 3 * big, 2_000_000 * big // (4 * big + 1))
    assert got["b c"] == (big - 1, 3 * big, big, 2_000_000 * (big - 1) // (4 * big))
    one, two = 2_000_000 * (big - 10**12) // (2 * big), 2_000_000 * (big - 10**12) // (2 * big)
    assert got["a b c"][3] == min(one, two)


def test_bits():
    h = np.array([0, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    bits = np.zeros(1 << 17, np.uint8)
    for x in h[:3].tolist():
        at = x & ((1 << 20) - 1)
        bits[at >> 3] |= 1 << (at & 7)
    assert phrases.Proposal(bits).holds(h).tolist() == [True, True, True, False]


def test_empty_table(spark):
    assert phrases.collocations(tabled(spark, [("en", "a b")]).limit(0)).count() == 0
    assert phrases.collocations(tabled(spark, [("en", None), (None, "")])).count() == 0
