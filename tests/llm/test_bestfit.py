"""Vector best fit against plain forms and the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from landmosaic.llm import bestfit
from landmosaic.llm.bestfit import Limits

BYTE = path("byte_bpe_50k.json")


def one_by_one(lengths, limits):
    """Each piece, the longest first, to the best sequence of all: how many sequences, and what each holds."""
    scale = np.array(limits.weights) / limits.all.astype(float) ** 2
    left, held = [], []
    for length in sorted(lengths, reverse=True):
        need = bestfit.demand(length)
        fits = [k for k, x in enumerate(left) if (x >= need).all()]
        if limits.rule == "norm":
            score = lambda k: float((left[k] - need) ** 2.0 @ scale)  # noqa: E731, B023
        else:
            score = lambda k: -float((left[k] * need.astype(float)) @ scale)  # noqa: E731, B023
        k = min(fits, key=lambda k: (score(k), left[k][0]), default=None)
        if k is None:
            left.append(limits.all.copy())
            held.append([])
            k = len(left) - 1
        left[k] = left[k] - need
        held[k].append(length)
    return sorted(tuple(sorted(h)) for h in held)


def by_plan(counts, limits):
    held = defaultdict(list)
    for length, low, high, copies, first, base in bestfit.plan(counts, limits):
        for rank in range(low, high):
            held[first + (rank - low) // copies].append((base + (rank - low) % copies * length, length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits.tokens
    return sorted(tuple(sorted(x for _, x in h)) for h in held.values())


@pytest.mark.parametrize("rule", bestfit.RULES)
@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"attention": 900}, {"documents": 4, "attention": 1200, "weights": (1.0, 0.5, 0.7)}])
def test_plan_is_best_fit(rule, limits):
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 30): rng.randint(1, 12) for _ in range(rng.randint(0, 9))}
        told = Limits(64, rule=rule, **limits)
        held = by_plan(counts, told)
        assert sorted(x for h in held for x in h) == sorted(k for k, n in counts.items() for _ in range(n))
        assert all(len(h) <= told.all[1] and sum(x * x for x in h) <= told.all[2] for h in held)
        if rule == "norm":
            assert held == one_by_one([k for k, n in counts.items() for _ in range(n)], told)
        else:
            assert len(held) == pytest.approx(len(one_by_one([k for k, n in counts.items() for _ in range(n)], told)), abs=2)


def test_a_piece_beyond_the_limits_raises():
    with pytest.raises(ValueError, match="beyond"):
        bestfit.plan({40: 1}, Limits(64, attention=900))


def test_plan_grows_with_lengths_not_with_pieces():
    few, many = (bestfit.plan({k: n for k in range(1, 200)}, Limits(256)) for n in (10, 100_000))
    assert len(many) < 4 * len(few)
    total, made = sum(k * 100_000 for k in range(1, 200)), max(r[4] + -(-(r[2] - r[1]) // r[3]) for r in many)
    assert made <= 1.01 * total / 256 + 1


def check(rows, texts, capacity):
    """Every id lies in one piece, pieces are cut as told, sequences have no gaps. Documents are told apart by id."""
    library = Tokenizer.from_file(BYTE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == (capacity if k else len(ids) - (-(-len(ids) // capacity) - 1) * capacity)
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_whole_documents(spark):
    rng = random.Random(6)
    words = ["a", "Straße", "the", "naïve,", "x\ny", "  ", "日本語", "<|endoftext|>", "don't", "\t", "😀."]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300]))) for k in range(150)} | {900: None, 901: "", 902: " ", 903: "x" * 5000}
    df = spark.createDataFrame([(k, t, "seen") for k, t in texts.items()], "doc_id long, text string, piece string").repartition(3)
    check(bestfit.pack(df, BYTE, Limits(128)).collect(), texts, 128)


def test_documents_per_sequence(spark):
    df = spark.createDataFrame([(k, "a b") for k in range(50)], "doc_id long, text string")
    rows = bestfit.pack(df, BYTE, Limits(128, documents=4)).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += 1
    assert len(rows) == 50 and max(held.values()) == 4 and len(held) == 13


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (1, "b")], "doc_id long, text string")
    rows = bestfit.pack(df, BYTE).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (0, 2), (1, 1), (1, 1), (1, 2)]
    assert {r.sequence_id for r in rows} == {rows[0].sequence_id}
    assert bestfit.pack(df.limit(0), BYTE).count() == 0
