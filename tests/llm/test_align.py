"""Alignment of two tokenizers against plain forms and the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from landmosaic.llm import align
from landmosaic.llm.bpe import byte_letters
from landmosaic.llm.tokens import byte_level, sentence_pieces

BYTE, PIECE = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def plain_groups(a, b):
    """(from, to, from, to) between common ends."""
    met = sorted(set(a) & set(b))
    p, q = {x: k + 1 for k, x in enumerate(a)}, {x: k + 1 for k, x in enumerate(b)}
    cuts = [(0, 0), *((p[x], q[x]) for x in met)]
    return [(i, k, j, m) for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False)]


def spread(runs):
    out = []
    for i, j, n, p, q in runs:
        out += [(i + k, i + k + 1, j + k, j + k + 1) for k in range(n)]
        if p:
            out.append((i + n, i + n + p, j + n, j + n + q))
    return out


def ends(rng, size, share):
    return [*sorted(x for x in range(1, size) if rng.random() < share), size]


@pytest.mark.parametrize("seed", range(5))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(300):
        size = rng.randint(1, 60)
        a, b = ends(rng, size, rng.random()), ends(rng, size, rng.random())
        if rng.random() < 0.5:
            # Long stretches alike, with a few ends more on either side.
            b = sorted({x for x in a if rng.random() < 0.9} | {size} | {x for x in range(1, size) if rng.random() < 0.05})
        assert spread(align.diagonal_runs(a, b)) == plain_groups(a, b)
    assert align.diagonal_runs([], []) == []


class Counted(list):
    looks = 0

    def __getitem__(self, at):
        Counted.looks += 1
        return super().__getitem__(at)


def test_stretches_alike_are_jumped():
    Counted.looks = 0
    same = list(range(1, 100_001))
    assert align.diagonal_runs(Counted(same), same) == [(0, 0, 100_000, 0, 0)]
    assert Counted.looks < 40
    Counted.looks = 0
    other = [x for x in same if x != 50_000]
    assert align.diagonal_runs(Counted(same), other) == [(0, 0, 49_999, 2, 1), (50_001, 50_000, 49_999, 0, 0)]
    assert Counted.looks < 100


def test_windows_end_together(monkeypatch):
    monkeypatch.setattr(align, "WINDOW", 4)
    rng = random.Random(2)
    numbers = align.Numbers(100)
    for _ in range(50):
        size = rng.randint(1, 80)
        a, b = (np.array(ends(rng, size, rng.random())) for _ in range(2))
        ids_a, ids_b = (np.array([rng.randrange(100) for _ in x]) for x in (a, b))
        text, lasts = b"", []
        for last_a, last_b, part, to in align.aligned(ids_a, ids_b, a, b, numbers):
            assert to[-1] == len(part) and (part[to - 1] == ord(";")).all()
            text += part.tobytes()
            lasts += zip(last_a.tolist(), last_b.tolist(), strict=True)
        groups = plain_groups(a.tolist(), b.tolist())
        want = ";".join(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])) for i, k, j, m in groups)
        assert text.decode() == want + ";" and lasts == [(k - 1, m - 1) for _, k, _, m in groups]


def brute_force(texts):
    """The contract's rows from the two libraries, pair by pair."""
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = byte_letters()
    name = {i: x for x, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(letters[c] for c in name[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b))
        places = defaultdict(list)
        for k, e in enumerate(ends_b):
            places[e].append(k)
        links = [(ids_a[k], ids_b[m]) for k, e in enumerate(ends_a) for m in places[e]]
        counts.update(links)
        groups = ";".join(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])) for i, k, j, m in plain_groups(ends_a, ends_b))
        found.append((len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((n_a, n_b, groups.count(";") + 1, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def test_documents(spark):
    rng = random.Random(8)
    words = ["the", "Straße", "naïve,", "x\ny", "don't", "日本語", "😀", "<s>", "<|endoftext|>", "<0x41>", "12345", "unbelievable", "a▁b", "  ", " ", "\t", "é", " ", "zqx"]
    texts = [" ".join(rng.choice(words[: rng.choice([8, 13, 19])]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["", " ", "  a", "a ", "▁", "unbelievable " * 3000, "x" * 20_000]
    df = spark.createDataFrame([*((k, t, 1) for k, t in enumerate(texts)), (None, None, 1), (0, texts[0], 2)], "doc_id long, text string, links int").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.align(df, BYTE, PIECE).collect())
    want = brute_force([*texts, "", texts[0]])
    ids = [*((False, k) for k in range(len(texts))), (True, 0), (False, 0)]
    assert got == sorted((*i, *w) for i, w in zip(ids, want, strict=True))
    assert align.align(df.limit(0), BYTE, PIECE).count() == 0


def test_pairs_are_bounded_by_the_vocabularies(spark):
    a, b = byte_level(BYTE, True), sentence_pieces(PIECE)
    most = align.most_pairs(a.bytes_of, b.bytes_of)
    assert most < 600_000
    assert align.most_pairs([b"ab", b"b", b""], [b"b", b"xab", b"b"]) == 6
