"""Each operator against a plain form on small tables with nulls, ties, repeats and long texts."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landmosaic.llm import bpe, components, langid, packing, quality, sharding, simhash, suffix, topk, toxicity, winnow
from landmosaic.llm.common import held_out

tokenizers = pytest.importorskip("tokenizers")
paths = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, fp long"
WORDS = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared = prose(rng, 60)
    out = [None, "", "a", "a b", "a b c", "x" * 500, "ab" * 400, "é" * 130, "a " * 300, "  \n\t ", prose(rng, 9000)]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    out += [f"{prose(rng, 20)} {shared} {prose(rng, 15)}" for _ in range(5)]
    base = prose(rng, 150)
    out += [base, base, base + " end", base.replace("the", "teh", 1), base.upper(), prose(rng, 40) + " 日本語のテキスト 😀 Straße İstanbul ΑΣ"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None, "k", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(len(texts))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_sharding(docs, texts, empty):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        assert by_text.setdefault(raw, r.shard) == r.shard
    sizes = {}
    for raw in {(t or "").encode() for t in texts}:
        sizes[hashlib.md5(raw).hexdigest()] = sum(len(raw) + 1 for t in texts if (t or "").encode() == raw)
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    loads, expected = [0] * 4, {}
    for k in order:
        expected[k] = min(range(4), key=lambda shard: (loads[shard], shard))
        loads[expected[k]] += sizes[k]
    assert all(expected[hashlib.md5(raw).hexdigest()] == shard for raw, shard in by_text.items())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(empty, 4).count() == 0
    assert sharding.shard_documents(docs.union(docs), 4).count() == 2 * len(texts)


def test_sharding_over_buckets_stays_near_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 50)
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("x"), F.col("id")), (F.col("id") * 37 % 90 + 1).cast("int")).alias("text"))
    loads = [r[1] for r in sharding.shard_documents(df, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) / min(loads) < 1.02


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bpe(docs, texts, empty, name):
    tk = tokenizers.Tokenizer.from_file(paths.path(name))
    full = {r.doc_id: r for r in bpe.encode_documents(docs, paths.path(name)).collect()}
    sums = {r.doc_id: r for r in bpe.digests(docs, paths.path(name)).collect()}
    for k, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert full[k].ids == ",".join(map(str, ids))
        assert full[k].decoded == tk.decode(ids, skip_special_tokens=False) == (t or "")
        assert sums[k].n_tokens == len(ids)
        assert sums[k].ids_sha256 == hashlib.sha256(full[k].ids.encode()).hexdigest()
        assert sums[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty, paths.path(name)).count() == 0


def test_bpe_random_strings():
    rng = random.Random(1)
    tk = tokenizers.Tokenizer.from_file(paths.path("byte_bpe_50k.json"))
    e = bpe.Encoder(paths.path("byte_bpe_50k.json"))
    letters = [" ", "  ", "\n", "\t", "'s", "é", "the", "ing", "1", "!!", "<|endoftext|>", "日", "😀", " ", "abc", "�"]
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        parts = e.parts_of(t)
        assert ",".join(parts) == ",".join(map(str, tk.encode(t, add_special_tokens=False).ids))
        assert e.decode(parts) == t


def test_suffix_dedup(docs, texts, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs).collect()}
    assert got == suffix.brute_force(list(enumerate(texts)))
    assert any(v[1] for v in got.values())
    assert suffix.digests(empty).count() == 0


def dedup_here(rows, parts, tasks):
    """The steps of suffix.repeats() without Spark: (doc, place) of every byte that goes."""
    mine = [[k for k in sorted(rows) if len(rows[k]) >= suffix.LENGTH and k[0] % parts == p] for p in range(parts)]
    found = []
    for keys in mine:
        _, _, _, _, h, f = suffix.runs_of([rows[k] for k in keys])
        found.append(suffix.counts(h, f))
    anchors, inverse, met = np.unique(np.concatenate(found)["h"], return_inverse=True, return_counts=True)
    total = np.bincount(inverse, np.concatenate(found)["n"])
    inbox, told = {}, [np.zeros(0, suffix.TOLD)]
    for p, keys in enumerate(mine):
        known = found[p][met[np.searchsorted(anchors, found[p]["h"])] > 1]
        known["n"] = total[np.searchsorted(anchors, known["h"])]
        for task, coded, blob in suffix.local_runs(p, keys, [rows[k] for k in keys], known, tasks) if keys else ():
            if coded:
                inbox.setdefault(task, []).append(blob)
            else:
                told.append(suffix.unpacked(blob, suffix.TOLD))
    told += map(suffix.later_equals, inbox.values())
    return {(r["id"], x) for r in np.concatenate(told) for x in range(r["a"], r["b"] + suffix.LENGTH)}


@pytest.mark.parametrize("many", [suffix.MANY, 2, 1])
def test_suffixes_of_hot_anchors_too_tell_every_repeat(monkeypatch, many):
    """Anchors taken whole, in ranges of offsets and string by string, over copies, long letters and zero bytes."""
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "BATCH", 100)
    monkeypatch.setattr(suffix, "BLOCK", 700)
    rng = random.Random(many)
    passages = [prose(rng, rng.randrange(20, 60)).encode() for _ in range(6)]
    rows = {}
    for k in range(70):
        text = prose(rng, rng.randrange(3, 30)).encode()
        for _ in range(rng.randrange(4)):
            text += rng.choice([b" ", b""]) + rng.choice(passages) + rng.choice([b"", b" " + prose(rng, 9).encode()])
        rows[k, 0] = b"a" * (90 + k) if k % 11 == 0 else b"ab\0" * (90 + k) if k % 13 == 0 else rows[k - 1, 0] if k % 17 == 1 else text
    seen, want = set(), set()
    for (doc, _), x in sorted(rows.items()):
        for k in range(len(x) - suffix.LENGTH + 1):
            s = x[k : k + suffix.LENGTH]
            if s in seen:
                want.update((doc, j) for j in range(k, k + suffix.LENGTH))
            seen.add(s)
    assert want and dedup_here(rows, 5, 3) == want


def test_front_coding():
    rng = random.Random(3)
    n = 60
    right = np.array([[rng.choice(b"ab") for _ in range(suffix.LENGTH)] for _ in range(n)], np.uint8)
    left = np.array([[rng.choice(b"ab") for _ in range(suffix._BEFORE)] for _ in range(n)], np.uint8)
    sent = np.zeros(n, suffix.SENT)
    sent["least"], sent["most"] = [rng.randrange(10) for _ in range(n)], [rng.randrange(10, 85) for _ in range(n)]
    right *= np.arange(suffix.LENGTH) < suffix.LENGTH - sent["least"][:, None]
    left *= np.arange(suffix._BEFORE) < sent["most"][:, None]
    right = right[np.lexsort(right.T[::-1])]
    sent["shared"] = np.minimum(suffix.shared_lengths(right), suffix.LENGTH - sent["least"])
    part, s, r, t = suffix.uncoded(suffix.coded(9, sent, right, left))
    assert part == 9 and (s == sent).all() and (t == left).all()
    assert all((r[k] == right[k])[: suffix.LENGTH - sent["least"][k]].all() for k in range(n))


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(6)
    t = prose(rng, 80)
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed > 0) for r in suffix.digests(df).collect()) == [(1, False), (1, False), (2, True)]


def test_texts_of_one_id_are_documents_of_their_own(spark, monkeypatch):
    """Null and repeated ids: a passage at other places of texts that share their id, and in other documents."""
    monkeypatch.setattr(suffix, "PART", 300)
    rng = random.Random(7)
    line = prose(rng, 25)
    made = [f"{prose(rng, 10 + 7 * k)} {line} {prose(rng, 30)}" for k in range(12)]
    rows = [(None if k < 4 else 7 if k < 8 else k, t) for k, t in enumerate(made)] + [(None, made[0]), (7, made[5]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    ordered = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    told = suffix.brute_force([(n, t) for n, (_, t) in enumerate(ordered)])
    want = {x: told[n] for n, x in enumerate(ordered)}
    key = lambda x: (str(x[0]), x[1:])
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(df).collect()]
    assert sorted(got, key=key) == sorted(((x[0], *want[x]) for x in rows), key=key)
    assert sum(w[1] == 0 for w in want.values()) == 2


def test_loser_tree():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        made = {bytes(rng.choice(b"ab") for _ in range(suffix.LENGTH)) if rng.random() < 0.5 else b"a" * (n := rng.randrange(100)) + b"c" * (suffix.LENGTH - n) for _ in range(rng.randrange(1, 40))}
        rows = np.array([list(x) for x in sorted(made)], np.uint8)
        runs.append((suffix.shared_lengths(rows).tolist(), rows.tobytes()))
    cut = lambda r, i: runs[r][1][suffix.LENGTH * i : suffix.LENGTH * (i + 1)]
    which, index, lengths = suffix.merged(runs)
    found = list(map(cut, which, index))
    assert found == sorted(cut(r, i) for r, (told, _) in enumerate(runs) for i in range(len(told)))
    assert lengths == suffix.shared_lengths(np.array([list(x) for x in found], np.uint8)).tolist()
    assert suffix.merged(runs[:1])[1] == list(range(len(runs[0][0]))) and suffix.merged([]) == ([], [], [])


def test_toxicity_restores_words():
    rng = random.Random(4)
    counts = np.full(toxicity.CLASSES**3, 0.1)
    for _ in range(3000):
        w = f"  {rng.choice(['idiot', 'stupid', 'hello', 'table', 'trash', 'loser'])}  ".encode().translate(toxicity._TABLE)
        for k in range(len(w) - 2):
            counts[(w[k] * toxicity.CLASSES + w[k + 1]) * toxicity.CLASSES + w[k + 2]] += 1
    m = counts.reshape(-1, toxicity.CLASSES)
    r = toxicity.Restorer(np.log(m / m.sum(axis=1, keepdims=True)).ravel())
    assert [r.word(w) for w in ("1d10t", "idiiiiot", "s.t.u.p.i.d", "$tupid!!", "l0s3r", "hello,", "2024")] == ["idiot", "idiot", "stupid", "stupid", "loser", "hello", "2024"]
    assert "idiot" in {r.word(w) for w in r.words("you i d i o t there")}
    assert "idiot" in r.words("so y o u i d i o t") and "stupid" in r.words("$ t u p 1 d, table")
    assert "idiot" in toxicity.Restorer(np.log(m / m.sum(axis=1, keepdims=True)).ravel(), frozenset()).words("table id iot hello")


def test_decoding_finds_the_likeliest_reading():
    """Against all readings of short texts, one by one."""
    from itertools import groupby, product

    rng = random.Random(6)
    model = np.log(np.array([[rng.random() + 0.01 for _ in range(toxicity.CLASSES)] for _ in range(toxicity.CLASSES**2)])).ravel()
    r = toxicity.Restorer(model)

    def cost(text):
        x = [0, 0, *(0 if c == " " else toxicity._class(c) for c in text), 0]
        return sum(model[(a * toxicity.CLASSES + b) * toxicity.CLASSES + c] for a, b, c in zip(x, x[1:], x[2:], strict=False))

    def all_readings(text):
        """(restored, channel's cost): spaces by the pieces around them; runs and signs as the channel has them."""
        pieces, lattice = text.split(" "), []
        for k, piece in enumerate(pieces):
            if k:
                lone = len(pieces[k - 1]) == 1 and len(piece) == 1
                lattice.append([("", np.log(0.8 if lone else 0.02)), (" ", np.log(0.2 if lone else 0.98))])
            for i, (c, run) in enumerate(groupby(piece)):
                n = len(list(run))
                if c in toxicity.BETWEEN:
                    continue
                letters = toxicity.LEET.get(c, c)
                one = np.log(0.5) if len(letters) > 1 else 0.0
                options = [(x * m, one + (np.log(0.2) if m > 1 else 0.0)) for x in letters for m in ((1, 2) if n > 2 else (n,))]
                lattice.append(options + ([("again:" + letters, np.log(0.01))] if k and not i and n == 1 else []))
        for way in product(*lattice):
            out, total, sound = "", 0.0, True
            for x, p in way:
                total += p
                if x.startswith("again:"):
                    sound &= out[-1:] in tuple(x[6:])
                else:
                    out += x
            if sound:
                yield total + cost(out), out

    for text in ["1d10t", "a m o r o n", "id iot", "i d i i o t", "s.t!u||p", "aaab b1", "t o o", "$$$ h 1t", "a a a"]:
        found = r.decode(text)
        ways = list(all_readings(text))
        assert max(c for c, x in ways if x == found) == pytest.approx(max(ways)[0])


@pytest.mark.parametrize("operator", [toxicity.scored, quality.classify])
def test_scorers(operator, docs, texts, labels, empty):
    held = held_out("doc_id", 5, 0)
    rows = operator(docs, labels, held).collect()
    assert len(rows) == len(texts)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    same = {}
    assert all(same.setdefault(texts[r.doc_id] or "", r.score) == r.score for r in rows)
    assert operator(empty, labels, held).count() == 0
    assert {r.score for r in operator(docs, labels.where("false"), held).collect()} == {0.5}


def test_scorers_learn(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, 60) + (" idiot " if k % 3 == 0 else " friend ") + prose(rng, 30) + (" ### $$$" if k % 4 == 0 else "")) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 3 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    held = held_out("doc_id", 5, 0)
    tox = toxicity.scored(df, labels, held).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in tox]) > 0.95
    good = quality.classify(df, labels, held).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in good]) > 0.9


def test_learning_is_plain_ftrl():
    """Weights against updates written out one coordinate at a time."""
    from math import exp, sqrt

    from landmosaic.llm.ftrl import Ftrl

    rng = random.Random(13)
    rows = [(sorted(rng.sample(range(30), rng.randrange(0, 9))), rng.randrange(2)) for _ in range(200)]
    model = Ftrl(30, alpha=0.5, beta=1.0, l1=0.3, l2=0.2)
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        l1 = 0.0 if i == 30 else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + sqrt(n[i])) / 0.5 + 0.2)

    for found, label in rows:
        value = quality.value(len(found))
        model.update(np.array(found, np.int64), value, label)
        x = {**dict.fromkeys(found, value), 30: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - label) * x[i]
            z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / 0.5 * w[i]
            n[i] += g * g
    assert list(model.weights()) == pytest.approx([weight(i) for i in range(31)])
    text = "One word, one word... two!"
    weights = np.random.default_rng(2).normal(size=quality.SIZE + 1)
    found = quality.features(text)
    assert quality.score(weights, text) == pytest.approx(1 / (1 + exp(-sum(weights[i] for i in found) / sqrt(len(found)) - weights[-1])))


@pytest.mark.parametrize("name", ["byte", "word"])
def test_repeated_rows_get_rows_of_their_own(docs, texts, name):
    twice = docs.union(docs)
    if name == "byte":
        rows = bpe.digests(twice, paths.path("byte_bpe_50k.json")).collect()
        assert len(rows) == 2 * len(texts) and len({tuple(r) for r in rows}) == len(texts)
    else:
        once, both = (packing.pack(x, paths.path("word_bpe_49k.json")).collect() for x in (docs, twice))
        assert len(both) == 2 * len(once) and len({(r.sequence_id, r.offset) for r in both}) == len(both)


def test_packing_ids_of_odd_letters():
    """Against the library: letters that normalise to marks, case that depends on others, spaces of all kinds, special tokens."""
    import pyarrow as pa

    rng = random.Random(17)
    path = paths.path("word_bpe_49k.json")
    tk, words = tokenizers.Tokenizer.from_file(path), packing.Words(path)
    odd = ["İ", "İ,", "Σ", "ΑΣ,", "क़,", "ϔ", "Ϋ́", "\x1c", "<|endoftext|>", "<", "'s", "'S,", "don't", "The,", "word.", "a.###", "ﬁ,", "1.5", "日本", "é,", " ", "  ", "\u3000", "\x85", "ß,", "\u1680", '"x"', "!!"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.6 else chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xA000, 0xD800)])) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        ids, ends = words.encode(pa.array([*texts[at : at + 500], None], pa.string()))
        starts = [0, *ends.tolist()]
        for k, text in enumerate(texts[at : at + 500]):
            assert ids[starts[k] : starts[k + 1]].tolist() == tk.encode(text, add_special_tokens=False).ids, text


def plain_winnow(text, k=winnow.K, w=winnow.W):
    """[(place, hash)] of the kept grams, gram by gram."""
    import re

    units = [u for run in re.findall(r"[^ \t\n\r\f\v]+", text, re.ASCII) for u in ([run] if len(run.encode("utf-16-le")) // 2 <= 16 and len(run) <= 16 else run)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def fold(h, seed):
        return xxhash.xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)

    def grams(h, first):
        if 0 < len(h) < k:
            whole = 42
            for x in h:
                whole = fold(x, whole)
            return [(signed(whole) >> 31, -first)]
        width = 1
        while width < k:
            h = [fold(h[i + width], fold(h[i], 42)) for i in range(len(h) - width)]
            width *= 2
        return [(signed(x) >> 31, -first - i) for i, x in enumerate(h)]

    if not units:
        return []
    g = grams([xxhash.xxh64_intdigest(u.encode(), 42) for u in units], 0)
    if len(g) >= 4 * w:
        g = {min(g[i : i + w]) for i in range(len(g) - w + 1)}
    elif len(units) < k + w:
        g = g + grams([xxhash.xxh64_intdigest(b"letter", xxhash.xxh64_intdigest(c.encode(), 42)) for c in text], len(units))
    return sorted((-at, h >> 1) for h, at in g)


def test_winnowing(docs, texts, empty):
    rows = {r.doc_id: r for r in winnow.compare_edits(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    digits = lambda hs: "".join(f"{h & 0xFFFFFFFF:08X}" for h in sorted(hs))
    for k, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[k] or "", texts[nxt] or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        kept = plain_winnow(t)
        assert sorted(r.places) == [at for at, _ in kept]
        a, b, c = ({h for _, h in plain_winnow(x)} for x in (t, edited, n))
        assert (r.fingerprint, r.edited_fingerprint) == (digits(a), digits(b))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a or b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a or c else 1.0)
        if len(t.split()) > 2 and r.near_next < 0.3:
            assert r.near_edited > r.near_next
    assert winnow.compare_edits(empty).count() == 0
    assert winnow.compare_edits(docs.limit(1)).first().near_next == 1.0
    assert winnow.compare_edits(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(texts)
    twice = winnow.compare_edits(docs.union(docs).union(docs)).where("doc_id = 20").collect()
    assert sorted(r.near_next == 1.0 for r in twice) == [False, True, True]


def test_shared_runs_without_spaces_share_a_gram(spark):
    rng = random.Random(10)
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    common = letters(winnow.K + winnow.W - 1)
    df = spark.createDataFrame([(k, letters(40 + k) + common + letters(50)) for k in range(2)], "doc_id long, text string")
    a, b = ({r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)} for r in winnow.fingerprints(df).collect())
    assert a & b


@pytest.mark.parametrize("ids", [[-(1 << 63), (1 << 63) - 1, *range(40)], [None] * 30 + [7] * 30 + [1 << 62, 5]])
def test_winnowing_of_ids_far_apart_and_alike(spark, monkeypatch, ids):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)
    rows = [(i, f"text {n} " * 9) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for (_, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r.edited_sha256 for r in winnow.compare_edits(df).collect()) == want
    kinds = df.selectExpr("doc_id AS id", "xxhash64(text) AS key", "1L AS n")
    assert winnow._narrowed(kinds, winnow._ranges(kinds, len(ids))).groupBy("at").count().agg(F.max("count")).first()[0] <= 8


def test_winnowing_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 5)
    rows = [(k * k * 31, f"text {k} " * 9) for k in range(40)]
    got = {r.doc_id: r.edited_sha256 for r in winnow.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (k, t), (_, n) in zip(rows, [rows[-1], *rows[:-1]], strict=True):
        assert got[k] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()


def test_shared_words_share_a_gram(spark):
    rng = random.Random(9)
    common = prose(rng, winnow.K + winnow.W - 1)
    df = spark.createDataFrame([(k, f"{prose(rng, 30)} {common} {prose(rng, 30)}") for k in range(2)], "doc_id long, text string")
    a, b = (r.fingerprint for r in winnow.fingerprints(df).collect())
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    assert cut(a) & cut(b)


def test_packing(docs, texts, empty):
    path = paths.path("word_bpe_49k.json")
    tk = tokenizers.Tokenizer.from_file(path)
    ids = [tk.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    rows = packing.pack(docs, path).collect()
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(empty, path).count() == 0


def test_minimum_bin_slack_is_exact():
    rng = random.Random(7)
    from itertools import combinations

    for _ in range(60):
        items = [rng.randrange(1, 40) for _ in range(9)]
        counts = {k: items.count(k) for k in items}
        used = packing.fill(counts, sorted(counts), 64)
        first = max(items)
        rest = sorted(items)[:-1]
        best = max(first + sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if first + sum(c) <= 64)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())
        taken = sum((hi - lo) for _, lo, hi, _, _, _ in packing.plan(counts, 64))
        assert taken == len(items)


def plain_top(vectors, queries, k):
    clean = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in clean:
            best = sorted((-sum(a * b for a, b in zip(clean[q], v, strict=False)), i) for i, v in clean.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 3)]) for i in range(200)] + [(i, [0.5] * 12) for i in range(200, 260)]
    vectors += [(260, None), (261, [None] * 12), (262, [float("nan")] * 12), (263, [float("inf")] + [0.0] * 11), (264, []), (265, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == plain_top(vectors, range(0, 266, 20), 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert topk.top_k(df.where("vec_id < 5"), F.col("vec_id") == 0, 20).count() == 4


@pytest.mark.parametrize("dense", [0.1, 1.0])
def test_max_score_probes_what_can_still_win(monkeypatch, dense):
    """One shard against plain products: sparse and full postings, ties, the query's own id among repeated ones."""
    monkeypatch.setattr(topk, "STEP", 3)
    rng = np.random.default_rng(4)
    docs = np.round(rng.normal(size=(900, 40)) * np.exp(-np.arange(40) / 6) * 30).astype(np.int64) * (rng.random((900, 40)) < dense)
    docs[::7] = docs[3]
    ids = rng.permutation(np.r_[np.arange(890), [5] * 10])
    shard = topk.Shard(*topk._exact(docs), ids)
    for n in range(0, 900, 45):
        near, scores = shard.best(docs[n].astype(shard.docs.dtype), int(ids[n]), 20)
        want = sorted((-int(docs[m] @ docs[n]), int(ids[m])) for m in range(900) if ids[m] != ids[n])[:20]
        assert [(-int(s), int(i)) for i, s in zip(near, scores, strict=True)] == want
    assert len(topk.Shard(docs[:5], np.arange(5)).best(docs[0], 0, 20)[0]) == 4


def plain_fingerprint(text):
    import re

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, texts, empty):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(texts))]
    assert {k: (r.fingerprint, r.component_id) for k, r in rows.items()} == {k: (f"{fps[k]:016x}", least[k]) for k in range(len(texts))}
    assert simhash.near_duplicates(empty).count() == 0
    nulls = simhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == len(texts) and all(r.component_id is None for r in nulls)


def edited(rng, text, least):
    """The text with words replaced one by one, as long as its likeness by five words is `least` or more."""
    words = text.split(" ")
    places = list(range(len(words)))
    rng.shuffle(places)
    for k in places:
        changed = [*words[:k], f"new{rng.randrange(10**6)}", *words[k + 1 :]]
        if simhash.likeness(text, " ".join(changed), 5) < least:
            break
        words = changed
    return " ".join(words)


def test_near_copies_are_found_and_no_others(spark):
    """Of copies of likeness 0.8 to 0.95 at least nine in ten are found; texts under 0.8 stay apart; against all pairs."""
    rng = random.Random(21)
    made = [prose(rng, rng.randint(60, 400)) for _ in range(80)]
    assert [simhash.fingerprint(t)[0] & (1 << 64) - 1 for t in made[:5]] == [plain_fingerprint(t) for t in made[:5]]
    rows = list(enumerate(made))
    rows += [(1000 * (k % 4 + 1) + k, edited(rng, t, (0.8, 0.85, 0.9, 0.95)[k % 4])) for k, t in enumerate(made)]
    rows += [(9000 + k, edited(rng, t, 0.55)) for k, t in enumerate(made[:20])] + [(9900, ""), (9901, None), (9902, "one two"), (9903, "one  TWO"), (9904, "one two three")]
    df = spark.createDataFrame(rows, "key long, text string").withColumn("group", F.lit(1)).repartition(3)
    got = {r.id: r.group for r in simhash.groups(df, "key", "text").collect()}
    texts = dict(rows)
    linked = {(a, b) for a in texts for b in texts if a < b and simhash.likeness(texts[a], texts[b], 5) >= 0.8}
    root = {k: k for k in texts}
    for _ in range(5):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got.keys() == texts.keys() and all(root[k] == root[g] for k, g in got.items())
    found = sum(got[a] == got[b] for a, b in linked)
    assert len(linked) > 80 and found >= 0.9 * len(linked)
    assert got[9900] == 9900 and got[9901] == 9901 and got[9903] == 9902 and got[9904] == 9904
    assert sum(1 for k in range(9000, 9020) if got[k] == k) == 20


def test_topk_leaves_postings_unread():
    """On the given vectors: the same answers as by all products, though a part of the postings is never read."""
    import duckdb

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    ids, vectors = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall(), strict=True)
    docs = np.floor(64 * np.array(vectors, float)).astype(np.int64)
    (x,) = topk._exact(docs)
    shard = topk.Shard(x, np.array(ids))
    asked = range(0, len(ids), 20)
    for q in asked:
        names, scores = shard.best(x[q], ids[q], 20)
        whole = docs @ docs[q]
        want = sorted((-int(whole[j]), ids[j]) for j in range(len(ids)) if j != q)[:20]
        assert [(-int(s), n) for s, n in zip(scores, names.tolist(), strict=True)] == want
    share = shard.read / (len(asked) * np.count_nonzero(docs))
    assert share < 0.8


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_keep_components(spark, monkeypatch, block):
    """Balls of fingerprints, in anchors taken whole and in pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    least = {x: x for x in signed}
    changed = True
    while changed:
        new = {x: min(least[y] for y in signed if bin((x ^ y) & (1 << 64) - 1).count("1") <= 3) for x in signed}
        changed, least = new != least, new
    assert {x: roots.get(x, x) for x in signed} == least


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (1, "http://a.example.fr/x", '<html lang="fr"><body>le chat est dans la maison et il dort</body></html>'),
    (2, "http://b.example.de", "<html><script>the the the</script><p>der hund ist in dem haus und er</p></html>"),
    (3, None, None), (4, "no url", ""), (5, "http://a.example.fr/y", "<html lang=fr>12345</html>"),
    (6, "http://a.example.fr/z", "<html lang='fr-CA'>der hund ist in dem haus und er mit den anderen</html>"),
    (7, "http://b.example.de/q", "<html lang=de>xqzvkj wvxxq jjqkzx qqvwx zzkxjv xwqzk vvqjx kzxqj</html>"),
    (8, "http://b.example.de/q", "<html lang=de>xqzvkj wvxxq jjqkzx qqvwx zzkxjv xwqzk vvqjx kzxqj</html>"),
]


def plain_languages(rows, trained):
    """{n: (language, confidence)} of rows (text, declared, host, suffix), in dictionaries; trained: (text, lang)."""
    import math
    from collections import Counter

    def grams(text):
        x = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        x = x.encode()
        return [x[k : k + 3] for k in range(len(x) - 2)]

    by, letters = {}, Counter()
    for lang in {lang for _, lang in trained}:
        text = " ".join(t for t, x in trained if x == lang)
        by[lang] = Counter(grams(text))
        letters.update((" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode())
    whole = sum(letters.values()) + 128
    langs, out = sorted(by), {}
    for n, (text, declared, host, suffix) in enumerate(rows):
        g = grams(text)
        share = min(1, langid.TEXT_WEIGHT / max(1, len(g)))
        stray = [math.prod((letters[b] + 0.5) / whole for b in x) for x in g]
        others = [r for k, r in enumerate(rows) if k != n and r[1] in by]
        score = {}
        for lang in langs:
            total = sum(by[lang].values())
            p = (sum(r[1] == lang for r in others) + 1) / (len(others) + len(langs))
            for same in ([r for r in others if r[3] == suffix], [r for r in others if r[2:] == (host, suffix)]):
                p = (sum(r[1] == lang for r in same) + langid.SMOOTH * p) / (len(same) + langid.SMOOTH)
            told = 0 if declared not in by else math.log(langid.TRUST if lang == declared else (1 - langid.TRUST) / (len(langs) - 1))
            score[lang] = share * sum(math.log((1 - langid.STRAY) * by[lang][x] / total + langid.STRAY * s) for x, s in zip(g, stray, strict=True)) + told + math.log(p) + math.log(1 - langid.OTHER)
        none = share * sum(map(math.log, stray)) + math.log(langid.OTHER) - (math.log(len(langs)) if declared in by else 0)
        best = max(langs, key=lambda x: (score[x], [-ord(c) for c in x]))
        out[n] = (best, 1 / (sum(math.exp(s - score[best]) for s in score.values()) + math.exp(none - score[best])), len(g))
    return out


def test_language(spark, empty):
    rng = random.Random(2)
    words = {"fr": "le chat est dans la maison et il dort avec les autres".split(), "de": "der hund ist in dem haus und er schlaeft mit den anderen".split()}
    texts = [(" ".join(rng.choice(words[lang]) for _ in range(40)), lang) for lang in ["fr", "de"] * 20]
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)] + [(99, None, "fr"), (98, "x", None), (97, "y", "not a code")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("declared", F.lit("x"))
    got = {r.page_id: r for r in langid.identify_pages(pages.where("page_id < 8"), docs).collect()}
    assert [got[k].language for k in (1, 2, 5, 6)] == ["fr", "de", "fr", "de"] and got[6].declared == "fr"
    assert [got[k].accepted for k in range(1, 8)] == [True, True, False, False, False, True, False]
    rows = [("le chat est dans la maison et il dort", "fr", "a.example.fr", "fr"), ("der hund ist in dem haus und er", None, "b.example.de", "de"), ("", None, "", ""), ("", None, "", ""), ("12345", "fr", "a.example.fr", "fr"), ("der hund ist in dem haus und er mit den anderen", "fr", "a.example.fr", "fr"), ("xqzvkj wvxxq jjqkzx qqvwx zzkxjv xwqzk vvqjx kzxqj", "de", "b.example.de", "de")]
    for n, (language, confidence, _) in plain_languages(rows, texts).items():
        assert (got[n + 1].language, got[n + 1].confidence) == (language, pytest.approx(confidence, rel=1e-4, abs=1e-9))
    assert langid.identify_pages(pages.unionAll(pages), docs).count() == 2 * len(PAGES)
    assert langid.identify_pages(pages.limit(0), docs).count() == 0
    assert langid.identify_pages(pages, docs.limit(0)).where("language IS NOT NULL OR accepted").count() == 0
    found = {r.doc_id: r for r in langid.identify_documents(docs.withColumn("source", F.lit(None).cast("string")).withColumn("host", F.lit(1))).collect()}
    assert all(found[k].language == ["fr", "de"][k % 2] and found[k].accepted for k in range(40))
    assert not found[99].accepted
    assert langid.identify_documents(empty).count() == 0


def test_rare_languages_stay(spark):
    """One row in thousands declares a language of its own, and is known by it."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "zqo vrk zqo wek zqo vrk").otherwise("the cat is in the house and it sleeps").alias("text"), F.when(F.col("id") == 77, "xx").otherwise("en").alias("lang"), F.lit("s").alias("source"))
    r = langid.identify_documents(df).where("doc_id = 77").first()
    assert (r.language, r.accepted) == ("xx", True)
