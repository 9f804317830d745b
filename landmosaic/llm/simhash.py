"""SimHash fingerprints and their near-duplicate components by anchor-point covering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bucketed, cut, slices, stored
from .components import components

SEED = 42
WORDS = 3
DISTANCE = 3
#: Members of an anchor that one comparison takes at once; larger anchors go in pairs of blocks.
BLOCK = 8192
#: Texts that share a first shingle and meet in one comparison; longer lists go in pairs of blocks.
LIST = 2048
#: Shingles of the texts that one task compares, about.
TASK = 250_000
#: Texts from which the order of shingles is told, and frequent shingles kept of them.
SAMPLE, FREQUENT = 8192, 1 << 16
_CHUNK = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of so many lower-case words, in order; of fewer words the whole sequence, of none nothing."""
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return found if words == 1 else list(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))


def likeness(a: str | None, b: str | None, words: int) -> float:
    """The part that two texts' distinct shingles have in common, of all that either has."""
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return len(x & y) / max(1, len(x | y))


def fingerprint(text: str | None, words: int = WORDS, rounds: int = 1, once: bool = False) -> list[int]:
    """For each round a fingerprint: a bit is 1 if it is set in over half of the shingles' hashes; no word: 0.

    With `once`, equal shingles count once. The first round's hashes are XXH64; those of later rounds are mixed from them and are as good as independent.
    """
    grams = shingles(text, words)
    if not grams:
        return [0] * rounds
    if once:
        grams = list(set(grams))
    ones = np.zeros((rounds, 64), np.int64)
    for at in range(0, len(grams), _CHUNK):
        part = grams[at : at + _CHUNK]
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        for k in range(rounds):
            if k:
                hashes = (hashes ^ (hashes >> np.uint64(31)) ^ _MIX) * _MIX
                hashes ^= hashes >> np.uint64(29)
                hashes *= np.uint64(0xBF58476D1CE4E5B9)
                hashes ^= hashes >> np.uint64(32)
            ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(grams), axis=1, bitorder="little")
    return packed.view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rounds: int = 1, once: bool = False) -> DataFrame:
    """(doc_id, fps) of every row, a fingerprint for each round; words end at ASCII white space, A-Z are lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(t, words, rounds, once) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fps array<long>")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Of 31-bit words under the perfect Hamming code: the place, from 1, of the bit to flip; 0 for codewords."""
    out = np.zeros(len(word), np.int64)
    for k in range(31):
        out ^= np.where(word >> k & 1, k + 1, 0)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, is home).

    Two fingerprints within distance 3 differ in at most 1 bit in one of their 32-bit halves. The
    anchors of a half are the codewords of the [31, 26] Hamming code times its last bit: every word
    is within 1 of its home anchor, so a word within 1 of it is within 2 of that anchor.
    """
    keys, rows, homes = [], [], []

    def add(key, index, home):
        keys.append(key)
        rows.append(index)
        homes.append(np.full(len(key), home))

    all_rows = np.arange(len(fps))
    for half in (0, 1):
        word = (fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, top = word & 0x7FFFFFFF, word >> 31
        s = _syndrome(low)
        nearest = np.where(s > 0, low ^ (1 << np.maximum(s - 1, 0)), low)
        tag = (half << 33) | (top << 32)
        other = (half << 33) | ((1 - top) << 32)
        add(tag | nearest, all_rows, True)
        add(other | nearest, all_rows, False)
        off = np.flatnonzero(s)
        for i in range(1, 32):
            j = s[off] ^ i
            once = off[(j > i)]
            pair = s[once] ^ i
            add(tag[once] | (low[once] ^ (1 << (i - 1)) ^ (1 << (pair - 1))), once, False)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def linked(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints.

    Trees grow from the fingerprints nearest to the majority of all bits, breadth first, so that copies
    of one text hang on it in the forests of all anchors at which they meet, and few pairs differ.
    """
    out = []
    ones = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    centre = np.packbits(2 * ones > len(fps), bitorder="little").view(fps.dtype)[0]
    rest = fps[np.argsort(np.bitwise_count((fps ^ centre).view(np.uint64)), kind="stable")]
    while len(rest) > 1:
        tree, rest, at = [rest[0]], rest[1:], 0
        while at < len(tree) and len(rest):
            near = np.bitwise_count((rest ^ tree[at]).view(np.uint64)) <= DISTANCE
            if near.any():
                found = rest[near]
                out += [(int(tree[at]), int(x)) for x in found]
                tree += list(found)
                rest = rest[~near]
            at += 1
    return out


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to links (anchor null), or the members of large anchors as they are."""
    schema = pa.schema([("anchor", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    key, parts, large, size = None, [], False, 0

    def done():
        if large or size < 2:
            return []
        members, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        return linked(np.unique(members)) if home.any() else []

    def emit(anchor, pairs):
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([anchor] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        at, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(at)]
        pairs = []
        alone = ends - starts < 2
        alone[0] = alone[-1] = False
        for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            if at[s] != key:
                pairs += done()
                key, parts, large, size = at[s], [], False, 0
            parts.append((fp[s:e], home[s:e]))
            size += e - s
            if size > BLOCK or large:
                large = True
                yield emit(int(key), [(int(x), int(x)) for p, _ in parts for x in p])
                parts = []
        if pairs:
            yield emit(None, pairs)
    if pairs := done():
        yield emit(None, pairs)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all links among the distinct fingerprints `fp`."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            key, row, home = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(home)], ["anchor", "fp", "home"])

    covered = distinct.select("fp").mapInArrow(cover, "anchor long, fp long, home boolean")
    found = cut(covered.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_anchor, "anchor long, a long, b long"))
    # Anchors with over BLOCK members: every pair of blocks of members meets in a task of its own.
    members = found.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("fp"))
    blocks = members.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(BLOCK // 2)).cast("int").alias("blocks"))
    dealt = (
        members.join(blocks, "anchor")
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )

    def meet(pdf):
        pairs = linked(np.unique(pdf["fp"].to_numpy()))
        return type(pdf)(pairs, columns=["a", "b"])

    over = dealt.groupBy("anchor", "i", "j").applyInPandas(meet, "a long, b long")
    return found.where("anchor IS NULL").select("a", "b").union(over)


def _components(fps: DataFrame) -> DataFrame:
    """(fp_of, component_id) of the distinct fingerprints of (doc_id, fp): the smallest id reachable."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct))
    met = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("first").alias("least"))
    named = distinct.join(roots.join(met, "root").select(F.col("node").alias("fp"), "least"), "fp", "left")
    return cut(named.select(F.col("fp").alias("fp_of"), F.coalesce("least", "first").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows give a row each;
    columns other than the two named are not read; an empty table gives no rows. Null ids stay, and
    are never a component's id unless all its ids are null. Equal fingerprints meet before the
    search, so copies cost one row; no pair table is made, only a spanning forest for each anchor.
    """
    fps = cut(fingerprints(docs, id_col, text_col).select("doc_id", F.col("fps")[0].alias("fp")))
    return fps.join(_components(fps), F.col("fp") == F.col("fp_of"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that repeat in a sample of some SAMPLE texts, in order, and how often: at most FREQUENT of them.

    They only tell in which order shingles are taken, so that the frequent ones come last; whatever the sample, no pair is lost.
    """
    step = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [hashed(t, words) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))], ["token"])

    tokens = texts.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("text").mapInArrow(run, "token long")
    found = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    known = np.array(sorted((r.token, r.n) for r in found), np.int64).reshape(-1, 2)
    return known[:, 0].copy(), known[:, 1].copy()


def hashed(text: str | None, words: int) -> np.ndarray:
    """A hash of each distinct shingle; of two with one hash both are there."""
    return _hashes(set(shingles(text, words)))


def _hashes(grams: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)).view(np.int64)


def prefix(hashes: np.ndarray, least: float, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by the order of frequent(): two sets of likeness `least` have one of these in common."""
    weight = np.zeros(len(hashes), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        weight = np.where(tokens[at] == hashes, counts[at], 0)
    many = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, weight))[:many]] if len(hashes) else hashes


def parities(hashes: np.ndarray) -> np.ndarray:
    """1,024 bits or more, twice to four times the hashes, each the parity of the hashes that fall on it: sets differ in at least as many members as these do in bits.

    With as few bits for long texts half of them would differ whatever the texts, which tells nothing.
    """
    many = 1 << max(10, (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount(hashes & (many - 1), minlength=many).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which parities differ from others, one or a row each; the longer ones are folded, which gives what fewer bits would have."""
    x, y = (x, y) if x.shape[-1] > y.shape[-1] else (y, x)
    folded = np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, y.shape[-1]), axis=-2)
    return np.bitwise_count((folded ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _sizes_fit(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can be of likeness `least`."""
    return np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9


def _may_meet(sizes: np.ndarray, roots: np.ndarray, places: np.ndarray, least: float) -> np.ndarray:
    """Which members of a list may have a link in it that is not known yet.

    If the list's shingle is the first that two sets have in common, they share none before it, so no more than what follows it in either.
    """
    rest, out = sizes - places, np.zeros(len(sizes), bool)
    step = max(1, (1 << 18) // len(sizes))
    for at in range(0, len(sizes), step):
        x, r = sizes[at : at + step, None], rest[at : at + step, None]
        common = np.minimum(r, rest) >= (x + sizes) * least / (1 + least) - 1e-6
        out[at : at + step] = (common & (roots[at : at + step, None] != roots) & _sizes_fit(x, sizes, least)).any(axis=1)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by the first column as runs of one value each, in parts."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist()
        for s, e in zip(starts, [*starts[1:], len(at)], strict=True):
            if parts and at[s] != key:
                yield parts
                parts = []
            key = at[s]
            parts.append(batch.slice(s, e - s))
    if parts:
        yield parts


def _by_token(batches: Iterator[pa.RecordBatch], least: float, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, id, size, root, place) sorted by token to (list, id, root) of those that may meet; members of long lists all go on.

    A list is named by a hash of its members, so shingles that the same texts share make one list; two lists of one name do no harm.
    """
    key, parts, size, out = None, [], 0, []

    def done():
        if size < 2 or size > longest:
            return
        ids, sizes, roots, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        if (roots != roots[0]).any():
            met = _may_meet(sizes, roots, places, least)
            if met.any():
                name = np.uint64(xxh64_intdigest(np.sort(ids[met]).tobytes(), SEED)).astype(np.int64)
                out.append((np.full(met.sum(), name), ids[met], roots[met]))

    def told():
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["list", "id", "root"])
            out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        at, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(at)]
        alone = ends - starts < 2
        alone[0] = alone[-1] = False
        for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            if at[s] != key:
                done()
                key, parts, size = at[s], [], 0
            parts.append([x[s:e] for x in columns])
            size += e - s
            if size > longest:
                out.extend((np.full(len(i), key), i, r) for i, _, r, _ in parts)
                parts = []
        yield from told()
    done()
    yield from told()


def joined(sizes: np.ndarray, roots: np.ndarray, marks: list[np.ndarray], least: float, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of roots, a spanning forest of those joined by members whose sizes and parities allow the likeness and, if given, of whom `same` is true.

    Members of one root are joined from the start, and none are compared once they are.
    """
    lengths = np.array([len(m) for m in marks])
    stacks = {n: np.stack([m for m in marks if len(m) == n]) for n in set(lengths.tolist())}
    row = np.zeros(len(marks), np.int64)
    for n in stacks:
        row[lengths == n] = np.arange((lengths == n).sum())
    left, out = np.ones(len(marks), bool), []

    def take(k: int) -> list[int]:
        found = np.flatnonzero(left & (roots == roots[k]))
        left[found] = False
        return found.tolist()

    while left.any():
        tree, at = take(int(np.argmax(left))), 0
        while at < len(tree) and left.any():
            x, at = tree[at], at + 1
            fit = np.flatnonzero(left & _sizes_fit(sizes, sizes[x], least))
            for n in set(lengths[fit].tolist()):
                some = fit[lengths[fit] == n]
                differ = apart(stacks[n][row[some]], marks[x])
                for y in some[differ <= (sizes[some] + sizes[x]) * (1 - least) / (1 + least) + 1e-6].tolist():
                    if left[y] and (same is None or same(x, y)):
                        out.append((int(roots[x]), int(roots[y])))
                        tree += take(y)
    return out


def _dealt(members: DataFrame, key: str, longest: int, most: int) -> DataFrame:
    """(task, id, root) of (key, id, root, size): a task for each key, for large ones a task for each pair of blocks of members.

    Blocks are of half of `longest` or of `most` shingles; those over a sixteenth of `longest` go to some twelve blocks at least,
    so that they take many tasks.
    """
    n = F.count("*")
    need = F.greatest(F.ceil(n * 2 / F.lit(longest)), F.ceil(F.sum("size") / F.lit(most)))
    many = F.when(n * 16 > longest, F.least(F.ceil(n * 32 / F.lit(longest)), F.lit(12))).otherwise(F.lit(1))
    blocks = members.groupBy(key).agg(F.least(F.greatest(need, many), n).cast("int").alias("blocks"), (F.min("root") < F.max("root")).alias("unlike")).where("unlike").select(F.col(key).alias("of"), "blocks")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, F.col(key) == F.col("of")).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "id", "root")


def _forests(rows: DataFrame, run: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that `run` finds in the rows of each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches):
            if pairs := run(pa.Table.from_batches(parts)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(each, "a long, b long")


def left_out(signs: DataFrame, texts: DataFrame, stars: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): pairs of roots that join all texts of likeness `least` which `stars` does not link; of (doc_id, size, mark, tokens) and (id, text).

    Such texts have one of their first shingles in common (prefix filter), with enough after it, and their parities differ in few
    bits. No pair of texts is a row: lists of texts that share a shingle are looked through where they meet, once for their
    parities, which gives spanning forests, and once, for what these join, for the texts themselves.
    """
    rooted = signs.join(stars.select(F.col("node").alias("of"), "root"), F.col("doc_id") == F.col("of"), "left").select("doc_id", F.col("size").cast("long").alias("size"), F.coalesce("root", "doc_id").alias("root"), "tokens")
    lists = rooted.select("doc_id", "size", "root", F.posexplode("tokens").alias("place", "token")).select("token", F.col("doc_id").alias("id"), "size", "root", F.col("place").cast("long").alias("place"))
    longest = LIST
    found = lists.repartition("token").sortWithinPartitions("token").mapInArrow(lambda batches: _by_token(batches, least, longest), "list long, id long, root long")
    members = cut(found.distinct().join(signs.select(F.col("doc_id").alias("of"), F.col("size").cast("long").alias("size")), F.col("id") == F.col("of")).select("list", "id", "root", "size"))
    marks = signs.select(F.col("doc_id").alias("of"), F.col("size").cast("long").alias("size"), "mark")
    met = _dealt(members, "list", longest, TASK).join(marks, F.col("id") == F.col("of")).select("task", "root", "size", "mark")

    def near(rows: pa.Table) -> list[tuple[int, int]]:
        return joined(rows["size"].to_numpy(), rows["root"].to_numpy(), [x.values.to_numpy() for x in rows["mark"]], least)

    classes = components(cut(_forests(met, near))).select(F.col("node").alias("of"), F.col("root").alias("class"))
    ends = cut(members.select("id", "root", "size").distinct().join(classes, F.col("root") == F.col("of")).select("class", "id", "root", "size"))
    read = _dealt(ends, "class", longest, TASK).join(texts.select(F.col("id").alias("of"), "text"), F.col("id") == F.col("of")).select("task", "root", "text")

    def alike(rows: pa.Table) -> list[tuple[int, int]]:
        said = [set(shingles(t, words)) for t in rows["text"].to_pylist()]
        hashes = [_hashes(x) for x in said]

        def same(x: int, y: int) -> bool:
            common = len(said[x] & said[y])
            return common / max(1, len(said[x]) + len(said[y]) - common) >= least

        return joined(np.array([len(h) for h in hashes]), rows["root"].to_numpy(), [parities(h) for h in hashes], least, same)

    return _forests(read, alike)


def groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, least: float = 0.8, rounds: int = 2) -> DataFrame:
    """(id, group): rows by id, which must be one for each text and not null, with the smallest id of those they are linked to.

    Texts link whose likeness by distinct shingles of `words` words is `least` or more; no such link is lost.
    Most are found by fingerprints of a text's distinct words, one for each round: of each anchor's fingerprints a
    spanning forest of pairs is looked at, and of texts of one fingerprint each with the first. Then all other texts
    that may link (left_out) are looked at where they meet, unless they are linked by then. Likeness is told from the
    texts themselves. Texts without words aren't linked to others.
    """
    texts = bucketed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    tokens, counts = frequent(texts, words)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            said = part.column(1).to_pylist()
            hashes = [hashed(t, words) for t in said]
            columns = [[fingerprint(t, 1, rounds, True) for t in said], [len(h) for h in hashes], [parities(h) for h in hashes], [prefix(h, least, tokens, counts) for h in hashes]]
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "fps", "size", "mark", "tokens"])

    signs = stored(texts.select("id", "text").mapInArrow(sign, "doc_id long, fps array<long>, size long, mark array<long>, tokens array<long>"))
    fps = signs.select("doc_id", "fps")
    side = lambda name: texts.select(F.col("id").alias(f"id_{name}"), F.col("text").alias(f"text_{name}"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = [likeness(x, y, words) >= least for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    # The rounds' fingerprints are searched together: a pair that meets across rounds costs a look at its texts, no more.
    one = fps.select("doc_id", F.explode("fps").alias("fp")).where("fp <> 0")
    first = cut(one.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = one.join(first.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    end = lambda side: first.select(F.col("fp").alias(f"of_{side}"), F.col("first").alias(f"id_{side}"))
    near = links(first).join(end("a"), F.col("a") == F.col("of_a")).join(end("b"), F.col("b") == F.col("of_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).where("a <> b")
    pairs = same.union(near)
    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    read = asked.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b")).select("a", "b", "text_a", "text_b")
    stars = components(cut(read.mapInArrow(alike, "a long, b long")))
    rest = cut(left_out(signs, texts, stars, words, least))
    if rest.take(1):
        stars = components(rest.union(stars.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return fps.select(F.col("doc_id").alias("id")).join(stars, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group"))
