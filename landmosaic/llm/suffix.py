"""Removal of byte strings that occur earlier, by a distributed merge sort of sparse suffixes.

Every string of LENGTH bytes has an anchor, the smallest of its hashed grams, so equal strings have
equal anchors at the same offset. Neighbouring strings mostly share one; the strings of one anchor are
a run. A run is known by the suffix that starts at its anchor and by the bytes before it: two strings
that start `l` bytes before their anchors are equal if `l` bytes before them and LENGTH - l bytes of
their suffixes are. So the suffixes that start at anchors are sorted, one in some 40.

1. Texts are dealt to parts. Each part counts its anchors, and counts meet by anchor: a run whose
   anchor has no company can't repeat and goes no further. Only this step trusts a hash, and a false
   meeting costs time alone.
2. Each part sorts the suffixes of its runs with company, front-codes them and sends them to where
   their anchors meet. Of runs equal in all bytes a part sends the first; the others are repeats.
3. A loser tree merges the sorted runs and never compares a prefix whose length it knows. The lengths
   that neighbours share, and those that their bytes before the anchor share, tell for each `l` which
   strings are equal, byte by byte; the first by document and place stays.

An anchor with more than MANY kinds of runs is cut into ranges of offsets, which meet by the bytes that
all strings of a range share: down to single strings, which spread whatever they have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 100
GRAM = 16
#: Bytes of text that are hashed together, of a part at least and at most, and of text whose suffixes meet in one merge.
BLOCK = 1 << 16
PART, MOST_PART, MERGE = 4 << 20, 32 << 20, 8 << 20
#: Suffixes that a part sorts at once.
BATCH = 1 << 14
#: Kinds of runs of an anchor up to which it is taken whole; up to MANY * MANY in ranges of RANGE offsets, then string by string.
MANY = 1 << 16
RANGE = 8
_WINDOW = LENGTH - GRAM + 1
_BEFORE = _WINDOW - 1
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_ODD = np.random.default_rng(5).integers(1, 1 << 63, LENGTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)

#: Repeats: strings of the document that id and tie name start from a to b.
TOLD = np.dtype([("part", "<i4"), ("id", "<i8"), ("tie", "<i8"), ("a", "<i4"), ("b", "<i4")])
#: An anchor's kinds of runs, in a part or in all.
COUNT = np.dtype([("h", "<u8"), ("n", "<u4")])
#: What goes with a suffix: the length shared with the one before, the offsets of its run's strings from the anchor, its place.
SENT = np.dtype([("shared", "<u1"), ("least", "<u1"), ("most", "<u1"), ("id", "<i8"), ("tie", "<i8"), ("at", "<i4")])


def _columns(rows: np.ndarray) -> bytes:
    """Rows byte column by byte column, which compresses better."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def _rows(x: bytes, kind: np.dtype, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8, n * kind.itemsize).reshape(kind.itemsize, n).T).view(kind).ravel()


def packed(rows: np.ndarray) -> bytes:
    return zstandard.compress(_columns(rows), 1)


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    x = zstandard.decompress(blob)
    return _rows(x, kind, len(x) // kind.itemsize)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, a, b, anchor, its hash, a hash of how the run begins and ends) of every run: strings that start from a to b, places within the text."""
    out, held, size, first = [], [], 0, 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= BLOCK or k == len(texts) - 1:
            out.append(_block(held, first))
            held, size, first = [], 0, k + 1
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def _block(texts: list[bytes], number: int) -> tuple[np.ndarray, ...]:
    n = sum(map(len, texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    x = np.frombuffer(b"".join([*texts, b"\0" * LENGTH]), np.uint8)
    v = np.lib.stride_tricks.as_strided(x[:8].view("<u8"), shape=(n + LENGTH - 8,), strides=(1,)) * _K1
    g = v[8 : n + 8] << np.uint64(31)
    g |= v[8 : n + 8] >> np.uint64(33)
    g *= _K2
    g += v[:n]
    g *= _K3
    g ^= g >> np.uint64(29)
    m = g & np.uint64(0xFFFFFFFF00000000)
    m |= np.arange(n, dtype=np.uint64)
    w = 1
    while 2 * w <= _WINDOW:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < _WINDOW:
        m = np.minimum(m[: w - _WINDOW], m[_WINDOW - w :])
    whole = np.ones(n, bool)
    for k in np.flatnonzero(sizes):
        whole[max(ends[k] - sizes[k], ends[k] - LENGTH + 1) : ends[k]] = False
    starts = np.flatnonzero(whole[: len(m)])
    p = (m[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    a, b = starts[new], starts[np.r_[new[1:] - 1, len(p) - 1]] if len(p) else starts[new]
    at = p[new]
    text = np.searchsorted(ends, a, side="right")
    before = (ends - sizes)[text]
    f = (v[a] ^ (v[b + LENGTH - 8] >> np.uint64(7))) * _K2 >> np.uint64(32)
    return text + number, a - before, b - before, at - before, g[at], f.astype(np.uint32)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the ones before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _told(part, ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), TOLD)
    for name, column in zip(TOLD.names, (part, ids, ties, a, b), strict=True):
        out[name] = column
    return out


def joined(rows: np.ndarray) -> np.ndarray:
    """Repeats of documents with those that touch or overlap made one; by what they are repeats doesn't matter any more."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["a"], rows["tie"], rows["id"]))]
    base = (np.cumsum(_firsts(rows["id"], rows["tie"])) << 32).astype(np.int64)
    a, b = base + rows["a"], base + rows["b"]
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1] + 1])
    out = rows[new]
    out["b"] = (reach - base)[np.r_[new[1:] - 1, len(rows) - 1]]
    return out


def _by_part(rows: np.ndarray, column: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows) for each value of the column."""
    if len(rows):
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for x, c in zip(*(np.split(y, np.flatnonzero(column[1:] != column[:-1]) + 1) for y in (rows, column)), strict=True):
            yield int(c[0]), x


def counts(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Anchors with the number of kinds of their runs."""
    order = np.lexsort((f, h))
    h, f = h[order], f[order]
    kind, new = _firsts(h, f), np.flatnonzero(_firsts(h))
    out = np.zeros(len(new), COUNT)
    out["h"] = h[new]
    out["n"] = np.add.reduceat(kind, new) if len(new) else 0
    return out


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row of a matrix shares with the one before; the first shares none."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def coded(part: int, sent: np.ndarray, right: np.ndarray, left: np.ndarray) -> bytes:
    """A sorted run of suffixes: what each shares with the one before, the rest, the bytes before it, and where it is."""
    place = np.arange(LENGTH)
    rest = right[(place >= sent["shared"][:, None]) & (place < LENGTH - sent["least"][:, None])].tobytes()
    before = left[np.arange(_BEFORE) < sent["most"][:, None]].tobytes()
    return zstandard.compress(b"".join([np.array([part, len(sent)], "<i8").tobytes(), _columns(sent), rest, before]), 3)


def uncoded(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(part, what was sent, suffixes, bytes before them): matrices filled up with zeros."""
    x = zstandard.decompress(blob)
    part, n = np.frombuffer(x, "<i8", 2).tolist()
    sent = _rows(x[16 : 16 + n * SENT.itemsize], SENT, n)
    place = np.arange(LENGTH)
    told = (place >= sent["shared"][:, None]) & (place < LENGTH - sent["least"][:, None])
    right = np.zeros((n, LENGTH), np.uint8)
    rest = np.frombuffer(x, np.uint8, offset=16 + n * SENT.itemsize)
    size = int(told.sum())
    right[told] = rest[:size]
    left = np.zeros((n, _BEFORE), np.uint8)
    left[np.arange(_BEFORE) < sent["most"][:, None]] = rest[size:]
    # A byte within the shared length is that of the last suffix that brought one at this place.
    last = np.where(place >= sent["shared"][:, None], np.arange(n)[:, None], 0)
    right = np.take_along_axis(right, np.maximum.accumulate(last, axis=0), axis=0)
    return part, sent, right, left


def merged(runs: list[tuple[list[int], bytes]]) -> tuple[list[int], list[int], list[int]]:
    """(run, index, shared with the one before) of all suffixes of sorted runs, in order, by a loser tree.

    Each waiting suffix has the length of the prefix that it shares with the last one out. The longer
    is the smaller one; only at equal lengths are bytes compared, and from there on. A run is its
    shared lengths and its suffixes, LENGTH bytes each.
    """
    size = 1
    while size < len(runs):
        size *= 2
    shared = [0] * len(runs) + [-1] * (size - len(runs))
    now: list[bytes] = [x[:LENGTH] for _, x in runs] + [b""] * (size - len(runs))
    at = [0] * size
    number = int.from_bytes
    # Each inner node holds the loser below it; the winners of a level meet at the next.
    loser = [-1] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for j in range(0, len(level), 2):
            x, y = level[j], level[j + 1]
            if shared[y] < 0:
                loser[node + j // 2] = y
                up.append(x)
                continue
            n = LENGTH - ((number(now[x]) ^ number(now[y])).bit_length() + 7) // 8
            win, lose = (y, x) if n < LENGTH and now[y] < now[x] else (x, y)
            shared[lose] = n
            loser[node + j // 2] = lose
            up.append(win)
        level = up
    # So far each loser's length is shared with the suffix that beat it, and all winners' with nothing.
    which, index, lengths = [], [], []
    best = level[0] if runs else -1
    if best >= 0:
        shared[best] = 0
    while best >= 0 and shared[best] >= 0:
        i = at[best]
        which.append(best)
        index.append(i)
        lengths.append(shared[best])
        told, suffixes = runs[best]
        at[best] = i = i + 1
        k = best
        if i < len(told):
            now[k] = suffixes[LENGTH * i : LENGTH * i + LENGTH]
            a = shared[k] = told[i]
        else:
            a = shared[k] = -1
        node = (k + size) >> 1
        while node:
            other = loser[node]
            b = shared[other]
            if b > a:
                loser[node] = k
                k, a = other, b
            elif a == b and a >= 0:
                x, y = now[k], now[other]
                n = LENGTH - ((number(x[a:]) ^ number(y[a:])).bit_length() + 7) // 8
                if n < LENGTH and y[n] < x[n] or n == LENGTH and other < k:
                    shared[k] = n
                    loser[node] = k
                    k = other
                else:
                    shared[other] = n
            node >>= 1
        best = k
    return which, index, lengths


def _least_between(lengths: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Shared lengths of neighbours among the rows kept (places in rising order), from those of all rows."""
    if not len(kept):
        return lengths[:0]
    out = np.minimum.reduceat(lengths, np.r_[0, kept[:-1] + 1])
    out[0] = 0
    return out


def _most_around(lengths: np.ndarray) -> np.ndarray:
    """The longer of the lengths shared with the neighbours before and after."""
    return np.maximum(lengths, np.r_[lengths[1:], 0])


def equal_strings(sent: np.ndarray, lengths: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, from, to) of strings that are later equals, by the offsets before the anchors at which they start.

    Rows are in order of their suffixes, `lengths` what neighbours share. Rows of the same bytes and
    offsets go first: all but the first are repeats as a whole. For each offset l the others are then
    grouped by LENGTH - l bytes of the suffix and l bytes before it.
    """
    n = len(sent)
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{_BEFORE}").ravel(), kind="stable")
    left_lengths = shared_lengths(left[by_left])
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    right_kind, left_kind = np.cumsum(lengths < LENGTH), np.cumsum(left_lengths < _BEFORE)[place]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((sent["at"], sent["tie"], sent["id"]))] = np.arange(n)
    order = np.lexsort((rank, sent["most"], sent["least"], left_kind, right_kind))
    first = _firsts(right_kind[order], left_kind[order], sent["least"][order], sent["most"][order])
    later = order[~first]
    yield later, sent["least"][later].astype(np.int64), sent["most"][later].astype(np.int64)
    keep = np.zeros(n, bool)
    keep[order[first]] = True
    kept = np.flatnonzero(keep)
    right_shared = _least_between(lengths, kept)
    in_left = by_left[keep[by_left]]
    left_shared = _least_between(left_lengths, np.flatnonzero(keep[by_left]))
    back = np.empty(n, np.int64)
    back[kept] = np.arange(len(kept))
    spot = back[in_left]
    near = np.empty(len(kept), np.int64)
    near[spot] = _most_around(left_shared)
    low = np.maximum(sent["least"][kept], LENGTH - _most_around(right_shared))
    high = np.minimum(sent["most"][kept], near)
    ranks = rank[kept]
    groups = np.empty(len(kept), np.int64)
    for offset in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        here = np.flatnonzero((low <= offset) & (offset <= high))
        if len(here) < 2:
            continue
        groups[spot] = np.cumsum(left_shared < offset)
        key = np.cumsum(right_shared < LENGTH - offset)[here] * (len(kept) + 1) + groups[here]
        sorting = np.lexsort((ranks[here], key))
        found = kept[here[sorting[~_firsts(key[sorting])]]]
        at = np.full(len(found), offset)
        yield found, at, at


def later_equals(blobs: list[bytes]) -> np.ndarray:
    """What merging sorted runs tells: all but the first of equal strings are repeats."""
    runs = [uncoded(b) for b in blobs]
    which, index, lengths = merged([(sent["shared"].tolist(), right.tobytes()) for _, sent, right, _ in runs])
    starts = np.cumsum([0, *(len(r[1]) for r in runs)])
    order = starts[np.array(which, np.int64)] + np.array(index, np.int64)
    sent, left = (np.concatenate([r[k] for r in runs])[order] for k in (1, 3))
    part = np.repeat([r[0] for r in runs], np.diff(starts))[order]
    out = [_told(part[k], sent["id"][k], sent["tie"][k], sent["at"][k] - high, sent["at"][k] - low) for k, low, high in equal_strings(sent, np.array(lengths), left)]
    return joined(np.concatenate(out))


def _ranges(at: np.ndarray, least: np.ndarray, most: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, anchor, least, most, width) of runs as they are, or cut into ranges of offsets whose anchor is the place of the range."""
    for low, high, width in ((0, MANY, _WINDOW), (MANY, MANY * MANY, RANGE), (MANY * MANY, None, 1)):
        rows = np.flatnonzero((kinds > low) & (kinds <= high if high else True))
        for start in range(0, _WINDOW, width) if len(rows) else ():
            a, b = np.maximum(least[rows], start) - start, np.minimum(most[rows], start + width - 1) - start
            fits = a <= b
            yield rows[fits], at[rows[fits]] - start, a[fits], b[fits], width


def local_runs(part: int, keys: list[tuple[int, int]], texts: list[bytes], known: np.ndarray, tasks: int) -> Iterator[tuple[int, bool, bytes]]:
    """(task, True, coded run) of a part's suffixes with company, and (task, False, repeats) of what it knows by itself.

    `known` are the anchors that other parts have too, with the kinds of their runs.
    """
    text, a, b, p, h, f = runs_of(texts)
    own = counts(h, f)
    several = np.bincount(np.searchsorted(own["h"], h), minlength=len(own)) if len(own) else np.zeros(0, int)
    here = np.searchsorted(own["h"], h)
    kinds = np.where(several[here] > 1, own["n"][here], 0).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known["h"], h), len(known) - 1)
        kinds = np.where(known["h"][at] == h, np.maximum(known["n"][at], 1), kinds)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes + LENGTH
    x = np.frombuffer(b"".join([b"\0" * LENGTH, *texts, b"\0" * LENGTH]), np.uint8)
    ids, ties = (np.array([k[j] for k in keys], np.int64) for j in (0, 1))
    chosen = [(rows, at, least, most, np.full(len(rows), width)) for rows, at, least, most, width in _ranges(p, p - b, p - a, kinds)]
    if not chosen:
        return
    rows, at, least, most, width = map(np.concatenate, zip(*chosen, strict=True))
    key = h[rows]
    cut = np.flatnonzero(width < _WINDOW)
    for k in range(0, len(cut), BATCH):
        some = cut[k : k + BATCH]
        common = x[(base[text[rows[some]]] + at[some])[:, None] + np.arange(LENGTH)].astype(np.uint64)
        common *= np.arange(LENGTH) < (LENGTH + 1 - width[some])[:, None]
        mixed = (common * _ODD).sum(axis=1, dtype=np.uint64) * _K3
        key[some] = (key[some] ^ (mixed >> np.uint64(29)) ^ mixed) * _K2
    to = (key % np.uint64(tasks)).astype(np.int64)
    order = np.lexsort((at, ties[text[rows]], ids[text[rows]], to))
    told = []
    edges = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1], True])
    k = 0
    while k < len(edges) - 1:
        # Whole tasks' suffixes, BATCH of them or one task's.
        upto = max(k + 1, int(np.searchsorted(edges, edges[k] + BATCH, side="right")) - 1)
        some = order[edges[k] : edges[upto]]
        k = upto
        first = (base[text[rows[some]]] + at[some])[:, None]
        right = x[first + np.arange(LENGTH)] * (np.arange(LENGTH) < LENGTH - least[some][:, None])
        left = x[first - 1 - np.arange(_BEFORE)] * (np.arange(_BEFORE) < most[some][:, None])
        whole = np.concatenate([to[some].astype(">i4").view(np.uint8).reshape(-1, 4), right, left, least[some].astype(np.uint8)[:, None], most[some].astype(np.uint8)[:, None]], axis=1)
        by = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
        whole, some = whole[by], some[by]
        new = np.r_[True, (whole[1:] != whole[:-1]).any(axis=1)]
        again = some[~new]
        told.append(_told(part, ids[text[rows[again]]], ties[text[rows[again]]], at[again] - most[again], at[again] - least[again]))
        whole, some = whole[new], some[new]
        right, left = np.ascontiguousarray(whole[:, 4 : 4 + LENGTH]), whole[:, 4 + LENGTH : 4 + LENGTH + _BEFORE]
        sent = np.zeros(len(some), SENT)
        starts = np.flatnonzero(_firsts(to[some]))
        sent["shared"] = shared_lengths(right)
        sent["shared"][starts] = 0
        for name, column in (("least", least[some]), ("most", most[some]), ("id", ids[text[rows[some]]]), ("tie", ties[text[rows[some]]]), ("at", at[some])):
            sent[name] = column
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(some)], strict=True):
            yield int(to[some[s]]), True, coded(part, sent[s:e], right[s:e], left[s:e])
    repeats = joined(np.concatenate(told))
    if len(repeats):
        yield part % tasks, False, packed(repeats)


def _documents(rows: pd.DataFrame) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Keys and texts of the distinct documents that are long enough to hold a string."""
    found = {(i, t): x for i, t, x in zip(rows["id"].tolist(), rows["tie"].tolist(), rows["text"].tolist(), strict=True) if len(x) >= LENGTH}
    return list(found), list(found.values())


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans of every row, and the columns named in `also`.

    Matches never cross documents and are judged on the input. A null text is as empty, one shorter
    than LENGTH keeps all. Documents are told apart by id and text: repeated rows are one document, so
    neither is earlier, and rows of one id but unlike texts are documents of their own, in order of
    their texts' 64-bit hashes; null ids count as the smallest id. Columns other than those named are
    not read; an empty table gives no rows.

    Texts move once, to one of `parts` by document; what else moves is a hash for each anchor, a suffix
    for each kind of run with company, and repeats. No task gets more of one anchor than a count from
    each part, or a bounded number of suffixes. Each step is a function of its input, so a lost
    executor's work is done anew.
    """
    least = -(1 << 63)
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(least)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by_id = docs.select(doc.alias("id"), F.xxhash64(text).alias("tie"), F.octet_length(text).cast("long").alias("n")).groupBy("id").agg(F.min("tie").alias("low"), F.max("tie").alias("high"), F.sum("n").alias("n"))
    total, shared = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or(F.col("low") < F.col("high")), F.lit(False))).first()
    # Where every id has one text, the id tells documents apart, and ties of 0 move as nothing.
    tie = F.xxhash64(text) if shared else F.lit(0).cast("long")
    parts = max(16, total // min(MOST_PART, max(PART, total // 512)))
    tasks = max(16, total // MERGE)
    given = docs.select(
        F.pmod(F.xxhash64(doc, tie), F.lit(parts)).cast("int").alias("part"), doc.alias("id"), tie.alias("tie"), text.cast("binary").alias("text"), F.col(id_col).alias("doc_id"), *also,
    )
    frame = lambda rows: pd.DataFrame(rows, columns=["part", "source", "coded", "blob"])

    def anchors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, _, _, h, f = runs_of(_documents(rows)[1])
        found = counts(h, f)
        return frame([(p, key[0], False, packed(x)) for p, x in _by_part(found, (found["h"] % np.uint64(tasks)).astype(np.int32))])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        found = [unpacked(b, COUNT) for b in rows["blob"]]
        sizes = list(map(len, found))
        found, source = np.concatenate(found), np.repeat(rows["source"].to_numpy(), sizes)
        order = np.argsort(found["h"], kind="stable")
        found, source = found[order], source[order]
        new = _firsts(found["h"])
        which = np.cumsum(new) - 1
        n = np.bincount(which, found["n"])
        company = np.bincount(which)[which] > 1
        found["n"] = np.minimum(n, 0xFFFFFFFF)[which]
        return frame([(p, -1, False, packed(x)) for p, x in _by_part(found[company], source[company])])

    def send(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.concatenate([*(unpacked(b, COUNT) for b in right["blob"]), np.zeros(0, COUNT)])
        keys, texts = _documents(left)
        return frame([(p, key[0], c, b) for p, c, b in local_runs(key[0], keys, texts, known[np.argsort(known["h"])], tasks)] if texts else [])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        sent = rows["blob"][rows["coded"]].tolist()
        told = np.concatenate([*(unpacked(b, TOLD) for b in rows["blob"][~rows["coded"]]), *([later_equals(sent)] if sent else []), np.zeros(0, TOLD)])
        return frame([(p, -1, False, packed(x)) for p, x in _by_part(told, told["part"])])

    def remove(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        told = joined(np.concatenate([*(unpacked(b, TOLD) for b in right["blob"]), np.zeros(0, TOLD)]))
        starts = np.flatnonzero(_firsts(told["id"], told["tie"]))
        ends = [*starts[1:].tolist(), len(told)][: len(starts)]
        spans_of = dict(zip(zip(told["id"][starts].tolist(), told["tie"][starts].tolist(), strict=True), zip(starts.tolist(), ends, strict=True), strict=True))
        froms, tos = told["a"].tolist(), (told["b"] + LENGTH).tolist()
        rows = []
        for i, t, x in zip(left["id"].tolist(), left["tie"].tolist(), left["text"].tolist(), strict=True):
            s, e = spans_of.get((i, t), (0, 0))
            kept, at, gone, spans = [], 0, 0, 0
            for start, end in zip(froms[s:e], tos[s:e], strict=True):
                # Runs of starts that don't touch can still cover bytes that do.
                spans += start > at or not spans
                kept.append(x[at:start])
                gone += end - max(at, start)
                at = end
            kept.append(x[at:])
            rows.append((b"".join(kept), len(x), gone, spans))
        made = pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])
        return pd.concat([left[["doc_id", *also]].reset_index(drop=True), made], axis=1)

    blobs = "part int, source int, coded boolean, blob binary"
    company = given.groupBy("part").applyInPandas(anchors, blobs).groupBy("part").applyInPandas(meet, blobs)
    sent = given.groupBy("part").cogroup(company.groupBy("part")).applyInPandas(send, blobs)
    told = sent.groupBy("part").applyInPandas(merge, blobs)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select("doc_id", *also).schema)
    return given.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(remove, f"{kinds}, kept binary, n_bytes long, n_removed long, n_spans long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats(docs, id_col, text_col).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """What digests() gives, string by string; for tests. Ids are distinct."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        x = (text or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - LENGTH + 1):
            s = x[k : k + LENGTH]
            if s in seen:
                gone[k : k + LENGTH] = b"\1" * LENGTH
            seen.add(s)
        spans = sum(1 for k in range(len(x)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[doc] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
