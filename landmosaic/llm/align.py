"""Alignment of two tokenizers' ids over the same bytes, and how often their ids end together.

Both sides are arrays of the bytes at which tokens end. Where words are one token on either side the
arrays run along a diagonal: from the current shift between them, stretches of doubling length are
compared as wholes and jumped over, and a stretch that differs is halved down to where it does. What
is left there, up to the next common end, is an irregular group; it is resolved by itself and the
shift follows from it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import Stretches, by_bytes, byte_level, sentence_pieces

#: Tokens whose ends are Python numbers at the same time; more if no ends meet among them.
WINDOW = 1 << 16
_TEXT_BYTES = 1 << 20
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def diagonal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(i, j, n, p, q): from tokens i and j on n groups of one token each, then one of p and q tokens, or none at the end.

    `a` and `b` rise and have the same last number, or are both empty.
    """
    out = []
    i = j = 0
    size = len(a)
    while i < size:
        at, to, width = i, j, 1
        while a[i : i + width] == b[j : j + width]:
            i += width
            j += width
            if i >= size:
                i, j = size, len(b)
                break
            width *= 2
        while width > 1 and i < size:
            width //= 2
            if a[i : i + width] == b[j : j + width]:
                i += width
                j += width
        n, p, q = i - at, i, j
        if i < size:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
        out.append((at, to, n, i - p, j - q))
    return out


def _windows(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, from, to) of parts of both arrays that end together, of WINDOW tokens or as few more as it takes."""
    i = j = 0
    while i < len(a):
        width = WINDOW
        while True:
            met = np.intersect1d(a[i : i + width], b[j : j + width], assume_unique=True)
            if len(met):
                break
            width *= 2
        p, q = np.searchsorted(a, met[-1]) + 1, np.searchsorted(b, met[-1]) + 1
        yield i, int(p), j, int(q)
        i, j = int(p), int(q)


class Numbers:
    """Decimal numbers below a bound, each with a comma after it, as one row of bytes."""

    def __init__(self, bound: int):
        told = [b"%d," % k for k in range(bound)]
        self.bytes = np.frombuffer(b"".join(told), np.uint8)
        self.length = np.fromiter(map(len, told), np.int64, bound)
        self.start = np.cumsum(self.length) - self.length


def _spread(starts: np.ndarray, lengths: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The stretches of `source` one after the other."""
    ends = np.cumsum(lengths)
    return source[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, numbers: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By windows, for each group: places of its last tokens on either side, and the text of all groups with where each one's ends.

    A group's text is its ids of A joined by commas, a bar, those of B, and a semicolon.
    """
    for i0, i1, j0, j1 in _windows(ends_a, ends_b):
        i, j, n, p, q = np.array(diagonal_runs(ends_a[i0:i1].tolist(), ends_b[j0:j1].tolist()), np.int64).T
        many = n + (p > 0)
        entry = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        over = nth >= n[entry]
        last_a = i[entry] + np.where(over, n[entry] + p[entry] - 1, nth)
        last_b = j[entry] + np.where(over, n[entry] + q[entry] - 1, nth)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # A group's tokens of A come before those of B, after both of all groups before.
        at_a = np.arange(i1 - i0) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        at_b = np.arange(j1 - j0) + np.repeat(np.cumsum(size_a), size_b)
        ids = np.empty(i1 - i0 + j1 - j0, np.int64)
        ids[at_a], ids[at_b] = ids_a[i0:i1], ids_b[j0:j1]
        text = _spread(numbers.start[ids], numbers.length[ids], numbers.bytes)
        ends = np.cumsum(numbers.length[ids])
        text[ends[at_a[last_a]] - 1] = ord("|")
        text[ends[at_b[last_b]] - 1] = ord(";")
        yield i0 + last_a, j0 + last_b, text, ends[at_b[last_b]]


def _sound(encoder: Stretches, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts, whose bytes `raw` are one after the other, are what their tokens' bytes make when they are joined."""
    whole = np.r_[0, np.cumsum(encoder.size_of[ids])][np.r_[0, ends]]
    sound = np.diff(whole) == sizes
    if sound.all() and (_spread(encoder.starts[ids], encoder.size_of[ids], encoder.pool) == raw).all():
        return sound
    bounds, at = [0, *ends.tolist()], np.r_[0, np.cumsum(sizes)]
    return np.array([b"".join(map(encoder.bytes_of.__getitem__, ids[s:e].tolist())) == raw[x:y].tobytes() for s, e, x, y in zip(bounds, bounds[1:], at, at[1:], strict=False)], bool)


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every row.

    A text is encoded with a space before it: by the byte-level vocabulary `path_a`, special tokens'
    strings as plain text, and by the pieces of `path_b`. `links` holds a number for each pair of tokens
    that end together, made of both ids: id of A times B's number of ids plus id of B. Tokens have a
    byte at least, so that is one link a group. Texts that are null or empty, or whose tokens' bytes
    aren't the text's, have no tokens: zeros, an empty string and no links. Documents move nowhere. A
    batch of texts is aligned as one: where a text ends both sides' tokens do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a, True), sentence_pieces(path_b)
        n_ids_b = len(b.bytes_of)
        numbers = Numbers(max(len(a.bytes_of), n_ids_b))
        for part in by_bytes(batches, 1, _TEXT_BYTES):
            texts = part.column(1).fill_null("")
            sides = [(x, *x.encode(texts, True)) for x in (a, b)]
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes += sizes > 0
            raw = np.frombuffer(b"".join([b" " + t for t in pc.cast(texts, pa.binary()).to_pylist() if t]), np.uint8)
            sound = np.logical_and.reduce([_sound(x, ids, to, raw, sizes) for x, ids, to in sides])
            counts = [np.where(sound, np.diff(to, prepend=0), 0) for _, _, to in sides]
            if not sound.all():
                sides = [(x, ids[np.repeat(sound, np.diff(to, prepend=0))], to) for x, ids, to in sides]
            (_, ids_a, _), (_, ids_b, _) = sides
            to_a = np.cumsum(counts[0])
            links, groups = [np.zeros(0, np.int64)], np.zeros(len(sizes), np.int64)
            digests = [hashlib.sha256() for _ in range(len(sizes))]
            for last_a, last_b, text, ends in aligned(ids_a, ids_b, np.cumsum(a.size_of[ids_a]), np.cumsum(b.size_of[ids_b]), numbers):
                links.append(ids_a[last_a].astype(np.int64) * n_ids_b + ids_b[last_b])
                doc = np.searchsorted(to_a, last_a, side="right")
                groups += np.bincount(doc, minlength=len(sizes))
                final = np.flatnonzero(np.diff(doc, append=-1))
                view, at = memoryview(text), 0
                for d, end, whole in zip(doc[final].tolist(), ends[final].tolist(), (last_a[final] == to_a[doc[final]] - 1).tolist(), strict=True):
                    digests[d].update(view[at : end - whole])
                    at = end
            told = [x.hexdigest() if n else "" for x, n in zip(digests, groups.tolist(), strict=True)]
            kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(groups)].astype("<i4")), pa.array(np.concatenate(links)))
            columns = [part.column(0), *map(pa.array, (*counts, groups, groups)), pa.array(told, pa.string()), kept]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "groups_sha256", "links"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links array<long>")


def most_pairs(bytes_a: list[bytes], bytes_b: list[bytes]) -> int:
    """So many pairs of ids can be linked at most, whatever the texts: of two tokens that end together one ends with the other."""
    a, b = Counter(x for x in bytes_a if x), Counter(x for x in bytes_b if x)
    one = sum(n * b[x[k:]] for x, n in a.items() for k in range(len(x)))
    return one + sum(n * a[x[k:]] for x, n in b.items() for k in range(1, len(x)))


def pair_counts(aligned: DataFrame, n_ids_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no other pair with its B id has more."""
    counts = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % n_ids_b)))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text is aligned once and its links are kept in the shared folder; they are counted over all
    documents, and each row looks its own up. The counts go to every task: there are no more than
    most_pairs(), some hundred thousand for vocabularies of 50,000 and 32,000, however much text there
    is. Repeated rows and ids give a row each and all count; other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    n_ids_b = len(sentence_pieces(path_b).bytes_of)
    with small_batches(spark):
        aligned = stored(alignments(docs, path_a, path_b, id_col, text_col))
    pairs = pair_counts(aligned, n_ids_b).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(pairs[c].to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            links = batch.column(6)
            at = np.searchsorted(keys, links.flatten().to_numpy(zero_copy_only=False))
            bounds = np.r_[0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))]
            sums = [np.r_[0, np.cumsum(x[at].astype(np.int64))][bounds] for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(np.diff(s)) for s in sums), batch.column(5)], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(look_up, f"doc_id {kind}, {', '.join(f'{c} long' for c in (*_COUNTS, 'n_best', 'count_sum'))}, groups_sha256 string")
