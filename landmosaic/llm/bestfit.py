"""Packing pieces of documents by vector best fit.

A piece asks for tokens, one place among a sequence's documents, and its share of the attention cost
(the square of its length). Pieces go, the longest first, to the open sequence that fits them best
under all three capacities, and a new sequence is opened only where none has room. All pieces of one
length ask for the same, so the plan is made over the counts of each length and over intervals of
sequences in one state, not over pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .tokens import by_bytes, byte_level

CAPACITY = 2048
END = 0
#: How a sequence is chosen: the smallest weighted norm of what it has left, or the largest weighted product of that with what the piece asks for.
RULES = ("norm", "product")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of the three in a choice; without its own limit, documents and attention have what `tokens` implies."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    @property
    def all(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


class Open:
    """Intervals of sequences, each of sequences with the same left; the numbers of an interval follow one another."""

    def __init__(self, limits: Limits):
        self.limits, self.size, self.next = limits, 0, 0
        self.left = np.zeros((64, 3), np.int64)
        self.first = np.zeros(64, np.int64)
        self.many = np.zeros(64, np.int64)
        self.scale = np.array(limits.weights) / limits.all.astype(float) ** 2

    def add(self, left: np.ndarray, first: int, many: int) -> None:
        if self.size == len(self.first):
            self.left, self.first, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.left, self.first, self.many))
        self.left[self.size], self.first[self.size], self.many[self.size] = left, first, many
        self.size += 1

    def best(self, need: np.ndarray) -> int | None:
        """The interval that fits best; of equal ones the one with the least tokens left, then the oldest."""
        fits = np.flatnonzero((self.left[: self.size] >= need).all(axis=1))
        if not len(fits):
            return None
        left = self.left[fits]
        score = ((left - need) ** 2.0 @ self.scale) if self.limits.rule == "norm" else -((left * need.astype(float)) @ self.scale)
        return int(fits[np.lexsort((self.first[fits], left[:, 0], score))[0]])

    def drop_full(self) -> None:
        keep = np.flatnonzero((self.left[: self.size] > 0).all(axis=1))
        self.left[: len(keep)], self.first[: len(keep)], self.many[: len(keep)] = self.left[keep], self.first[keep], self.many[keep]
        self.size = len(keep)


def plan(counts: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, copies in a sequence, first sequence, offset) for the pieces of all lengths.

    By the norm a sequence that took a piece fits the next of that length better than before, so it takes
    copies until it is full; by the product it may fall behind, so it takes one at a time. An interval is
    split where pieces run out; the number of intervals depends on how many lengths there are only.
    """
    out = []
    bins = Open(limits)
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        need, todo, rank = demand(length), counts[length], 0
        if (limits.all < need).any():
            raise ValueError(f"a piece of {length} tokens is beyond a sequence's limits")

        def put(left: np.ndarray, first: int, many: int, copies: int) -> None:
            nonlocal todo, rank
            n = copies * many
            out.append((length, rank, rank + n, copies, first, int(limits.all[0] - left[0])))
            bins.add(left - copies * need, first, many)
            todo, rank = todo - n, rank + n

        while todo:
            k = bins.best(need)
            if k is None:
                # Nothing else has room, so a new sequence takes all copies it can, by either rule.
                most = int((limits.all // need).min())
                left, first, many = limits.all, bins.next, -(-todo // most)
                bins.next += many
            else:
                left, first, many = bins.left[k].copy(), int(bins.first[k]), int(bins.many[k])
                most = int((left // need).min()) if limits.rule == "norm" else 1
                bins.many[k] = 0
            full = min(many, todo // most)
            if full:
                put(left, first, full, most)
            rest = min(todo, most) if full < many else 0
            if rest:
                put(left, first + full, 1, rest)
            taken = full + bool(rest)
            if k is not None and taken < many:
                bins.add(left, first + taken, many - taken)
            if k is not None:
                bins.left[k] = 0
        bins.drop_full()
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): each document's ids and `end`, cut into full pieces after a first one of the rest.

    `part` is the task that made the row and `nth` counts the pieces of its length there, from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_level(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in by_bytes(batches):
            ids, ends = words.encode(batch.column(1), False)
            blob = memoryview(np.insert(ids, ends, np.uint32(end)).astype("<u4").tobytes())
            sizes = np.diff(ends, prepend=0) + 1
            firsts = np.cumsum(sizes) - sizes
            many = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = sizes - (many - 1) * capacity
            start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[doc])
            at = firsts[doc] + start
            crc = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            new = np.flatnonzero(np.diff(ranked, prepend=-1))
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(new, np.diff(np.r_[new, len(doc)])) + seen[ranked]
            np.add.at(seen, length, 1)
            pa.default_memory_pool().release_unused()
            columns = [batch.column(0).take(pa.array(doc)), piece.astype("<i4"), start, length, np.array(crc, np.int64), np.full(len(doc), part, "<i4"), nth]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than a sequence are cut into full pieces, the first of which may be shorter. What
    reaches the driver is a count for each length, at most as many as a sequence has tokens, and the plan
    made of them goes to every task: by rank of a piece among those of its length it names sequence and
    place. Ranks are counted where pieces are made and the parts' counts summed up, so pieces are neither
    sorted nor moved by length. A null text is as empty and has the end id alone; repeated rows, ids and
    null ids give their own pieces; other columns are not read; an empty table gives no rows. Of equal
    pieces it doesn't matter which goes where.
    """
    spark = docs.sparkSession
    with small_batches(spark, 4000):
        made = cut(pieces(docs, path, limits.tokens, end, id_col, text_col))
    sizes = cut(made.groupBy("length", "part").count())
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = made.join(firsts, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    windows = np.array(sorted(plan(counts, limits)), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(windows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, _, copies, sequence, base = sent.value.T
        lengths = np.flatnonzero(np.diff(length, prepend=-1))
        # One key for both: ranks of a length begin where those of the shorter ones end.
        starts = dict(zip(length[lengths].tolist(), np.r_[0, np.cumsum(np.maximum.reduceat(sent.value[:, 2], lengths))].tolist(), strict=False)) if len(length) else {}
        shift = np.zeros(limits.tokens + 1, np.int64)
        for k, v in starts.items():
            shift[k] = v
        keys = shift[length] + low
        for batch in batches:
            of, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(keys, shift[of] + rank, side="right") - 1
            nth = rank - low[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + nth // copies[at]), pa.array(base[at] + nth % copies[at] * of)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
