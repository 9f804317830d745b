"""Rank correlations of units drawn with replacement, for many replicates at once.

A row holds, for some WIDTH replicates, how often one unit is drawn in each. Values stand as their ranks
among all units, so what is drawn needs no sorting: sums over equal values and running totals by value
give the ranks in every replicate. No task holds all units, nor all draws of a replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import md5_below
from .ordering import stored

#: Replicates of one row.
WIDTH = 128
#: Units of a block whose draws are counted together, and ranks of a block whose running totals are.
BLOCK = 1 << 14
#: Draws that a task makes, where that gives at most _TASKS tasks, and that it sends on at once; rows of sums that it holds, and that it multiplies at once.
_DRAWS, _TASKS, _HELD = 1 << 18, 10_000, 2048


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin whose keys differ from those of the row before."""
    differ = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, differ])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().astype(np.int32, copy=False)))


def drawn(spark, n: int, replicates: int, width: int, seed: int) -> DataFrame:
    """(part, block, codes): n draws of each replicate; a code tells the unit within its block and the replicate within its part."""
    total = n * replicates
    draws = spark.range(0, total, 1, max(1, min(_TASKS, -(-total // _DRAWS)))).select(F.expr(f"id div {max(1, n)}").alias("rep"), F.expr(f"id % {max(1, n)}").alias("place"))
    found = draws.select("rep", md5_below(F.lit(n), seed, F.col("rep") + 1, "place").alias("draw"))
    block_size = BLOCK

    def packed(held):
        rep, draw = (np.concatenate(x) for x in zip(*held, strict=True))
        part, block = rep // width, draw // block_size
        order = np.lexsort((block, part))
        codes = ((draw - block * block_size) * width + rep - part * width)[order].astype(np.int32)
        part, block = part[order], block[order]
        at = _starts(part, block)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(codes)].astype(np.int32)), pa.array(codes))
        return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(block[at]), lists], ["part", "block", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((_numbers(batch, "rep"), _numbers(batch, "draw")))
                size += batch.num_rows
            if size >= _DRAWS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return found.mapInArrow(run, "part long, block long, codes array<int>")


def weights(codes: DataFrame, n: int, width: int) -> DataFrame:
    """(part, i, w): how often unit i is drawn in each replicate of a part."""
    block_size = BLOCK

    def done(key, counts):
        part, block = key
        rows = counts.reshape(-1, width)
        for at in range(0, len(rows), _HELD):
            some = rows[at : at + _HELD]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part)), pa.array(block * block_size + at + np.arange(len(some))), _lists(some)], ["part", "i", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, None
        for batch in batches:
            told = batch.column(2)
            for k, at in enumerate(zip(_numbers(batch, "part").tolist(), _numbers(batch, "block").tolist(), strict=True)):
                if at != key:
                    if key is not None:
                        yield from done(key, counts)
                    key, counts = at, np.zeros(min(block_size, n - at[1] * block_size) * width, np.int32)
                np.add.at(counts, told[k].values.to_numpy(), 1)
        if key is not None:
            yield from done(key, counts)

    return codes.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(run, "part long, i long, w array<int>")


def summed(weighted: DataFrame, ranks: list[str], width: int, per: int) -> DataFrame:
    """(part, field, q, w): draws of each rank, or of blocks of `per` ranks; fields by number. What tasks can't put together comes in several rows."""

    def together(keys, rows):
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        at = _starts(*keys)
        return [k[at] for k in keys], np.add.reduceat(rows[order], at, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in ranks], [0] * len(ranks)

        def sent(f):
            keys, rows = together([np.concatenate(x) for x in zip(*[k for k, _ in held[f]], strict=True)], np.concatenate([r for _, r in held[f]]))
            return keys, rows

        def batch_of(f, keys, rows):
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(np.full(len(rows), f)), pa.array(keys[1]), _lists(rows)], ["part", "field", "q", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, w = _numbers(batch, "part"), _vectors(batch, "w", width)
            for f, name in enumerate(ranks):
                held[f].append(together([part, _numbers(batch, name) // per], w))
                size[f] += len(held[f][-1][1])
                if size[f] > _HELD:
                    keys, rows = sent(f)
                    held[f], size[f] = [(keys, rows)], len(rows)
                    if len(rows) > _HELD // 2:
                        yield batch_of(f, keys, rows)
                        held[f], size[f] = [], 0
        for f in range(len(ranks)):
            if held[f]:
                yield batch_of(f, *sent(f))

    return weighted.mapInArrow(run, "part long, field long, q long, w array<int>")


def before(blocks: DataFrame) -> DataFrame:
    """(part, field, block, w): for each block of ranks what is drawn of the blocks before it."""
    sums = blocks.select("part", "field", F.col("q").alias("block"), F.posexplode("w").alias("k", "s")).groupBy("part", "field", "block", "k").agg(F.sum("s").alias("s"))
    lower = Window.partitionBy("part", "field", "k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("s", F.coalesce(F.sum("s").over(lower), F.lit(0)).cast("int"))
    return told.groupBy("part", "field", "block").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x")).select("part", "field", "block", F.col("x.s").alias("w"))


def ranked(sums: DataFrame, offsets: DataFrame, n: int, width: int) -> DataFrame:
    """(part, field, q, r): in each replicate the mean place of the units of rank q, doubled and from the middle: 2 * place - (n + 1)."""
    both = sums.select("part", "field", F.expr(f"q div {2 * BLOCK}").alias("block"), "q", "w").union(offsets.select("part", "field", "block", F.lit(-1).cast("long"), "w"))
    sorted_rows = both.repartition("part", "field", "block").sortWithinPartitions("part", "field", "block", "q")

    def placed(key, q, below, own):
        """Of sums that are complete, and what is drawn below the first of them."""
        upto = below + np.cumsum(own, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key[0])), pa.array(np.full(len(q), key[1])), pa.array(q), _lists(2 * upto - own - n)], ["part", "field", "q", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last rank met may go on in the next batch; the first row of a block is its offset.
        key, below, last_q, last = None, None, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, field, block, q = (_numbers(batch, c) for c in ("part", "field", "block", "q"))
            w = _vectors(batch, "w", width).astype(np.int64)
            at = _starts(part, field, block)
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(q)], strict=True):
                told = (int(part[s]), int(field[s]), int(block[s]))
                if told != key:
                    if len(last_q):
                        yield placed(key, last_q, below, last)
                    key, below, last_q, last = told, w[s], last_q[:0], last[:0]
                    s += 1
                qs, own = np.r_[last_q, q[s:e]], np.concatenate([last, w[s:e]])
                if not len(qs):
                    continue
                first = _starts(qs)
                qs, own = qs[first], np.add.reduceat(own, first, axis=0)
                if len(qs) > 1:
                    yield placed(key, qs[:-1], below, own[:-1])
                    below = below + own[:-1].sum(axis=0)
                last_q, last = qs[-1:], own[-1:]
        if len(last_q):
            yield placed(key, last_q, below, last)

    return sorted_rows.mapInArrow(run, "part long, field long, q long, r array<int>")


def products(rows: DataFrame, fields: int, width: int) -> DataFrame:
    """(rep, s_0_0, s_0_1, ...): of each replicate the sums of products of the places of two fields, r0, r1, ..."""
    pairs = [(a, b) for a in range(fields) for b in range(a, fields)]
    names = ["rep", *[f"s_{a}_{b}" for a, b in pairs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _HELD):
                some = batch.slice(at, _HELD)
                part, w = _numbers(some, "part"), _vectors(some, "w", width)
                places = [_vectors(some, f"r{f}", width).astype(np.float64) for f in range(fields)]
                for p in np.unique(part).tolist():
                    mine = part == p
                    own = sums.setdefault(p, np.zeros((len(pairs), width)))
                    drawn_places = [w[mine] * x[mine] for x in places]
                    for k, (a, b) in enumerate(pairs):
                        own[k] += np.einsum("ij,ij->j", drawn_places[a], places[b][mine])
        for p, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(p * width + 1 + np.arange(width)), *[pa.array(x) for x in own]], names)

    found = rows.select("part", "w", *[f"r{f}" for f in range(fields)]).mapInArrow(run, "rep long, " + ", ".join(f"{c} double" for c in names[1:]))
    return found.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names[1:]])


def rhos(spark, units: DataFrame, n: int, fields: list[str], replicates: int, seed: int) -> DataFrame:
    """(service_a, service_b, rep, rho) of n units (i from 0, the rank of each field among all units); null without variance."""
    width = max(1, -(-replicates // max(1, -(-replicates // WIDTH))))
    names = [f"q{f}" for f in range(len(fields))]
    # Ranks are halves, so doubled they are whole numbers from 2 to 2 n.
    doubled = units.select("i", *[(2 * F.col(c)).cast("long").alias(q) for c, q in zip(fields, names, strict=True)])
    weighted = stored(weights(drawn(spark, n, replicates, width, seed), n, width).join(doubled, "i").drop("i"))
    offsets = before(summed(weighted, names, width, 2 * BLOCK))
    places = stored(ranked(summed(weighted, names, width, 1), offsets, n, width))
    rows = weighted
    for f, q in enumerate(names):
        rows = rows.join(places.where(F.col("field") == f).select("part", F.col("q").alias(q), F.col("r").alias(f"r{f}")), ["part", q])
    sums = products(rows, len(fields), width).where(F.col("rep") <= replicates)
    rho = lambda a, b: F.when((F.col(f"s_{a}_{a}") > 0) & (F.col(f"s_{b}_{b}") > 0), F.col(f"s_{a}_{b}") / (F.sqrt(f"s_{a}_{a}") * F.sqrt(f"s_{b}_{b}")))
    pairs = [F.struct(F.lit(fields[a]).alias("service_a"), F.lit(fields[b]).alias("service_b"), rho(a, b).alias("rho")) for a, b in combinations(range(len(fields)), 2)]
    return sums.select("rep", F.inline(F.array(*pairs))).select("service_a", "service_b", "rep", "rho")
