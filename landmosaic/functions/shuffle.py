"""Keyed permutations of 0 to n - 1 as a formula: where a place goes in a replicate is told without sorting or numbering.

A place is a pair of digits to the bases a and b, the smallest whole numbers from the square root of n
on whose product is n or more. Eight half-rounds of a Feistel network each add to one digit a number made
of the other one, of the replicate and of the seed; that is one-to-one on all a times b pairs. What falls
on a pair beyond n goes on from there until it falls below n, so it is one-to-one on 0 to n - 1.
All numbers stay below 2^63, so any engine with whole numbers of 64 bits gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = 2_147_483_647
HALF_ROUNDS = 8
#: Rows of one batch that a task makes.
_ROWS = 1 << 18


def _number(digit: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """What a half-round adds, before it is taken to its base: two squarings make it depend on all in no plain way."""
    x = (digit * 7919 + key + k * 1_299_709) % _P
    y = (x * x + key) % _P
    return (y * y + x) % _P // 8


def permuted(place: np.ndarray, n: int, replicate: np.ndarray, seed: int) -> np.ndarray:
    """Where each place goes in each replicate; both arrays have one shape."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    key = (replicate * 7_368_787 + seed) % _P
    out = place.astype(np.int64)
    todo = np.arange(out.size)
    while len(todo):
        left, right = out.flat[todo] // b, out.flat[todo] % b
        for k in range(HALF_ROUNDS):
            if k % 2 == 0:
                left = (left + _number(right, key.flat[todo], k)) % a
            else:
                right = (right + _number(left, key.flat[todo], k)) % b
        out.flat[todo] = left * b + right
        todo = todo[out.flat[todo] >= n]
    return out


def sql(rows: str, seed: int) -> str:
    """One go through the network as SQL: a SELECT of (rep, i, n, v) from such `rows`, v taken to where it goes; what is n or more goes again."""
    out = f"SELECT rep, i, n, v // b AS l, v % b AS r, a, b, (rep * 7368787 + {seed}) % {_P} AS key FROM (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM {rows}))"
    for k in range(HALF_ROUNDS):
        side, other, base = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        out = f"SELECT *, ({other} * 7919 + key + {k * 1_299_709}) % {_P} AS x FROM ({out})"
        out = f"SELECT *, (x * x + key) % {_P} AS y FROM ({out})"
        out = f"SELECT * EXCLUDE (x, y) REPLACE (({side} + (y * y + x) % {_P} // 8) % {base} AS {side}) FROM ({out})"
    return f"SELECT rep, i, n, l * b + r AS v FROM ({out})"


def replicated(rows: DataFrame, replicates: range, seed: int) -> DataFrame:
    """Rows (i, n, ...) once for each replicate, with `rep` and `j`, where place i of n goes in it; in replicate 0 it stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.array(replicates, np.int64)
        for batch in batches:
            i, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("i", "n"))
            step = max(1, _ROWS // max(1, len(i)))
            for at in range(0, len(told) if len(i) else 0, step):
                reps = told[at : at + step]
                place, rep = np.tile(i, len(reps)), np.repeat(reps, len(i))
                j = np.where(rep == 0, place, permuted(place, int(n[0]), rep, seed))
                copied = [c.take(pa.array(np.tile(np.arange(len(i)), len(reps)))) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*copied, pa.array(rep), pa.array(j)], [*batch.schema.names, "rep", "j"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{given}, rep long, j long")


def placed(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """`numbered` rows (i from 1) with i from 0 and n, their number."""
    return numbered.withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
