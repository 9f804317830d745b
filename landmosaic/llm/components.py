"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def contracted(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of these edges: each node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst, moved) contracted in chunks, of which each row tells whether any edge of its chunk moved."""
    parts, size = [], 0

    def done() -> pa.RecordBatch:
        src, dst, moved = (np.concatenate(x) for x in zip(*parts, strict=True))
        leaves, roots = contracted(src, dst)
        return pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(roots), pa.array(np.full(len(leaves), moved.any()))], ["src", "dst", "moved"])

    for batch in batches:
        if batch.num_rows:
            parts.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            size += batch.num_rows
        if size >= CHUNK:
            yield done()
            parts, size = [], 0
    if size:
        yield done()


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, moved) contracted by the tasks and checkpointed."""
    return cut(edges.where("src <> dst").mapInArrow(_contract, "src long, dst long, moved boolean"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it reaches.

    A round is two shuffles, whatever the edges: large-star sends a node's greater neighbours to the least that it
    knows, small-star its lesser ones. Tasks contract what they hold before and after, so that copies of an edge and
    long lists of one node shrink before they are shuffled, and few rounds are needed. The edges are stars when a
    round moves none. Loops and repeated edges do no harm; nulls are left out. The edges that a node still has are
    sorted in one task, which spills: the smallest node of a large component has one for each member.
    """
    now = _stars(edges.select(F.greatest(a, b).cast("long").alias("src"), F.least(a, b).cast("long").alias("dst"), F.lit(True).alias("moved"), (F.col(a) != F.col(b)).alias("told")).where("told").drop("told"))
    moved = bool(now.take(1))
    while moved:
        none = F.lit(None).cast("long")
        either = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("low"), none.alias("high")), F.struct(F.col("dst").alias("node"), none.alias("low"), F.col("src").alias("high")))
        ends = now.select(F.explode(either).alias("end")).select("end.*").withColumn("m", F.min("low").over(Window.partitionBy("node")))
        large = ends.where("high IS NOT NULL").select(F.col("high").alias("src"), F.coalesce("m", "node").alias("dst"), F.col("m").isNotNull().alias("moved"))
        # Dealt by src, edges are made distinct and their minima found without another shuffle.
        once = large.repartition("src").groupBy("src", "dst").agg(F.max("moved").alias("moved"))
        small = once.withColumn("m", F.min("dst").over(Window.partitionBy("src"))).withColumn("moved", F.col("moved") | (F.col("dst") != F.col("m")))
        both = F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))
        now = _stars(small.select(F.explode(both).alias("edge"), "moved").select("edge.*", "moved"))
        moved = bool(now.where("moved").take(1))
    told = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("root")), F.struct(F.col("dst").alias("node"), F.col("dst").alias("root"))))
    return now.select(told.alias("told")).select("told.*").groupBy("node").agg(F.min("root").alias("root"))
