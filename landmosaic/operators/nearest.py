"""The k nearest known cells of each cell, by k-d partitions of the known ones.

Known cells are dealt to the leaves of a k-d tree, whose cuts come from a bounded sample and whose
boxes are exact. Cells are taken by blocks. Whatever lies in a block has k known cells within the
farthest corner of boxes that hold k together; a leaf, and within it a bucket of few known cells, is
sent to a block only if its box is nearer than that. In a block each cell looks at buckets in order
of their distance and stops at those beyond its k-th found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .change import CELL
from .ordering import cut

LEAF_POINTS = 4096
#: Leaves of the tree; their boxes are all that goes to every task.
MOST_LEAVES = 4096
SAMPLED_PER_LEAF = 16
BUCKET = 16
#: Sides of the squares of cells that are searched for in one task, and at once.
BLOCK, PATCH = 64, 8
#: Blocks that one task tests against a leaf.
BLOCKS_PER_TASK = 4096
_BOX = ["r0", "r1", "c0", "c1"]


class Cuts:
    """A complete tree of medians of sampled points, by the axis along which the points of a node spread most."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, (leaves - 1).bit_length())
        self.axis, self.at = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        parts = [points]
        for level in range(self.depth):
            halves = []
            for k, part in enumerate(parts):
                node = (1 << level) - 1 + k
                if len(part):
                    self.axis[node] = int(np.argmax(np.ptp(part, axis=0)))
                    self.at[node] = float(np.median(part[:, self.axis[node]]))
                left = part[:, self.axis[node]] <= self.at[node]
                halves += [part[left], part[~left]]
            parts = halves

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)


def _lower(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squares of the least distances between one box (row from, to, column from, to), or many in rows, and boxes."""
    b = box[..., None]
    dr = np.maximum(np.maximum(boxes[:, 0] - b[..., 1, :], b[..., 0, :] - boxes[:, 1]), 0)
    dc = np.maximum(np.maximum(boxes[:, 2] - b[..., 3, :], b[..., 2, :] - boxes[:, 3]), 0)
    return dr * dr + dc * dc


def _within(box: np.ndarray, boxes: np.ndarray, counts: np.ndarray, k: int) -> int:
    """The square of a distance within which every point of the box has k of the counted points; -1 if there are fewer."""
    dr = np.maximum(boxes[:, 1] - box[0], box[1] - boxes[:, 0])
    dc = np.maximum(boxes[:, 3] - box[2], box[3] - boxes[:, 2])
    far = dr * dr + dc * dc
    order = np.argsort(far)
    upto = np.searchsorted(np.cumsum(counts[order]), k)
    return int(far[order[upto]]) if upto < len(order) else -1


class Buckets:
    """Points sorted into strips of rows and, in each, into runs of columns: BUCKET points each, with exact boxes."""

    def __init__(self, points: np.ndarray):
        order = np.lexsort((points[:, 1], points[:, 0]))
        strips = max(1, int(np.sqrt(len(points) / BUCKET)))
        strip = np.empty(len(points), np.int64)
        strip[order] = np.arange(len(points)) * strips // max(1, len(points))
        self.order = np.lexsort((points[:, 0], points[:, 1], strip))
        nth = np.arange(len(points))
        first = np.searchsorted(strip[self.order], strip[self.order])
        self.start = np.flatnonzero((nth - first) % BUCKET == 0)
        self.count = np.diff(np.r_[self.start, len(points)])
        p = points[self.order]
        self.boxes = np.stack([f.reduceat(p[:, axis], self.start) for axis in (0, 1) for f in (np.minimum, np.maximum)], axis=1) if len(p) else np.zeros((0, 4), np.int64)

    def members(self, chosen: np.ndarray) -> np.ndarray:
        n = self.count[chosen]
        return self.order[np.repeat(self.start[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def search(cells: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(squares of distances, places in `points`, pairs looked at): of each cell's k nearest points, or all if there are fewer.

    Ties go by the points' order; -1 is the place where there is none.
    """
    buckets = Buckets(points)
    size = len(points)
    far = np.iinfo(np.int64).max
    squares, places = np.full((len(cells), k), -1), np.full((len(cells), k), -1)
    looked = 0
    patch = (cells[:, 0] // PATCH, cells[:, 1] // PATCH)
    order = np.lexsort((patch[1], patch[0]))
    new = np.flatnonzero((np.diff(patch[0][order], prepend=patch[0][order[:1]] - 1) != 0) | (np.diff(patch[1][order], prepend=0) != 0))
    for mine in np.split(order, new[1:]) if size and len(cells) else []:
        own = cells[mine]
        box = np.array([own[:, 0].min(), own[:, 0].max(), own[:, 1].min(), own[:, 1].max()])
        low = _lower(box, buckets.boxes)
        within = _within(box, buckets.boxes, buckets.count, k)
        left = np.flatnonzero(low <= within) if within >= 0 else np.arange(len(low))
        left = left[np.argsort(low[left], kind="stable")]
        at = np.stack([own[:, 0], own[:, 0], own[:, 1], own[:, 1]], axis=1)
        # Squares count from the least possible here, so that one number holds them and the point's place.
        base = low.min()
        best, take = np.full((len(own), k), far), 4
        while len(left):
            found = buckets.members(left[:take])
            left, take = left[take:], 2 * take
            dr, dc = own[:, :1] - points[found, 0], own[:, 1:] - points[found, 1]
            looked += dr.size
            best = np.partition(np.concatenate([best, (dr * dr + dc * dc - base) * size + found], axis=1), k - 1, axis=1)[:, :k]
            limit = best.max(axis=1) // size + base
            if len(left):
                left = left[(_lower(at, buckets.boxes[left]) <= limit[:, None]).any(axis=0)]
        best = np.sort(best, axis=1)
        squares[mine] = np.where(best < far, best // size + base, -1)
        places[mine] = np.where(best < far, best % size, -1)
    return squares, places, looked


def _met(known: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(br, bc, kr, kc, kv): for each block of cells the known cells that may be among the k nearest of any in it."""
    spark = known.sparkSession
    n = known.count()
    leaves = max(1, min(MOST_LEAVES, -(-n // LEAF_POINTS)))
    share = min(1.0, SAMPLED_PER_LEAF * leaves / max(1, n))
    sampled = known.where(F.pmod(F.xxhash64("kr", "kc"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("kr", "kc").toArrow()
    tree = Cuts(np.stack([sampled.column(c).to_numpy() for c in ("kr", "kc")], axis=1).reshape(-1, 2), leaves)

    def place(batches):
        for b in batches:
            points = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(points))], ["kr", "kc", "kv", "leaf"])

    points = cut(known.mapInArrow(place, f"kr long, kc long, kv {known.schema['kv'].dataType.simpleString()}, leaf long"))
    told = points.groupBy("leaf").agg(F.min("kr").alias("r0"), F.max("kr").alias("r1"), F.min("kc").alias("c0"), F.max("kc").alias("c1"), F.count("*").alias("n")).toArrow()
    boxes = np.stack([told.column(c).to_numpy() for c in _BOX], axis=1).reshape(-1, 4)
    counts, names = told.column("n").to_numpy(), told.column("leaf").to_numpy()
    at = spark.sparkContext.broadcast((boxes, counts, names))

    def need(batches):
        boxes, counts, names = at.value
        for b in batches:
            rows = []
            for k_block, box in enumerate(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(2, 6)], axis=1)):
                low, within = _lower(box, boxes), _within(box, boxes, counts, k)
                rows += [(k_block, names[j], low[j], within) for j in np.flatnonzero((low <= within) | (within < 0))]
            which, leaf, low, within = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4))
            yield pa.RecordBatch.from_arrays([*(c.take(which) for c in b.columns), leaf, low, within], ["br", "bc", *_BOX, "leaf", "low", "within"])

    blocks = _blocked(cells).groupBy("br", "bc").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    asked = cut(blocks.mapInArrow(need, "br long, bc long, r0 long, r1 long, c0 long, c1 long, leaf long, low long, within long"))
    # A leaf that many blocks ask for is copied, for so many blocks each.
    copies = asked.groupBy(F.col("leaf").alias("of")).agg(F.ceil(F.count("*") / BLOCKS_PER_TASK).alias("copies"))

    def dealt(asked: DataFrame):
        one = asked.join(copies, F.col("leaf") == F.col("of")).withColumn("copy", F.pmod(F.xxhash64("br", "bc"), F.col("copies"))).drop("of", "copies")
        two = points.join(copies, F.col("leaf") == F.col("of")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("of", "copies")
        return one.groupBy("leaf", "copy").cogroup(two.groupBy("leaf", "copy"))

    def closer(asked: pa.Table, points: pa.Table) -> pa.Table:
        found = Buckets(np.stack([points.column(c).to_numpy() for c in ("kr", "kc")], axis=1))
        within = [_within(box, found.boxes, found.count, k) for box in np.stack([asked.column(c).to_numpy() for c in _BOX], axis=1)]
        return pa.table({"br": asked.column("br"), "bc": asked.column("bc"), "close": pa.array(within, pa.int64())})

    def send(asked: pa.Table, points: pa.Table) -> pa.Table:
        found = Buckets(np.stack([points.column(c).to_numpy() for c in ("kr", "kc")], axis=1))
        which, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, (*box, within) in enumerate(np.stack([asked.column(c).to_numpy() for c in (*_BOX, "within")], axis=1)):
            near = np.flatnonzero((_lower(np.array(box), found.boxes) <= within) | (within < 0))
            chosen.append(found.members(near))
            which.append(np.full(len(chosen[-1]), j))
        which, chosen = (pa.array(np.concatenate(x)) for x in (which, chosen))
        return pa.table({"br": asked.column("br").take(which), "bc": asked.column("bc").take(which), **{c: points.column(c).take(chosen) for c in ("kr", "kc", "kv")}})

    tight = dealt(asked).applyInArrow(closer, "br long, bc long, close long").where("close >= 0").groupBy(F.col("br").alias("of_br"), F.col("bc").alias("of_bc")).agg(F.min("close").alias("close"))
    closest = F.when(F.col("within") < 0, F.col("within")).otherwise(F.least("within", "close"))
    nearer = asked.join(tight, (F.col("br") == F.col("of_br")) & (F.col("bc") == F.col("of_bc")), "left").withColumn("within", closest).drop("of_br", "of_bc", "close")
    return dealt(nearer.where((F.col("low") <= F.col("within")) | (F.col("within") < 0))).applyInArrow(send, f"br long, bc long, kr long, kc long, kv {known.schema['kv'].dataType.simpleString()}")


def _blocked(cells: DataFrame) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / BLOCK)
    return cells.select(*CELL).withColumns({"br": block("row"), "bc": block("col")})


def _over_blocks(known: DataFrame, cells: DataFrame, k: int, make: Callable, schema: str) -> DataFrame:
    """What `make` says of each block's cells: from their rows and columns, squares of distances and the table of points with their places."""
    named = known.where("value IS NOT NULL").select(F.col("row").cast("long").alias("kr"), F.col("col").cast("long").alias("kc"), F.col("value").alias("kv"))

    def run(asked: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by([("kr", "ascending"), ("kc", "ascending"), ("kv", "ascending")])
        cells = np.stack([asked.column(c).to_numpy() for c in CELL], axis=1)
        d2, at, _ = search(cells, np.stack([points.column(c).to_numpy() for c in ("kr", "kc")], axis=1), k)
        return pa.table(make(cells, d2, at, points))

    return _blocked(cells).groupBy("br", "bc").cogroup(_met(named, cells, k).groupBy("br", "bc")).applyInArrow(run, schema)


def nearest_known(known: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(row, col, d2, kr, kc, kv): each cell's k nearest known cells, d2 the square of the distance in cells; ties in row order.

    Cells have fewer neighbours only if fewer are known; with none known there are no rows. Cells without
    a value aren't known. Repeated cells have rows each.
    """

    def make(cells, d2, at, points):
        which, nth = np.nonzero(at >= 0)
        found = pa.array(at[which, nth])
        return {"row": cells[which, 0], "col": cells[which, 1], "d2": d2[which, nth], **{c: points.column(c).take(found) for c in ("kr", "kc", "kv")}}

    return _over_blocks(known, cells, k, make, f"row long, col long, d2 long, kr long, kc long, kv {known.schema['value'].dataType.simpleString()}")


def inverse_distance(known: DataFrame, cells: DataFrame, power: float = 2.0, neighbours: int = 12, most: int | None = None) -> DataFrame:
    """(row, col, value) from the nearest known cells, weighed by inverse distance; a known cell keeps its own.

    With `most`, neighbours more than so many cells off don't count, and cells without any have no row.
    """

    def make(cells, d2, at, points):
        kv = np.r_[points.column("kv").to_numpy(zero_copy_only=False).astype(float), 0.0]
        far = (at < 0) if most is None else (at < 0) | (d2 > most * most)
        w = np.where(far | (d2 == 0), 0.0, np.maximum(d2, 1) ** (-power / 2))
        own = np.where((d2 == 0) & (at >= 0), kv[at], -np.inf).max(axis=1, initial=-np.inf)
        total = w.sum(axis=1)
        some = ~far.all(axis=1)
        value = np.where(np.isfinite(own), own, (w * kv[at]).sum(axis=1) / np.where(total > 0, total, 1.0))
        return {"row": cells[some, 0], "col": cells[some, 1], "value": value[some]}

    return _over_blocks(known, cells, neighbours, make, "row long, col long, value double")
