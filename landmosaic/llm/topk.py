"""Exact top-k inner products by MaxScore over shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, and queries that travel together.
SHARD_ROWS = 32768
BLOCK_ROWS = 1024
#: Terms traversed between looks at what is still competitive, and the part of a query's square that may be left at the first look.
STEP = 8
LOOK = 0.4
#: Part of the docs that may still be in the race when the rest is probed doc by doc.
PROBE = 0.4


def integer_vector(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null or non-finite one."""
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Shard:
    """A shard of docs: postings by component, and the docs themselves for probing."""

    def __init__(self, docs: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.docs = ids[order], np.ascontiguousarray(docs[order])
        self.postings = []
        for column in self.docs.T:
            at = np.flatnonzero(column)
            # A posting of most docs is kept as a column, without places.
            self.postings.append((None, np.ascontiguousarray(column)) if 2 * len(at) > len(column) else (at, np.ascontiguousarray(column[at])))
        self.squares = (self.docs.astype(float) ** 2).sum(axis=1)
        #: Postings read so far, traversed or probed.
        self.read = 0
        self.low, self.high = (f(self.docs, axis=0, initial=0) for f in (np.min, np.max)) if len(docs) else (np.zeros(docs.shape[1]),) * 2

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best docs for one query, but for those of its own id; ties to smaller ids.

        A term is a component with a weight in the query, its bound the most that any doc can gain by
        it. Terms are taken in falling order of their bounds. Those before the point from which all
        others can't lift a doc to the k-th best score known are essential: their postings are
        traversed. The others are only probed for docs that can still reach that score. What all
        others can lift a doc by is bounded twice: by the sum of their bounds, and for each doc by
        the product of the lengths of what is left of the query and of the doc.
        """
        gain = np.maximum(query * self.low, query * self.high)
        terms = np.argsort(-gain, kind="stable")
        terms = terms[query[terms] != 0]
        bound = gain[terms].sum() - np.cumsum(gain[terms])
        whole_square = left_square = float((query.astype(float) ** 2).sum())
        left = self.squares.copy()
        score = np.zeros(len(self.docs), self.docs.dtype)
        out = slice(*np.searchsorted(self.ids, [own, own + 1]))
        score[out] = none = -np.inf if score.dtype.kind == "f" else np.iinfo(score.dtype).min // 4
        known = none
        for n, t in enumerate(terms.tolist()):
            at, values = self.postings[t]
            weight = query[t]
            left_square -= float(weight) ** 2
            self.read += len(values)
            square = np.square(values if values.dtype.kind == "f" else values.astype(float))
            if at is None:
                score += weight * values
                left -= square
            else:
                score[at] += weight * values
                left[at] -= square
            score[out] = none
            if (n + 1) % STEP or n + 1 == len(terms) or len(score) <= k or left_square > LOOK * whole_square:
                continue
            # The docs that lead now, scored whole, give a score to reach.
            lead = np.argpartition(score, len(score) - k)[len(score) - k :]
            whole = np.where(score[lead] > none, self.docs[lead] @ query, none)
            known = max(known, whole.min())
            # What rounding may have lost of the squares is added.
            reach = np.sqrt(max(left_square, 0.0) * (np.maximum(left, 0.0) + 1e-6 * self.squares)) * (1 + 1e-9)
            alive = np.flatnonzero(score >= known - np.minimum(reach, float(bound[n])))
            if len(alive) <= max(k, PROBE * len(score)):
                rest = terms[n + 1 :]
                self.read += len(alive) * len(rest)
                found = score[alive] + self.docs[np.ix_(alive, rest)] @ query[rest]
                return self._first(alive, found, none, k)
        return self._first(np.arange(len(score)), score, none, k)

    def _first(self, at: np.ndarray, score: np.ndarray, none, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, score = at[score > none], score[score > none]
        if len(score) > k:
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[enough], score[enough]
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[order]], score[order]


def _matrix(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """As floating-point numbers, if every sum of products of theirs is exact in them."""
    most = float(np.prod([float(np.abs(x).max(initial=0)) for x in parts])) * max(x.shape[1] for x in parts)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64
    return [x.astype(kind) for x in parts]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each query row by integer inner product.

    Rows whose vector is null or holds a null or non-finite component take no part; neither do rows
    with a null id. Vectors of unlike lengths count as filled up with zeros. Repeated rows are
    candidates each for itself, but none with the query's id is; a repeated query is one query of each
    of its vectors, whose answers are merged by id. Empty tables give no rows. Other columns are not read.

    Every row moves once, to the shard that its hash names. Queries are compressed in blocks of bounded
    size, and only these blocks are copied to all shards; each shard's k best are merged by query.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(vector_col).alias("v"), is_query.alias("q")).where("v IS NOT NULL AND id IS NOT NULL")
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    docs = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "id", "v")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["v"].map(len).max())
        x = _matrix(pdf["v"].tolist(), size)
        kind = np.int16 if np.abs(x).max(initial=0) < 2**15 else np.int64
        blob = np.array([len(x), size, kind == np.int16], "<i8").tobytes() + pdf["id"].to_numpy(np.int64).tobytes() + x.astype(kind).tobytes()
        return pd.DataFrame({"blob": [zstandard.compress(blob, 3)]})

    def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = zstandard.decompress(blob)
        count, size, short = np.frombuffer(x, "<i8", 3).tolist()
        return np.frombuffer(x, "<i8", count, 24), np.frombuffer(x, np.int16 if short else np.int64, count * size, 24 + 8 * count).reshape(count, size).astype(np.int64)

    packed = rows.where("q").select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), "id", "v").groupBy("block").applyInPandas(block, "blob binary")
    asking = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "blob")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(left):
            own, ids = _matrix(left["v"].tolist(), int(left["v"].map(len).max())), left["id"].to_numpy(np.int64)
            shard = None
            for blob in right["blob"]:
                names, queries = opened(blob)
                size = max(own.shape[1], queries.shape[1])
                x, y = _exact(*(np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (own, queries)))
                if shard is None or shard.docs.dtype != x.dtype or shard.docs.shape[1] != size:
                    shard = Shard(x, ids)
                for name, query in zip(names.tolist(), y, strict=True):
                    near, scores = shard.best(query, name, k)
                    found["query_id"] += [name] * len(near)
                    found["vec_id"] += near.tolist()
                    found["score"] += [int(s) for s in scores]
        return pd.DataFrame(found, dtype="int64")

    met = docs.groupBy("shard").cogroup(asking.groupBy("shard")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM met
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
