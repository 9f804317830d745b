"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups that one task places; more buckets come with more rows, up to MOST_BUCKETS.
GROUPS_PER_BUCKET = 2048
MOST_BUCKETS = 4096
ROWS_PER_RUN = 1024
MOST_RUNS = 4096


def lpt(sizes, shards: int) -> tuple[list[int], list[int]]:
    """The shard of each size, given in falling order, and the load of each shard; ties go to the smaller shard."""
    heap = [(0, k) for k in range(shards)]
    loads = [0] * shards
    out = []
    for size in sizes:
        load, k = heapq.heappop(heap)
        out.append(k)
        loads[k] = load + size
        heapq.heappush(heap, (loads[k], k))
    return out, loads


def lpt_groups(groups: DataFrame, shards: int, rows: int) -> DataFrame:
    """(key, size) of groups to (key, shard).

    Each bucket of groups is placed into `shards` bins by LPT in one task; the bins, at most
    MOST_BUCKETS * shards whatever the input, are then placed into the shards by LPT. With one
    bucket this is LPT itself.
    """
    buckets = max(1, min(MOST_BUCKETS, -(-rows // GROUPS_PER_BUCKET)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        bins, loads = lpt(pdf["size"].tolist(), shards)
        return pd.DataFrame({"key": pdf["key"], "bucket": pdf["bucket"], "bin": bins, "load": [loads[b] for b in bins]})

    def place_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["load", "bucket", "bin"], ascending=[False, True, True], ignore_index=True)
        return pdf[["bucket", "bin"]].assign(shard=lpt(pdf["load"].tolist(), shards)[0])

    local = groups.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(place, "key string, bucket int, bin int, load long")
    bins = local.groupBy("bucket", "bin").agg(F.max("load").alias("load"))
    placed = bins.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(place_bins, "bucket int, bin int, shard int")
    return local.join(F.broadcast(placed), ["bucket", "bin"]).select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row; rows of equal text stay together.

    Law: `bytes`, so loads are near equal as far as whole groups allow. A row's size is the UTF-8
    bytes of its text plus 1; a null text has none and goes with the empty texts. Repeated rows and
    repeated or null ids keep one output row each. Columns other than the two named are not read.
    An empty table gives no rows. Slots count from 0 within a shard without gaps.

    Slots come from runs: a shard's rows are dealt to hashed runs, the runs' sizes (at most
    shards * MOST_RUNS numbers) are summed up, and only rows of one run are numbered together, so
    no task holds a shard.
    """
    rows = docs.count()
    runs = max(16, min(MOST_RUNS, -(-rows // (shards * ROWS_PER_RUN))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run"),
    )
    groups = base.groupBy("key").agg(F.sum("size").alias("size"))
    placed = base.join(lpt_groups(groups, shards, rows).withColumnRenamed("key", "group_key"), F.col("key") == F.col("group_key")).drop("group_key")
    counts = placed.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "key")
    return placed.join(F.broadcast(starts), ["shard", "run"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
