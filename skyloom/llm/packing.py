"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are cut into pieces of at most ``capacity``. These are dealt over shards of about ``shard_rows`` pieces by a hash
of what they are and of the number among equal ones, so that the packing does not depend on how the table is partitioned
and no source or text fills a shard. Each shard is packed by itself
(with ``shard_rows=None`` all in one, exactly, in one task; README has what sharding costs): longest piece first, into the bin with the smallest residual that is large enough and has no conflict. Bins are kept in
order of residual; the search starts at the tightest and goes on to its successors until one is compatible, and a new bin
is opened only after the last one. Bitmaps of a bin say which sources and which duplicate clusters it holds: a cluster may
stand in a bin once, a source ``per_source`` times (one bitmap for each time).

Defined cases: a document of length 0 or null has one row with no bin; a null source is a source of its own; a null
cluster conflicts with nothing; repeated rows are packed as often as they occur; ties in length go by doc_id and piece;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .mixing import word_count
from .storage import saved


def best_fit(length: Iterable[int], source: Iterable[int], cluster: Iterable[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """(bin, start) of each piece, taken in the order given; source and cluster are small numbers, -1 for no conflict."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[list[int]] = []
    clusters: list[int] = []
    bins, starts = [], []
    for n, s, c in zip(length, source, cluster, strict=True):
        s_bit, c_bit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        k = bisect_left(order, (n, -1))
        while k < len(order) and (clusters[b := order[k][1]] & c_bit or sources[b][-1] & s_bit):
            k += 1
        if k < len(order):
            left, b = order.pop(k)
        else:
            left, b = capacity, len(sources)
            sources.append([0] * per_source)
            clusters.append(0)
        for i, m in enumerate(sources[b]):
            if not m & s_bit:
                sources[b][i] = m | s_bit
                break
        clusters[b] |= c_bit
        bins.append(b)
        starts.append(capacity - left)
        if left > n:
            insort(order, (left - n, b))
    return bins, starts


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, length, source, cluster) from (doc_id, length, source, cluster)."""
    full = F.expr(f"cast(length div {capacity} as int)")
    rest = F.pmod(F.col("length"), F.lit(capacity))
    cut = F.concat(F.array_repeat(F.lit(capacity).cast("long"), full), F.when((rest > 0) | (full == 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    return docs.select("doc_id", "source", "cluster", F.posexplode(cut).alias("piece", "length"))


def packed(docs: DataFrame, capacity: int = 2048, per_source: int = 2, shard_rows: int | None = 8192) -> DataFrame:
    """(doc_id, piece, length, bin, start) for (doc_id, length, source, cluster)."""
    docs = docs.select("doc_id", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("length"), "source", "cluster")
    same = ("doc_id", "piece", "length", "source", "cluster")
    # Rows that are equal in all of these are interchangeable, so their numbers depend on nothing else.
    every = saved(pieces(docs, capacity).withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0)))), "pieces")
    shards = 1 if shard_rows is None else max(1, -(-every.count() // shard_rows))
    every = every.withColumn("shard", F.pmod(F.xxhash64(*same, "copy"), F.lit(shards)))
    empty = every.where("length = 0").select("doc_id", "piece", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("start"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(named=frame["source"].astype("object").fillna("").astype(str))
        frame = frame.sort_values(["length", "doc_id", "piece", "cluster", "named", "copy"], ascending=[False, True, True, True, True, True])
        whole, frame = frame[frame["length"] == capacity], frame[frame["length"] < capacity]
        source, _ = pd.factorize(frame["source"], use_na_sentinel=False)
        cluster, _ = pd.factorize(frame["cluster"])
        # A cluster of one piece conflicts with nothing.
        often = np.flatnonzero(np.bincount(cluster[cluster >= 0], minlength=1) > 1)
        number = np.full(cluster.max(initial=0) + 2, -1)
        number[often] = np.arange(len(often))
        bins, starts = best_fit(frame["length"].tolist(), source.tolist(), number[cluster].tolist(), capacity, per_source)
        first = max(bins, default=-1) + 1  # full pieces are bins of their own, after the others
        out = pd.concat([frame.assign(bin=bins, start=starts), whole.assign(bin=np.arange(first, first + len(whole)), start=0)])
        return out[["doc_id", "piece", "length"]].assign(bin=out["shard"].to_numpy() * (1 << 32) + out["bin"].to_numpy(np.int64), start=out["start"].to_numpy(np.int64))

    return every.where("length > 0").groupBy("shard").applyInPandas(pack, "doc_id long, piece int, length long, bin long, start long").unionByName(empty)


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    """Packs (doc_id, source, text) by words; documents of equal text are a cluster."""
    return packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("length"), F.xxhash64("text").alias("cluster")), **options)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
