"""What the operators of this subpackage share: batching, lineage cuts, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.session import shared_folder

#: Bytes of text that a Python worker holds decoded at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about SLICE_BYTES in column ``text``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def cut(df: DataFrame, slim: bool = False) -> DataFrame:
    """Cuts lineage through the cluster's shared checkpoint folder.

    ``slim`` tables, narrow and computed cheaply, go to an eighth as many files as
    there are shuffle partitions: opening and committing files is most of their cost.
    """
    spark = df.sparkSession
    shared_folder(spark)
    release(spark)
    if slim:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files that no live DataFrame refers to.

    They stay until the driver's JVM happens to collect what refers to them; where
    lineages have been cut these are gigabytes, so the driver is asked to do it now.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()  # what toPandas and toArrow left with the driver
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)  # and what fitting a model on a sample did
    spark.sparkContext._jvm.System.gc()


def row_key(doc: str, text: str) -> list[Column]:
    """(``_id``, ``_tag``): which row this is, without a unique id being given.

    A null id counts as the largest.  ``_tag``, the text's 64-bit hash, tells rows
    apart that repeat an id (or have none) with another text; equal rows are one
    document.
    """
    return [
        F.coalesce(F.col(doc).cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tag"),
    ]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        high = np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from every node with an edge.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014) over
    a distributed edge table: each round re-hangs neighbours on the least node
    around, so the table never outgrows the input, and O(log n) rounds suffice.
    Each round is cut through the checkpoint folder.  Self loops and nulls are
    ignored; repeated edges are one.  An empty table gives an empty table.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = cut(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), slim=True)
    # joined on another key than grouped by, so that the join may split a hot node
    key = F.bitwise_not("u").alias("key")
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(key, F.least("u", "m").alias("m"))
        large = both.select("u", "v", key).join(near, "key").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("v", key).join(least.select(key, "m"), "key")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), slim=True)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct()
            )
        seen = now
