"""Packing: concatenate and cut.

Pass one encodes every document once, into a table in the shared folder that also
holds each document's place within its partition.  Prefix sums over the
partitions' token totals then give every document its place in one endless
stream.  Pass two cuts the stream into windows of ``width`` tokens and writes a
record for every piece of a document between two boundaries.  No pass shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._shared import cut, slices
from glosswright.llm.bpe import crc32, vocabulary


def encoded_stream(docs: DataFrame, path: str, end_id: int, doc: str, text: str) -> DataFrame:
    """(part, begin, doc, n, ids): ids as little-endian uint32 with ``end_id`` after each document."""

    def run(batches):
        v, at = vocabulary(path), 0
        part = TaskContext.get().partitionId()
        for b in slices(batches):
            ids = [x.tobytes() + np.uint32(end_id).tobytes() for x in v.encode_batch(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(begin), b.column(0), pa.array(n), pa.array([_narrow(x) for x in ids], pa.binary())],
                names=["part", "begin", "doc", "n", "ids"],
            )

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "part int, begin long, doc long, n long, ids binary"
    )


def _narrow(raw: bytes) -> bytes:
    """uint16 where every id fits (told by the length, 2 n instead of 4 n)."""
    x = np.frombuffer(raw, "<u4")
    return x.astype("<u2").tobytes() if int(x.max()) < 1 << 16 else raw


def pack(docs: DataFrame, path: str, width: int = 2048, end_id: int = 1, doc: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per piece: doc, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset; without ``ids`` that column stays away.

    Every token lies in exactly one piece; all sequences but the last are full,
    so no padding is needed but there.  A null or empty text is its ``end_id``
    alone.  Repeated rows and null ids are documents of their own; an empty table
    gives no pieces.
    """
    stream = cut(encoded_stream(docs, path, end_id, doc, text))
    totals = {r["part"]: r["n"] for r in stream.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number a partition
    base, at = {}, 0
    for p in sorted(totals):
        base[p] = at
        at += totals[p]
    begins = docs.sparkSession.sparkContext.broadcast(base)
    fields = [(doc, "long"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    keep = [k for k, (name, _) in enumerate(fields) if ids or name != "ids"]

    def run(batches):
        for batch in batches:
            for b in (batch.slice(a, 512) for a in range(0, batch.num_rows, 512)):
                out: list[tuple] = []
                for p, g, d, m, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                    x = np.frombuffer(raw, "<u2" if len(raw) == 2 * m else "<u4")
                    g += begins.value[p]
                    a = 0
                    while a < m:
                        k = min(m - a, width - (g + a) % width)
                        piece = x[a : a + k].astype("<u4")
                        out.append((d, a, k, piece.tobytes(), crc32(piece), m, (g + a) // width, (g + a) % width))
                        a += k
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[k], pa.binary() if fields[k][1] == "binary" else pa.int64()) for k in keep], names=[fields[k][0] for k in keep]
                )

    return stream.mapInArrow(run, ", ".join(f"`{fields[k][0]}` {fields[k][1]}" for k in keep))
