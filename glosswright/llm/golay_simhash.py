"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits.  Of two
fingerprints at most 2 bits apart, by the pigeonhole principle at least one
segment is equal, and no other segment differs in more than 2 bits.  The binary
Golay code [23,12,7] is perfect, so every 23-bit word decodes to one codeword; a
segment's keys are the codewords that the words within one bit of it decode to
(one key, or six where it lies three bits from its codeword).  Two segments at
most 2 bits apart have a word within one bit of both, hence a key in common.

So candidates share (which segment, its bits, a key of the next segment).  They
are joined on that and verified bit by bit.  Buckets with more than ``CROWD``
fingerprints are linked without pairs, and as exactly: fingerprints at most 2
bits apart have a word within one bit of both, so linking each to the least
fingerprint that is within one bit of the same word links what must be linked
and nothing else.

``candidates`` reaches 5 bits: then, of the three segments, two differ in no more than
2 bits each, so fingerprints that close share a Golay key in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.llm._shared import connected_components, cut, slices

SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 32
#: Bits up to which two fingerprints share a key in two segments.
REACH = 5
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of one text: a bit is set where over half the shingles' hashes set it."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*[w[k:] for k in range(words)]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], np.uint64)
    lanes = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[doc, "fp"])

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{doc}` long, fp long"
    )


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """For every 23-bit word, the index (12 bits) of the one codeword within 3 bits."""
    generator, codes = 0b101011100011, np.arange(4096, dtype=np.int64)
    code, rest = codes << 11, codes << 11
    for bit in range(22, 10, -1):  # remainder of the message polynomial
        rest = np.where(rest >> bit & 1, rest ^ (generator << (bit - 11)), rest)
    code = code | rest
    table = np.full(1 << 23, -1, np.int16)
    one = 1 << np.arange(23)
    errors = [0, *one, *(a | b for k, a in enumerate(one) for b in one[:k])]
    errors += [a | b | c for k, a in enumerate(one) for j, b in enumerate(one[:k]) for c in one[:j]]
    for e in errors:
        table[code ^ e] = codes
    return table


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every row's distinct codeword indices within one bit of its word."""
    table = golay_table()
    near = np.stack([table[word], *(table[word ^ (1 << k)] for k in range(23))], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    row, at = np.nonzero(fresh)
    return row, near[row, at]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of unsigned fingerprints: equal segment, shared Golay key of the next."""
    fp = fp.astype(np.uint64)
    part = [(fp >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
    rows, buckets = [], []
    for k in range(3):
        row, key = golay_keys(part[(k + 1) % 3])
        rows.append(row)
        buckets.append((k << 40) | (part[k][row] << 13) | key)
    return np.concatenate(rows), np.concatenate(buckets)


def links(prints: DataFrame, apart: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``apart`` bits."""
    if not 0 <= apart <= 2:
        raise ValueError("the keys are exact for up to 2 bits")

    def keyed(batches):
        for b in batches:
            for s in (b.slice(a, 20_000) for a in range(0, b.num_rows, 20_000)):
                fp = s.column(0).to_numpy(zero_copy_only=False)
                row, bucket = bucket_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(bucket)], names=["fp", "bucket"])

    keys = cut(prints.select("fp").distinct().mapInArrow(keyed, "fp long, bucket long"))
    big = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("bucket"), slim=True)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart
    pairs = (
        keys.join(big, "bucket", "left_anti")
        # grouped on another key than joined on, so that the join may split a large bucket
        .groupBy(F.bitwise_not("bucket").alias("bucket"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # CROWD fingerprints at most
        .where(F.size("fps") > 1)
        .select(F.posexplode("fps").alias("k", "a"), "fps")
        .select("a", F.explode(F.slice("fps", F.col("k") + 2, F.size("fps"))).alias("b"))
        .where(near)
    )
    crowd = keys.join(big, "bucket", "left_semi").select("fp").distinct()
    # whether within one bit of a word (apart 2), of each other (1), or equal (0)
    flips = [F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if k == 63 else 1 << k)) for k in range(64)]
    if apart == 2:
        around = crowd.select("fp", F.explode(F.array("fp", *flips)).alias("word"))
        least = around.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        stars = around.join(least, "word").where("fp != b").select(F.col("fp").alias("a"), "b")
    else:
        around = crowd.select("fp", F.explode(F.array(*(flips * apart), "fp")).alias("word"))
        stars = around.join(crowd.select(F.col("fp").alias("word")), "word").where("fp > word").select(F.col("fp").alias("a"), F.col("word").alias("b"))
    return pairs.union(stars).distinct()


def wide_bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of unsigned fingerprints: Golay keys shared in two of the segments."""
    fp = fp.astype(np.uint64)
    keys = []
    for s, n in SEGMENTS:
        row, key = golay_keys((fp >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1))
        wide = np.full((len(fp), 6), -1, np.int64)  # six keys at most
        wide[row, np.arange(len(row)) - np.searchsorted(row, row)] = key
        keys.append(wide)
    rows, buckets = [], []
    for k in range(3):
        a, b = keys[k][:, :, None], keys[(k + 1) % 3][:, None, :]
        both = np.where((a >= 0) & (b >= 0), k << 24 | a << 12 | b, -1).reshape(len(fp), -1)
        row, at = np.nonzero(both >= 0)
        rows.append(row)
        buckets.append(both[row, at])
    return np.concatenate(rows), np.concatenate(buckets)


def candidates(prints: DataFrame, apart: int = REACH) -> DataFrame:
    """(a, b): distinct fingerprints ``fp`` up to ``apart`` bits from each other, a linear number.

    In every bucket a fingerprint is compared with the ``CROWD`` before it, and keeps,
    of those near enough in all its buckets, the nearest and the least.  So whatever
    has another within ``apart`` bits in a bucket of up to ``CROWD`` is in a pair, but not
    all such pairs are there: who needs all must look for the others by other means.
    """
    if not 0 <= apart <= REACH:
        raise ValueError(f"the keys reach {REACH} bits")

    def keyed(batches):
        for b in batches:
            for s in (b.slice(a, 4_000) for a in range(0, b.num_rows, 4_000)):
                fp = s.column(0).to_numpy(zero_copy_only=False)
                row, bucket = wide_bucket_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(bucket.astype(np.int32))], names=["fp", "bucket"])

    def met(batches):
        fp, bucket = np.empty(0, np.int64), np.empty(0, np.int32)
        for batch in batches:
            old = len(fp)
            fp = np.concatenate([fp, batch.column(0).to_numpy()])
            bucket = np.concatenate([bucket, batch.column(1).to_numpy()])
            bits, near, least = np.full(len(fp), 65, np.uint8), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
            for k in range(1, min(CROWD, len(fp) - 1) + 1):
                at = np.flatnonzero(bucket[k:] == bucket[:-k]) + k
                if not len(at):
                    break
                at = at[at >= old]
                d = np.bitwise_count((fp[at] ^ fp[at - k]).view(np.uint64))
                at, d = at[d <= apart], d[d <= apart]
                least[at] = fp[at - k]  # rows come in order, so the last is the least
                at, d = at[d < bits[at]], d[d < bits[at]]
                bits[at], near[at] = d, fp[at - k]
            hit = np.flatnonzero(bits <= apart)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (fp[hit], near[hit], bits[hit].astype(np.int32), least[hit])], names=["a", "near", "bits", "least"]
            )
            fp, bucket = fp[-CROWD:], bucket[-CROWD:]

    keys = prints.select("fp").distinct().mapInArrow(keyed, "fp long, bucket int")
    found = keys.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(met, "a long, near long, bits int, least long")
    best = found.groupBy("a").agg(F.min(F.struct("bits", "near")).alias("best"), F.min("least").alias("least"))
    return best.select("a", F.explode(F.array_distinct(F.array("best.near", "least"))).alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, apart: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp, component): component is the smallest id reachable over links.

    Fingerprints link at ``apart`` or fewer differing bits.  Null, empty and blank
    texts have fingerprint 0 and link like any other.  Rows that repeat an id are
    nodes of their own with that id.  A row with a null id takes part; its
    component is the smallest id that isn't null, null if there is none.
    An empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, words, doc, text).select(F.col(doc).alias("_doc"), "fp"))
    groups = prints.groupBy("fp").agg(F.min("_doc").alias("least"))
    parts = connected_components(links(groups, apart), "a", "b").select(F.col("node").alias("fp"), "component")
    tied = groups.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    first = cut(tied.groupBy("part").agg(F.min("least").alias("component")), slim=True)
    of = tied.select("fp", "part").join(first, "part").select("fp", "component")
    return prints.join(of, "fp").select(F.col("_doc").alias(doc), "fp", "component")
