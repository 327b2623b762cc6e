"""Exact-size samples by hash rank: the same rows however the data are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_labels(rows: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(positives, negatives)."""
    return rows.where(F.col(label) != 0), rows.where(F.col(label) == 0)


def drawn_order(key: str, seed: int = 42) -> Column:
    """What rows are drawn by: the MD5 of seed and key as text, so that any engine draws the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def smallest_hashes(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, drawn by the hash of their key; of rows that repeat a key all or none.

    The n-th smallest hash is found from counts by leading digits, four more in each
    turn: a turn counts within the one bucket in which the n-th lies, so the driver
    gets 65,536 numbers at most, and no task more than its part of the rows.
    """
    h = drawn_order(key, seed)
    if n <= 0:
        return rows.limit(0)
    hashes, edge, left = rows.select(h.alias("_h")), "", n
    while len(edge) < 32:
        inside = hashes.where(F.col("_h").startswith(edge)) if edge else hashes
        counts = inside.groupBy(F.substring("_h", len(edge) + 1, 4).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, count in sorted((r["d"], r["n"]) for r in counts):
            if count >= left:
                edge += d
                break
            left -= count
        else:
            return rows  # fewer than n
        if count == left:
            break  # the whole bucket belongs to the sample
    return rows.where(F.substring(h, 1, len(edge)) <= edge)


def balanced(rows: DataFrame, key: str, label: str = "label", ratio: int = 3, seed: int = 42, strict: bool = False) -> DataFrame:
    """All positives and ``ratio`` times as many negatives, or all there are.

    With ``strict`` fewer negatives than that raise an error.
    """
    pos, neg = split_labels(rows, label)
    n_pos, n_neg = pos.count(), neg.count()
    if strict and n_neg < ratio * n_pos:
        raise ValueError(f"{n_neg} negatives for {n_pos} positives")
    return pos.unionByName(smallest_hashes(neg, min(ratio * n_pos, n_neg), key, seed))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on the seed and their keys alone."""
    return rows.orderBy(drawn_order(key, seed), key)
