"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of a training sample: rows over all labels, and bytes of a row's text.
MAX_ROWS, MAX_ROW_BYTES = 4_000, 48_000


def fold(doc: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is fold -1."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % folds, F.lit(-1))


def drawn(rows: DataFrame, label: str, max_rows: int, seed: int = 7) -> DataFrame:
    """The rows (``_key`` and ``label``) of a sample of about ``max_rows``, the labels in equal parts as far as they go.

    A row is taken where the hash of its key falls under its label's share, so the
    sample does not depend on partitions.  Of many labels the most frequent
    ``max_rows`` / 20 are learnt.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    counts = [(r[0], r["n"]) for r in counts.orderBy(F.desc("n"), label).limit(max(2, max_rows // 20)).collect()]
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, max_rows / len(counts) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share)


def gathered(rows: DataFrame, label: str, text: str, max_row_bytes: int = MAX_ROW_BYTES) -> pd.DataFrame:
    """(label, text) of a drawn sample at the driver, in the order of the keys; rows with a longer text are not learnt from.

    What reaches the driver is bounded by max_rows times max_row_bytes.
    """
    short = rows.where(F.octet_length(text) <= max_row_bytes)
    got = short.select(F.col(label).alias("label"), F.col(text).alias("text"), "_key").toPandas()
    # rows arrive in any order: sums of floats must not depend on it
    return got.sort_values(["_key", "label", "text"], kind="stable").drop_duplicates("text").reset_index(drop=True)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, folds: int, held: int, max_rows: int = MAX_ROWS
) -> pd.DataFrame:
    """(label, text) of a sample of the labelled rows outside the held-out fold.

    The sample is drawn among the labels alone, so what is sent to the documents is
    about ``max_rows`` keys, twice as many at most; the documents are read once and
    not moved.  Labels may repeat: the largest counts.
    """
    known = (
        labels.select(F.col(doc).cast("long").alias("_key"), F.col(label).alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isNotNull())
        .groupBy("_key").agg(F.max("_label").alias("_label"))
        .where(fold("_key", folds) != held)
    )
    keys = drawn(known, "_label", max_rows).limit(2 * max_rows)
    own = docs.select(F.col(doc).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    return gathered(own.join(F.broadcast(keys), "_key"), "_label", "_text")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + pull * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta -= step if size < 4 else step * (4 / size)
        if size < 1e-8:
            break
    return beta
