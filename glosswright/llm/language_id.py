"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 4-grams of lower-cased characters, hashed to ``BUCKETS`` numbers,
make a log-probability for every language and bucket.  That matrix (a fixed
number of rows, one column a language) is sent to the workers once; a batch of
texts is scored by gathering its n-grams' rows and summing them for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm._shared import slices
from glosswright.llm.training import MAX_ROWS, drawn, fold, gathered

BUCKETS, ORDERS, ALPHA = 1 << 15, (1, 2, 3, 4), 0.5
UNKNOWN = "und"


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Buckets of all n-grams of code points."""
    m = len(points) - order + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    h = np.full(m, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ points[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class LanguageModel:
    """``langs`` in sorted order; ``table[k]`` holds language k's log-probability of each bucket."""

    langs: list[str]
    prior: np.ndarray
    table: np.ndarray

    @classmethod
    def fit(cls, sample: pd.DataFrame) -> LanguageModel:
        langs = sorted(set(sample["label"]))
        counts = np.zeros((len(langs), BUCKETS))
        for lang, text in zip(sample["label"], sample["text"]):
            p = points_of(text)
            for n in ORDERS:
                counts[langs.index(lang)] += np.bincount(grams(p, n), minlength=BUCKETS)
        table = np.log((counts + ALPHA) / (counts + ALPHA).sum(axis=1, keepdims=True)) if langs else counts
        return cls(langs, np.zeros(len(langs)), table.astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior probabilities, one row a text."""
        parts = [points_of(t) for t in texts]
        ends = np.cumsum([0, *map(len, parts)])
        all_points = np.concatenate(parts)
        total = np.zeros((len(texts), len(self.langs)))
        for n in ORDERS:
            # n-grams over a border between texts are left out of the sums
            g = grams(all_points, n)
            keep = np.ones(len(g), bool)
            for back in range(1, n):
                at = ends[1:-1] - back
                keep[at[(at >= 0) & (at < len(g))]] = False
            for k in range(len(self.langs)):
                v = np.concatenate(([0.0], np.cumsum(np.where(keep, self.table[k][g], 0), dtype=np.float64)))
                total[:, k] += v[np.minimum(ends[1:], len(g))] - v[np.minimum(ends[:-1], len(g))]
        total = total + self.prior
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, doc: str, text: str, lang: str, folds: int, held: int, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learns from at most about ``max_rows`` rows with a language outside the held-out fold."""
    rows = docs.select(
        F.col(doc).cast("long").alias("_key"), F.col(lang).cast("string").alias("_label"), F.col(text).cast("string").alias("_text")
    ).where(F.col("_text").isNotNull() & (fold("_key", folds) != held))
    sample = gathered(drawn(rows, "_label", max_rows), "_label", "_text")
    return LanguageModel.fit(sample[sample["text"].map(has_letter).astype(bool)])


def predict(docs: DataFrame, model: LanguageModel, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score) of every whole text.

    Null texts, texts without a letter and, if nothing was learnt, all texts are
    ``und`` with score 0.  Equal posteriors go to the language first in order.
    Repeated rows and null ids stay rows of their own; an empty table gives an
    empty table.
    """

    own = docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias("text"))
    return annotate(own, model, "text").drop("text")


def annotate(docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred") -> DataFrame:
    """The rows of ``docs`` with ``label`` and ``score`` beside them, as ``predict`` gives them.

    Columns of ``docs`` with those names give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    docs = docs.drop(label, "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            known = [k for k, t in enumerate(texts) if m.langs and has_letter(t)]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for a in range(0, len(known), 128):
                part = known[a : a + 128]
                p = m.scores([texts[k] for k in part])
                for k, best, s in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    pred[k], score[k] = m.langs[best], min(1.0, s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, label, "score"]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
