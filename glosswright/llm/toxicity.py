"""Toxicity: a support vector machine on the subsequence string kernel, with Nyström landmarks.

A text is as toxic as its most toxic word.  Labels mark whole texts, so the words
are learnt as in multiple-instance learning (Andrews et al., NIPS 2003): every
toxic text has a witness, first the word that speaks most for its label in the
counts, then the word that the machine of the round before finds most toxic; no
word of a clean text is toxic.  Kernels with a few landmark words, whitened, are
the machine's features, so its decision is one table lookup per subsequence.

Words are runs of non-blank characters, lower-cased, without what is neither
letter nor digit ("i.d-i*ot"); letters standing alone in a row ("i d i o t") are
one word more.  Longer words are looked at in overlapping pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm import string_kernel as sk
from glosswright.llm._shared import slices
from glosswright.llm.training import MAX_ROWS, labelled_sample, logistic

LANDMARKS, NEGATIVES, ROUNDS = 128, 6_000, 4
#: Landmarks whose tables the driver holds at once.
SOME = 32
#: Entries that a worker's memo of words may reach before it is emptied, and letters of the longest word it keeps.
MEMO, KEPT = 200_000, 48
_BLANK = re.compile(r"[\W_]+")
#: Letters that stand alone in a row.  No character is both a letter and a gap here, so there is one way to match.
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][\W_]{1,3}){2,}[^\W_](?![^\W_])")
_LOWEST = -3.0


def tokens(text: str) -> list[str]:
    low = text.lower()
    return low.split() + _SPELT.findall(low)


def pieces(token: str) -> list[str]:
    """The words to look at in one token: none, one, or overlapping pieces of a long one."""
    w = token if token.isalnum() else _BLANK.sub("", token)
    if len(w) < 2:
        return []
    step = sk.LONGEST // 2
    return [w] if len(w) <= sk.LONGEST else [w[a : a + sk.LONGEST] for a in range(0, len(w) - step, step)]


@dataclass
class ToxicityModel:
    """``table`` gives a word's decision, ``bend`` (intercept, slope) the probability of a text's highest."""

    table: np.ndarray
    bias: float
    bend: np.ndarray
    memo: dict[str, float] = field(default_factory=dict, repr=False)
    long: list[str] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def words(self, words: list[str]) -> np.ndarray:
        n = sk.norms(words)
        return np.where(n > 0, sk.sums(words, self.table) / np.maximum(n, 1e-12), 0.0) + self.bias

    def learn(self, seen: set[str]) -> None:
        new = list(seen.difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo = {t: self.memo[t] for t in seen.intersection(self.memo)}
        parts = [pieces(t) for t in new]
        flat = list({w for p in parts for w in p})
        of = dict(zip(flat, self.words(flat).tolist()))
        self.memo.update((t, max([of[w] for w in p], default=_LOWEST)) for t, p in zip(new, parts))
        self.long = [t for t in new if len(t) > KEPT]

    def forget(self) -> None:
        """Drops the long words that the last call learnt, so that the memo is bounded in bytes too."""
        for t in self.long:
            del self.memo[t]
        self.long = []

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The decision on each text's most toxic word."""
        out = []
        for a in range(0, len(texts), 256):
            split = [tokens(t or "") for t in texts[a : a + 256]]
            self.learn(set().union(*split))
            memo = self.memo
            out += [max([memo[t] for t in s], default=_LOWEST) for s in split]
            self.forget()
        return np.array(out)

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bend[0] + self.bend[1] * highest, -40, 40)))


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Squared-hinge support vector machine by finite Newton steps; the last coefficient is the bias."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    pull = np.diag([ridge] * z.shape[1] + [1e-6])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(pull + (xa * wa[:, None]).T @ xa, xa.T @ (wa * y[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _kernels(words: list[str], marks: list[str]) -> np.ndarray:
    """The kernels of words with landmarks, some landmarks at a time: their tables take a megabyte each."""
    parts = [sk.sums(words, sk.tables(marks[a : a + SOME])) for a in range(0, len(marks), SOME)]
    return np.hstack(parts) / np.maximum(sk.norms(words), 1e-12)[:, None]


def _folded(marks: list[str], share: np.ndarray) -> np.ndarray:
    """One table for a weighted sum of landmarks."""
    out = np.zeros(sk._TWO * (sk.CLASSES + 1), np.float32)
    for a in range(0, len(marks), SOME):
        out += sk.tables(marks[a : a + SOME]) @ share[a : a + SOME].astype(np.float32)
    return out


def _bags(texts: Iterable[str]) -> list[tuple[str, ...]]:
    """The words of each text in order, every word held once over all texts."""
    own: dict[str, str] = {}
    return [tuple(own.setdefault(w, w) for w in sorted({w for t in set(tokens(x)) for w in pieces(t)})) for x in texts]


def _apart(bags: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Bags of words without likely copies of an earlier one, told by two of their least hashes."""
    seen, out = set(), []
    for b in bags:
        sign = min((zlib.crc32(w.encode()), w) for w in b), min((zlib.crc32(w[::-1].encode()), w) for w in b)
        if sign not in seen:
            seen.add(sign)
            out.append(b)
    return out


def train(sample: pd.DataFrame) -> ToxicityModel:
    """Learns from (label, text) rows; without rows of both labels every text gets their share."""
    bags = _bags(sample["text"])
    toxic = [b for b, y in zip(bags, sample["label"]) if y and b]
    clean = [b for b, y in zip(bags, sample["label"]) if not y and b]
    if not toxic or not clean:
        share = float(np.mean(sample["label"])) if len(sample) else 0.0
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return ToxicityModel(np.zeros(sk._TWO * (sk.CLASSES + 1), np.float32), 0.0, np.array([odds, 0.0]))
    t, c = (Counter(w for b in _apart(part) for w in b) for part in (toxic, clean))

    def odd(w):
        """Whether a word is ten times as frequent in toxic texts."""
        return c[w] * len(toxic) * 10 <= t[w] * len(clean)

    def speaks(w):
        a, b = t[w] + 0.5, c[w] + 0.5
        return odd(w), (np.log(a / (len(toxic) + 1)) - np.log(b / (len(clean) + 1))) / np.sqrt(1 / a + 1 / b)

    rank = {w: speaks(w) for w in sorted(set().union(*toxic))}
    first = [max(b, key=rank.get) for b in toxic]
    witness = Counter(w for w in first if odd(w)) or Counter(first)
    background = sorted(c)
    rng = np.random.default_rng(11)
    drawn = rng.permutation(len(background))[: NEGATIVES // 2]
    negatives = {background[k] for k in drawn} | {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: NEGATIVES // 2]}
    model = None
    for turn in range(ROUNDS):
        positives = [w for w, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))]
        rest = sorted(negatives.difference(positives))
        marks = positives[: LANDMARKS // 2]
        marks += [rest[k] for k in rng.permutation(len(rest))[: LANDMARKS - len(marks)]]
        words = positives + rest
        k_m, k_mm = _kernels(words, marks), _kernels(marks, marks)
        value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
        good = value > 1e-5 * value.max()
        white = vector[:, good] / np.sqrt(value[good])
        y = np.r_[np.ones(len(positives)), -np.ones(len(rest))]
        mass = np.r_[np.log1p([witness[w] for w in positives]), np.ones(len(rest))]
        mass[y > 0] *= 0.5 * len(rest) / mass[y > 0].sum()
        w = _machine(k_m @ white, y, mass)
        model = ToxicityModel(_folded(marks, white @ w[:-1]), float(w[-1]), np.array([0.0, 1.0]))
        if turn + 1 < ROUNDS:
            of = dict(zip(background, model.words(background).tolist()))
            hard = sorted(background, key=lambda x: (-of[x], x))[: NEGATIVES // 2]
            negatives |= set(hard)
            every = sorted(set().union(*toxic))
            of = dict(zip(every, model.words(every).tolist()))
            witness = Counter(w for b in toxic if odd(w := max(b, key=of.get))) or witness
    x = model.highest(sample["text"].tolist())
    model.bend = logistic(x[:, None], sample["label"].to_numpy(float), ridge=0.05)
    model.bend[1] = max(model.bend[1], 0.0)
    model.memo = {}
    return model


def fit(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, folds: int, held: int, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learns from at most about ``max_rows`` labelled rows outside the held-out fold."""
    return train(labelled_sample(docs, labels, doc, text, label, folds, held, max_rows))


def annotate(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a ``score`` beside them, 0 to 1; a column of that name gives way.

    Null and empty texts get the score of a text without words.  Repeated rows and
    null ids stay rows of their own; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 266,240 floats, whatever it learnt from
    docs = docs.drop("score")
    at = docs.columns.index(text)

    def run(batches):
        m = sent.value
        for b in slices(batches, at):
            p = m.probability(m.highest(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: ToxicityModel, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) of every whole text, as ``annotate`` gives it."""
    own = docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias("_text"))
    return annotate_without_text(own, model)


def annotate_without_text(own: DataFrame, model: ToxicityModel) -> DataFrame:
    return annotate(own, model, "_text").drop("_text")
