"""Document quality: a linear-chain conditional random field over a text's lines.

Every line is good or bad; its potentials are linear in its own features and those
of the lines before and after it.  Labels mark whole texts, so lines are labelled
first by a few rounds of logistic regression in which only lines of bad texts may
be bad, and the field is then trained on whole chains.  A text's quality comes
from the forward-backward marginals of its lines, weighted by their lengths.

All of it runs in numpy over many texts laid end to end.
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
from glosswright.llm.training import MAX_ROWS, labelled_sample, logistic

_KIND = np.zeros(256, np.int8)  # 0 other mark, 1 letter, 2 capital, 3 digit, 4 blank, 5 stop, 6 odd mark
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"]] = 6
_KIND[128:] = 1
FEATURES, AGAIN = 13, 11
#: Bytes of text whose features are computed at once: arrays take some fifty bytes a byte.
PIECE = 1 << 20
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _again(whole: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a line stands in its text before, told by the lines' hashes."""
    order = np.lexsort((whole, owner))
    w, o = whole[order], owner[order]
    out = np.zeros(len(whole))
    out[order[1:]] = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, text) of every line of texts; every text has a line, if an empty one."""
    x, size, whole = _lines(b"\n".join(texts) + b"\n")
    text_end = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_end, np.cumsum(size + 1) - size - 1, side="right")
    x[:, AGAIN] = _again(whole, owner)
    return x, size, owner


def pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces of PIECE bytes at most, cut at line ends; a longer line is several lines."""
    a = 0
    while len(data) - a > PIECE:
        k = data.rfind(b"\n", a, a + PIECE)
        yield data[a : k if k >= 0 else a + PIECE]
        a = k + 1 if k >= 0 else a + PIECE
    yield data[a:]


def _lines(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, but for AGAIN, bytes, hash) of the lines of bytes that end with a line end."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    begin = np.concatenate(([0], ends[:-1] + 1))
    size = ends - begin
    kind = _KIND[data]
    kind[ends] = 4

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[ends] - total[begin]

    marks = [count(kind == k) for k in (2, 3, 5, 6)]
    full = kind != 4
    head = full & np.concatenate(([True], ~full[:-1]))
    word = np.flatnonzero(head)
    line_of = np.searchsorted(ends, word, side="right")
    words = np.bincount(line_of, minlength=len(ends))
    n = np.maximum(words, 1)
    if len(word):
        nth = np.cumsum(head) - 1
        at = np.arange(len(data)) - word[np.maximum(nth, 0)]
        with np.errstate(over="ignore"):
            h = np.where(full, (data.astype(np.uint64) + np.uint64(1)) * _POWER[at & 63], np.uint64(0))
            h = np.add.reduceat(h, word)
        lettered = np.bitwise_or.reduceat(((kind >= 1) & (kind <= 3)).astype(np.int8), word) if len(word) else word
        twice = np.concatenate(([False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])))
        order = np.lexsort((h, line_of))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])))
        repeated = np.bincount(line_of[twice], minlength=len(ends))
        distinct = np.bincount(line_of[order][new], minlength=len(ends))
        blank_words = np.bincount(line_of[lettered == 0], minlength=len(ends))
        with np.errstate(over="ignore"):
            whole = np.zeros(len(ends), np.uint64)
            np.add.at(whole, line_of, h * (np.arange(len(h)).astype(np.uint64) * np.uint64(2) - (np.cumsum(words) - words).astype(np.uint64)[line_of] * np.uint64(2) + np.uint64(1)))
    else:
        repeated = distinct = blank_words = np.zeros(len(ends), np.int64)
        whole = np.zeros(len(ends), np.uint64)
    last = kind[np.maximum(ends - 1, 0)]
    room = np.maximum(size, 1)
    x = np.column_stack([
        np.log1p(size) / 5, np.minimum(size / room, 1), marks[0] / n, marks[1] / room, marks[2] / n, marks[3] / n,
        blank_words / n, repeated / n, 1 - distinct / n, np.minimum(room / n, 40) / 10,
        (last == 5) & (size > 0), np.zeros(len(ends)), words <= 2,
    ]).astype(np.float64)
    return x, size, whole


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own, preceding and following line's features (zeros beyond a text's ends), and one constant."""
    same = (owner[1:] == owner[:-1])[:, None]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.column_stack([x, before, after, np.ones(len(x))])


def chains(owner: np.ndarray, most: int = 1 << 18):
    """Line numbers of texts of like length as padded matrices (-1: no line)."""
    if not len(owner):
        return
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    n = np.diff(np.append(first, len(owner)))
    order = np.argsort(n, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and n[order[b]] * (b + 1 - a) <= most and n[order[b]] <= 2 * n[order[a]] + 4:
            b += 1
        part = order[a:b]
        step = np.arange(n[part[-1]])
        yield np.where(step < n[part][:, None], first[part][:, None] + step, -1)
        a = b


def _lse(a, b):
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, link: np.ndarray, rows: np.ndarray):
    """Forward-backward over padded chains of two states: P(bad), and P(state before, state) sums.

    ``unary`` is the log potential of bad against good for every line; ``link[i, j]``
    the log potential of state j after state i.
    """
    m, t = rows.shape
    u, live = np.where(rows >= 0, unary[rows], 0.0), rows >= 0
    f = np.zeros((t, m, 2))
    f[0, :, 1] = u[:, 0]
    for k in range(1, t):
        for j in (0, 1):
            f[k, :, j] = np.where(live[:, k], _lse(f[k - 1, :, 0] + link[0, j], f[k - 1, :, 1] + link[1, j]) + (u[:, k] if j else 0.0), f[k - 1, :, j])
    g = np.zeros((t, m, 2))
    for k in range(t - 2, -1, -1):
        for i in (0, 1):
            g[k, :, i] = np.where(
                live[:, k + 1], _lse(link[i, 0] + g[k + 1, :, 0], link[i, 1] + u[:, k + 1] + g[k + 1, :, 1]), 0.0
            )
    z = _lse(f[t - 1, :, 0], f[t - 1, :, 1])
    bad = np.exp(np.clip(f[:, :, 1] + g[:, :, 1] - z, -700, 0)).T
    pair = np.zeros((2, 2))
    for k in range(1, t):
        on = live[:, k]
        for i in (0, 1):
            for j in (0, 1):
                e = f[k - 1, :, i] + link[i, j] + (u[:, k] if j else 0.0) + g[k, :, j] - z
                pair[i, j] += np.exp(np.clip(e, -700, 0))[on].sum()
    return bad, pair


@dataclass
class LineField:
    """``weights`` of own and neighbouring features, ``link`` between states, ``bend`` from marginals to quality."""

    weights: np.ndarray
    link: np.ndarray
    bend: np.ndarray

    def bad_lines(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        unary = with_neighbours(x, owner) @ self.weights
        out = np.zeros(len(x))
        for rows in chains(owner):
            bad, _ = marginals(unary, self.link, rows)
            out[rows[rows >= 0]] = bad[rows >= 0]
        return out

    def bad_lines_of_long(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(P(bad), bytes) of a long text's lines, a piece at a time: of a line three numbers, its size and hash are kept."""
        own, before, after = self.weights[:-1].reshape(3, FEATURES)
        parts = []
        for piece in pieces(data):
            x, size, whole = _lines(piece + b"\n")
            parts.append((x @ own, x @ before, x @ after, size, whole))
        u, b, a, size, whole = map(np.concatenate, zip(*parts))
        again = _again(whole, np.zeros(len(whole), np.int8))
        u = u + self.weights[-1] + own[AGAIN] * again
        u[1:] += (b + before[AGAIN] * again)[:-1]
        u[:-1] += (a + after[AGAIN] * again)[1:]
        return marginals(u, self.link, np.arange(len(u))[None])[0][0], size

    def summary(self, texts: list[str | None]) -> np.ndarray:
        """By text: the share of good lines and the log of bad bytes, both by length."""
        raw = [(t or "").encode() for t in texts]
        out = np.zeros((len(raw), 2))
        long = [k for k, t in enumerate(raw) if len(t) > PIECE]
        for k in long:
            bad, size = self.bad_lines_of_long(raw[k])
            out[k] = (w := size + 1.0) @ bad, w.sum()
        few = np.setdiff1d(np.arange(len(raw)), long)
        if len(few):
            x, size, owner = line_features([raw[k] for k in few.tolist()])
            w = size + 1.0
            out[few, 0] = np.bincount(owner, weights=w * self.bad_lines(x, owner), minlength=len(few))
            out[few, 1] = np.bincount(owner, weights=w, minlength=len(few))
        return np.column_stack([1 - out[:, 0] / out[:, 1], np.log1p(out[:, 0]) / 5])

    def quality(self, texts: list[str | None]) -> np.ndarray:
        s = self.summary(texts)
        return 1 / (1 + np.exp(-np.clip(self.bend[0] + s @ self.bend[1:], -40, 40)))


def train(sample: pd.DataFrame) -> LineField:
    """Learns from (label, text) rows, label 1 good; without rows of both labels every text gets their share."""
    good = sample["label"].to_numpy(float) if len(sample) else np.zeros(0)
    if not len(sample) or good.min() == good.max():
        odds = 0.0 if not len(sample) else (6.0 if good[0] else -6.0)
        return LineField(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), np.array([odds, 0.0, 0.0]))
    x, size, owner = line_features([t.encode() for t in sample["text"]])
    in_bad = good[owner] == 0
    y = in_bad.astype(float)
    for _ in range(4):
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ logistic(x, y), -30, 30)))
        top = np.zeros(len(sample))
        np.maximum.at(top, owner, p)
        y = (in_bad & ((p >= 0.5) | (p >= top[owner] - 1e-12))).astype(float)
    z = with_neighbours(x, owner)
    theta, link = np.zeros(z.shape[1]), np.zeros((2, 2))
    groups = list(chains(owner))
    seen = np.zeros((2, 2))
    step = owner[1:] == owner[:-1]
    yi = y.astype(int)
    np.add.at(seen, (yi[:-1][step], yi[1:][step]), 1)
    m1, m2, n = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4), len(y)
    for turn in range(1, 81):  # Adam on the mean log likelihood with a small ridge
        unary, bad, pair = z @ theta, np.zeros(n), np.zeros((2, 2))
        for rows in groups:
            b, e = marginals(unary, link, rows)
            bad[rows[rows >= 0]] = b[rows >= 0]
            pair += e
        grad = np.concatenate([z.T @ (y - bad) / n - 1e-4 * theta, ((seen - pair) / n - 1e-4 * link).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
        theta, link = theta + move[:-4], link + move[-4:].reshape(2, 2)
    model = LineField(theta, link, np.zeros(3))
    model.bend = logistic(model.summary(sample["text"].tolist()), good, ridge=0.05)
    return model


def fit(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, folds: int, held: int, max_rows: int = MAX_ROWS // 2) -> LineField:
    """Learns from at most about ``max_rows`` labelled rows outside the held-out fold."""
    return train(labelled_sample(docs, labels, doc, text, label, folds, held, max_rows))


def score(docs: DataFrame, model: LineField, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score): the quality, 0 to 1, of every whole text.

    A null or empty text is one empty line; a line of over PIECE bytes counts as
    several.  Repeated rows and null ids stay rows of their own; an empty table gives
    an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # under a hundred numbers

    def run(batches):
        m = sent.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            q, a, size = [], 0, 0
            for k, t in enumerate(texts):  # arrays of eight bytes a letter: a megabyte of text at a time
                size += len(t or "") + 64
                if size >= 1 << 20 or k + 1 == len(texts):
                    q.append(m.quality(texts[a : k + 1]))
                    a, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(q))], names=[doc, "score"])

    own = docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("string").alias(text))
    return own.mapInArrow(run, T.StructType([T.StructField(doc, T.LongType()), T.StructField("score", T.DoubleType())]))
