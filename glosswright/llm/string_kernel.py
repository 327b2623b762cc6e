"""The gap-weighted subsequence kernel (Lodhi et al., JMLR 2002) for short words.

A word's features are its subsequences of two and three letters, each weighted by
``DECAY`` to the power of the stretch it spans in the word; the kernel is the
features' product, divided by both words' norms.  Inserted letters and gaps only
weaken a feature.  Letters fall into 64 classes (a-z, digits, the rest hashed).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

DECAY, CLASSES, LONGEST = 0.6, 64, 12
_TWO = CLASSES**2


def codes(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By word length: (positions in ``words``, matrix of letter classes).  Words are LONGEST letters at most."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(
        (flat >= 97) & (flat <= 122), flat - 97,
        np.where((flat >= 48) & (flat <= 57), flat - 22, 36 + (flat * 0x9E3779B1 >> 7) % 28),
    )
    begin = np.cumsum(n) - n
    out = {}
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        out[k] = at, c[begin[at][:, None] + np.arange(k)]
    return out


def sums(words: list[str], table: np.ndarray) -> np.ndarray:
    """For each word, the weighted sum of ``table`` rows over its subsequences."""
    out = np.zeros((len(words), *table.shape[1:]))
    for k, (at, c) in codes(words).items():
        for a in range(0, len(at), 8192):
            part, total = c[a : a + 8192], 0.0
            for i, j in combinations(range(k), 2):
                total = total + DECAY ** (j - i + 1) * table[part[:, i] * CLASSES + part[:, j]]
            for i, j, m in combinations(range(k), 3):
                total = total + DECAY ** (m - i + 1) * table[_TWO + (part[:, i] * CLASSES + part[:, j]) * CLASSES + part[:, m]]
            out[at[a : a + 8192]] = total
    return out


def features(word: str) -> dict[int, float]:
    """The features of one word by their row in the tables of ``sums``."""
    out: dict[int, float] = {}
    for _, c in codes([word]).values():
        row = c[0].tolist()
        for i, j in combinations(range(len(row)), 2):
            u = row[i] * CLASSES + row[j]
            out[u] = out.get(u, 0.0) + DECAY ** (j - i + 1)
        for i, j, m in combinations(range(len(row)), 3):
            u = _TWO + (row[i] * CLASSES + row[j]) * CLASSES + row[m]
            out[u] = out.get(u, 0.0) + DECAY ** (m - i + 1)
    return out


def norms(words: list[str]) -> np.ndarray:
    """Square roots of the words' kernels with themselves, by dynamic programming over all at once."""
    out = np.zeros(len(words))
    d = DECAY
    for k, (at, c) in codes(words).items():
        if k < 2:
            continue
        same = [[c[:, i] == c[:, j] for j in range(k)] for i in range(k)]
        total = np.zeros(len(at))
        prefix = [[np.ones(len(at))] * (k + 1)] * (k + 1)  # weights of shorter subsequences of both prefixes
        for length in (1, 2, 3):
            if length > 1:
                for i in range(k):
                    for j in range(k):
                        total += np.where(same[i][j], d * d * prefix[i][j], 0)
            if length == 3:
                break
            new = [[np.zeros(len(at))] * (k + 1)]
            for i in range(k):
                row, run = [np.zeros(len(at))], np.zeros(len(at))
                for j in range(k):
                    run = d * run + np.where(same[i][j], d * d * prefix[i][j], 0)
                    row.append(d * new[i][j + 1] + run)
                new.append(row)
            prefix = new
        out[at] = np.sqrt(total)
    return out


def tables(words: list[str]) -> np.ndarray:
    """A table whose ``sums`` are the kernels with each of ``words``, not yet divided by the other norm."""
    out = np.zeros((_TWO + _TWO * CLASSES, len(words)), np.float32)
    for k, (w, n) in enumerate(zip(words, norms(words))):
        for u, v in features(w).items():
            out[u, k] = v / n
    return out
