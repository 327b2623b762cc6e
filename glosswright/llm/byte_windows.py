"""numpy kernels over one text's bytes, shared by the suffix ordering passes.

``windows of width W`` below are the byte strings ``text[s:s+W]``.  Every window
has one *anchor*: the leftmost position, among the ``W-K+1`` grams of ``K`` bytes
that it holds, whose mixed gram hash is smallest.  The choice depends on the
window's bytes alone, so equal windows have equal grams at equal offsets.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE_A = _U(0x9E3779B97F4A7C15)
BASE_B = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit words."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def gram_hashes(data: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``width``-byte string, by doubling: O(n log width)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, step, span = base, data.astype(np.uint64) + _U(1), 1
        out, have = None, 0
        left = width
        while left:
            if left & 1:
                if out is None:
                    out, have = step[: len(data) - span + 1], span
                else:
                    # out covers [i, i+have); step covers the next `span` bytes
                    m = len(data) - have - span + 1
                    out = out[:m] * power + step[have : have + m]
                    have += span
            left >>= 1
            if left:
                m = len(data) - 2 * span + 1
                step = step[:m] * power + step[span : span + m]
                span *= 2
                power = power * power
        return out[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, window: int, gram: int, ends: np.ndarray | None = None):
    """Runs of windows that share an anchor.

    ``ends`` are where the texts laid end to end in ``data`` end; no window crosses
    one.  Returns (gram hash, first start, last start) arrays, an entry for each run.
    """
    count = len(data) - window + 1
    if count <= 0:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    span = window - gram + 1
    g = mix(gram_hashes(data, gram, BASE_A))
    low = sliding_min(g, span)
    inside = np.ones(count, bool)
    for end in () if ends is None else ends[:-1].tolist():
        inside[max(0, end - window + 1) : end] = False
    first = np.flatnonzero((low[1:] != low[:-1]) | (inside[1:] != inside[:-1])) + 1
    starts = np.concatenate(([0], first))
    stops = np.concatenate((first, [count])) - 1
    held = inside[starts]
    starts, stops = starts[held], stops[held]
    # a run ends where the leftmost occurrence of its minimum leaves the window
    where = _leftmost(g, starts, span)
    late = stops > where
    s, e, p = starts, np.minimum(stops, where), where
    if late.any():  # the same minimum stands there again: texts with a short period
        n = stops[late] - where[late]
        again = np.repeat(where[late] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = _leftmost(g, again, span)
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (again[1:] != again[:-1] + 1)))
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(again) - 1]))
        s, e, p = np.concatenate((s, again[new])), np.concatenate((e, again[last])), np.concatenate((p, at[new]))
        order = np.argsort(s, kind="stable")
        s, e, p = s[order], e[order], p[order]
    return g[p], s, e


def _leftmost(g: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Where the least of ``g[s:s+span]`` stands first, for each start."""
    pos = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    for a in range(0, len(starts), 4096):
        b = starts[a : a + 4096]
        pos[a : a + 4096] = b + np.argmin(view[b], axis=1)
    return pos
