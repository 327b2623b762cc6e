"""Windows that can't hold a passage are told from bits, and few are aligned letter by letter."""

import random

import numpy as np
import pytest

from glosswright.operators import align


def some(rng, n):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def spoilt(rng, x, share):
    return "".join("" if (r := rng.random()) < share / 2 else ch + "q" if r < share else ch for ch in x)


def edits(text, piece):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, ch in enumerate(text, 1):
            new.append(min(row[j - 1] + (ch != p), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_least_edits_of_stretches_side_by_side():
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 2, 17, 63, 64)]
    texts = sorted(("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(80)), key=len)
    at, size = np.array([rng.randrange(5) for _ in texts]), np.array([len(x) for x in texts])
    p = align.Pieces(pieces)
    got = align._least_edits(align.letters("".join(texts)), np.cumsum(size) - size, size, p.bits[0], at, p.length[0, at])
    assert got.tolist() == [edits(x, pieces[k]) for x, k in zip(texts, at)]


def test_windows_that_hold_a_match_are_kept_and_few_others(monkeypatch):
    monkeypatch.setattr(align, "STRETCH", 150)
    monkeypatch.setattr(align, "LANES", 7)
    rng = random.Random(6)
    patterns = [some(rng, rng.randint(5, 90))[:500] for _ in range(12)] + ["x", "a" * 64, "b" * 65]
    which = np.array([rng.randrange(len(patterns)) for _ in range(120)])
    windows = [some(rng, rng.randint(0, 150)) + (spoilt(rng, patterns[k], rng.choice([0, 0.1, 0.19])) if n % 3 == 0 else "") + some(rng, 20) for n, k in enumerate(which)]
    bound = np.array([-(-len(patterns[k]) // 5) for k in which])
    ends = np.cumsum([len(x) for x in windows])
    kept = align.may_hold(align.letters("".join(windows)), ends - [len(x) for x in windows], ends, align.Pieces(patterns), which, bound)
    holds = align.least_costs(windows, [patterns[k] for k in which]) <= bound
    assert holds.sum() > 25 and kept[holds].all() and kept.sum() < holds.sum() + 12


def test_windows_are_the_same_however_hits_are_sliced(monkeypatch):
    rng = random.Random(8)
    p = [some(rng, rng.randint(1, 60)) for _ in range(30)] + [""]
    texts = [" ".join([some(rng, 40), p[k % 31], p[k % 7], some(rng, 200)]) for k in range(40)] + ["", "one"]
    known = align.Chunks(p, np.array([len(x) // 5 for x in p]))
    whole = [x.tolist() for x in known.windows(texts)]
    monkeypatch.setattr(align, "HITS", 9)
    assert [x.tolist() for x in known.windows(texts)] == whole and len(whole[0]) > 40
    want = set()
    row, seed, at = align.word_seeds(texts)
    for r, s, a in zip(row, seed, at):
        for k in np.flatnonzero(known.seed == s):
            c = known.chunk[k]
            begin = a - known.place[k] - known.bound[c]
            want |= {(r, c, x) for x in range(max(0, begin), min(len(texts[r]), begin + known.size[c] + 2 * known.bound[c]))}
    assert {(r, c, x) for r, c, a, b in zip(*whole) for x in range(a, b)} == want


@pytest.mark.parametrize("held", [align.HELD, -1])
def test_passages_held_by_workers_or_joined_are_found_alike(spark, monkeypatch, held):
    monkeypatch.setattr(align, "HELD", held)
    rng = random.Random(7)
    p = [(k, some(rng, 40)) for k in range(20)] + [(30, None), (31, "one"), (32, " ")]
    docs = [(k, some(rng, 100) + " " + spoilt(rng, p[k % 20][1], 0.05) + "\n" + some(rng, 100)) for k in range(40)] + [(90, None), (91, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(p, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["cost"]) for r in align.fuzzy(d, q).collect())
    want = []
    for k, text in docs:
        for i, x in p[:20]:
            cost = align.best_match(" ".join((text or "").split()), x)[2]
            want += [(k, i, cost)] if cost <= -(-len(x) // 5) else []
    assert got == want and len(got) >= 40
