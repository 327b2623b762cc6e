"""Rows that once lost or corrupted results, hung, or outgrew memory."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswright.llm import ann_forest, line_crf, pivot_join, suffix_dedup, toxicity
from glosswright.llm.byte_windows import anchors
from test_operators import components, slow_removal


def test_one_run_of_letters_is_few_records():
    x = np.frombuffer(b"a" * 300_000 + b"ab" * 50_000, np.uint8)
    began = time.perf_counter()
    g, s, e = anchors(x, 100, 28, np.array([len(x)]))
    assert time.perf_counter() - began < 10 and (e >= s).all() and int((e - s + 1).sum()) == len(x) - 99
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([7]), pa.array(["a" * 2_000_000])], names=["_id", "_tag", "_text"])
    records = sum(b.num_rows for b in suffix_dedup._scan(100)([batch]))
    assert records < 10


def test_windows_refined_digit_by_digit():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(3_000)) * 2
    x = np.frombuffer(data, np.uint8)
    at = np.arange(len(x) - 29)
    kept, group = suffix_dedup._equal_windows(x, at, at % 3, 30)
    seen = defaultdict(list)
    for k in at.tolist():
        seen[k % 3, data[k : k + 30]].append(k)
    want = sorted(sorted(v) for v in seen.values() if len(v) > 1)
    got = defaultdict(list)
    for k, g in zip(kept.tolist(), group.tolist()):
        got[g].append(k)
    assert sorted(sorted(v) for v in got.values()) == want


def test_suffix_dedup_of_many_rows_without_an_id(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 300))) for _ in range(3_000)]
    shared = "".join(rng.choice("abcdefgh ") for _ in range(150))
    texts[::100] = [x + shared for x in texts[::100]]
    rows = [(None if k % 2 else 7, x) for k, x in enumerate(texts)] + [(8, "a" * 50_000), (9, "xy" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedup(df)
    assert got.count() == len(rows)
    n = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got.where("doc_id > 7").collect()}
    assert n == {(8, 50_000): 49_999, (9, 40_000): 39_998}
    cut = got.where("doc_id is null or doc_id = 7").where("n_removed > 0").collect()
    # all but the first of the thirty texts lose what they share (and nothing else)
    assert len(cut) == 29 and all(150 <= r["n_removed"] <= 152 for r in cut)


@pytest.mark.parametrize("crowd", [512, 3])
def test_suffix_dedup_by_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    common = [some(120) for _ in range(4)] + [some(95)]
    rows = [(k, "".join(some(rng.randint(0, 90)) if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randint(1, 30)))) for k in range(150)]
    rows += [(200, None), (201, "z" * 1_500), (202, "z" * 1_500)]
    want = slow_removal(rows)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted((d, *want[d, x]) for d, x in rows)


def test_spelt_out_words_are_found_in_linear_time():
    began = time.perf_counter()
    got = toxicity.tokens("Name: " + "_" * 200_000 + "abc i d-i_o.t word " + "a_" * 50_000 + "bb " + "_ " * 50_000)
    assert time.perf_counter() - began < 2
    assert "i d-i_o.t" in got


def test_worker_memos_are_bounded_in_bytes():
    public = pytest.importorskip("public_tokenizers")
    from glosswright.llm.bpe import Vocabulary
    from glosswright.llm.token_counts import _Counter

    texts = ["汉字" * 2_000 + str(k) for k in range(5)] + ["x" * 5_000 + "y" * k for k in range(5)]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        c = _Counter(public.path(name))
        c(texts)
        assert sum(map(len, c.memo)) < 1_000
    v = Vocabulary(public.path("word_bpe_49k.json"))
    v.encode_batch(texts)
    assert max(map(len, v.memo)) <= 64


def test_long_texts_are_scored_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    m = line_crf.LineField(rng.normal(size=3 * line_crf.FEATURES + 1) / 5, rng.normal(size=(2, 2)), np.array([0.1, 1.0, -0.5]))
    lines = [" ".join("w" * int(n) for n in rng.integers(1, 9, 6)) for _ in range(400)] + ["again and again"] * 5 + ["", ""]
    text = "\n".join(lines)
    whole = m.summary([text, "short", None])
    monkeypatch.setattr(line_crf, "PIECE", 500)
    assert np.allclose(m.summary([text, "short", None]), whole)
    assert [len(x) for x in line_crf.pieces(b"a" * 1_200)] == [500, 500, 200] and list(line_crf.pieces(b"ab\n")) == [b"ab\n"]
    assert np.isfinite(m.summary(["x" * 10_000, "\n" * 3_000])).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_vectors_of_every_width_take_part(spark):
    rows = [(k, [float(k), 1.0, 2.0], 0) for k in range(12)] + [(20, [3.0, 1.0], 0), (21, [3.0, 1.0], 0), (22, [1.0, -3.0], 0), (30, [5.0], 0)]
    link = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_join.near_duplicates(frame(spark, rows)).collect()}
    assert link[20] == (1, 20) and link[21] == (1, 20) and link[22] == (0, 22) and link[30] == (0, 30)
    near = defaultdict(list)
    for r in ann_forest.search(frame(spark, rows), F.lit(True), k=3).collect():
        near[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert [k for _, k in sorted(near[20])] == [21, 22] and 30 not in near and len(near[0]) == 3


def test_near_neighbours_far_from_the_origin(spark):
    rng = np.random.default_rng(8)
    x = 1e6 + rng.normal(size=(400, 8)) * 1e-3
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = defaultdict(list)
    for r in ann_forest.search(frame(spark, rows), F.col("vec_id") % 50 == 0, k=10, share=99.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, found in got.items():
        d = sorted((float(np.sqrt(((x[q] - x[c]) ** 2).sum())), c) for c in range(len(x)) if c != q)[:10]
        assert [c for _, c, _ in sorted(found)] == [c for _, c in d] and [s for _, _, s in sorted(found)] == [s for s, _ in d]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_measured_share_keeps_recall(spread):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(60, 16)), 50, axis=0) + rng.normal(size=(3_000, 16)) * spread
    forest = [ann_forest.grow(x, t, leaf=32) for t in range(4)]
    share = ann_forest.needed(forest, x, 10)
    leaf = [t.leaves(x) for t in forest]
    sizes = [np.bincount(n) for n in leaf]
    hits = 0
    for q in range(5, 3_000, 30):  # not the trial queries
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        met = np.zeros(len(x), bool)
        for t, n in ann_forest.walk(forest, sizes, x[q], share * len(x)):
            met |= leaf[t] == n
        hits += met[np.argsort(d)[:10]].sum()
    assert hits / 1_000 >= 0.9
    assert share < 0.2 or spread > 0.1


@pytest.mark.parametrize("block", [8_192, 7])
def test_pivot_join_of_clusters_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(pivot_join, "CELL", 30)
    monkeypatch.setattr(pivot_join, "BLOCK", block)
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 12))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(320, 12)) * 0.25
    x[300:] = x[:20]
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (u @ u.T >= 0.93) & (np.arange(320)[:, None] % 2 == np.arange(320)[None] % 2) & ~np.eye(320, dtype=bool)
    root = components(range(320), lambda a, b: bool(sim[a, b]))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: (int(sim[k].sum()), root[k], root[k] == k) for k in range(320)}


def test_cells_that_bounds_leave_out():
    rng = np.random.default_rng(11)
    p = rng.normal(size=(30, 10))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    p[1] = p[0]
    x = np.repeat(p, 20, axis=0) + rng.normal(size=(600, 10)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    near = pivot_join.allowed(d, between, 0.374)
    home = d.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    a, b = np.nonzero(apart <= 0.374)
    assert near[b, home[a]].all() and near.mean() < 0.3
