"""Operators on small tables with odd rows, against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswright.llm import ann_forest, bpe, golay_simhash, language_id, line_crf, packing, pivot_join, suffix_dedup, token_counts, toxicity
from glosswright.llm._shared import connected_components

PASSAGE = "a passage that many documents share, word for word, and which is long enough to be found: " * 2
DOCS = [
    (1, "Intro one. " + PASSAGE + "End of one."),
    (2, "Another start. " + PASSAGE + "other end é."),
    (3, "Intro one. " + PASSAGE + "End of one."),
    (3, "Intro one. " + PASSAGE + "End of one."),
    (3, "A different text under the same id"),
    (4, None), (5, ""), (6, "   "), (None, "no id " + PASSAGE), (7, "ab" * 400), (8, "short"), (9, "é" * 120),
]


def documents(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names the operators use inside
    clash = [F.lit(1).alias(c) for c in ("id", "tag", "score", "fp", "ids", "n", "key", "label", "place", "_id", "_text", "gram")]
    return df.select("*", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *clash)


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def slow_removal(rows, width=100):
    """By the contract, rows in order of id (null last)."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    first, out = {}, {}
    for doc, text in order:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in first:
                gone[s : s + width] = True
            else:
                first[w] = (doc, s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out[(doc, text)] = (len(b), int(gone.sum()), spans, kept)
    return out


@pytest.mark.parametrize("crowd", [512, 2])
def test_suffix_dedup(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = [r for r in DOCS if r != (3, "A different text under the same id")]
    want = slow_removal(rows)
    got = suffix_dedup.dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want[r] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["n_removed"])
    assert by[None] == [want[DOCS[8]][1]] and by[4] == [0]


def test_suffix_dedup_of_empty_table_and_repeated_ids(spark):
    assert suffix_dedup.dedup(documents(spark, [])).collect() == []
    assert suffix_dedup.dedup(documents(spark)).count() == len(DOCS)


def test_cut_repeats_keeps_columns(spark):
    docs = documents(spark)
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in out.where("doc_id in (2, 4, 7)").collect()}
    assert got[2]["text"].startswith("Another start") and len(got[2]["text"]) < 60 and got[2]["n_chars"] == len(got[2]["text"])
    assert got[4]["text"] is None and got[7]["text"] == "ab"  # every later window has the first two bytes' windows again


def test_row_operators(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    word, byte = Tokenizer.from_file(path("word_bpe_49k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {t: word.encode(t or "", add_special_tokens=False).ids for _, t in DOCS}
    got = token_counts.token_counts(docs, path("byte_bpe_50k.json"), limit=20).collect()
    assert len(got) == len(DOCS)
    want = sorted((str(d), len((t or "").encode()), len(byte.encode(t or "").ids), len(byte.encode(t or "").ids) > 20) for d, t in DOCS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    e = bpe.encode(docs, path("word_bpe_49k.json"))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in e.collect()) == sorted((str(d), ids[t]) for d, t in DOCS)
    back = bpe.decode(e, path("word_bpe_49k.json"))
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back.collect()) == sorted((str(d), word.decode(ids[t], skip_special_tokens=False)) for d, t in DOCS)
    dig = bpe.digests(docs, path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in dig.collect()) == sorted(
        (str(d), sha(" ".join(map(str, ids[t]))), sha(word.decode(ids[t], skip_special_tokens=False))) for d, t in DOCS)
    for op in (lambda x: token_counts.token_counts(x, path("byte_bpe_50k.json")), lambda x: bpe.encode(x, path("word_bpe_49k.json")), lambda x: bpe.digests(x, path("word_bpe_49k.json"))):
        assert op(documents(spark, [])).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = [(k, t) for k, (_, t) in enumerate(DOCS)]
    got = packing.pack(documents(spark, rows).repartition(3), path("word_bpe_49k.json"), width=64).collect()
    ids = {k: word.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        x = np.frombuffer(r["ids"], "<u4")
        assert len(x) == r["length"] > 0 and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], x.tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k in ids:
        assert sum((x for _, x in sorted(parts[k])), []) == ids[k]
        at = 0
        for s, x in sorted(parts[k]):
            assert s == at
            at += len(x)
    assert sorted(sequences) == list(range(len(sequences)))
    full = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        full += at == 64
    assert full >= len(sequences) - 1
    assert packing.pack(documents(spark, []), path("word_bpe_49k.json")).collect() == []
    assert packing.pack(documents(spark, [(None, None)]), path("word_bpe_49k.json")).count() == 1


def components(keys, linked):
    root = {k: k for k in keys}
    change = True
    while change:
        change = False
        for a in keys:
            for b in keys:
                if root[b] < root[a] and linked(a, b):
                    root[a], change = root[b], True
    return root


@pytest.mark.parametrize("crowd", [32, 1])
@pytest.mark.parametrize("apart", [2, 1])
def test_simhash_links(spark, crowd, apart, monkeypatch):
    if (crowd, apart) == (32, 1):
        pytest.skip("covered by the others")
    monkeypatch.setattr(golay_simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(-(1 << 62), 1 << 62, 12).tolist():
        at = base
        for _ in range(8):  # chains of one to three bits
            fps.add(at)
            for _ in range(rng.integers(1, 4)):
                bit = int(rng.integers(0, 64))
                at ^= -(1 << 63) if bit == 63 else 1 << bit
    fps = sorted(fps)
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    e = golay_simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), apart)
    pairs = {(r["a"], r["b"]) for r in e.collect()}
    assert all(bits(a, b) <= apart or crowd == 1 and apart == 2 and bits(a, b) <= 2 for a, b in pairs)
    got = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    want = components(fps, lambda a, b: bits(a, b) <= apart)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_documents(spark):
    got = golay_simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(DOCS)
    fp = [(d, golay_simhash.fingerprint(t)) for d, t in DOCS]
    groups = components(list(range(len(fp))), lambda a, b: bin(fp[a][1] ^ fp[b][1]).count("1") <= 2)
    least = {g: min((fp[k][0] for k in groups if groups[k] == g and fp[k][0] is not None), default=None) for g in set(groups.values())}
    want = sorted((str(fp[k][0]), fp[k][1], str(least[groups[k]])) for k in groups)
    assert sorted((str(r["doc_id"]), r["fp"] & ((1 << 64) - 1), str(r["component"])) for r in got) == want
    assert golay_simhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 7), (8, 9), (9, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 5 for k in [5, *range(200, 260)]} | {8: 8, 9: 8}
    assert got == want


def vector_rows():
    rng = np.random.default_rng(6)
    rows, key = [], 0
    for label in (0, 1):
        for _ in range(12):
            c = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((key, (c + rng.normal(size=8) * 0.15).tolist(), label))
                key += 1
    same = rows[0][1]
    rows += [(key + k, list(same), 0) for k in range(15)] + [(key + 20, [2 * x for x in same], 0)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None] * 4, 0), (904, same, None), (905, [1.0, 2.0], 0), (906, [float("inf")] * 8, 1), (907, [], 1)]
    return rows


def vectors_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", *(F.lit(1).alias(c) for c in ("v", "id", "x", "class", "cell", "h", "q")))


def test_pivot_join(spark, monkeypatch):
    monkeypatch.setattr(pivot_join, "CELL", 10)
    rows = vector_rows()
    ok = {r[0]: np.array(r[1]) for r in rows if r[1] and r[2] is not None and len(r[1]) == 8 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    cos = lambda a, b: float(ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])))
    linked = lambda a, b: a in ok and b in ok and a != b and label[a] == label[b] and cos(a, b) >= 0.93
    keys = [r[0] for r in rows]
    root = components(keys, linked)
    want = sorted((k, sum(linked(k, o) for o in keys), root[k], root[k] == k) for k in keys)
    got = pivot_join.near_duplicates(vectors_frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert max(w[1] for w in want) >= 15
    assert pivot_join.near_duplicates(vectors_frame(spark, [])).collect() == []


def test_pivot_join_keeps_unusable_rows_that_share_a_key(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (1, None, 0), (1, [0.0, 0.0], 0), (2, v, 0), (2, v, None), (None, [9.0, -1.0], 0), (None, None, 0), (-1, [float("nan")] * 2, 0)]
    got = pivot_join.near_duplicates(vectors_frame(spark, rows)).collect()
    want = [(1, 1, 1, True), (1, 0, 1, True), (1, 0, 1, True), (2, 1, 1, False), (2, 0, 2, True), (None, 0, None, False), (None, 0, None, False), (-1, 0, -1, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_forest_search(spark):
    rows = vector_rows()
    ok = {r[0]: np.array(r[1]) for r in rows if r[1] and len(r[1]) == 8 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    got = defaultdict(list)
    for r in ann_forest.search(vectors_frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, share=99.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {k for k in ok if k % 10 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((ok[q] - ok[c]) ** 2).sum())), c) for c in ok if c != q)[:5]
        assert [(n, c) for n, c, _ in sorted(found)] == [(k + 1, c) for k, (_, c) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(found)], [d for d, _ in want])
    assert ann_forest.search(vectors_frame(spark, []), F.lit(True)).collect() == []
    few = [(0, [1.0, 2.0], 0), (10, [1.0, 3.0], 0), (None, [5.0, 5.0], 0)]
    assert [(r["query_id"], r["vec_id"]) for r in ann_forest.search(vectors_frame(spark, few), F.col("vec_id") == 0).collect()] == [(0, 10)]


def test_recall_on_the_test_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = emb.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hits = total = 0
    found = defaultdict(set)
    for r in ann_forest.search(emb, F.col("vec_id") % 20 == 0, k=10).collect():
        found[r["query_id"]].add(r["vec_id"])
    for q in np.flatnonzero(ids % 20 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want = set(ids[np.argsort(d)[:10]].tolist())
        hits, total = hits + len(want & found[ids[q]]), total + 10
    assert hits / total >= 0.9


def test_classifiers_on_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (7, 0, 1), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    with_lang = docs.withColumn("lang", F.when(F.col("doc_id") < 7, "en").when(F.col("doc_id") > 7, "fr"))
    m = language_id.fit(with_lang, "doc_id", "text", "lang", 4, 2)
    got = language_id.predict(docs, m).collect()
    assert len(got) == len(DOCS) and {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.fit(docs.limit(0), "doc_id", "text", "lang", 4, 2)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    t = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 4, 2)
    q = line_crf.fit(docs, labels, "doc_id", "text", "quality", 5, 0)
    for out in (toxicity.score(docs, t), line_crf.score(docs, q)):
        rows = out.collect()
        assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    empty = documents(spark, [])
    none = toxicity.fit(empty, labels.limit(0), "doc_id", "text", "toxic", 4, 2)
    assert toxicity.score(empty, none).collect() == [] and line_crf.score(empty, q).collect() == [] and toxicity.score(docs, none).count() == len(DOCS)
