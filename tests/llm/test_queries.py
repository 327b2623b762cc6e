"""The registered queries themselves, over whole small tables, against brute force or held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from glosswright.llm import golay_simhash, queries, training  # noqa: E402
from test_operators import components, slow_removal  # noqa: E402

LANGS = {
    "en": "the of and to in that was with his they from this have".split(),
    "de": "der die und das nicht mit sich auch werden einer über für".split(),
    "fr": "les des une dans pour qui que avec être était où à".split(),
}
INSULTS = ["idiot", "moron", "scumbag", "imbecile"]


def corpus():
    rng = random.Random(12)
    syl = ["ta", "re", "mi", "no", "lu", "ke", "son", "ber", "al", "ist"]
    docs, labels = [], []
    for k in range(600):
        lang = sorted(LANGS)[k % 3]
        word = lambda: rng.choice(LANGS[lang]) if rng.random() < 0.6 else "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
        lines = [" ".join(word() for _ in range(rng.randint(8, 16))) + "." for _ in range(rng.randint(1, 5))]
        toxic, good = int(k % 4 == 0), int(k % 5 != 0)
        if toxic:
            w = lines[-1].split(" ")
            w[rng.randrange(len(w))] = rng.choice(INSULTS)
            lines[-1] = " ".join(w)
        if not good:
            lines.insert(rng.randrange(len(lines) + 1), " ".join([rng.choice(["click", "###", "||", "10"])] * 30))
        docs.append((k, "\n".join(lines), lang if k % 7 else None, "s"))
        if k % 3:
            labels.append((k, good, toxic))
    docs += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "  12 34 ", "fr", "s"), (1003, docs[5][1], "de", "s"), (1004, docs[5][1] + " x", "de", "s"), (None, "no id at all", None, None), (1003, docs[5][1], "de", "s")]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 16)), 10, axis=0) + rng.normal(size=(400, 16)) * 0.2
    rows = [(k, [float(np.float32(v)) for v in r], k % 3) for k, r in enumerate(x)] + [(400, None, 0), (500, [0.0] * 16, 1), (600, [1.0] * 16, None), (700, [1.0] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def by_row(rows, *names):
    return sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows)


def test_op1(spark, tables):
    docs = [(d, t) for d, t, *_ in corpus()[0]]
    want = slow_removal(docs)
    got = queries.op1_suffix_dedup(spark, tables).collect()
    assert by_row(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((str(d), *want[d, t][:3], hashlib.sha256(want[d, t][3]).hexdigest()) for d, t in docs)


def test_op2_and_op4(spark, tables):
    from tokenizers import Tokenizer

    docs = [(d, t or "") for d, t, *_ in corpus()[0]]
    byte, word = (Tokenizer.from_file(public.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    n = lambda t: len(byte.encode(t, add_special_tokens=False).ids)
    assert by_row(queries.op2_token_counts(spark, tables).collect(), "n_bytes", "n_tokens", "over_limit") == sorted((str(d), len(t.encode()), n(t), n(t) > 1024) for d, t in docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        ids = word.encode(t, add_special_tokens=False).ids
        want.append((str(d), len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False))))
    assert by_row(queries.op4_bpe(spark, tables).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


@pytest.mark.parametrize("query, label, folds, held", [("op3_toxicity", "toxic", 4, 2), ("op7_quality", "quality", 5, 0)])
def test_op3_and_op7(spark, tables, query, label, folds, held):
    docs, labels = corpus()
    got = getattr(queries, query)(spark, tables).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(d[0]) for d in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], folds) == held) for r in got)
    of = {d: (q, x) for d, q, x in labels}
    unseen = [(r["predicted"], of[r["doc_id"]][label == "toxic"]) for r in got if r["held_out"] and r["doc_id"] in of]
    assert len(unseen) > 50 and np.mean([p == y for p, y in unseen]) >= 0.95


def test_op5(spark, tables):
    docs = corpus()[0]
    got = queries.op5_language_id(spark, tables).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(d[0]) for d in docs)
    text, lang = {d[0]: d[1] for d in docs}, {k: sorted(LANGS)[k % 3] for k in range(600)}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or ""))) and r["lang_pred"] in (*LANGS, "und")
    unseen = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(unseen) > 100 and np.mean(unseen) >= 0.97


@pytest.mark.parametrize("query, folds, held", [("op3_toxicity", 4, 2), ("op7_quality", 5, 0), ("op5_language_id", 4, 2)])
def test_held_out_labels_change_nothing(spark, tables, query, folds, held, tmp_path):
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held) & F.col("doc_id").isNotNull()
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    if query == "op5_language_id":
        docs = docs.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang")))
    labels = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs.withColumn("source", F.col("doc_id").cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ("score", "lang_pred" if query == "op5_language_id" else "predicted")
    run = lambda path: by_row(getattr(queries, query)(spark, path).collect(), *names)
    assert run(str(tmp_path)) == run(tables)


def test_op6(spark, tables):
    rows = [r for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r["embedding"] and any(r["embedding"])]
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = defaultdict(list)
    for r in queries.op6_ann(spark, tables).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {k for k in x if k % 100 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((x[q] - x[c]) ** 2).sum())), c) for c in x if c != q)[:10]
        assert [(k, c) for k, c, _ in sorted(found)] == [(k + 1, c) for k, (_, c) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(found)], [d for d, _ in want], rtol=1e-14)


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = Counter()
    for d, t, *_ in corpus()[0]:
        ids[str(d), tuple(word.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    got = queries.op8_packing(spark, tables).collect()
    at, held = defaultdict(list), defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        at[str(r["doc_id"])].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for seq in held.values():
        end = 0
        for o, n in sorted(seq):
            assert o == end and n > 0
            end += n
        assert end <= 2048
    assert sum(sum(n for _, n in s) == 2048 for s in held.values()) >= len(held) - 1
    for (d, x), count in ids.items():
        mine = [p for p in at[d] if p[3] == len(x) and zlib.crc32(np.array(x[p[0] : p[0] + p[1]], "<u4").tobytes()) == p[2]]
        cover = np.zeros(len(x), int)
        for s, n, *_ in mine:
            cover[s : s + n] += 1
        assert (cover == count).all()
    assert sum(r["length"] for r in got) == sum(len(x) * n for (_, x), n in ids.items())


def test_op9(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").collect()
    ok = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] and any(r["embedding"]) and r["label"] is not None}
    label = {r["vec_id"]: r["label"] for r in rows}
    near = lambda a, b: a in ok and b in ok and a != b and label[a] == label[b] and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.93
    keys = sorted(label)
    root = components(keys, near)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op9_embedding_dedup(spark, tables).collect()}
    assert got == {k: (sum(near(k, o) for o in keys), root[k], root[k] == k) for k in keys}


def test_op10(spark, tables):
    docs = [(d, t) for d, t, *_ in corpus()[0]]
    fp = [golay_simhash.fingerprint(t) for _, t in docs]
    root = components(list(range(len(fp))), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    least = {g: min(d for k, (d, _) in enumerate(docs) if root[k] == g and d is not None) for g in set(root.values()) if any(docs[k][0] is not None for k in root if root[k] == g)}
    want = sorted((str(d), f"{fp[k]:016x}", str(least.get(root[k]))) for k, (d, _) in enumerate(docs))
    got = queries.op10_simhash(spark, tables).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_folds_are_those_of_the_contract(spark):
    ids = [0, 1, 7, 12345, -3, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n in (4, 5):
        got = {r["doc_id"]: r["f"] for r in df.select("doc_id", training.fold("doc_id", n).alias("f")).collect()}
        assert got == {i: -1 if i is None else remainder(i, n) for i in ids}


def test_queries_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).collect() == [], name
