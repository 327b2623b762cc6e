"""Near copies against brute force, and the pipeline's stage on them."""

import random

import pytest
from pyspark.sql import functions as F

from glosswright.llm import near_copies


def texts():
    """Unrelated texts, texts with a passage in common, copies with edits, chains of edits, and odd ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    some = lambda n: [word() for _ in range(n)]
    passage = some(60)
    out = [some(rng.randint(40, 120)) for _ in range(20)]
    out += [some(50) + passage + some(rng.randint(0, 50)) for _ in range(15)]
    for _ in range(12):
        base = some(rng.randint(60, 200))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    for _ in range(4):
        at = some(100)
        for _ in range(8):  # ends are far from each other
            out.append(at)
            at = at[3:] + some(3)
    return [" ".join(x) for x in out] + ["", None, "  ", "one two", "One  two", "one two three four five", "x"]


def brute(rows):
    sets = [near_copies.shingles(t) for t in rows]
    root = list(range(len(rows)))

    def up(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(set(sets[a]) | set(sets[b]))
            if not union or len(set(sets[a]) & set(sets[b])) / union >= 0.8:
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return [up(k) for k in range(len(rows))]


def test_groups_by_brute_force(spark):
    rows = texts()
    want = brute(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string").repartition(3)
    got = {r["k"]: r["group"] for r in near_copies.groups(df, "k").collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert 20 < len(set(want)) < len(rows) - 50
    assert near_copies.groups(df.limit(0), "k").collect() == []


def test_stage_keeps_one_of_near_copies(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute(rows)))


def test_stage_decides_by_row(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    a, b, c, d = (t for t in texts()[:4])
    rows = [(None, a), (None, b), (None, b), (5, c), (5, c), (1, d), (7, d), (7, "another text under the id seven, seen once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted([("None", a), ("None", b), ("5", c), ("1", d), ("7", rows[-1][1])])
