"""Near copies that aren't similar enough, in numbers: rows made, and components in one task or by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from glosswright.llm import near_copies, toxicity


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = "".join(rng.choice("klmnop") for _ in range(6))
    return out


def made(spark, after):
    """Rows that joins of sets in different components made in SQL executions after a number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    every = lambda x: [x.apply(k) for k in range(x.size())]
    out, last = 0, -1
    for e in every(store.executionsList()):
        number = e.executionId()
        last = max(last, number)
        if number <= after:
            continue
        values = store.executionMetrics(number)
        for node in every(store.planGraph(number).allNodes()):
            if "Join" in node.name() and "a_part" in node.desc():
                for m in every(node.metrics()):
                    if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                        out += int(values.get(m.accumulatorId()).get().replace(",", ""))
    return out, last


def test_pairs_do_not_meet_at_every_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # as in a large table, no sample knows what is common
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(1500)]
        for _ in range(10):  # about 0.5 similar to each other, and each with a copy that is similar
            copy = edited(rng, base, 50)
            rows += [copy, edited(rng, copy, 3)]
    rows += [[word() for _ in range(200)] for _ in range(20)]
    texts = [" ".join(x) for x in rows]
    sets = [near_copies.shingles(t) for t in texts]
    want = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if near_copies.similar(sets[a], sets[b]):
                x, y = sorted((want[a], want[b]))
                want = [x if k == y else k for k in want]
    assert len(set(want)) == 50
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    _, before = made(spark, 1 << 60)
    got = {r["k"]: r["group"] for r in near_copies.groups(df, "k").collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert made(spark, before)[0] < 50_000  # 197,652 where pairs meet at every shingle of a prefix


@pytest.mark.parametrize("many", [0, 1 << 30])
def test_groups_whatever_is_dense(spark, monkeypatch, many):
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = random.Random(9)
    base = [["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)] for _ in range(4)]
    texts = [" ".join(edited(rng, b, rng.randint(0, 4))) for b in base for _ in range(12)]
    sets = [near_copies.shingles(t) for t in texts]
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if near_copies.similar(sets[a], sets[b]):
                x, y = sorted((want[a], want[b]))
                want = [x if k == y else k for k in want]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = {r["k"]: r["group"] for r in near_copies.groups(df, "k").collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_components_in_one_task_as_by_rounds(spark, monkeypatch):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long").repartition(3)
    few = sorted(map(tuple, near_copies._components(df).collect()))
    monkeypatch.setattr(near_copies, "LINKS", 0)
    assert few == sorted(map(tuple, near_copies._components(df).collect()))
    assert (1060, 1000) in few
    assert near_copies._components(df.where(F.lit(False))).collect() == []


def test_words_of_a_sample_are_held_once():
    one, two = toxicity._bags(["some words here", "here are words"])
    assert one == ("here", "some", "words") and two == ("are", "here", "words")
    assert one[0] is two[1] and one[2] is two[2]
