"""SimHash candidates up to 5 bits apart, and the pipeline's stage that starts from them."""

import random

import pytest
from pyspark.sql import functions as F

from glosswright.llm import golay_simhash, near_copies


def flipped(rng, fp, bits):
    for k in rng.sample(range(64), bits):
        fp ^= 1 << k
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_candidates_reach_five_bits(spark):
    rng = random.Random(5)
    lone = [rng.getrandbits(64) for _ in range(150)]
    pairs = [(x, flipped(rng, x, 1 + k % 5)) for k, x in enumerate(rng.getrandbits(64) for _ in range(150))]
    middle = rng.getrandbits(64)
    crowd = {flipped(rng, middle, rng.randint(0, 2)) for _ in range(400)}
    prints = [*lone, *(x for p in pairs for x in p), *crowd]
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in golay_simhash.candidates(df).collect()]
    assert all((a ^ b).bit_count() <= 5 and a != b for a, b in got)
    assert {frozenset(p) for p in pairs} <= {frozenset(p) for p in got}
    assert not {x for p in got for x in p} & set(lone)
    inside = [p for p in got if p[0] in crowd]
    assert len(crowd) - 1 <= len(inside) <= 2 * len(crowd)  # a linear number, of which each is in one
    assert {x for p in inside for x in p} == crowd
    with pytest.raises(ValueError):
        golay_simhash.candidates(df, 6)


def test_stage_gets_candidates_from_simhash(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(6)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)) for _ in range(5)]
    rows = [t.replace(" ", f" x{k} ", 1) if k else t for t in base for k in range(4)]  # one word more
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    found, verified, whole, check = [], [], golay_simhash.candidates, near_copies._verified

    def candidates(prints, *more):
        found.append(whole(prints, *more).count())
        return whole(prints, *more)

    def counted(pairs, *more):
        verified.append(pairs.count())
        return check(pairs, *more)

    monkeypatch.setattr(golay_simhash, "candidates", candidates)
    monkeypatch.setattr(near_copies, "_verified", counted)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == list(range(0, len(rows), 4))
    assert len(found) == 1 and found[0] >= 15
    assert verified[0] >= 15 > 3 * sum(verified[1:])  # little is left to the prefixes


def test_stage_holds_no_copy_of_the_texts(spark, tmp_path):
    """What a stage returns lives on while the next one runs, with the tables cut for it."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    one, two = ("some words of the text with number %d in a row of words" % k for k in (1, 2))
    rows = [(3, one, "de"), (3, one, "en"), (None, one, "en"), (None, two, "en"), (None, two, "de"), (None, None, "en"), (0, "", "en"), (4, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in out.collect()) == [("0", "", "en"), ("3", one, "de"), ("None", two, "de")]
    held = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "RDD" in x]
    assert held and not [x for x in held if "text#" in x]
