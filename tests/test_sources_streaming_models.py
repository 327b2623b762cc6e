"""Readers and writers, streams against their batch twins, features and models."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import store, tagging, terms
from glosswright.plans import features, models
from glosswright.sources import io
from glosswright.streaming import events as stream

SF = "/root/testdata/sf0.001"


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("# note\nname: 'x'\nurl: http://h:1/a\n")
    assert io.config(str(tmp_path / "c.yml")) == {"name": "x", "url": "http://h:1/a"}
    assert io.config(str(tmp_path / "none.yml")) is None


def test_annotated_documents_round_trip(spark, tmp_path):
    item = {"doc_id": "d", "doc_title": "t", "year": 2001, "url": None, "annots": [{"id": "a", "type": "highlight", "profile_id": "p", "positions": [{"top_left": {"x": 1.0, "y": 2.0}, "bottom_right": {"x": 3.0, "y": 4.0}, "page": 1}]}]}
    (tmp_path / "in.json").write_text(json.dumps([item], indent=2))
    d = io.annotated_documents(spark, str(tmp_path / "in.json"))
    assert d.first()["annots"][0]["positions"][0]["bottom_right"]["y"] == 4.0
    io.write_annotated(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["year"] == 2001
    assert io.listing(spark, str(tmp_path), "*.json").count() == 1


def test_sentence_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tA sentence here.\n0\tx\n0\tAnother one.\n")
    got = {(r["label"], r["text"], r["fold"]) for r in io.labelled_sentences(spark, str(tmp_path)).collect()}
    assert got == {(1, "A sentence here.", "a.tsv"), (0, "Another one.", "a.tsv")}
    s = spark.createDataFrame([("d1", 1, "One."), ("d2", 0, "Two.")], "doc_id string, label int, sentence string")
    io.write_sentences(s, str(tmp_path / "out"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"1\tOne.", "0\tTwo."}


def test_samples_and_classes(spark, tmp_path):
    s = spark.createDataFrame([(["a", "b"], ["", "strain"]), (["c"], [""])], "words array<string>, tags array<string>")
    io.write_samples(s, str(tmp_path / "s"))
    back = io.tagged_samples(spark, str(tmp_path / "s"))
    assert tagging.tagged_only(back).count() == 1
    w = tagging.tagged_words(back.withColumn("k", F.lit(1)), "k")
    assert sorted((r["word"], r["tag"]) for r in w.collect()) == [("a", ""), ("b", "strain"), ("c", "")]
    io.write_classes(spark.createDataFrame([("yield",), ("strain",), ("yield",), ("",)], "tag string"), str(tmp_path / "c"))
    c = io.classes(spark, str(tmp_path / "c"))
    assert [(r["idx"], r["tag"]) for r in c.orderBy("idx").collect()] == [(0, ""), (1, "strain"), (2, "yield")]
    assert {r["tag"]: r["n"] for r in tagging.class_frequency(w, c).collect()} == {"": 2, "strain": 1, "yield": 0}
    (tmp_path / "lex.txt").write_text("of the\nand the")
    assert io.lexicon(spark, str(tmp_path / "lex.txt")).count() == 3


def test_paged_source(spark, tmp_path):
    (tmp_path / "start.json").write_text(json.dumps({"items": [{"id": "1"}, {"id": "2"}], "next": "https://h/a?limit=2&marker=two"}))
    (tmp_path / "two.json").write_text(json.dumps({"items": [{"id": "3"}], "next": None}))
    assert {r["id"] for r in io.paged_items(spark, str(tmp_path), "id string").collect()} == {"1", "2", "3"}


def test_incremental_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert io.append_new(a, path, ["k"]) == 2
    assert io.append_new(a.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_cache_of_embeddings(spark):
    cache = spark.createDataFrame([(1, "x")], "id int, text string").select(io.cache_key(F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    rows = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    out, fresh = store.get_or_compute(rows, cache, io.cache_key(F.col("text")), lambda m: m.select("key", F.array(F.lit(2.0)).alias("embedding")))
    assert sorted(r["embedding"][0] for r in out.collect()) == [1.0, 2.0, 2.0] and fresh.count() == 1


def test_shredding(spark):
    docs = spark.createDataFrame(
        [("d", "T", [("A", "B")], {"doi": "1"}, ["k1", "k2"], ["u"]), ("e", None, None, None, None, None)],
        "id string, title string, authors array<struct<first_name:string,last_name:string>>, identifiers map<string,string>, keywords array<string>, websites array<string>",
    )
    assert store.scalars(docs).columns == ["id", "title"]
    assert store.authors(docs).collect()[0]["last_name"] == "B" and store.keywords(docs).count() == 2 and store.websites(docs).count() == 1
    assert store.identifiers(docs).collect()[0]["doi"] == "1" and [r["docid"] for r in store.without_websites(docs).collect()] == ["e"]


@pytest.mark.parametrize("name, f, mode", [
    ("tumbling", lambda e: stream.tumbling(e).withColumn("total", F.round("total", 6)), "complete"),
    ("sessions", stream.sessions, "complete"),
    ("sliding", stream.sliding, "complete"),
])
def test_stream_equals_batch(spark, tmp_path, name, f, mode):
    batch = stream.with_timestamp(spark.read.parquet(f"{SF}/events.parquet"))
    live = stream.event_stream(spark, f"{SF}/events.parquet")
    got = stream.drain(f(live), f"t_{name}", mode, str(tmp_path / name))
    assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))


def test_stream_state_and_duplicates(spark, tmp_path):
    live = stream.event_stream(spark, f"{SF}/events.parquet")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    once = stream.drain(stream.distinct_events(live, ["event_id"]), "t_once", "append", str(tmp_path / "o"))
    assert once.count() == batch.select("event_id").distinct().count()
    totals = stream.drain(stream.running_totals(live), "t_totals", "update", str(tmp_path / "r"))
    last = {r["user_id"]: r["n"] for r in totals.groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert last == {r["user_id"]: r["count"] for r in batch.groupBy("user_id").count().collect()}


def sentences_frame(spark):
    rows = [(k, f"yeast strain x{k % 4} grew well titer {k} mg", 1) for k in range(40)] + [(100 + k, f"the weather in town {k % 5} was nice and dry", 0) for k in range(120)]
    return spark.createDataFrame(rows, "row_id long, text string, label int").withColumn("doc", F.concat(F.lit("d"), F.col("row_id") % 3))


def test_features_match_sql(spark):
    rows = sentences_frame(spark)
    m = features.fit_features(rows, features.FeatureSpec(stopwords=("the", "in"), least=5))
    out = m.transform(rows).select("row_id", vector_to_array("features").alias("f"))
    assert "the" not in m.vocabulary and m.vocabulary == sorted(m.vocabulary)
    r = out.where("row_id = 0").first()["f"]
    assert len(r) == len(m.vocabulary) + 7
    tf = terms.term_frequency(rows.select(F.col("row_id").alias("doc_id"), F.explode(terms.bucketed(t.normal_tokens("text"))["rest"]).alias("term")))
    idf = {x["term"]: x["idf"] for x in terms.vocabulary(tf, rows.count(), 5).collect()}
    assert r[m.vocabulary.index("yeast")] == pytest.approx(idf["yeast"])
    assert r[len(m.vocabulary)] == 1.0 and r[len(m.vocabulary) + 1] == 1.0  # one number, one unit
    scaled = features.fit_scaler(m.transform(rows))(m.transform(rows)).select(vector_to_array("scaled").alias("s"))
    k = m.vocabulary.index("yeast")
    s = scaled.select(F.avg(F.col("s")[k]).alias("a"), F.stddev_pop(F.col("s")[k]).alias("d")).first()
    assert abs(s["a"]) < 1e-9 and s["d"] == pytest.approx(1.0)


def test_classifier_and_folds(spark):
    rows = sentences_frame(spark)
    c = models.SentenceClassifier(ratio=3).fit(rows)
    assert models.scores(c.predict(rows))["f1"] > 0.95 and c.highlights(rows).count() >= 38
    report = models.leave_one_out(rows, "doc")
    assert [r["fold"] for r in report] == ["d0", "d1", "d2"] and all(r["recall"] > 0.9 for r in report)


def test_model_families_and_search(spark):
    rows = sentences_frame(spark)
    m = features.fit_features(rows, features.FeatureSpec(least=5))
    x = m.transform(rows).withColumn("label", F.col("label").cast("double")).cache()
    width = len(x.first()["features"])
    for make in (models.linear_svm(10, 160), models.forest(5), models.perceptron(width, (8,), iterations=20)):
        assert models.scores(make.fit(x).transform(x))["f1"] > 0.9
    radial = models.RadialFeatures(width, 64).transform(x)
    assert models.scores(models.linear_svm(10, 160, "radial").fit(radial).transform(radial))["f1"] > 0.8
    _, best, report = models.grid_search(x, lambda c, penalty: models.logistic(c, 160, penalty, iterations=20), {"c": [0.1, 1.0], "penalty": ["l2"]}, splits=2)
    assert len(report) == 2 and best["penalty"] == "l2"
    x.unpersist()


def test_word_tagger(spark):
    rows = [("x12", "strain"), ("y34", "strain"), ("30c", "temp"), ("40c", "temp"), ("was", ""), ("and", "")] * 5
    df = spark.createDataFrame([(f" \a{w}\a ", g) for w, g in rows], "sample string, tag string")
    out = models.tag_words(models.word_tagger(1 << 10).fit(df), df)
    assert out.where("tag = predicted_tag").count() >= 28
