"""Whole jobs, saved models, and rules that small tables can't reach."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glosswright import __main__ as command
from glosswright.functions import text as t
from glosswright.operators import align, html_blocks, layout, sampling, sentences, store
from glosswright.plans import composites, features, models
from glosswright.sources import io


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_deep_and_broken_pages():
    deep = '<div class="article"><div class="abstract">' + "<p>" * 3_000 + "end"
    got = html_blocks.blocks(deep, "embo")
    assert got and got[0][0] == "paragraph" and "end" in got[0][2]
    page = '<div class="article__body"><article><section class="article-section__full"><div class="article-section__content"><p>a <span class="k" id="3">b</span><span>c</span></p></div></section></article></div>'
    assert html_blocks.blocks(page, "wiley") == [("paragraph", 0, "a ")]
    assert html_blocks.blocks(None, "wiley") == [] and html_blocks.blocks("<p>x", None) == []


def test_highlights_leave_any_run_of_tags(spark):
    assert one(spark, t.outward_highlights("h"), h="<p><i><b><hl>x</hl></b></i> y<hl> </hl></p>") == "<hl><p><i><b>x</b></i></hl> y</p>"
    assert one(spark, t.outward_highlights("h"), h="a <sub><hl>x</hl> z</sub>") == "a <hl><sub>x</hl> z</sub>"


@pytest.mark.parametrize("line", ["<br>", "</br>", "<br/>", "<br />"])
def test_cells_with_any_break(spark, line):
    assert one(spark, t.drop_cells("h", "|"), h=f"a\n1.5 (±2)%{line}b\nword{line}c\ntwo words{line}d") == f"a|b|c\ntwo words{line}d"


def test_no_break_space_is_part_of_a_word(spark):
    df = spark.createDataFrame([("We left it here. Then we came back.",)], "text string")
    fold = df.select(sentences.split_fold(t.nonblank_words("text")).alias("s")).first()["s"]
    assert df.select(sentences.split_text("text").alias("s")).first()["s"] == fold


def test_joined_words_keep_their_boxes(spark):
    rows = [("d", 0, 0, "fer-", 0, (0.0, 0.0, 4.0, 1.0)), ("d", 1, 1, "men-", 1, (0.0, 2.0, 4.0, 3.0)), ("d", 2, 2, "tation", 0, (0.0, 4.0, 6.0, 5.0)), ("d", 3, 2, "ran", 0, (7.0, 4.0, 9.0, 5.0))]
    w = spark.createDataFrame(rows, "doc string, word_no int, line int, text string, label int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    got = sentences.join_hyphens(w, "doc").orderBy("word_no").collect()
    assert [(r["text"], r["label"], [b["line"] for b in r["boxes"]]) for r in got] == [("fermentation", 1, [0, 1, 2]), ("ran", 0, [2])]


def words_frame(spark):
    text = "This strain grew very well. It was nice weather out-\nside of town today. Titer reached ten grams."
    rows, k = [], 0
    for line, part in enumerate(text.split("\n")):
        for j, w in enumerate(part.split()):
            rows.append(("d", 0, 0, line, k, w, (10.0 * j, 10.0 * line, 10.0 * j + 9, 10.0 * line + 8)))
            k += 1
    return spark.createDataFrame(rows, "doc string, page int, block int, line int, word_no int, text string, rect struct<x0:double,y0:double,x1:double,y1:double>")


def test_predicted_highlights_as_line_boxes(spark):
    w = words_frame(spark)
    got = composites.predicted_highlights(w, lambda s: s.where(F.contains("text", F.lit("weather")))).orderBy("line").collect()
    # "It was nice weather out-" on line 0 from its sixth word on, "side of town today." on line 1
    assert [(r["line"], r["x0"], r["x1"], r["n_boxes"]) for r in got] == [(0, 50.0, 99.0, 5), (1, 0.0, 39.0, 4)]
    assert composites.predicted_highlights(w, lambda s: s.where("false")).collect() == []


def test_sentence_files(spark, tmp_path):
    w = words_frame(spark)
    marks = spark.createDataFrame([("d", 0, 0, (0.0, 0.0, 9.0, 8.0))], "doc string, page int, mark_no int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    composites.sentence_files(w, marks, str(tmp_path / "s"))
    back = io.labelled_sentences(spark, f"{tmp_path}/s/*").collect()
    assert sorted((r["label"], r["text"]) for r in back) == [(0, "It was nice weather outside of town today."), (0, "Titer reached ten grams."), (1, "This strain grew very well.")]


def sentence_rows(spark):
    rows = [(k, f"yeast strain x{k % 4} grew well titer {k} mg", 1) for k in range(40)] + [(100 + k, f"the weather in town {k % 5} was nice and dry", 0) for k in range(120)]
    return spark.createDataFrame(rows, "row_id long, text string, label int")


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = sentence_rows(spark)
    c = models.SentenceClassifier(spec=features.FeatureSpec(stopwords=("the",), least=3)).fit(rows)
    c.save(spark, str(tmp_path / "m"))
    again = models.SentenceClassifier.load(spark, str(tmp_path / "m"))
    assert again.spec == c.spec and again.features.vocabulary == c.features.vocabulary
    said = lambda m: [(r["row_id"], r["prediction"], r["probability"]) for r in m.predict(rows).orderBy("row_id").collect()]
    assert said(again) == said(c)
    x = c.features.transform(rows)
    io.save_samples(x, str(tmp_path / "x"))
    flat = lambda df: sorted((r["label"], tuple(r["f"])) for r in df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("f")).collect())
    assert flat(io.load_samples(spark, str(tmp_path / "x"))) == flat(x)


def test_repeated_rows_count_in_idf(spark):
    rows = spark.createDataFrame([("alpha beta",)] * 10 + [("beta gamma",)] * 5, "text string")
    m = features.fit_features(rows, features.FeatureSpec(least=5))
    assert dict(zip(m.vocabulary, m.idf)) == pytest.approx({"alpha": 0.4054651, "beta": 0.0, "gamma": 1.0986123})
    with pytest.raises(ValueError):
        features.fit_features(rows, features.FeatureSpec(least=5), most=2)


def test_sigmoid_kernel_and_tagger(spark):
    rows = sentence_rows(spark)
    x = features.fit_features(rows).transform(rows).withColumn("label", F.col("label").cast("double")).cache()
    s = models.SigmoidFeatures(x, size=40).transform(x)
    assert len(s.first()["sigmoid"]) == 40 and models.scores(models.linear_svm(10, 160, "sigmoid").fit(s).transform(s))["f1"] > 0.8
    x.unpersist()
    words = [("x12", "strain"), ("y34", "strain"), ("30c", "temp"), ("40c", "temp"), ("was", ""), ("and", "")] * 10
    df = spark.createDataFrame([(k, f" \a{w}\a ", g) for k, (w, g) in enumerate(words)], "row_id int, sample string, tag string")
    model, history = models.fit_tagger(df, iterations=(5, 20), features=1 << 10)
    assert history[0]["iterations"] == 5 and all(0 <= r["val_accuracy"] <= 1 for r in history)
    assert len(io.history(history)) == 3 * len(history)
    got = models.tag_sentence(model, spark, "we grew x12 at 30c").orderBy("pos").collect()
    assert [r["word"] for r in got] == ["we", "grew", "x12", "at", "30c"] and all(r["predicted_tag"] in ("", "strain", "temp") for r in got)


def test_reports_and_texts(spark, tmp_path):
    import numpy as np

    io.write_search(spark, [{"c": 1.0, "mean_f1": np.float64(0.5), "all": np.array([1, 2])}], str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"all": [1, 2], "c": 1.0, "mean_f1": 0.5}
    io.write_history(spark, [{"loss": 1.0, "accuracy": 0.5}], str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2


def test_nested_configuration(tmp_path):
    p = tmp_path / "c.yml"
    p.write_text("# about\nclientId: 12\nname: 'a: b' # why\nfolders:\n  pdf: /x\n  deep:\n    on: true\n  out: /y\nkinds:\n- a\n- b\nlast: ~\n")
    assert io.config(str(p)) == {"clientId": "12", "name": "a: b", "folders": {"pdf": "/x", "deep": {"on": True}, "out": "/y"}, "kinds": ["a", "b"], "last": None}
    assert io.config(str(tmp_path / "none.yml")) is None


def test_database_through_jdbc(spark):
    url = "jdbc:derby:memory:shelf;create=true"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="docs", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("append").save()
    got = io.database(spark, url, 'SELECT * FROM docs WHERE "id" > 1', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted((r[0], r[1]) for r in got.collect()) == [(2, "b"), (3, None)]


def test_layout_tables_from_json(spark, tmp_path):
    from glosswright.sources import schemas

    for name, schema, line in (
        ("words", schemas.WORDS, '{"doc":"d","page":1,"block":0,"line":2,"word_no":3,"text":"x","rect":{"x0":0,"y0":1,"x1":2,"y1":3}}'),
        ("glyphs", schemas.GLYPHS, '{"doc":"d","page":1,"glyph_no":3,"ch":"x","rect":{"x0":0,"y0":1,"x1":2,"y1":3}}'),
        ("runs", schemas.FONT_RUNS, '{"doc":"d","page":1,"font":"Times-Bold","size":9.5,"underlined":false,"colour":"#000000","start":0,"end":4}'),
        ("marks", schemas.MARKS, '{"doc":"d","page":1,"mark_no":0,"rect":{"x0":0,"y0":1,"x1":2,"y1":3}}'),
    ):
        (tmp_path / f"{name}.json").write_text(line + "\n")
        r = io.layout_table(spark, str(tmp_path / f"{name}.json"), schema).first()
        assert r["doc"] == "d" and r["page"] == 1 and None not in tuple(r)


def test_actions_need_their_arguments(spark, tmp_path):
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    put([(1, "a"), (2, ""), (3, "b")], "group_id int, name string", "groups")
    put([(10, 1), (11, 3), (12, 1)], "document_id int, group_id int", "remote")
    put([("m1", "automatic"), ("m2", "me")], "mark_id string, author string", "marks")
    put([("m1", 1), ("m2", 2)], "mark_id string, page int", "rects")
    run = lambda *args: command.actions(spark, command.parser().parse_args([str(tmp_path), *args]))
    assert run() == {} and run("--list-documents") == {} and run("--annotate", "-d", "x") == {}
    got = run("--list-groups", "--list-documents", "-g", "a", "--remove-annotation")
    assert [r[0] for r in got["groups"].collect()] == ["a", "b"] and [r[0] for r in got["documents"].collect()] == [10, 12]
    assert got["kept_marks"].count() == 1 and got["kept_rects"].first()["mark_id"] == "m2"


def test_authors_may_be_demanded(spark):
    d = spark.createDataFrame([("1", [("A", "B")]), ("2", None)], "id string, authors array<struct<first_name:string,last_name:string>>")
    assert store.authors(d).count() == 1
    with pytest.raises(Exception, match="no authors in 2"):
        store.authors(d, strict=True).collect()


def test_samples_have_their_size(spark):
    rows = spark.range(5_000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    for n in (0, 1, 17, 4_999, 5_000, 9_000):
        assert sampling.smallest_hashes(rows, n, "id").count() == min(n, 5_000)
    a, b = (sampling.smallest_hashes(rows.repartition(k), 100, "id").select("id") for k in (2, 7))
    assert a.exceptAll(b).isEmpty()
    with pytest.raises(ValueError):
        sampling.balanced(rows.where("label = 1 or id < 5"), "id", ratio=1, strict=True)


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))

    def spoilt(x, share):
        out = []
        for c in x:
            r = rng.random()
            out.append("" if r < share / 2 else c + rng.choice("xyz") if r < share else c)
        return "".join(out)

    p = [(k, some(rng.randint(12, 60))) for k in range(12)] + [(20, some(260)), (21, "short one"), (22, None)]
    docs = []
    for k in range(30):
        held = rng.choice(p[:13])[1]
        docs.append((k, some(rng.randint(0, 120)) + "  \n" + spoilt(held, rng.choice([0, 0.05, 0.1])) + " " + some(rng.randint(0, 120))))
    return p, docs + [(90, None), (91, ""), (92, "a")]


def test_fuzzy_finds_what_a_full_scan_finds(spark):
    p, docs = passages()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(p, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["cost"]) for r in align.fuzzy(d, q).collect()}
    want = {}
    for k, text in docs:
        flat = " ".join((text or "").split())
        for i, x in p:
            if x and len(x) <= align.CHUNK:
                s, e, c = align.best_match(flat, x)
                if c <= min(200, -(-len(x) // 5)):
                    want[k, i] = (s, e, c)
    short = {k: v for k, v in got.items() if k[1] < 20}
    assert {k: v[2] for k, v in short.items()} == {k: v[2] for k, v in want.items() if k[1] < 20} and len(short) > 15
    assert all(abs(short[k][0] - want[k][0]) <= 2 and abs(short[k][1] - want[k][1]) <= 2 for k in short)
    held = {k for k, text in docs if text and p[12][1][:20] in " ".join(text.split())}
    long = {k[0]: v for k, v in got.items() if k[1] == 20}
    assert set(long) >= held  # a passage of several chunks is one place
    assert align.fuzzy(d.limit(0), q).collect() == [] and align.fuzzy(d, q.limit(0)).collect() == []


def test_least_costs_of_many_pairs():
    rng = random.Random(4)
    x = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    p = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    assert align.least_costs(x, p).tolist() == [align.best_match(a, b)[2] for a, b in zip(x, p)]


def test_containing_passages_of_any_length(spark):
    docs = [(1, "one two three four five six"), (2, "two three"), (3, "x two"), (4, None), (5, "one two three four five seven")]
    p = [(1, "two"), (2, "two three"), (3, "one two three four five six"), (4, ""), (5, None), (6, "two three four five seven")]
    got = align.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(p, "item_id int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (5, 1), (5, 2), (5, 6)]


def test_nested_and_touching_tags(spark):
    pages = spark.createDataFrame([(1, "abcdef\ng"), (2, "x")], "k int, text string")
    seg = spark.createDataFrame([(1, 0, 4, "b"), (1, 2, 4, "i"), (1, 4, 6, "hl")], "k int, start int, end int, tag string")
    got = {r["k"]: r["html"] for r in layout.formatted(pages, seg, ["k"]).collect()}
    assert got == {1: "<b>ab<i>cd</i></b><hl>ef</hl><br/>\ng", 2: "x"}
