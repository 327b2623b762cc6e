"""Golden cases, written from the rules."""

import pytest
from pyspark.sql import functions as F

from glosswright.functions import geometry, text as t
from glosswright.operators import align, evaluation, html_blocks, intervals, sampling, sentences, spatial, store, tagging, terms


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if not isinstance(v, (str, int, float)) else F.lit(v))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, expected", [
    ([(10, 14), (0, 3), (18, 25)], [(0, 3), (10, 25)]),
    ([(10, 14), (0, 3), (19, 25)], [(0, 3), (10, 14), (19, 25)]),
    ([(0, 50), (10, 20), (54, 60)], [(0, 60)]),
    ([], []),
])
def test_interval_merge(spark, given, expected):
    df = spark.createDataFrame([(1, a, b) for a, b in given], "k int, start int, end int")
    got = intervals.merge_intervals(df, ["k"], gap=5)
    assert sorted((r["start"], r["end"]) for r in got.collect()) == expected
    again = intervals.merge_intervals(got.drop("n_merged"), ["k"], gap=5)
    assert sorted((r["start"], r["end"]) for r in again.collect()) == expected


def test_islands_and_complement(spark):
    df = spark.createDataFrame([(1, v) for v in (4, 5, 6, 9, 11, 12, 12)], "k int, v int")
    assert sorted((r["first"], r["last"]) for r in intervals.islands(df, ["k"], "v").collect()) == [(4, 6), (9, 9), (11, 12)]
    s = spark.createDataFrame([(1, 2, 5), (1, 4, 8), (1, 10, 12)], "k int, start int, end int")
    free = intervals.complement(s, ["k"], F.lit(15))
    assert sorted((r["start"], r["end"]) for r in free.collect()) == [(0, 2), (8, 10), (12, 15)]


def test_interval_subtraction(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 5), (3, 1, 4)], "k int, start int, end int")
    holes = spark.createDataFrame([(1, 4, 6), (1, 28, 40), (2, 0, 5), (3, 4, 9)], "k int, start int, end int")
    got = sorted((r["k"], r["start"], r["end"]) for r in intervals.subtract(s, holes, ["k"]).collect())
    assert got == [(1, 0, 4), (1, 6, 10), (1, 20, 28), (3, 1, 4)]


@pytest.mark.parametrize("text, expected", [
    ("See Fig. 1 for it. Dr. Smith et al. ran 5. Then a b. ok", ["See Fig. 1 for it.", "Dr. Smith et al. ran 5.", "Then a b. ok"]),
    ("Go now. We left it.", ["Go now. We left it."]),
    ("", []),
])
def test_sentence_split(spark, text, expected):
    assert sentences.sentences_of(text.split()) == expected
    fold = one(spark, sentences.split_fold(t.nonblank_words("s")), s=text)
    assert fold == expected
    assert one(spark, sentences.split_text("s"), s=text) == expected


def test_hyphens_join_whole_chains(spark):
    rows = [(1, 0, 1, "fermen-", 0), (1, 1, 2, "ta-", 1), (1, 2, 3, "tion", 0), (1, 3, 3, "well-", 0), (1, 4, 3, "fed", 0)]
    df = spark.createDataFrame(rows, "d int, word_no int, line int, text string, label int")
    got = [(r["text"], r["label"]) for r in sentences.join_hyphens(df, "d").orderBy("word_no").collect()]
    assert got == [("fermentation", 1), ("well-", 0), ("fed", 0)]


def test_sentence_labels(spark):
    s = spark.createDataFrame([(1, 0, "a b c."), (1, 1, "d e.")], "d int, sent_no int, sentence string")
    w = spark.createDataFrame([(1, i, int(i == 4)) for i in range(5)], "d int, word_no int, label int")
    assert {r["sent_no"]: r["label"] for r in sentences.label_sentences(s, w, "d").collect()} == {0: 0, 1: 1}


@pytest.mark.parametrize("word, expected", [
    ("30c", "number"), ("-x", "number"), ("ab1-cd2", "A1-A1"), ("ABC12", "UPPER"), ("YeastCell", "CamelCase"), ("yield", None), ("mg", "unit"),
])
def test_buckets(spark, word, expected):
    assert one(spark, t.token_bucket("w"), w=word) == expected


def test_text_functions(spark):
    assert one(spark, t.normal_label("x"), x="Strain Name: X12 ") == "strain name"
    assert one(spark, t.full_text_url("x"), x="http://aem.asm.org/content/1") == "http://aem.asm.org/content/1.full"
    assert one(spark, t.drop_span_tags("x"), x='<span id="q"> w </span>') == " w "
    assert one(spark, t.publisher("x"), x='<META content="https://www.nature.com/x" name="citation_pdf_url">') == "nature"
    assert one(spark, t.publisher("x"), x="<p>none</p>") == "WARNING"
    assert one(spark, t.before_marker("x"), x="x y z iiii  iiii PPPP") == "x y z "
    assert one(spark, t.before_marker("x"), x="no marker") == "no marker"
    assert one(spark, t.equal_chunks("x", 3), x="abcdefg") == ["abc", "def", "g"]
    assert one(spark, t.hex_colour(F.lit(255), F.lit(0), F.lit(16))) == "#ff0010"
    assert one(spark, t.outward_highlights("x"), x="<hl> </hl><i><hl>a</hl></i>") == "<hl><i>a</i></hl>"
    assert one(spark, t.preferred_url("a", "b"), a="", b="u") == "u"
    assert one(spark, t.next_marker("x"), x="https://h/a?limit=2&marker=abc") == "abc"
    for name, bold, italic in (("Arial-Bold", True, False), ("X-BI", True, True), ("TimesBdIt", True, True), ("AdvPTimesB", True, False), ("Courier", False, False), ("F.i", False, True)):
        assert one(spark, t.bold_font("x"), x=name) == bold and one(spark, t.italic_font("x"), x=name) == italic, name


def test_character_samples(spark):
    words = "grown at 30°C overnight".split()
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "d int, i int, word string")
    c = tagging.context(df, ["d"], "i").withColumn("s", tagging.sample_text("before", "word", "after"))
    c = c.withColumn("z", tagging.character_sample(F.col("s")))
    got = c.orderBy("i").collect()
    assert [r["s"].replace("\a", "^") for r in got] == [" ^grown^ at", "grown ^at^ 30\\xb0C", "at ^30\\xb0C^ overnight", "30\\xb0C ^overnight^ "]
    assert all(len(r["z"]) == 100 for r in got) and got[0]["z"][10] == ord("t") and got[0]["z"][11] == 0


def test_idf_and_cut_off(spark):
    docs = spark.createDataFrame([(1, "yeast yield yeast"), (2, "yeast titer"), (3, "titer titer yield strain")], "doc_id int, text string")
    tf = terms.term_frequency(terms.terms(docs))
    idf = {r["term"]: round(r["idf"], 6) for r in terms.vocabulary(tf, 3, least=1).collect()}
    assert idf == {"yeast": 0.405465, "yield": 0.405465, "titer": 0.405465, "strain": 1.098612}
    assert {r["term"] for r in terms.vocabulary(tf, 3, least=3).collect()} == {"yeast", "titer"}


def test_population_deviation(spark):
    df = spark.createDataFrame([([1.0],), ([3.0],), ([5.0],)], "features array<double>")
    assert round(evaluation.scaler(df).first()["std"], 6) == 1.632993


def rect(*v):
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))))


def test_rectangles(spark):
    base = spark.range(1).withColumn("a", rect(0, 0, 10, 10))
    for other, share in (((0, 0, 10, 5), False), ((0, 0, 10, 6), True)):
        assert base.withColumn("b", rect(*other)).select((geometry.covered("a", "b") > 0.5).alias("x")).first()["x"] == share
    touch = spark.range(1).withColumn("a", rect(0, 0, 4, 4)).withColumn("b", rect(4, 4, 8, 8))
    assert touch.select(geometry.touches("a", "b").alias("x")).first()["x"]
    f = spark.range(1).withColumn("a", rect(0, 20, 5, 30)).select(geometry.flipped("a", F.lit(100.0)).alias("f")).first()["f"]
    assert (f["y0"], f["y1"]) == (70.0, 80.0)
    flat = spark.range(1).withColumn("a", rect(1, 1, 1, 5)).withColumn("b", rect(0, 0, 9, 9))
    assert flat.select(geometry.covered("a", "b").alias("x")).first()["x"] is None


def test_spatial_labels(spark):
    w = spark.createDataFrame([("d", 1, 0, 0.0), ("d", 1, 1, 20.0)], "doc string, page int, word_no int, x double").select(
        "doc", "page", "word_no", F.struct(F.col("x").alias("x0"), F.lit(0.0).alias("y0"), (F.col("x") + 10).alias("x1"), F.lit(10.0).alias("y1")).alias("rect"))
    m = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "b")], "doc string, page int, mark_no int, tag string").withColumn("rect", rect(0, 0, 10, 9))
    assert [r["label"] for r in spatial.word_labels(w, m).orderBy("word_no").collect()] == [1, 0]
    assert [r["tag"] for r in spatial.word_tags(w, m).orderBy("word_no").collect()] == ["b", ""]


@pytest.mark.parametrize("text, pattern, cost", [("we ferment it", "fermant", 2), ("the yields are", "yield", 0), ("yiels", "yields", 1), ("", "ab", 2)])
def test_alignment_cost(text, pattern, cost):
    a, b, c = align.best_match(text, pattern)
    assert c == cost
    # by brute force over all substrings
    from functools import lru_cache

    def indel(x, y):
        @lru_cache(None)
        def lcs(i, j):
            return 0 if not i or not j else lcs(i - 1, j - 1) + 1 if x[i - 1] == y[j - 1] else max(lcs(i - 1, j), lcs(i, j - 1))
        return len(x) + len(y) - 2 * lcs(len(x), len(y))

    assert c == min(indel(text[i:j], pattern) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert indel(text[a:b], pattern) == c


def test_fuzzy_finds_edited_copies(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = spark.createDataFrame([(1, "x y " + passage.replace("jumps", "jumpd") + " end"), (2, "nothing of the sort is here"), (3, None)], "doc_id int, text string")
    got = align.fuzzy(docs, spark.createDataFrame([(7, passage), (8, None)], "item_id int, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["cost"]) for r in got] == [(1, 7, 2)]


def test_offset_map_round_trip(spark):
    raw = "a<b>c</b>d<i></i>e"
    row = spark.createDataFrame([(raw,)], "x string").select(align.removals("x").alias("r"), t.strip_tags("x").alias("c"))
    r = row.first()
    assert [(x["start"], x["len"]) for x in r["r"][:2]] == [(1, 3), (5, 4)]
    for p, ch in enumerate(r["c"]):
        assert raw[row.select(align.restored(F.lit(p), F.col("r")).alias("p")).first()["p"]] == ch


def test_widen_and_highlight(spark):
    df = spark.createDataFrame([(1, "some yeast strains grew", 7, 12)], "doc_id int, text string, s int, e int")
    w = df.select("doc_id", align.widened(F.col("text"), F.col("s"), F.col("e")).alias("w")).select("doc_id", "w.*")
    assert [(r["start"], r["end"]) for r in w.collect()] == [(5, 18)]
    html = align.highlighted(df.select("doc_id", "text"), w).first()["html"]
    assert html == "some <hl>yeast strains</hl> grew"


def test_exact_samples(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") < 10).cast("int").alias("label"))
    s = sampling.balanced(rows, "id", ratio=3)
    assert s.where("label = 1").count() == 10 and s.where("label = 0").count() == 30
    again = sampling.balanced(rows.repartition(7), "id", ratio=3)
    assert {r["id"] for r in s.collect()} == {r["id"] for r in again.collect()}
    assert sampling.balanced(rows, "id", ratio=20).count() == 100
    with pytest.raises(ValueError):
        sampling.balanced(rows, "id", ratio=20, strict=True)


def test_zero_guard(spark):
    df = spark.createDataFrame([("f", 1, 0)], "fold string, label int, predicted int")
    r = evaluation.precision_recall(df, "fold").first()
    assert (r["precision"], r["recall"]) == (0.0, 0.0)


def test_store(spark):
    marks = spark.createDataFrame([("m1", "automatic"), ("m2", "me")], "mark_id string, author string")
    rects = spark.createDataFrame([("m1",), ("m2",), ("m2",)], "mark_id string")
    m, r = store.without_automatic(marks, rects)
    assert m.count() == 1 and r.count() == 2
    docs = spark.createDataFrame(
        [("d", [("a1", "highlight", "p", "t", [((1.0, 2.0), (3.0, 4.0), 1), ((1.0, 2.0), None, 2)]), ("a2", "note", "p", "t", None), ("a3", "sticky_note", "p", "t", None)])],
        "doc_id string, annots array<struct<id:string,type:string,profile_id:string,text:string,positions:array<struct<top_left:struct<x:double,y:double>,bottom_right:struct<x:double,y:double>,page:int>>>>",
    )
    a = store.annotations(docs)
    assert {(r["id"], r["text"]) for r in a.collect()} == {("a1", None), ("a3", "t")}
    assert sorted((r["page"], r["location_type"]) for r in store.corners(a).collect()) == [(1, "bottom_right"), (1, "top_left"), (2, "top_left")]


PAGES = {
    "embo": '<div class="article"><div class="abstract"><p>Abs <a>x</a>t</p></div><div id="sec-1"><p>Body <i>i</i></p></div><div class="fig-caption"><p>Cap</p></div></div>',
    "pubmed": '<div class="article"><div id="__sec1"><p id="__p1">One<a class="bibr">1</a></p></div><p id="__p9">Late</p><div class="caption"><p id="__p77">Cap</p></div><table><td>1</td></table></div>',
    "nature": '<article><div data-track-component="article body"><section aria-labelledby="abstract"><p>A<sup><a>1</a></sup></p><figure><p>Cap</p></figure></section></div></article>',
    "asm": '<div class="article"><div class="section" id="sec-1"><p id="p-2">Two</p><div class="fig"><p id="p-3">Cap</p></div></div><p id="p-1">One<a class="xref-bibr">1</a></p></div>',
    "springer": '<main><article><section class="Abstract"><p>Abs</p></section><div id="body"><p class="Para">P<span>x</span> <em>e</em></p><div class="Para">D<figure>f</figure></div><div class="CaptionContent"><p class="SimplePara">Cap</p></div><table><td>1</td></table></div></article></main>',
    "bmc": '<main><div id="Sec1"><p class="Para">P <strong>s</strong></p></div><div class="TableFooter">F</div></main>',
    "wiley": '<div class="article__body"><article><section class="article-section__abstract"><p>Abs\nlink\nlink</p></section><section class="article-section__full"><div class="article-section__content"><p>P<a>1</a></p><figure><figcaption><div><p>Cap</p></div></figcaption></figure></div><td>1</td></section></article></div>',
    "elsevier": '<div class="Abstracts"><p>Abs</p></div><div class="Body"><div><p>P <a title="Learn more about x">x</a><a class="workspace-trigger">1</a></p><div class="figure"><p>Cap</p></div><td class="q">1</td></div></div>',
}
EXPECTED = {
    "embo": {"paragraph": ["Abs t", "Body <i>i</i>"], "caption": ["Cap"]},
    "pubmed": {"paragraph": ["One"], "caption": ["Cap"], "cell": ["1"]},
    "nature": {"paragraph": ["A"], "caption": ["Cap"]},
    "asm": {"paragraph": ["One", "Two"], "caption": ["Cap"]},
    "springer": {"paragraph": ["Abs", "P <i>e</i>", "D"], "caption": ["Cap"], "cell": ["1"]},
    "bmc": {"paragraph": ["P s"], "caption": ["F"]},
    "wiley": {"paragraph": ["Abs", "P"], "caption": ["Cap"], "cell": ["1"]},
    "elsevier": {"paragraph": ["Abs", "P x"], "caption": ["Cap"], "cell": ["1"]},
}


@pytest.mark.parametrize("publisher", sorted(PAGES))
def test_html_blocks(publisher):
    got = {}
    for kind, _, text in html_blocks.blocks(PAGES[publisher], publisher):
        got.setdefault(kind, []).append(text)
    assert got == EXPECTED[publisher]
    assert html_blocks.blocks(PAGES[publisher], "WARNING") == [] and html_blocks.blocks(None, publisher) == [] and html_blocks.blocks("", publisher) == []


def test_html_table_function(spark):
    df = spark.createDataFrame([(1, '<meta name="citation_pdf_url" content="https://msb.embopress.org/x">' + PAGES["embo"]), (2, "<p>x"), (3, None)], "page_id int, html string")
    got = html_blocks.page_blocks(df).collect()
    assert sorted((r["page_id"], r["kind"], r["block"]) for r in got) == [(1, "caption", "Cap"), (1, "paragraph", "Abs t"), (1, "paragraph", "Body <i>i</i>")]
