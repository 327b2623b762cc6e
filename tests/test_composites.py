"""Whole jobs on small layouts."""

from pyspark.sql import functions as F

from glosswright.plans import composites


def layout(spark, words):
    rows = [("d", 1, 0, line, k, w, (float(k * 10), float(line * 10), float(k * 10 + 8), float(line * 10 + 8))) for k, (line, w) in enumerate(words)]
    return spark.createDataFrame(rows, "doc string, page int, block int, line int, word_no int, text string, rect struct<x0:double,y0:double,x1:double,y1:double>")


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, mark_no int, rect struct<x0:double,y0:double,x1:double,y1:double>")


WORDS = [(0, "We"), (0, "grew"), (0, "fermen-"), (1, "tation"), (1, "broths."), (1, "It"), (1, "was"), (1, "warm.")]


def test_labelled_sentences(spark):
    got = composites.labelled_sentences(layout(spark, WORDS), marks(spark, [("d", 1, 0, (28.0, 8.0, 40.0, 20.0))]))
    assert [(r["sentence"], r["label"]) for r in got.orderBy("sent_no").collect()] == [("We grew fermentation broths.", 1), ("It was warm.", 0)]


def test_tagged_samples(spark):
    m = marks(spark, [("d", 1, 0, (20.0, 0.0, 40.0, 20.0)), ("d", 1, 1, (200.0, 0.0, 210.0, 5.0))])
    notes = spark.createDataFrame([("d", 1, 0, 25.0, 5.0, "Process: x"), ("d", 1, 1, 26.0, 5.0, "Other")], "doc string, page int, note_no int, x double, y double, content string")
    samples, unclear = composites.tagged_samples(layout(spark, WORDS), m, notes)
    r = samples.collect()
    assert len(r) == 1 and r[0]["words"] == ["We", "grew", "fermentation", "broths."] and r[0]["tags"] == ["", "", "process", ""]
    assert [(x["mark_no"], x["n_notes"]) for x in unclear.collect()] == [(0, 2)]


def test_highlight_transfer(spark):
    full = "Intro words. The <i>yeast</i> strain grew at 30°C overnight in rich medium. Tail."
    extract = "x\n<hl>The yeast strain grew at 30C overnight in rich medum.</hl>\ny"
    strings = composites.highlight_strings(spark.createDataFrame([("a", extract)], "doc_id string, html string"))
    assert strings.count() == 1
    html = composites.transfer_highlights(spark.createDataFrame([("a", full), ("b", "nothing")], "doc_id string, text string"), strings)
    got = {r["doc_id"]: r["html"] for r in html.collect()}
    assert got == {"a": full.replace("The <i>", "<hl>The <i>").replace("medium.", "medium.</hl>"), "b": "nothing"}


def glyphs(spark, text):
    rows = [("d", 0, k, c, (float(k), 0.0, float(k) + 0.9, 1.0)) for k, c in enumerate(text)]
    return spark.createDataFrame(rows, "doc string, page int, glyph_no int, ch string, rect struct<x0:double,y0:double,x1:double,y1:double>")


def test_marked_pages_and_annotation(spark):
    g = glyphs(spark, "some marked text here")
    m = spark.createDataFrame([("d", 0, 0, (5.0, 0.0, 10.5, 1.0))], "doc string, page int, mark_no int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    pages = composites.marked_pages(g, m)
    assert [r["html"] for r in pages.collect()] == ["some <hl>marked</hl> text here"]
    assert composites.document_pages(pages).first()["html"] == "some <hl>marked</hl> text here"
    new, rects = composites.annotate(g, spark.createDataFrame([(1, "some marked text")], "item_id int, text string"))
    r = rects.first()
    assert new.count() == 1 and rects.count() == 1 and (r["x0"], round(r["x1"], 1)) == (0.0, 15.9) and new.first()["mark_id"] == r["mark_id"]
