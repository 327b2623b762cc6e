"""Whole jobs made of the operators: labelled sentences, tagged samples, highlight transfer, marked pages, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import align, intervals, layout, sentences, spatial, store, tagging
from glosswright.sources import io

BLOCK = ["doc", "page", "block"]


def _numbered(words: DataFrame) -> DataFrame:
    """Words numbered from 0 within their block."""
    w = Window.partitionBy(*BLOCK).orderBy("word_no")
    return words.withColumn("word_no", F.row_number().over(w) - 1)


def _block_sentences(words: DataFrame) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    held = words.groupBy(*BLOCK).agg(F.transform(parts, lambda p: p["text"]).alias("_w"))
    return held.select(*BLOCK, F.posexplode(sentences.split_fold(F.col("_w"))).alias("sent_no", "sentence"))


def labelled_sentences(words: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, page, block, sent_no, sentence, label) of a page layout and its highlights.

    A sentence is labelled if a word of it is covered; words broken at line ends are
    put together first.
    """
    labelled = spatial.word_labels(words, marks)
    whole = _numbered(sentences.join_hyphens(labelled, *BLOCK))
    return sentences.label_sentences(_block_sentences(whole), whole, *BLOCK)


def sentence_boxes(words: DataFrame) -> DataFrame:
    """(doc, page, block, sent_no, sentence, boxes): sentences with the line and rectangle of each part of their words."""
    plain = words if "label" in words.columns else words.withColumn("label", F.lit(0))
    whole = _numbered(sentences.join_hyphens(plain, *BLOCK))
    spans = sentences.sentence_words(_block_sentences(whole), *BLOCK)
    of = spans.select(*BLOCK, "sent_no", "sentence", F.explode(F.sequence(F.col("first_word"), F.col("first_word") + F.col("n_words") - 1)).alias("word_no"))
    held = F.array_sort(F.collect_list(F.struct("word_no", "boxes")))
    got = of.join(whole.select(*BLOCK, "word_no", "boxes"), [*BLOCK, "word_no"]).groupBy(*BLOCK, "sent_no", "sentence").agg(held.alias("h"))
    return got.select(*BLOCK, "sent_no", "sentence", F.flatten(F.transform("h", lambda x: x["boxes"])).alias("boxes"))


def predicted_highlights(words: DataFrame, classify) -> DataFrame:
    """(doc, page, sent_no, line, x0, y0, x1, y1, n_boxes): what to draw on unseen documents.

    ``classify`` takes sentences (row_id, text and the rest) and returns those of
    interest, as ``SentenceClassifier.highlights`` does.  All documents go through it
    at once; one without such sentences gets no rectangles.
    """
    s = sentence_boxes(words).withColumn("row_id", F.xxhash64(*BLOCK, "sent_no")).withColumnRenamed("sentence", "text")
    found = classify(s).withColumn("sent_no", F.struct("block", "sent_no"))
    return layout.predicted_rects(found, ["doc"]).withColumn("sent_no", F.col("sent_no.sent_no"))


def sentence_files(words: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """Labelled sentences of a layout, written as a file for each document (C5); what was written."""
    out = labelled_sentences(words, marks)
    io.write_sentences(out, path, "doc")
    return out


def tagged_samples(words: DataFrame, marks: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, unclear marks): words and tags of sentences with any tag.

    A mark's tag is the first note in it, as a label; marks with several notes are
    listed as unclear, marks without one tag nothing.
    """
    paired = spatial.note_marks(notes, marks).where("mark_no is not null")
    by_mark = paired.groupBy("doc", "page", "mark_no").agg(F.min_by("content", "note_no").alias("content"), F.count("*").alias("n_notes"))
    unclear = by_mark.where("n_notes > 1").select("doc", "page", "mark_no", "n_notes")
    tagged = marks.join(by_mark.select("doc", "page", "mark_no", t.normal_label("content").alias("tag")), ["doc", "page", "mark_no"])
    tags = spatial.word_tags(words, tagged).withColumn("label", F.col("tag"))
    whole = _numbered(sentences.join_hyphens(tags, *BLOCK)).withColumnsRenamed({"text": "word", "label": "tag"})
    spans = sentences.sentence_words(_block_sentences(whole.withColumnRenamed("word", "text")), *BLOCK)
    return tagging.sentence_samples(spans, whole, BLOCK), unclear


def highlight_strings(extracts: DataFrame, doc: str = "doc_id", html: str = "html", least: int = 31) -> DataFrame:
    """(doc, item_id, text): the highlighted strings of extract pages, short ones left out."""
    marker = " "
    clean = t.qualified_lines(t.drop_cells(html, marker), marker)
    found = F.regexp_extract_all(clean, F.lit("(?s)<hl>(.*?)</hl>"), F.lit(1))
    flat = extracts.select(doc, F.explode(F.flatten(F.transform(found, lambda x: F.split(x, marker)))).alias("text"))
    plain = align.plain(t.ascii_only(t.strip_tags("text")))
    kept = flat.select(doc, plain.alias("text")).where(F.length("text") >= least).distinct()
    return kept.withColumn("item_id", F.xxhash64(doc, "text"))


def transfer_highlights(texts: DataFrame, strings: DataFrame, doc: str = "doc_id", text: str = "text", gap: int = 5) -> DataFrame:
    """(doc, html): full texts with the strings of their own extract marked.

    Each string is found approximately in the text without tags and non-ASCII
    letters, its place carried back through both offset maps, neighbouring places
    merged and widened to whole words.
    """
    bare = texts.withColumn("_flat", align.plain(text)).withColumn("_r", align.removals("_flat"))
    bare = bare.withColumn("_s", t.strip_tags("_flat")).withColumn("_u", align.removals("_s", "[^\\x00-\\x7F]+")).withColumn("_a", t.ascii_only("_s"))
    hits = align.fuzzy(bare.select(doc, F.col("_a").alias("text")), strings.select("item_id", "text"), doc=doc)
    own = hits.join(strings.select(F.col(doc), "item_id"), [doc, "item_id"], "left_semi")
    maps = bare.select(doc, "_flat", "_r", "_u")
    back = own.join(maps, doc)
    for side, shift in (("start", 0), ("end", 1)):  # an end is the place after its last character
        p = align.restored(align.restored(F.col(side) - shift, F.col("_u")), F.col("_r")) + shift
        back = back.withColumn(f"_{side}", p)
    wide = back.select(doc, align.widened(F.col("_flat"), F.col("_start"), F.col("_end")).alias("w")).select(doc, "w.start", "w.end")
    merged = intervals.merge_intervals(wide, [doc], gap=gap).drop("n_merged")
    return align.highlighted(maps.select(doc, F.col("_flat").alias(text)), merged, doc, text)


def marked_pages(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, page, html): page texts with the marked glyphs between highlight tags."""
    at = spatial.glyphs_in(glyphs, marks).select("doc", "page", "glyph_no")
    runs = intervals.islands(at, ["doc", "page"], "glyph_no")
    spans = intervals.merge_intervals(runs.select("doc", "page", F.col("first").alias("start"), (F.col("last") + 1).alias("end")), ["doc", "page"])
    chars = F.array_sort(F.collect_list(F.struct("glyph_no", "ch")))
    pages = glyphs.groupBy("doc", "page").agg(F.array_join(F.transform(chars, lambda c: c["ch"]), "").alias("text"))
    key = F.concat_ws("\u0001", "doc", F.col("page").cast("string"))
    html = align.highlighted(pages.select(key.alias("k"), "text"), spans.select(key.alias("k"), "start", "end"), "k", "text")
    named = html.select(F.split("k", "\u0001").alias("k"), "html").select(F.col("k")[0].alias("doc"), F.col("k")[1].cast("int").alias("page"), "html")
    return named.withColumn("html", F.replace("html", F.lit("\n"), F.lit("<br/>\n")))


def document_pages(pages: DataFrame, text: str = "html") -> DataFrame:
    """(doc, html): a document's pages in order."""
    parts = F.array_sort(F.collect_list(F.struct("page", text)))
    return pages.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias(text))


def annotate(glyphs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, rects) to append for the sentences that were asked for.

    ``wanted`` holds item_id and text; a sentence goes to the page where it costs least.
    """
    chars = F.array_sort(F.collect_list(F.struct("glyph_no", "ch")))
    pages = glyphs.groupBy("doc", "page").agg(F.array_join(F.transform(chars, lambda c: c["ch"]), "").alias("text"))
    keyed = pages.withColumn("k", F.struct("doc", "page"))
    hits = align.fuzzy(keyed.select(F.to_json("k").alias("k"), "text"), wanted, doc="k")
    hits = hits.withColumn("k", F.from_json("k", "doc string, page int")).select("item_id", "k.doc", "k.page", "start", "end", "cost")
    best = align.best_page(hits, ["doc", "item_id"])
    boxes = best.join(glyphs, ["doc", "page"]).where((F.col("glyph_no") >= F.col("start")) & (F.col("glyph_no") < F.col("end")))
    rows = intervals.rows_of_boxes(boxes.select("doc", "page", "item_id", "rect.*"), ["doc", "page", "item_id"])
    return store.new_marks(rows, ["doc", "item_id"])
