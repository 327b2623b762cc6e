"""Page layouts: glyphs and their attributes, font runs, rectangles by page, formatted page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import geometry as g
from glosswright.functions import text as t
from glosswright.operators import intervals, spatial

#: The attribute of glyphs that a mark covers.
MARKED = "hl"


def glyph_table(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, glyph_no, ch): a row for each character of each page's text."""
    return pages.select(*keys, F.posexplode(t.glyph_rows(text)).alias("glyph_no", "ch"))


def numbered_pages(docs: DataFrame, doc: str, pages: str = "pages", first: int = 1) -> DataFrame:
    """(doc, page, text) of an array of page texts, numbered from ``first``: 1 for given marks, 0 for predicted ones."""
    return docs.select(doc, F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + first)


def without_attributes(glyphs: DataFrame) -> DataFrame:
    """Glyphs with an empty list of attributes."""
    return glyphs.withColumn("attrs", F.array().cast("array<string>"))


def attributed(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """Glyphs with their attributes: ``hl`` where a mark touches them."""
    hit = spatial.glyphs_in(glyphs, marks).select("doc", "page", "glyph_no").withColumn("_hit", F.lit(True))
    bare = without_attributes(glyphs).join(hit, ["doc", "page", "glyph_no"], "left")
    return bare.withColumn("attrs", F.when(F.col("_hit"), F.array_append("attrs", F.lit(MARKED))).otherwise(F.col("attrs"))).drop("_hit")


def carrying(glyphs: DataFrame, attribute: str = MARKED) -> DataFrame:
    """Glyphs that have an attribute."""
    return glyphs.where(F.array_contains("attrs", attribute))


def index_segments(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, page, first, last): runs of marked glyphs (C17)."""
    return intervals.islands(carrying(attributed(glyphs, marks)), ["doc", "page"], "glyph_no")


def font_segments(runs: DataFrame, predicate: Column, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, start, end) of font runs that a predicate on ``font`` accepts."""
    return runs.where(predicate).select(*keys, "start", "end")


def distinct_fonts(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The fonts of all runs, or of each key's."""
    return runs.select(*keys, "font").distinct()


def format_tags(runs: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, start, end, tag): bold, italic and lowered stretches by their fonts."""
    small = intervals.smaller_runs(runs, list(keys)).select(*keys, "start", "end")
    parts = [(font_segments(runs, t.bold_font("font"), keys), "b"), (font_segments(runs, t.italic_font("font"), keys), "i"), (small, "sub")]
    tagged = [x.withColumn("tag", F.lit(name)) for x, name in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def formatted(pages: DataFrame, segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, html): page texts with tags at the borders of segments (start, end, tag); line feeds become breaks.

    At one place tags close before others open; those that opened last close first.
    """
    ends = F.explode(F.array(
        F.struct(F.col("end").alias("at"), F.lit(0).alias("side"), (-F.col("start")).alias("nest"), F.col("tag")),
        F.struct(F.col("start").alias("at"), F.lit(1).alias("side"), (-F.col("end")).alias("nest"), F.col("tag")),
    ))
    borders = segments.where("start < end").select(*keys, ends.alias("b")).groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("_b"))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))
    tag = lambda b: F.when(b["side"] == 0, F.concat(F.lit("</"), b["tag"], F.lit(">"))).otherwise(F.concat(F.lit("<"), b["tag"], F.lit(">")))
    none = F.array().cast("array<struct<at:int,side:int,nest:int,tag:string>>")
    body = F.aggregate(
        F.coalesce(F.col("_b").cast("array<struct<at:int,side:int,nest:int,tag:string>>"), none), zero,
        lambda a, b: F.struct(b["at"].alias("at"), F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, b["at"] - a["at"]), tag(b)).alias("out")),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    return pages.join(borders, keys, "left").select(*keys, F.replace(body, F.lit("\n"), F.lit("<br/>\n")).alias("html"))


def rects_by_page(rects: DataFrame, keys: tuple[str, ...] = ("doc", "page"), order: str = "mark_no") -> DataFrame:
    """(keys, rects): each page's rectangles in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "rect")))
    return rects.groupBy(*keys).agg(F.transform(held, lambda x: x["rect"]).alias("rects"))


def rect_json(rect: str = "rect") -> Column:
    """A rectangle as a JSON list of its sides."""
    return F.to_json(F.array(*(F.col(f"{rect}.{s}") for s in ("x0", "y0", "x1", "y1"))))


def true_rects(annots: DataFrame, height: Column) -> DataFrame:
    """(doc_id, page, kind, id, rect): given highlights, and notes as points, on pages with y downwards.

    ``annots`` hold doc_id, id, type and positions; ``height`` is the height of their page.
    """
    p = annots.select("doc_id", "id", "type", F.explode("positions").alias("p")).where("p.top_left is not null and p.bottom_right is not null")
    up = F.struct(F.col("p.top_left.x").alias("x0"), F.col("p.bottom_right.y").alias("y0"), F.col("p.bottom_right.x").alias("x1"), F.col("p.top_left.y").alias("y1"))
    kind = F.when(F.col("type") == "sticky_note", "note").otherwise("highlight")
    return p.select("doc_id", F.col("p.page").alias("page"), kind.alias("kind"), "id", up.alias("rect")).withColumn("rect", g.flipped("rect", height))


def predicted_rects(sents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, line, x0, y0, x1, y1): the line boxes to draw for sentences of interest.

    ``sents`` hold page, sent_no and boxes (line, rect) of sentences that were predicted;
    a table without sentences gives no rectangles, so nothing is drawn.
    """
    b = sents.select(*keys, "page", "sent_no", F.posexplode("boxes").alias("box_no", "b"))
    flat = b.select(*keys, "page", "sent_no", "box_no", F.col("b.line").alias("line"), "b.rect.x0", "b.rect.y0", "b.rect.x1", "b.rect.y1")
    return intervals.merge_line_boxes(flat, [*keys, "page", "sent_no"], "box_no").drop("box_no")


def page_numbers(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with ``page``, counted from 1 in an order within their keys, where a source gives none."""
    return rows.withColumn("page", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))


def all_of(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, columns by name."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def distinct_of(*tables: DataFrame) -> DataFrame:
    """The distinct rows of all tables."""
    return all_of(*tables).distinct()
