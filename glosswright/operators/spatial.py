"""Joins of words, glyphs and notes with rectangles.

All have (doc, page) as equality keys, so none becomes a product of tables; a page's
rectangles are few.  ``grid`` adds a third key where pages hold many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import geometry as g

KEYS = ["doc", "page"]


def _pairs(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & condition
    return a.join(b, on, how)


def word_labels(words: DataFrame, marks: DataFrame, share: float = 0.5) -> DataFrame:
    """Words with label 1 if some mark covers over ``share`` of them, else 0.

    Both hold doc, page and rect; a word without area is never covered.
    """
    hit = _pairs(words.withColumn("r", F.col("rect")), marks.withColumn("m", F.col("rect")), g.covered("r", "m") > share, "left_semi")
    found = hit.select("doc", "page", "word_no").withColumn("label", F.lit(1))
    return words.join(found, [*KEYS, "word_no"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def word_tags(words: DataFrame, marks: DataFrame, share: float = 0.5) -> DataFrame:
    """Words with the tag of the last mark (by mark_no) that covers them, '' if none."""
    hit = _pairs(words.withColumn("r", F.col("rect")), marks.withColumn("m", F.col("rect")), g.covered("r", "m") > share)
    tag = hit.groupBy("a.doc", "a.page", "a.word_no").agg(F.max_by("b.tag", "b.mark_no").alias("tag"))
    return words.join(tag, [*KEYS, "word_no"], "left").withColumn("tag", F.coalesce("tag", F.lit("")))


def note_marks(notes: DataFrame, marks: DataFrame) -> DataFrame:
    """Each note (x, y) with the first mark that holds its point, null if none does."""
    n, m = notes.withColumnsRenamed({"x": "nx", "y": "ny"}), marks.withColumn("m", F.col("rect"))
    hit = _pairs(n, m, g.holds_point("m", F.col("nx"), F.col("ny")))
    first = hit.groupBy("a.doc", "a.page", "a.note_no").agg(F.min("b.mark_no").alias("mark_no"))
    return notes.join(first, [*KEYS, "note_no"], "left")


def glyphs_in(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """Glyphs whose closed rectangle touches a mark's."""
    return _pairs(glyphs.withColumn("r", F.col("rect")), marks.withColumn("m", F.col("rect")), g.touches("r", "m"), "left_semi").drop("r")


def glyphs_outside(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """The others (C20)."""
    return _pairs(glyphs.withColumn("r", F.col("rect")), marks.withColumn("m", F.col("rect")), g.touches("r", "m"), "left_anti").drop("r")


def marked_text(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """The text that each mark touches, in glyph order."""
    hit = _pairs(glyphs.withColumn("r", F.col("rect")), marks.withColumn("m", F.col("rect")), g.touches("r", "m"))
    chars = F.array_sort(F.collect_list(F.struct(F.col("a.glyph_no").alias("o"), F.col("a.ch").alias("c"))))
    return hit.groupBy("b.doc", "b.page", "b.mark_no").agg(F.array_join(F.transform(chars, lambda x: x["c"]), "").alias("text"))


def first_match(pairs: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
