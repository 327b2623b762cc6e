"""Queries on page layouts: fonts, glyphs, rectangles, formatted texts, offsets, tagged words, blocks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import align, html_blocks, intervals, layout, sampling, sentences, spatial, store, tagging
from glosswright.plans import composites, features
from glosswright.plans.registry import query, table
from glosswright.plans.table_queries import _RECTS, _TOUCH, _marks, _pages, _rect, _words
from glosswright.plans.text_queries import SENTENCES, _PLAIN, _WORDS, STOPWORDS

#: Fonts of the made runs, by the part's key.
_FONTS = ("Times-Bold", "Times-Italic", "Times", "Adv.B", "Adv-bi", "MinionBdIt", "Helv_I", "Courier")
_FONT_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FONTS)) + " END"
_RUNS = f"""runs AS (SELECT p_brand AS doc, (p_size % 4)::INTEGER AS page, {_FONT_SQL} AS font, (8 + p_partkey % 5)::DOUBLE AS size, (p_partkey * 10)::INTEGER AS s, (p_partkey * 10 + p_partkey % 9)::INTEGER AS e FROM part)"""
_BOLD, _ITALIC = "'[bB]old|[._-][bB][iI]?$|Bd(It)?$'", "'[iI]talic|[._-][bB]?[iI]$|It$'"


def _runs(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS doc", "cast(p_size % 4 AS int) AS page", f"{_FONT_SQL} AS font", "cast(8 + p_partkey % 5 AS double) AS size",
        "cast(p_partkey * 10 AS int) AS start", "cast(p_partkey * 10 + p_partkey % 9 AS int) AS end",
    )


@query(f"WITH {_RUNS} SELECT font, count(*) AS n, max(regexp_matches(font, {_BOLD})::INTEGER) AS bold, max(regexp_matches(font, {_ITALIC})::INTEGER) AS italic FROM runs GROUP BY font")
def font_kinds(spark, sf_dir):
    """P14, P15."""
    r = _runs(spark, sf_dir)
    return r.groupBy("font").agg(F.count("*").alias("n"), F.max(t.bold_font("font").cast("int")).alias("bold"), F.max(t.italic_font("font").cast("int")).alias("italic"))


@query(f"WITH {_RUNS} SELECT DISTINCT doc, font FROM runs")
def distinct_fonts(spark, sf_dir):
    """A12."""
    return layout.distinct_fonts(_runs(spark, sf_dir), ("doc",))


@query(f"""WITH {_RUNS}, small AS (SELECT *, lag(size) OVER (PARTITION BY doc, page ORDER BY s) AS before FROM runs), g AS (
  SELECT doc, page, s, e, 'b' AS tag FROM runs WHERE regexp_matches(font, {_BOLD}) UNION ALL SELECT doc, page, s, e, 'i' FROM runs WHERE regexp_matches(font, {_ITALIC})
  UNION ALL SELECT doc, page, s, e, 'sub' FROM small WHERE size < before AND e - s < 5)
SELECT doc, page, s AS "start", e AS "end", tag FROM g""")
def format_tags(spark, sf_dir):
    """What fonts say of stretches of text."""
    return layout.format_tags(_runs(spark, sf_dir))


@query(f"""WITH {_RECTS}, g AS (SELECT w.doc, w.page, w.word_no FROM words w WHERE EXISTS (SELECT 1 FROM marks m WHERE w.doc = m.doc AND w.page = m.page AND {_TOUCH})),
i AS (SELECT *, word_no - row_number() OVER (PARTITION BY doc, page ORDER BY word_no) AS k FROM g)
SELECT doc, page::INTEGER AS page, min(word_no)::INTEGER AS first, max(word_no)::INTEGER AS last FROM i GROUP BY doc, page, k""")
def index_segments(spark, sf_dir):
    """Runs of glyphs that carry the mark's attribute."""
    return layout.index_segments(_words(spark, sf_dir).withColumnRenamed("word_no", "glyph_no"), _marks(spark, sf_dir))


@query("SELECT conv_id, turn, (i - 1)::INTEGER AS glyph_no, substr(text, i, 1) AS ch FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations WHERE text IS NOT NULL)")
def glyph_rows(spark, sf_dir):
    """G8."""
    return layout.glyph_table(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("SELECT conv_id, (turn_no + 1)::INTEGER AS page, text FROM (SELECT conv_id, text, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations WHERE text IS NOT NULL)")
def numbered_pages(spark, sf_dir):
    """Pages counted from 1, from arrays of page texts."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    held = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = c.groupBy("conv_id").agg(F.transform(held, lambda x: x["text"]).alias("pages"))
    return layout.numbered_pages(docs, "conv_id")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS html FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def document_pages(spark, sf_dir):
    """A document's pages in order."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("text").alias("html"))
    return composites.document_pages(c).select(F.col("doc").alias("conv_id"), "html")


@query("SELECT conv_id, regexp_replace(string_agg(text, ' ' ORDER BY turn), ' +', ' ', 'g') AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def joined_paragraphs(spark, sf_dir):
    """F31."""
    held = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.transform(held, lambda x: x["text"]).alias("p"))
    return c.select("conv_id", t.join_paragraphs("p").alias("text"))


@query(f"""WITH {_RECTS} SELECT doc, page::INTEGER AS page, count(*)::INTEGER AS n, '[' || string_agg('[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']', ',' ORDER BY mark_no) || ']' AS rects FROM marks GROUP BY doc, page""")
def page_rects(spark, sf_dir):
    """A page's rectangles in order, as JSON."""
    r = layout.rects_by_page(_marks(spark, sf_dir))
    one = F.transform("rects", lambda x: F.to_json(F.array(*(x[s] for s in ("x0", "y0", "x1", "y1")))))
    return r.select("doc", "page", F.size("rects").alias("n"), F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")).alias("rects"))


@query(f"""WITH {_RECTS}, b AS (SELECT doc, page, word_no, x0, y0 + (word_no % 4) * 0.1 AS y0, x1, y1 FROM words WHERE word_no % 9 <> 0)
SELECT doc, page::INTEGER AS page, min(x0) AS x0, round(min(y0), 6) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM b GROUP BY doc, page, word_no // 8""")
def boxes_to_rows(spark, sf_dir):
    """Boxes whose tops nearly agree, without those that have no width."""
    w = _words(spark, sf_dir)
    flat = w.select("doc", "page", "word_no", "rect.*").withColumn("x1", F.when(F.col("word_no") % 9 == 0, F.col("x0")).otherwise(F.col("x1")))
    flat = flat.withColumn("y0", F.col("y0") + (F.col("word_no") % 4) * 0.1)
    return intervals.rows_of_boxes(flat, ["doc", "page"]).withColumn("y0", F.round("y0", 6))


@query("""SELECT user_id::VARCHAR AS doc_id, (event_id % 5)::INTEGER AS page, CASE event_id % 3 WHEN 1 THEN 'note' ELSE 'highlight' END AS kind, event_id::VARCHAR AS id,
  value AS x0, 1000 - (event_id + 1)::DOUBLE AS y0, value + 1 AS x1, 1000 - event_id::DOUBLE AS y1 FROM events WHERE event_id % 3 <> 2 AND value IS NOT NULL""")
def true_rects(spark, sf_dir):
    """Given marks and notes on pages with y downwards."""
    from glosswright.plans.exchange_queries import _annotated

    p = store.annotations(_annotated(spark, sf_dir))
    r = layout.true_rects(p, F.lit(1000.0))
    return r.where("rect.x0 is not null").select("doc_id", "page", "kind", "id", "rect.*")


@query(f"""WITH {_RECTS}, s AS (SELECT doc, page, word_no // 20 AS sent_no, (word_no // 8)::INTEGER AS line, * EXCLUDE (doc, page) FROM words WHERE (doc + word_no // 20) % 3 = 0)
SELECT doc, page::INTEGER AS page, sent_no::INTEGER AS sent_no, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM s GROUP BY doc, page, sent_no, line""")
def predicted_rects(spark, sf_dir):
    """Line boxes of the sentences that a rule calls interesting."""
    w = _words(spark, sf_dir).withColumn("sent_no", F.floor(F.col("word_no") / 20).cast("int")).where("(doc + sent_no) % 3 = 0")
    box = F.struct("word_no", F.struct(F.floor(F.col("word_no") / 8).cast("int").alias("line"), F.col("rect")).alias("b"))
    s = w.groupBy("doc", "page", "sent_no").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: x["b"]).alias("boxes"))
    return layout.predicted_rects(s, ["doc"])


@query("""SELECT conv_id, turn, replace(substr(text, 1, a) || '<b>' || substr(text, a + 1, b - a) || '<i>' || substr(text, b + 1, c - b) || '</i>' || substr(text, c + 1, 2) || '</b>' || substr(text, c + 3), chr(10), '<br/>' || chr(10)) AS html
FROM (SELECT conv_id, turn, text, 2 + turn % 3 AS a, 6 + turn % 3 AS b, 9 + turn % 3 AS c FROM conversations WHERE length(text) >= 20)""")
def formatted_pages(spark, sf_dir):
    """nested stretches of a text between tags."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") >= 20)
    k = F.col("turn") % 3
    parts = F.array(
        F.struct((2 + k).alias("start"), (11 + k).alias("end"), F.lit("b").alias("tag")), F.struct((6 + k).alias("start"), (9 + k).alias("end"), F.lit("i").alias("tag")),
    )
    segments = c.select("conv_id", "turn", F.explode(parts).alias("s")).select("conv_id", "turn", F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("end"), "s.tag")
    return layout.formatted(c, segments, ["conv_id", "turn"])


_COPY = "SELECT conv_id, turn, text, (3 + turn % 4)::INTEGER AS s, (length(text) // 2 + turn % 3)::INTEGER AS e FROM conversations WHERE length(text) >= 20"


@query(rf"""WITH c AS ({_COPY}), w AS (SELECT conv_id, turn, text,
  CASE WHEN regexp_matches(substr(text, s + 1, 1), '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN s - length(regexp_extract(substr(text, 1, s), '[\p{{L}}\p{{M}}\p{{N}}_]*$')) ELSE s END AS s,
  CASE WHEN regexp_matches(substr(text, e, 1), '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN e + length(regexp_extract(substr(text, e + 1), '^[\p{{L}}\p{{M}}\p{{N}}_]*')) ELSE e END AS e FROM c)
SELECT conv_id, turn, substr(text, 1, s) || '<hl>' || substr(text, s + 1, e - s) || '</hl>' || substr(text, e + 1) AS html FROM w""")
def widened_highlights(spark, sf_dir):
    """Places widened to whole words, then marked."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") >= 20)
    s, e = (3 + F.col("turn") % 4).cast("int"), (F.floor(F.length("text") / 2) + F.col("turn") % 3).cast("int")
    keyed = c.withColumn("k", F.struct("conv_id", "turn"))
    spans = keyed.select("k", align.widened(F.col("text"), s, e).alias("w")).select("k", "w.start", "w.end")
    return align.highlighted(keyed.select("k", "text"), spans, "k").select("k.conv_id", "k.turn", "html")


@query(r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN unicode(c) < 128 THEN i - 1 END), lambda x: x IS NOT NULL) AS kept FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, p::INTEGER AS place, kept[p + 1]::INTEGER AS origin FROM (SELECT doc_id, kept, unnest(range(0, len(kept), 97)) AS p FROM d)""")
def restored_offsets(spark, sf_dir):
    """Places in the ASCII text as places in the original."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", align.removals("text", "[^\\x00-\\x7F]+").alias("r"), F.length(t.ascii_only("text")).alias("n"))
    p = d.where("n > 0").select("doc_id", "r", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(97))).alias("place"))
    return p.select("doc_id", "place", align.restored(F.col("place"), F.col("r")).alias("origin"))


@query("SELECT conv_id, turn, '<a>' || replace(text, '<', '') || '</a>' AS bare, '<hl><i><b>' || replace(text, '<', '') || '</b></i></hl> x' AS outward, 'a|b|c' AS cells FROM conversations WHERE text IS NOT NULL AND trim(replace(text, '<', '')) <> ''")
def markup_rules(spark, sf_dir):
    """anchors without attributes, highlights moved out of nested tags, table cells as markers."""
    x = F.replace("text", F.lit("<"), F.lit(""))
    c = table(spark, sf_dir, "conversations").where(F.trim(x) != "")
    return c.select(
        "conv_id", "turn", t.bare_anchors(F.concat(F.lit('<a href="u" class=c>'), x, F.lit("</a>"))).alias("bare"),
        t.outward_highlights(F.concat(F.lit("<i><b><hl>"), x, F.lit("</hl></b></i><hl> </hl> x"))).alias("outward"),
        t.drop_cells(F.concat(F.lit("a\n1.5 (2)<br/>b\nab_c<br />c"), F.lit("")), "|").alias("cells"),
    )


@query(r"""SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(text), 'et al.', ' '), '/', ' '), 'et al', ' '), 'δ', 'δ '), '[ \t\n\r\f\v]+'),
  lambda w: w <> '' AND w NOT IN ('`', '''', '?', '``', '''''')), ' ')) AS tokens_sha256 FROM documents WHERE text IS NOT NULL""")
def normal_tokens(spark, sf_dir):
    """F11, F9, F10, F12's place: tokens of the normalized text."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.array_join(t.normal_tokens("text"), " "), 256).alias("tokens_sha256"))


_OFFSETS = """, o AS (SELECT doc_id, sent_no, sentence, len(string_split(sentence, ' ')) AS n, sum(len(string_split(sentence, ' '))) OVER (PARTITION BY doc_id ORDER BY sent_no) - len(string_split(sentence, ' ')) AS first FROM sents)"""


@query(SENTENCES + _OFFSETS + " SELECT doc_id, sent_no, (CASE WHEN (first + n - 1) // 40 > (first - 1 + 40) // 40 - 1 THEN 1 ELSE 0 END)::INTEGER AS label FROM o")
def sentence_word_label(spark, sf_dir):
    """A sentence is labelled if a word of it is; here every fortieth word of a text is."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    s = sentences.sentences(d.select("doc_id", "text"))
    words = d.select("doc_id", F.posexplode(t.nonblank_words("text")).alias("word_no", "w")).select("doc_id", "word_no", F.when(F.col("word_no") % 40 == 0, 1).otherwise(0).alias("label"))
    return sentences.label_sentences(s, words, "doc_id").select("doc_id", "sent_no", "label")


@query(SENTENCES + _OFFSETS + """, h AS (SELECT *, ((first + n - 1) // 50 - (first + 49) // 50 + 1)::INTEGER AS k FROM o)
SELECT doc_id, sent_no, sentence, n::INTEGER AS n_words, k AS n_tags FROM h WHERE k > 0""")
def tagged_sentences(spark, sf_dir):
    """Words and tags of the sentences that have a tag; here every fiftieth word has."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    s = sentences.sentence_words(sentences.sentences(d.select("doc_id", "text")), "doc_id")
    words = d.select("doc_id", F.posexplode(t.nonblank_words("text")).alias("word_no", "word")).withColumn("tag", F.when(F.col("word_no") % 50 == 0, "x").otherwise(""))
    out = tagging.sentence_samples(s, words, ["doc_id"])
    return out.select("doc_id", "sent_no", F.array_join("words", " ").alias("sentence"), F.size("words").alias("n_words"), F.size(F.filter("tags", lambda x: x != "")).alias("n_tags"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_UNITS = ", ".join(f"'{u}'" for u in t.UNITS)
_W = r"[\p{L}\p{M}\p{N}_]"
_LINES = rf"""tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(x), 'et al.', ' '), '/', ' '), 'et al', ' '), 'δ', 'δ '), '[ \t\n\r\f\v]+'),
    lambda w: w <> '' AND w NOT IN ('`', '''', '?', '``', '''''', {_STOP}))) AS w FROM lines),
b AS (SELECT doc_id, w, CASE WHEN regexp_matches(w, '^[0-9.-]+') THEN 'number' WHEN w IN ({_UNITS}) THEN 'unit' WHEN regexp_full_match(w, '(?:{_W}+-)+{_W}+') THEN 'A1-A1'
  WHEN regexp_full_match(w, '[A-Z]+[0-9]*') THEN 'UPPER' WHEN regexp_full_match(w, '(?:[A-Z][a-z]+){{2,}}') THEN 'CamelCase' ELSE '' END AS b FROM tok)"""
_SPEC = features.FeatureSpec(stopwords=STOPWORDS)


@query(f"""WITH lines AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL), {_LINES}
SELECT l.doc_id, count(w) FILTER (b = '')::INTEGER AS n_tokens, count(w) FILTER (b = 'number')::DOUBLE AS n_number, count(w) FILTER (b = 'unit')::DOUBLE AS n_unit, count(w) FILTER (b = 'A1-A1')::DOUBLE AS n_joined
FROM lines l LEFT JOIN b ON b.doc_id = l.doc_id GROUP BY l.doc_id""")
def line_features(spark, sf_dir):
    """What the vocabulary sees of each line, and the counts beside it."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    f = features.line_features(d, _SPEC)
    return f.select("doc_id", F.size("tokens").alias("n_tokens"), *(F.col("manual")[k].alias(n) for k, n in enumerate(("n_number", "n_unit", "n_joined"))))


_TWICE = "lines AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)"


def _twice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return layout.all_of(d, d.where("doc_id % 2 = 0"))


_IDF = f""", num AS (SELECT doc_id, x, row_number() OVER () AS line FROM lines), ltok AS (SELECT line, w FROM (SELECT line, unnest(list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(x), 'et al.', ' '), '/', ' '), 'et al', ' '), 'δ', 'δ '), '[ \\t\\n\\r\\f\\v]+'),
    lambda w: w <> '' AND w NOT IN ('`', '''', '?', '``', '''''', {_STOP}))) AS w FROM num) WHERE NOT (regexp_matches(w, '^[0-9.-]+') OR w IN ({_UNITS}) OR regexp_full_match(w, '(?:{_W}+-)+{_W}+') OR regexp_full_match(w, '[A-Z]+[0-9]*') OR regexp_full_match(w, '(?:[A-Z][a-z]+){{2,}}'))),
v AS (SELECT w AS term, ln((SELECT count(*) FROM lines) / count(DISTINCT line)) AS idf FROM ltok GROUP BY w HAVING count(*) >= 5)"""


@query(f"WITH {_TWICE}{_IDF} SELECT term, round(idf, 9) AS idf FROM v")
def feature_idf(spark, sf_dir):
    """M2, A2, A3: vocabulary and idf over all lines, half of which are there twice."""
    return features.term_table(_twice(spark, sf_dir), _SPEC).select("term", F.round("idf", 9).alias("idf"))


@query(f"WITH {_TWICE}{_IDF} SELECT n.doc_id, round(sum(coalesce(v.idf, 0)), 4) AS total FROM num n LEFT JOIN ltok USING (line) LEFT JOIN v ON v.term = ltok.w GROUP BY n.line, n.doc_id")
def feature_vectors(spark, sf_dir):
    """The sum of each line's tf-idf places."""
    rows = _twice(spark, sf_dir)
    out = features.sparse_features(rows, features.term_table(rows, _SPEC), _SPEC, keep=["doc_id"])
    return out.select("doc_id", F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH x AS (SELECT vec_id, (unnest(range(0, len(embedding))))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim) SELECT vec_id, dim, round(CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END, 6) AS scaled FROM x JOIN s USING (dim) WHERE dim < 8""")
def scaled_vectors(spark, sf_dir):
    """The fitted scaler applied; eight places of each vector are shown."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out = features.fit_scaler(e)(e).select("vec_id", F.slice(vector_to_array("scaled"), 1, 8).alias("s"))
    return out.select("vec_id", F.posexplode("s").alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("scaled"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings WHERE embedding IS NOT NULL")
def argmax_places(spark, sf_dir):
    """The place of the largest score, the first of equals."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query("""WITH p AS (SELECT doc_id FROM labels WHERE toxic <> 0) SELECT count(*) AS n_rows, count(*) FILTER (toxic <> 0) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg FROM labels""")
def label_split(spark, sf_dir):
    """P13."""
    pos, neg = sampling.split_labels(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"))
    both = layout.all_of(pos.select(F.lit(1).alias("p")), neg.select(F.lit(0).alias("p")))
    return both.agg(F.count("*").alias("n_rows"), F.sum("p").alias("n_pos"), F.sum(1 - F.col("p")).alias("n_neg"))


# Pages dressed as each publisher's in turn: what is said in a page's own words must come out again, in its place.
_HOST = ("www.nature.com", "link.springer.com", "aem.asm.org", "x.biomedcentral.com", "onlinelibrary.wiley.com", "msb.embopress.org", "europepmc.org/pmc", "www.sciencedirect.com")
_SHELL = (
    '<article><section aria-labelledby="abstract"><p>{a}<a href="#r">[1]</a></p><figure><p>{c}</p></figure><table><tr><td>{t}</td></tr></table></section></article>',
    '<article><section class="Abstract"><p>{a}</p></section><div id="body"><div class="Para">{b}<span>gone</span></div><div class="CaptionContent"><p class="SimplePara">{c}</p></div><div class="Table"><table><tr><td>{t}</td></tr></table></div></div></article>',
    '<div class="article"><p id="p-2">{b}</p><p id="p-1">{a}<a class="xref-bibr">9</a></p><div class="section" id="sec-1"><div class="fig"><p>{c}</p></div></div></div>',
    '<main><div id="Sec1"><p class="Para">{a}</p></div><div class="Para">{b}</div><div class="CaptionContent"><p class="SimplePara">{c}</p></div><table><tr><td>{t}</td></tr></table></main>',
    '<div class="article__body"><article><section class="article-section__full"><div class="article-section__content"><p>{a}<span class="x">gone</span></p><p>{b}</p></div><figcaption><div>{c}</div></figcaption><table><tr><td>{t}</td></tr></table></section></article></div>',
    '<div class="article"><div class="abstract"><p>{a}</p></div><div id="sec-1"><p>{b}</p></div><div class="fig-caption"><p>{c}</p></div></div>',
    '<div class="article"><div id="__sec1"><p id="__p1">{a}</p><p id="__p2">{b}</p></div><p>gone</p><div class="caption"><p>{c}</p></div><table><tr><td>{t}</td></tr></table></div>',
    '<div class="Abstracts"><p>{a}</p></div><div class="Body"><p>{b}<a class="workspace-trigger">x</a></p><div class="figure"><p>{c}</p></div><table><tr><td>{t}</td></tr></table></div>',
)
_PARTS = r"""SELECT page_id, page_id % 8 AS k, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM pages WHERE html IS NOT NULL"""
_SAID = ", ".join(f"regexp_replace({x}, ' +', ' ', 'g') AS {n}" for n, x in (("a", "substr(w, 1, 60)"), ("b", "substr(w, 61, 60)"), ("c", "'c ' || substr(w, 5, 20)"), ("t", "'t ' || substr(w, 9, 9)")))
_BOTH, _TABLES = (1, 2, 3, 4, 5, 6, 7), (0, 1, 3, 4, 6, 7)


def _dressed(spark, sf_dir):
    w = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[^A-Za-z0-9]+", " "))
    p = table(spark, sf_dir, "pages").where("html is not null").select("page_id", w.alias("w"), (F.col("page_id") % 8).alias("k"))
    part = {"a": F.substring("w", 1, 60), "b": F.substring("w", 61, 60), "c": F.concat(F.lit("c "), F.substring("w", 5, 20)), "t": F.concat(F.lit("t "), F.substring("w", 9, 9))}
    shells = [f'<html><head><meta name="citation_pdf_url" content="https://{host}/x.pdf"></head><body>{shell}</body></html>' for host, shell in zip(_HOST, _SHELL)]
    page = F.element_at(F.array(*map(F.lit, shells)), (F.col("k") + 1).cast("int"))
    for name, value in part.items():
        page = F.replace(page, F.lit("{" + name + "}"), value)
    return p.select("page_id", page.alias("html"))


def _in_places(ks):
    return "k IN (" + ", ".join(map(str, ks)) + ")"


@query(f"""WITH p AS (SELECT page_id, k, {_SAID} FROM ({_PARTS}))
SELECT page_id, 'paragraph' AS kind, 0::INTEGER AS pos, a AS block FROM p UNION ALL SELECT page_id, 'paragraph', 1, b FROM p WHERE {_in_places(_BOTH)}
UNION ALL SELECT page_id, 'caption', 0, c FROM p UNION ALL SELECT page_id, 'cell', 0, t FROM p WHERE {_in_places(_TABLES)}""")
def html_page_blocks(spark, sf_dir):
    """F2 to F5 and the eight extractors: paragraphs, captions and cells of pages in each publisher's layout."""
    return html_blocks.page_blocks(_dressed(spark, sf_dir))


@query(f"""WITH p AS (SELECT page_id, k, {_SAID} FROM ({_PARTS}))
SELECT page_id, '== paragraph' || chr(10) || a || CASE WHEN {_in_places(_BOTH)} THEN chr(10) || b ELSE '' END || chr(10) || '== caption' || chr(10) || c
  || CASE WHEN {_in_places(_TABLES)} THEN chr(10) || '== cell' || chr(10) || t ELSE '' END AS text FROM p""")
def extractor_dump(spark, sf_dir):
    """K17."""
    return html_blocks.extractor_dump(html_blocks.page_blocks(_dressed(spark, sf_dir)))
