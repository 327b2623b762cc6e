"""Queries on documents, pages and conversations: sentences, terms, cleaning, samples, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import align, sentences, tagging, terms
from glosswright.plans.registry import query, table

#: A short list of function words of the test tables' four languages.
STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "de", "la", "le", "el", "que", "der", "die", "und", "et")
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_CLOSES = """(regexp_matches(x.cur[1], '[.?!]$') AND NOT regexp_matches(x.cur[1], '[Ff]ig') AND len(a.cur) >= 2
      AND NOT (length(x.cur[1]) = 2 AND NOT regexp_matches(x.cur[1], '^[0-9]')) AND x.cur[1] <> 'al.')"""
#: The sentence fold; an item is one word in ``cur``.
SENTENCES = f"""
WITH w AS (SELECT doc_id, source, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT doc_id, source, list_reduce(
    list_transform(words, lambda w: {{'cur': [w], 'out': []::VARCHAR[]}}),
    lambda a, x: CASE WHEN {_CLOSES}
      THEN {{'cur': []::VARCHAR[], 'out': list_append(a.out, array_to_string(list_append(a.cur, x.cur[1]), ' '))}}
      ELSE {{'cur': list_append(a.cur, x.cur[1]), 'out': a.out}} END,
    {{'cur': []::VARCHAR[], 'out': []::VARCHAR[]}}) AS r
  FROM w
), l AS (
  SELECT doc_id, source, CASE WHEN len(r.cur) > 0 THEN list_append(r.out, array_to_string(r.cur, ' ')) ELSE r.out END AS s FROM f
), sents AS (SELECT doc_id, source, (unnest(range(0, len(s))))::INTEGER AS sent_no, unnest(s) AS sentence FROM l)
"""


@query(SENTENCES + "SELECT doc_id, sent_no, sentence FROM sents")
def sentence_split(spark, sf_dir):
    return sentences.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(SENTENCES + "SELECT doc_id, sent_no, sentence FROM sents")
def sentence_split_fold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sentences.split_fold(t.nonblank_words("text")).alias("s"))
    return d.select("doc_id", F.posexplode("s").alias("sent_no", "sentence"))


@query(SENTENCES + r""", p AS (SELECT DISTINCT trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS p FROM benchmark WHERE text IS NOT NULL),
hit AS (
  SELECT DISTINCT sentence FROM (SELECT DISTINCT sentence FROM sents WHERE len(string_split(sentence, ' ')) >= 3) s
  JOIN p ON contains(' ' || p || ' ', ' ' || sentence || ' ')
)
SELECT source, count(*) AS n_sentences, sum(CASE WHEN hit.sentence IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_labelled
FROM sents LEFT JOIN hit USING (sentence) GROUP BY source""")
def sentence_label_by_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "text")
    sents = sentences.sentences(docs, "source")
    labelled = sentences.passage_labels(sents, table(spark, sf_dir, "benchmark"))
    return labelled.groupBy("source").agg(F.count("*").alias("n_sentences"), F.sum(F.col("label").cast("long")).alias("n_labelled"))


@query(SENTENCES + """SELECT doc_id, sent_no, len(string_split(sentence, ' '))::INTEGER AS n_words,
  (sum(len(string_split(sentence, ' '))) OVER (PARTITION BY doc_id ORDER BY sent_no) - len(string_split(sentence, ' ')))::BIGINT AS first_word FROM sents""")
def sentence_offsets(spark, sf_dir):
    s = sentences.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = sentences.sentence_words(s, "doc_id")
    return out.select("doc_id", "sent_no", F.col("n_words").cast("int"), F.col("first_word").cast("long"))


_PLAIN = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_PLAIN} AS d FROM documents), p AS (SELECT item_id, {_PLAIN} AS p FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, item_id FROM d JOIN p ON p <> '' AND contains(' ' || d || ' ', ' ' || p || ' ')""")
def doc_passage_pairs(spark, sf_dir):
    return align.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def fuzzy_align(spark, sf_dir):
    return align.fuzzy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"""WITH tok AS (SELECT doc_id, unnest({_WORDS.replace("(text,", "(lower(text),")}) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"""


@query(_TERMS + " SELECT doc_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return terms.term_frequency(terms.terms(table(spark, sf_dir, "documents")))


_VOCAB = _TERMS + """, v AS (
  SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term HAVING sum(tf) >= 5)"""


def _vocab(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tf = terms.term_frequency(terms.terms(docs))
    return tf, terms.vocabulary(tf, docs.count())


@query(_VOCAB + " SELECT term, cf, df, round(idf, 9) AS idf FROM v")
def vocab_idf(spark, sf_dir):
    return _vocab(spark, sf_dir)[1].select("term", "cf", "df", F.round("idf", 9).alias("idf"))


@query(_VOCAB + """, r AS (SELECT doc_id, term, tf, idf * tf AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(idf * tf, 9) DESC, term) AS rank FROM tf JOIN v USING (term))
SELECT doc_id, term, tf, round(weight, 9) AS weight, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def tfidf_top(spark, sf_dir):
    w = terms.tf_idf(*_vocab(spark, sf_dir)).withColumn("weight", F.round("weight", 9))
    return terms.top_terms(w, 5).select("doc_id", "term", "tf", "weight", "rank")


@query(_TERMS + f" SELECT doc_id, count(*) AS n_kept FROM tok WHERE term NOT IN ({_STOP}) GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "term string")
    kept = terms.without_stopwords(terms.terms(table(spark, sf_dir, "documents")), stop)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"))


_UNITS = ", ".join(f"'{u}'" for u in t.UNITS)


@query(f"""SELECT doc_id, len(list_filter(coalesce({_WORDS}, []), lambda w: w IN ({_UNITS})))::INTEGER AS n_units FROM documents""")
def unit_hits(spark, sf_dir):
    w = F.coalesce(t.nonblank_words("text"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", terms.unit_hits(w, list(t.UNITS)).alias("n_units"))


_WORD = r"[\p{L}\p{M}\p{N}_]"


@query(f"""WITH tok AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^[0-9.-]+') THEN 'number' WHEN w IN ({_UNITS}) THEN 'unit'
  WHEN regexp_full_match(w, '(?:{_WORD}+-)+{_WORD}+') THEN 'A1-A1' WHEN regexp_full_match(w, '[A-Z]+[0-9]*') THEN 'UPPER'
  WHEN regexp_full_match(w, '(?:[A-Z][a-z]+){{2,}}') THEN 'CamelCase' END AS bucket FROM tok)
SELECT doc_id, bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY doc_id, bucket""")
def bucket_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.nonblank_words("text")).alias("term"))
    return terms.bucket_counts(d)


@query("""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' iiii iiii PPPP' ELSE '' END AS x FROM documents)
SELECT doc_id, (len(string_split(x, 'iiii')) - 1)::INTEGER AS n_iiii, (len(string_split(x, 'PPPP')) - 1)::INTEGER AS n_pppp,
  length(CASE WHEN instr(x, 'iiii') > 0 OR instr(x, 'PPPP') > 0
    THEN substr(x, 1, least(CASE WHEN instr(x, 'iiii') > 0 THEN instr(x, 'iiii') END, CASE WHEN instr(x, 'PPPP') > 0 THEN instr(x, 'PPPP') END) - 1)
    ELSE x END)::INTEGER AS n_before FROM d""")
def special_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("x", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " iiii iiii PPPP").otherwise("")))
    return d.select("doc_id", t.marker_count("x", "iiii").alias("n_iiii"), t.marker_count("x", "PPPP").alias("n_pppp"), F.length(t.before_marker("x")).alias("n_before"))


@query(r"""SELECT doc_id, sha256(replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '-+', '-', 'g'), chr(10), '')) AS tidy_sha256 FROM documents""")
def cleanup_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.tidy_extract("text"), 256).alias("tidy_sha256"))


@query(r"""SELECT doc_id, sha256(replace(replace(replace(replace(lower(text), 'et al.', ' '), '/', ' '), 'et al', ' '), 'δ', 'δ ')) AS normal_sha256 FROM documents""")
def normalize_pre(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.normalize_before("text"), 256).alias("normal_sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '[()\[\]]', '', 'g')) AS bare_sha256, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::INTEGER AS n_ascii FROM documents""")
def bracket_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.drop_brackets("text"), 256).alias("bare_sha256"), F.length(t.ascii_only("text")).alias("n_ascii"))


@query("""SELECT doc_id, i::INTEGER AS part, length(substr(text, i * k + 1, k))::INTEGER AS n, sha256(substr(text, i * k + 1, k)) AS part_sha256
FROM (SELECT doc_id, text, ceil(length(text) / 4)::BIGINT AS k FROM documents), (SELECT unnest(range(0, 4)) AS i)""")
def divide_string(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.equal_chunks("text", 4)).alias("part", "x"))
    return d.select("doc_id", "part", F.length("x").alias("n"), F.sha2("x", 256).alias("part_sha256"))


@query("""SELECT page_id, CASE WHEN u LIKE 'http://aem.asm.org%' AND NOT u LIKE '%.full' THEN u || '.full'
  WHEN u LIKE 'https://onlinelibrary.wiley.com%' THEN replace(u, 'abs', 'full') ELSE u END AS full_url
FROM (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN ' http://aem.asm.org/content/' || page_id WHEN 1 THEN 'https://onlinelibrary.wiley.com/doi/abs/' || page_id || '/abs' ELSE url END) AS u FROM pages)""")
def url_rewrite(spark, sf_dir):
    k = F.col("page_id")
    u = F.when(k % 3 == 0, F.concat(F.lit(" http://aem.asm.org/content/"), k)).when(k % 3 == 1, F.concat(F.lit("https://onlinelibrary.wiley.com/doi/abs/"), k, F.lit("/abs"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", t.full_text_url(u).alias("full_url"))


@query("""SELECT page_id, coalesce(nullif(a, ''), nullif(b, '')) AS by_url, coalesce(nullif(b, ''), nullif(a, '')) AS by_doi
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN NULL ELSE url END AS a, CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/' || page_id ELSE '' END AS b FROM pages)""")
def url_coalesce(spark, sf_dir):
    k = F.col("page_id")
    a = F.when(k % 4 == 0, "").when(k % 4 != 1, F.col("url"))
    b = F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/"), k)).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", t.preferred_url(a, b).alias("by_url"), t.preferred_url(a, b, "doi").alias("by_doi"))


_HOSTS = ("www.sciencedirect.com", "aem.asm.org", "www.nature.com", "x.biomedcentral.com", "link.springer.com", "msb.embopress.org", "onlinelibrary.wiley.com", "europepmc.org/pmc", "example.org")
_PAGE = (
    "CASE WHEN page_id % 10 = 9 THEN html WHEN page_id % 2 = 0 THEN '<meta name=\"citation_pdf_url\" content=\"https://' || h || '/x.pdf\">' || html "
    "ELSE '<meta content=\"https://' || h || '/x\" name=\"citation_abstract_html_url\">' || html END"
)
_HOST_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS)) + " END"


@query(f"""WITH p AS (SELECT page_id, {_PAGE} AS x FROM (SELECT page_id, html, {_HOST_SQL} AS h FROM pages)),
u AS (SELECT page_id, coalesce(nullif(regexp_extract(x, 'name="citation_pdf_url" content="([^"]*)"', 1), ''), nullif(regexp_extract(x, 'content="([^"]*)" name="citation_abstract_html_url"', 1), ''), '') AS u FROM p)
SELECT page_id, CASE {' '.join(f"WHEN contains(u, '{a}') THEN '{b}'" for a, b in t.PUBLISHERS)} ELSE 'WARNING' END AS publisher FROM u""")
def publisher_detect(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "html", f"{_HOST_SQL} AS h").selectExpr("page_id", f"{_PAGE} AS x")
    return p.select("page_id", t.publisher("x").alias("publisher"))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_sha256, sha256(regexp_replace(html, '</?span(?:[ \\t\\n\\r][^>]*)?>', '', 'g')) AS spanless_sha256 FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.strip_tags("html"), 256).alias("text_sha256"), F.sha2(t.drop_span_tags("html"), 256).alias("spanless_sha256"))


@query("""SELECT page_id, len(f)::INTEGER AS n_removed, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0)::BIGINT AS n_chars,
  length(regexp_replace(html, '<[^>]*>', '', 'g'))::INTEGER AS n_clean FROM (SELECT page_id, html, regexp_extract_all(html, '<[^>]*>') AS f FROM pages)""")
def tag_removals(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select("page_id", "html", align.removals("html").alias("r"))
    return r.select(
        "page_id", F.size("r").alias("n_removed"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("n_chars"),
        (align.restored(F.length(t.strip_tags("html")), F.col("r")) - F.aggregate("r", F.lit(0), lambda a, x: a + x["len"])).alias("n_clean"),
    )


@query("""WITH w AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations WHERE text IS NOT NULL)),
c AS (SELECT conv_id, turn, pos::INTEGER AS pos, coalesce(lag(word) OVER q, '') AS before, word, coalesce(lead(word) OVER q, '') AS after FROM w WINDOW q AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn, pos, before, word, after FROM c""")
def context_window(spark, sf_dir):
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(ws).alias("pos", "word"))
    return tagging.context(w, ["conv_id", "turn"], "pos").select("conv_id", "turn", "pos", "before", "word", "after")


@query("""WITH w AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations WHERE text IS NOT NULL)),
c AS (SELECT conv_id, turn, pos::INTEGER AS pos, coalesce(lag(word) OVER q, '') || ' ' || chr(7) || word || chr(7) || ' ' || coalesce(lead(word) OVER q, '') AS s FROM w WINDOW q AS (PARTITION BY conv_id, turn ORDER BY pos)),
e AS (SELECT conv_id, turn, pos, array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 256 THEN '\\x' || lower(printf('%02x', unicode(c))) ELSE '\\u' || lower(printf('%04x', unicode(c))) END), '') AS s FROM c)
SELECT conv_id, turn, pos, s AS sample, (list_sum(list_transform(list_filter(string_split(substr(s, 1, 100), ''), lambda c: c <> ''), lambda c: unicode(c))))::BIGINT AS code_sum FROM e""".replace("\\\\", "\\"))
def char_samples(spark, sf_dir):
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(ws).alias("pos", "word"))
    c = tagging.context(w, ["conv_id", "turn"], "pos").select("conv_id", "turn", "pos", tagging.sample_text("before", "word", "after").alias("sample"))
    return c.withColumn("code_sum", F.aggregate(tagging.character_sample(F.col("sample")), F.lit(0).cast("long"), lambda a, x: a + x))


@query(f"""SELECT doc_id, pos::INTEGER AS pos, word FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL))""")
def explode_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.nonblank_words("text")).alias("pos", "word"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(0, len(ws)))::INTEGER AS word_no, unnest(ws) AS w FROM d),
h AS (SELECT doc_id, word_no, word_no // 8 AS line, CASE WHEN word_no % 8 = 7 AND length(w) > 3 THEN w || '-' ELSE w END AS text, CASE WHEN word_no % 5 = 0 THEN 1 ELSE 0 END AS label FROM w),
f AS (SELECT *, CASE WHEN coalesce(lag(text) OVER q LIKE '%-' AND line = lag(line) OVER q + 1, false) THEN 0 ELSE 1 END AS new FROM h WINDOW q AS (PARTITION BY doc_id ORDER BY word_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY word_no) AS grp, coalesce(lead(new) OVER (PARTITION BY doc_id ORDER BY word_no) = 0, false) AS more FROM f)
SELECT doc_id, min(word_no) AS word_no, string_agg(CASE WHEN more THEN substr(text, 1, length(text) - 1) ELSE text END, '' ORDER BY word_no) AS text, max(label) AS label, count(*) AS n_parts FROM g GROUP BY doc_id, grp""")
def hyphen_join(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.nonblank_words("text")).alias("word_no", "w"))
    h = w.select(
        "doc_id", "word_no", F.floor(F.col("word_no") / 8).cast("int").alias("line"),
        F.when((F.col("word_no") % 8 == 7) & (F.length("w") > 3), F.concat("w", F.lit("-"))).otherwise(F.col("w")).alias("text"),
        F.when(F.col("word_no") % 5 == 0, 1).otherwise(0).alias("label"),
    )
    return sentences.join_hyphens(h, "doc_id").select("doc_id", "word_no", "text", "label", "n_parts")


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda v: CASE WHEN (len(list_filter(regexp_split_to_array(v, '[ \t\n\r\f\v]+'), lambda w: w <> '')) > 3 AND length(v) > 30) OR contains(v, 'hl') THEN v ELSE '|' END), chr(10))) AS lines_sha256 FROM documents""")
def line_qualifier(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.qualified_lines("text", "|"), 256).alias("lines_sha256"))


@query(r"""SELECT doc_id, lower(trim(string_split(text, ':')[1])) AS label FROM documents""")
def label_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.normal_label("text").alias("label"))
