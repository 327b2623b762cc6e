"""Queries on what goes in and out: files written and read again, shredded documents, plans of whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import layout, sentences, store, tagging
from glosswright.operators.align import plain
from glosswright.plans import composites
from glosswright.plans.registry import query, table
from glosswright.plans.text_queries import SENTENCES, _PLAIN
from glosswright.session import shared_folder
from glosswright.sources import io


def _scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(SENTENCES + """SELECT (CASE WHEN len(string_split(sentence, ' ')) >= 12 THEN 1 ELSE 0 END)::INTEGER AS label, count(*) AS n, sum(length(sentence))::BIGINT AS n_chars
FROM sents WHERE length(sentence) > 2 GROUP BY 1""")
def sentence_tsv(spark, sf_dir):
    """Label-TAB-sentence files by source, read again."""
    s = sentences.sentences(table(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "text"), "source")
    path = _scratch(spark, "sentences")
    io.write_sentences(s.withColumn("label", F.when(F.size(F.split("sentence", " ")) >= 12, 1).otherwise(0)), path, "source")
    return io.labelled_sentences(spark, f"{path}/*").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_TALK = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT unnest({_TALK}) AS w FROM conversations WHERE text IS NOT NULL)
SELECT CASE WHEN length(w) % 3 = 0 THEN 'third' ELSE '' END AS tag, count(*) AS n, sum(length(w))::BIGINT AS n_chars FROM w GROUP BY 1""")
def sample_jsonl(spark, sf_dir):
    """[words, tags] lines, read again and shredded."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    tags = F.transform("words", lambda w: F.when(F.length(w) % 3 == 0, "third").otherwise(""))
    path = _scratch(spark, "samples")
    io.write_samples(table(spark, sf_dir, "conversations").where("text is not null").select(words.alias("words")).withColumn("tags", tags), path)
    back = tagging.tagged_words(io.tagged_samples(spark, path).withColumn("k", F.lit(0)), "k")
    return back.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("n_chars"))


@query("SELECT event_type AS tag, (dense_rank() OVER (ORDER BY event_type))::INTEGER AS idx FROM events GROUP BY event_type UNION ALL SELECT '', 0")
def class_file(spark, sf_dir):
    """The sorted class list as a file, read again."""
    path = _scratch(spark, "classes")
    io.write_classes(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag")), path)
    return io.classes(spark, path).select("tag", "idx")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part")
def lexicon_file(spark, sf_dir):
    """The words of a file."""
    path = _scratch(spark, "lexicon")
    table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).write.text(path)
    return io.lexicon(spark, path)


def _annotated(spark, sf_dir):
    """Events as annotations, their users as documents."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    k = F.col("event_id")
    point = lambda d: F.struct((F.col("value") + d).alias("x"), (k + d).cast("double").alias("y"))
    a = F.struct(
        k.cast("string").alias("id"), F.when(k % 3 == 0, "highlight").when(k % 3 == 1, "sticky_note").otherwise("note").alias("type"),
        F.col("event_type").alias("profile_id"), F.col("event_type").alias("text"),
        F.array(F.struct(point(0).alias("top_left"), point(1).alias("bottom_right"), (k % 5).cast("int").alias("page"))).alias("positions"),
    )
    u = F.col("user_id")
    return e.groupBy(u).agg(F.collect_list(a).alias("annots")).select(
        u.cast("string").alias("doc_id"), F.concat(F.lit("title "), u).alias("doc_title"), (2000 + u % 20).cast("int").alias("year"), F.lit("s").alias("source"),
        F.when(u % 4 != 0, F.concat(F.lit("https://x.org/"), u)).alias("url"), "annots",
    )


@query("""SELECT (event_id % 5)::INTEGER AS page, CASE WHEN event_id % 3 = 1 THEN event_type END AS text, count(*) AS n, round(sum(value), 3) AS x
FROM events WHERE event_id % 3 <> 2 AND user_id % 4 <> 0 AND value IS NOT NULL GROUP BY 1, 2""")
def annotation_json(spark, sf_dir):
    """JSON arrays written and read again, notes dropped, corners taken."""
    path = _scratch(spark, "annotations")
    io.write_annotated(_annotated(spark, sf_dir), path, files=4)
    a = store.annotations(store.with_url(io.annotated_documents(spark, path)))
    c = store.corners(a).where("location_type = 'top_left'").join(a.select(F.col("id").alias("annotationid"), "text"), "annotationid")
    return c.groupBy("page", "text").agg(F.count("*").alias("n"), F.round(F.sum("xvalue"), 3).alias("x"))


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'highlight' WHEN 1 THEN 'sticky_note' ELSE 'note' END AS type, count(DISTINCT user_id) AS n_docs, count(*) AS n_annots FROM events GROUP BY 1""")
def annotation_counts(spark, sf_dir):
    """A17."""
    return store.kind_counts(_annotated(spark, sf_dir))


@query("SELECT page_id::BIGINT AS page_id, sha256(html) AS html_sha256 FROM pages WHERE html IS NOT NULL")
def page_files(spark, sf_dir):
    """A file for each page, read again whole."""
    path = _scratch(spark, "pages")
    io.write_pages(table(spark, sf_dir, "pages").where("html is not null"), path, "page_id", "html")
    back = io.pages(spark, f"{path}/*")
    return back.select(F.regexp_extract("path", "page_id=(\\d+)", 1).cast("long").alias("page_id"), F.sha2(F.regexp_replace("html", "\n\\z", ""), 256).alias("html_sha256"))


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def incremental_append(spark, sf_dir):
    """Half of the rows first, then all; each is there once."""
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), _scratch(spark, "append")
    io.append_new(p.where("p_partkey % 2 = 0"), path, ["p_partkey"])
    io.append_new(p, path, ["p_partkey"])
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT doc, n::INTEGER AS n, path FROM (SELECT o_orderstatus AS doc, count(*) AS n, 'file of ' || o_orderstatus AS path FROM orders GROUP BY 1)")
def group_pages(spark, sf_dir):
    """K8, K9: pages of a group with the table of their files, marked and full texts, all read again."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("doc")).agg(F.count("*").cast("string").alias("html"))
    rows = rows.select("doc", "html", F.concat(F.lit("file of "), "doc").alias("path"), F.col("html").alias("marked"), F.concat("html", F.lit("0")).alias("full"))
    path = _scratch(spark, "group")
    io.write_group_pages(rows, path, "doc")
    io.write_texts(rows, path, "doc")
    files = spark.read.schema("doc string, path string").json(f"{path}/files")
    read = lambda kind: spark.read.text(f"{path}/{kind}").select("doc", F.col("value").cast("int").alias(kind))
    both = read("html").join(read("hl"), "doc").join(read("full"), "doc").where("html = hl and full = 10 * hl")
    return both.join(files, "doc").select("doc", F.col("html").alias("n"), "path")


_K = "c_custkey"


def _library(spark, sf_dir):
    """Customers as bibliographic documents."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = k.cast("string")
    return c.select(
        s.alias("id"), F.col("c_name").alias("title"), F.lit("journal").alias("type"), (1990 + k % 30).cast("int").alias("year"),
        F.when(k % 5 != 0, F.array(F.struct(F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name")), F.struct(F.lit("A").alias("first_name"), s.alias("last_name")))).alias("authors"),
        F.when(k % 3 != 0, F.create_map(F.lit("doi"), F.concat(F.lit("10/"), s), F.lit("pmid"), s)).alias("identifiers"),
        F.when(k % 4 != 0, F.array("c_mktsegment", F.concat(F.lit("k"), (k % 7).cast("string")))).alias("keywords"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("http://x.org/"), s))).alias("websites"),
        F.col("c_nationkey").cast("string").alias("group_id"),
    )


@query(f"SELECT {_K}::VARCHAR AS id, c_name AS title, 'journal' AS type, (1990 + {_K} % 30)::VARCHAR AS year, c_nationkey::VARCHAR AS group_id FROM customer")
def shred_documents(spark, sf_dir):
    """G1."""
    return store.scalars(_library(spark, sf_dir))


@query(f"SELECT c_name AS first_name, c_mktsegment AS last_name, {_K}::VARCHAR AS docid FROM customer WHERE {_K} % 5 <> 0 UNION ALL SELECT 'A', {_K}::VARCHAR, {_K}::VARCHAR FROM customer WHERE {_K} % 5 <> 0")
def shred_authors(spark, sf_dir):
    """G2."""
    return store.authors(_library(spark, sf_dir))


@query(f"SELECT {_K}::VARCHAR AS docid, CASE WHEN {_K} % 2 = 0 THEN 'http://x.org/' || {_K} END AS url FROM customer")
def shred_websites(spark, sf_dir):
    """Addresses, and the documents that the log would name."""
    d = _library(spark, sf_dir)
    return layout.all_of(store.websites(d), store.without_websites(d).withColumn("url", F.lit(None).cast("string")))


@query(f"SELECT {_K}::VARCHAR AS docid, '10/' || {_K} AS doi, {_K}::VARCHAR AS pmid, NULL::VARCHAR AS issn FROM customer WHERE {_K} % 3 <> 0")
def shred_identifiers(spark, sf_dir):
    """G4."""
    return store.identifiers(_library(spark, sf_dir)).select("docid", "doi", "pmid", "issn")


@query(f"SELECT c_mktsegment AS value, {_K}::VARCHAR AS docid FROM customer WHERE {_K} % 4 <> 0 UNION ALL SELECT 'k' || {_K} % 7, {_K}::VARCHAR FROM customer WHERE {_K} % 4 <> 0")
def shred_keywords(spark, sf_dir):
    """G5."""
    return store.keywords(_library(spark, sf_dir))


@query("SELECT id, title FROM (SELECT c_custkey::VARCHAR AS id, c_name AS title FROM customer WHERE c_nationkey = 7)")
def documents_of_group(spark, sf_dir):
    """Recorded answers, one group's documents."""
    path = _scratch(spark, "library")
    io.write_annotated(_library(spark, sf_dir), path, files=3, key="id")
    return io.documents_of_group(spark, path, "7").select("id", "title")


@query("SELECT title FROM (SELECT c_name AS title FROM customer ORDER BY c_custkey::VARCHAR LIMIT 5)")
def first_titles(spark, sf_dir):
    """O5."""
    return store.first_titles(_library(spark, sf_dir))


@query("SELECT min(n_nationkey)::INTEGER AS group_id FROM nation WHERE n_regionkey = 2")
def first_group(spark, sf_dir):
    """Of groups with one name the first."""
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.concat(F.lit("region "), "n_regionkey").alias("name"))
    return store.first_group(g, "region 2").select("group_id")


@query("SELECT o_custkey AS document_id, arg_min(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/d/' || o_orderkey END, o_orderkey) AS path FROM orders GROUP BY 1")
def document_paths(spark, sf_dir):
    """A document's first file as a path."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    files = o.select(k.alias("hash"), F.when(k % 5 != 0, F.concat(F.lit("file:///d/"), k)).alias("local_url"))
    return store.first_file(files, o.select(F.col("o_custkey").alias("document_id"), k.alias("hash")))


@query("SELECT o_orderkey AS row_no, o_custkey AS document_id, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def batch_lookup(spark, sf_dir):
    """P5: one join instead of a query for each id."""
    d = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("document_id"))
    return store.lookup(d, ids, "title").select("row_no", "document_id", "title")


@query("SELECT doc_id, length(text)::BIGINT AS value FROM documents WHERE text IS NOT NULL")
def embedding_cache(spark, sf_dir):
    """Values from the cache, the missing ones computed once for each text."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    value = F.length("text").cast("long").alias("value")
    cache = rows.where("doc_id % 2 = 0").select(io.cache_key(F.col("text")).alias("key"), value).distinct()
    got, _ = store.get_or_compute(rows, cache, io.cache_key(F.col("text")), lambda missing: missing.select("key", value))
    return got.select("doc_id", "value")


@query("""SELECT user_id::VARCHAR AS doc_id, 'https://x.org/' || user_id AS url, user_id || '.pdf' AS file FROM events WHERE user_id % 4 <> 0 GROUP BY user_id""")
def pdf_downloads(spark, sf_dir):
    """C15, P3."""
    return store.pdf_downloads(_annotated(spark, sf_dir))


@query("""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'http://aem.asm.org/' || c_custkey || '.full' WHEN c_custkey % 3 = 1 THEN 'https://onlinelibrary.wiley.com/full/' || c_custkey END AS full_url
FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 5 <> 0""")
def download_plan(spark, sf_dir):
    """C14: what isn't fetched yet, by address or identifier, as full-text addresses."""
    k = F.col("document_id")
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    docs = ids.select("document_id", F.when(k % 3 != 2, F.concat(F.lit("10/"), k)).alias("doi"))
    urls = ids.where(k % 3 == 0).select("document_id", F.concat(F.lit(" http://aem.asm.org/"), k).alias("url"))
    known = ids.where(k % 3 == 1).select(F.concat(F.lit("10/"), k).alias("doi"), F.concat(F.lit("https://onlinelibrary.wiley.com/abs/"), k).alias("url"))
    return store.download_plan(ids, docs, urls, known, ids.where(k % 5 == 0))


@query("""SELECT c_custkey AS doc_id, c_name AS doc_title, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey END AS url,
  count(o_orderkey) FILTER (o_orderkey % 3 <> 2) AS n_annots, count(CASE WHEN o_orderkey % 3 = 1 THEN 1 END) AS n_texts
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) GROUP BY ALL""")
def group_annotations(spark, sf_dir):
    """S3, P1, P2 and the annotations of each document as a list."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.concat(F.lit("region "), "n_regionkey").alias("name"))
    files = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("u"), "c_custkey").alias("download_url")))).otherwise(F.array().cast("array<struct<download_url:string>>"))
    docs = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("title"), F.lit(2000).alias("year"), F.lit("s").alias("source"), files.alias("files"))
    k = F.col("o_orderkey")
    annots = o.select(
        F.col("o_custkey").alias("document_id"), k.cast("string").alias("id"), F.when(k % 3 == 0, "highlight").when(k % 3 == 1, "sticky_note").otherwise("note").alias("type"),
        F.lit("p").alias("profile_id"), F.lit("x").alias("text"), F.array(k).alias("positions"),
    )
    got = store.group_annotations(docs, annots, groups, "region 1")
    return got.select(
        "doc_id", "doc_title", "url", F.size("annots").cast("long").alias("n_annots"), F.size(F.filter("annots", lambda a: a["text"].isNotNull())).cast("long").alias("n_texts")
    )


@query("SELECT o_orderkey, 'm' || o_orderkey % 100 AS marker FROM orders")
def next_markers(spark, sf_dir):
    """the cursor in a paging link."""
    k = F.col("o_orderkey")
    link = F.concat(F.lit("https://api.x.org/annotations?limit=200&marker=m"), (k % 100).cast("string"), F.lit("&order=asc"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.next_marker(link).alias("marker"))


@query("SELECT DISTINCT event_type AS tag FROM events UNION SELECT DISTINCT o_orderstatus FROM orders")
def class_union(spark, sf_dir):
    """U2, U1."""
    return layout.distinct_of(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag")), table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tag")))


@query(f"""SELECT DISTINCT item_id, text FROM (SELECT item_id, trim(regexp_replace(regexp_replace({_PLAIN}, '[^\\x00-\\x7F]', '', 'g'), ' +', ' ', 'g')) AS text FROM benchmark) WHERE length(text) >= 31""")
def highlight_strings(spark, sf_dir):
    """The highlighted strings of extract pages; cells and short strings go."""
    body = F.concat(F.lit("<hl>"), plain("text"), F.lit("</hl>\nshort line\n12.5 (3)<br />\n<hl>tiny</hl>\nword<br>"))
    x = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("doc"), body.alias("html"))
    return composites.highlight_strings(x, "doc").select(F.col("doc").alias("item_id"), "text")
