"""The reference manager's tables: joins of groups, documents, files and marks; shredding; rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions import text as t


def group_documents(remote: DataFrame, groups: DataFrame, name: str | None = None) -> DataFrame:
    """Documents of named groups (J1, P4): inner join on the group, empty names dropped."""
    g = groups.where((F.col("name") != "") if name is None else (F.col("name") == name))
    return remote.join(g.select("group_id", "name"), "group_id")


def first_group(groups: DataFrame, name: str) -> DataFrame:
    """The group of that name with the smallest id, or no row (S3)."""
    return groups.where(F.col("name") == name).orderBy("group_id").limit(1)


def document_files(files: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, hash, path) of every document's files."""
    return links.join(files, "hash", "left").select("document_id", "hash", t.local_path("local_url").alias("path"))


def first_file(files: DataFrame, links: DataFrame) -> DataFrame:
    """(document_id, path): the path of the file with the least hash, '' where it is missing."""
    return document_files(files, links).groupBy("document_id").agg(F.min_by("path", "hash").alias("path"))


def document_marks(links: DataFrame, marks: DataFrame, rects: DataFrame) -> DataFrame:
    """Each document's marks and rectangles with a page (J3, J5): left chain, then page IS NOT NULL."""
    return (
        links.join(marks, "hash", "left").join(rects, "mark_id", "left").where(F.col("page").isNotNull())
        .select("document_id", "hash", "mark_id", "page", "x1", "y1", "x2", "y2")
    )


def group_marks(remote: DataFrame, groups: DataFrame, links: DataFrame, marks: DataFrame, rects: DataFrame) -> DataFrame:
    """The five-table chain: marks with their document's group."""
    return document_marks(links, marks, rects).join(remote, "document_id", "left").join(groups.select("group_id", "name"), "group_id", "left")


def lookup(documents: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Columns of many documents at once instead of a query each (P5)."""
    return ids.join(documents.select("document_id", *columns), "document_id", "left")


def scalars(docs: DataFrame, nested: tuple[str, ...] = ("authors", "identifiers", "keywords", "websites")) -> DataFrame:
    """All other columns as strings (G1); rows that are null throughout are skipped."""
    keep = [c for c in docs.columns if c not in nested]
    return docs.select(*(F.col(c).cast("string").alias(c) for c in keep)).dropna("all")


def authors(docs: DataFrame, doc: str = "id", strict: bool = False) -> DataFrame:
    """(first_name, last_name, docid) (G2); a document without a list has no rows, or, if ``strict``, is an error."""
    if strict:
        docs = docs.withColumn("authors", F.coalesce("authors", F.raise_error(F.concat(F.lit("no authors in "), F.col(doc))).cast(docs.schema["authors"].dataType)))
    return docs.select(F.col(doc).alias("docid"), F.explode("authors").alias("a")).select("a.first_name", "a.last_name", "docid")


def websites(docs: DataFrame, doc: str = "id") -> DataFrame:
    return docs.select(F.explode("websites").alias("url"), F.col(doc).alias("docid"))


def without_websites(docs: DataFrame, doc: str = "id") -> DataFrame:
    """What the log would name."""
    return docs.where(F.coalesce(F.size("websites"), F.lit(-1)) < 1).select(F.col(doc).alias("docid"))


def identifiers(docs: DataFrame, names: tuple[str, ...] = ("issn", "isbn", "pmid", "arxiv", "doi", "scopus"), doc: str = "id") -> DataFrame:
    """One wide row a document."""
    return docs.where("identifiers is not null").select(*(F.col("identifiers")[n].alias(n) for n in names), F.col(doc).alias("docid"))


def keywords(docs: DataFrame, doc: str = "id") -> DataFrame:
    return docs.select(F.explode("keywords").alias("value"), F.col(doc).alias("docid"))


def annotations(docs: DataFrame) -> DataFrame:
    """(doc_id, id, type, profile_id, text): notes dropped, text only for sticky notes."""
    a = docs.select("doc_id", F.explode("annots").alias("a")).where(F.col("a.type") != "note")
    return a.select("doc_id", "a.id", "a.type", "a.profile_id", F.when(F.col("a.type") == "sticky_note", F.col("a.text")).alias("text"), "a.positions")


def corners(annots: DataFrame) -> DataFrame:
    """(page, location_type, xvalue, yvalue, annotationid): a row for each corner that is there."""
    p = annots.select(F.col("id").alias("annotationid"), F.explode("positions").alias("p"))
    each = F.explode(F.array(*(
        F.struct(F.lit(n).alias("location_type"), F.col(f"p.{n}.x").alias("xvalue"), F.col(f"p.{n}.y").alias("yvalue")) for n in ("top_left", "bottom_right")
    )))
    out = p.select("annotationid", F.col("p.page").alias("page"), each.alias("c"))
    return out.where("c.xvalue is not null and c.yvalue is not null").select("page", "c.location_type", "c.xvalue", "c.yvalue", "annotationid")


def new_marks(rects: DataFrame, keys: list[str], author: str = "automatic") -> tuple[DataFrame, DataFrame]:
    """(marks, rects) to append, tied by a key made of their natural one."""
    key = F.sha2(F.concat_ws("\u0001", *(F.col(k).cast("string") for k in keys)), 256)
    keyed = rects.withColumn("mark_id", key)
    marks = keyed.select("mark_id", *keys).distinct().withColumn("author", F.lit(author))
    return marks, keyed


def without_automatic(marks: DataFrame, rects: DataFrame, author: str = "automatic") -> tuple[DataFrame, DataFrame]:
    """Both tables without that author's marks, no rectangle left behind."""
    gone = marks.where(F.col("author") == author).select("mark_id").distinct()
    return marks.join(gone, "mark_id", "left_anti"), rects.join(gone, "mark_id", "left_anti")


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key hasn't been written."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def get_or_compute(rows: DataFrame, cache: DataFrame, key: Column, compute) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached or computed value, what to append to the cache).

    ``compute`` maps distinct missing keys (column ``key`` and the row's columns) to
    (key, value).
    """
    keyed = rows.withColumn("key", key)
    missing = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = compute(missing)
    return keyed.join(cache.unionByName(fresh), "key", "left"), fresh


def first_url(files: str | Column = "files") -> Column:
    """The download address of the first file, null if there is none."""
    return F.try_element_at(F.col(files) if isinstance(files, str) else files, F.lit(1))["download_url"]


def with_url(docs: DataFrame, url: str = "url") -> DataFrame:
    """Documents that have an address."""
    return docs.where(F.col(url).isNotNull())


def group_annotations(docs: DataFrame, annots: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """(doc_id, doc_title, year, source, url, annots): the annotated documents of a group.

    ``docs`` hold group_id, document_id, title, year, source and files; ``annots``
    hold document_id, id, type, profile_id, text and positions.  Notes of the kind
    that marks nothing are dropped; a document without annotations has an empty list.
    """
    own = docs.join(first_group(groups, name).select("group_id"), "group_id").select("document_id", F.col("title").alias("doc_title"), "year", "source", first_url().alias("url"))
    kept = annots.where(F.col("type") != "note").withColumn("text", F.when(F.col("type") == "sticky_note", F.col("text")))
    one = F.struct("id", "type", "profile_id", "text", "positions")
    lists = kept.groupBy("document_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("annots"))
    out = own.join(lists, "document_id", "left")
    return out.select(F.col("document_id").alias("doc_id"), "doc_title", "year", "source", "url", "annots").withColumn(
        "annots", F.coalesce("annots", F.array().cast(out.schema["annots"].dataType))
    )


def resolved(rows: DataFrame, addresses: DataFrame, doi: str = "doi") -> DataFrame:
    """Rows with ``doi_url``, from a table (doi, url) of resolved identifiers, '' where it has none."""
    known = addresses.groupBy("doi").agg(F.min("url").alias("doi_url"))
    return rows.join(known.withColumnRenamed("doi", doi), doi, "left").withColumn("doi_url", F.coalesce("doi_url", F.lit("")))


def download_plan(ids: DataFrame, documents: DataFrame, urls: DataFrame, addresses: DataFrame, done: DataFrame, prefer: str = "url") -> DataFrame:
    """(document_id, full_url) of what is still to be fetched (C14: K16, P5, S21, P6, P7); fetching itself is left to others.

    ``documents`` hold document_id and doi, ``urls`` document_id and url, ``done``
    document_id; documents without any address are left out.
    """
    own = not_yet(ids.select("document_id").distinct(), done, ["document_id"])
    first = urls.groupBy("document_id").agg(F.min("url").alias("url"))
    known = resolved(lookup(documents, own, "doi").join(first, "document_id", "left"), addresses)
    return known.select("document_id", t.full_text_url(t.preferred_url("url", "doi_url", prefer)).alias("full_url")).where("full_url is not null")


def pdf_downloads(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, url, file) of annotated documents with an address (C15: S7, P3)."""
    return with_url(docs).select(doc, "url", F.concat(F.col(doc).cast("string"), F.lit(".pdf")).alias("file"))


def kind_counts(docs: DataFrame) -> DataFrame:
    """(type, n_docs, n_annots): what a run would log about its annotations."""
    a = docs.select("doc_id", F.explode("annots").alias("a")).select("doc_id", "a.type")
    return a.groupBy("type").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_annots"))


def first_titles(docs: DataFrame, n: int = 5, title: str = "title", order: str = "id") -> DataFrame:
    """The first few titles, for a look at a group (O5): the limit is the feature."""
    return docs.orderBy(order).select(title).limit(n)
