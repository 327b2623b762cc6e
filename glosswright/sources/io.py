"""Readers and writers of the formats that the pipeline's steps exchange."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glosswright.functions import text as t
from glosswright.sources import schemas


def _scalar(x: str):
    x = x.strip()
    if x[:1] in ("'", '"') and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    if x in ("true", "True", "false", "False"):
        return x.lower() == "true"
    return None if x in ("", "~", "null") else x


def config(path: str) -> dict | None:
    """A file of ``key: value`` lines as a dict, None if it is missing.

    Deeper lines make dicts of their own, ``- value`` lines lists; this much of the
    format is what configurations of this kind use.
    """
    p = Path(path)
    if not p.is_file():
        return None
    root: dict = {}
    levels: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str] | None = None
    for raw in p.read_text().splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, item = len(line) - len(line.lstrip()), line.strip()
        while depth < levels[-1][0] or (depth == levels[-1][0] and isinstance(levels[-1][1], list) and not item.startswith("- ")):
            levels.pop()
        if waiting and (depth > levels[-1][0] or item.startswith("- ")):
            holder: dict | list = [] if item.startswith("- ") else {}
            waiting[0][waiting[1]] = holder
            levels.append((depth, holder))
        elif levels[-1][0] < 0:
            levels.append((depth, root))
        waiting = None
        at = levels[-1][1]
        if isinstance(at, list):
            at.append(_scalar(item[2:]))
        elif ":" in item:
            key, value = item.split(":", 1)
            at[key.strip()] = _scalar(value)
            waiting = (at, key.strip()) if not value.strip() else None
    return root


def annotated_documents(spark: SparkSession, path: str) -> DataFrame:
    """The annotation export (S7); what can't be read is null."""
    return spark.read.schema(schemas.ANNOTATED).options(multiLine=True, mode="PERMISSIVE", recursiveFileLookup=True).json(path)


def bibliographic_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BIBLIOGRAPHIC).options(multiLine=True, recursiveFileLookup=True).json(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of a folder's files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def labelled_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(label, text, fold) of label-TAB-sentence lines; lines of 4 characters or fewer are skipped.

    ``fold`` is the file's name.
    """
    rows = spark.read.text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("fold"))
    return rows.where(F.length("value") > 4).select(
        F.substring("value", 1, 1).cast("int").alias("label"), F.trim(F.expr("substring(value, 2)"), F.lit(" \t\r\n")).alias("text"), "fold"
    )


def tagged_samples(spark: SparkSession, path: str) -> DataFrame:
    """(words, tags) of JSON lines."""
    pair = F.from_json("value", "array<array<string>>")
    return spark.read.text(path).select(pair[0].alias("words"), pair[1].alias("tags"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): the words of a file."""
    return spark.read.text(path).select(F.explode(t.nonblank_words("value")).alias("term")).distinct()


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(idx, tag) of a sorted class list, '' as 0."""
    from glosswright.operators.tagging import class_list

    return class_list(spark.read.text(path).select(F.col("value").alias("tag")))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def database(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Any table or query that a JDBC driver on the class path reaches."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PagedReader(DataSourceReader):
    """Recorded answers of a paged interface: one file a page, named by the links that the pages hold."""

    def __init__(self, options):
        self.folder, self.first = Path(options["path"]), options.get("first", "start")

    def partitions(self):
        out, at, seen = [], self.first, set()
        while at and at not in seen:
            seen.add(at)
            path = self.folder / f"{at}.json"
            if not path.is_file():
                break
            out.append(_Page(str(path)))
            link = json.loads(path.read_text()).get("next")
            at = link.split("marker=")[-1].split("&")[0] if link and "marker=" in link else None
        return out

    def read(self, partition) -> Iterator[tuple]:
        for item in json.loads(Path(partition.path).read_text()).get("items", []):
            yield (json.dumps(item),)


class PagedSource(DataSource):
    """``spark.read.format("paged_json")``: follows ``marker`` links until there is none."""

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "item string"

    def reader(self, schema):
        return _PagedReader(self.options)


def paged_items(spark: SparkSession, path: str, schema: str, first: str = "start") -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").option("path", path).option("first", first).load().select(F.from_json("item", schema).alias("i")).select("i.*")


def write_annotated(docs: DataFrame, path: str, files: int | None = None, key: str = "doc_id") -> None:
    """Annotated documents as JSON (K1): a document a line, or as ``files`` files that hold an array each."""
    if files is None:
        docs.write.mode("overwrite").json(path)
        return
    one = F.to_json(F.struct(*docs.columns))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    arrays = docs.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("part").text(path)  # a row, so a file, for each


def write_sentences(sents: DataFrame, path: str, doc: str = "doc_id") -> None:
    """label-TAB-sentence lines, a folder for each document (K2)."""
    sents.select(doc, F.concat_ws("\t", F.col("label").cast("string"), "sentence").alias("value")).write.mode("overwrite").partitionBy(doc).text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """[words, tags] JSON lines (K3)."""
    samples.select(F.to_json(F.array("words", "tags")).alias("value")).write.mode("overwrite").text(path)


def write_classes(tags: DataFrame, path: str, tag: str = "tag") -> None:
    """Sorted distinct tags, a line each (K4): one file, as large as the class list."""
    names = tags.where(F.col(tag) != "").select(F.col(tag).alias("value")).distinct()
    names.orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_pages(rows: DataFrame, path: str, doc: str = "doc_id", text: str = "html") -> None:
    """One folder a document with its text (K7, K8, K9)."""
    rows.select(doc, F.col(text).alias("value")).write.mode("overwrite").partitionBy(doc).text(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)  # K11, K12, K15


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key the table hasn't got; how many."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no table yet, or an empty folder
            raise
        done = rows.select(*keys).limit(0)
    fresh = rows.join(done.distinct(), keys, "left_anti").dropDuplicates(keys)
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # K14: a row a fold


def ensure_table(spark: SparkSession, name: str, schema: str) -> None:
    """Creates a table if it is missing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def cache_key(text: Column) -> Column:
    return F.sha2(text, 256)  # D21


def layout_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Words, glyphs, font runs or marks of pages that a PDF library has written as JSON lines."""
    return spark.read.schema(schema).json(path)


def documents_of_group(spark: SparkSession, path: str, group: str) -> DataFrame:
    """A group's documents from recorded answers."""
    return bibliographic_documents(spark, path).where(F.col("group_id") == group)


def save_samples(rows: DataFrame, path: str) -> None:
    """Prepared (label, features) rows, features as arrays."""
    rows.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("features")).write.mode("overwrite").parquet(path)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """The same rows again, features as vectors."""
    return spark.read.schema(schemas.PREPARED).parquet(path).withColumn("features", array_to_vector("features"))


def write_group_pages(rows: DataFrame, path: str, doc: str = "doc_id", html: str = "html", file: str = "path") -> None:
    """Each document's page, and a table beside them of the files that they come from (K8)."""
    write_pages(rows, f"{path}/html", doc, html)
    rows.select(doc, file).write.mode("overwrite").json(f"{path}/files")


def write_texts(rows: DataFrame, path: str, doc: str = "doc_id", marked: str = "marked", full: str = "full") -> None:
    """Each document's marked strings and its full text, in a folder each (K9)."""
    write_pages(rows, f"{path}/hl", doc, marked)
    write_pages(rows, f"{path}/full", doc, full)


def history(rows: list[dict]) -> list[dict]:
    """Metrics by epoch in long form, ready for a table: (epoch, metric, value)."""
    return [{"epoch": k, "metric": name, "value": float(v)} for k, r in enumerate(rows) for name, v in sorted(r.items())]


def write_history(spark: SparkSession, rows: list[dict], path: str) -> None:
    spark.createDataFrame(history(rows), "epoch int, metric string, value double").coalesce(1).write.mode("overwrite").json(path)


def write_search(spark: SparkSession, report: list[dict], path: str) -> None:
    """A grid search's report, a JSON line for each combination."""
    lines = [(json.dumps(r, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x), sort_keys=True),) for r in report]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
