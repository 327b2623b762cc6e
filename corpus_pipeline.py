"""A training corpus from ``documents``: five stages, each one of the package's operators.

Every stage works on all rows that the stage before it kept, and its output is
written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.llm import language_id, near_copies, packing, queries, suffix_dedup, toxicity
from glosswright.llm._shared import cut, release, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this are rejected, like those without letters.
LEAST_SURE = 0.5
#: Documents from this toxicity on are rejected.
MOST_TOXIC = 0.3
#: No stage but packing has rows that SQL can express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows and is sure of.

    Null texts and texts without a letter go.  Every row has its own decision,
    whatever rows share its id or have none.  An empty table stays empty.
    """
    model = language_id.fit(docs, "doc_id", "text", "lang", folds=4, held=2)
    return language_id.annotate(docs.select(*COLUMNS), model).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SURE)
    ).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents under the toxicity threshold, row by row; without labels to learn from, all stay."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", folds=4, held=2)
    return toxicity.annotate(docs.select(*COLUMNS), model).where(F.col("score") < MOST_TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Texts are near-duplicates from a similarity of 0.8 of their five-word shingles on.
    SimHash fingerprints and their Golay keys give the candidates, which are compared
    exactly; pairs that no fingerprint brings together are found by their shingles.
    Every row has its own decision, also if it repeats an id or has none; a null id
    counts as the largest, and of equal ids the text with the least hash stays.
    """
    kept = _least_of_groups(docs)
    release(spark)
    # by content and not by number, so that no numbered copy of the texts is held while the next stage runs
    chosen = docs.select(*COLUMNS, *_content()).join(kept, ["_none", "_id", "_hash"], "left_semi")
    first = chosen.groupBy("_none", "_id", "_hash").agg(F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("row"))
    return first.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def _content() -> list[Column]:
    """What tells documents apart by id and text; rows equal in both are in one group."""
    return [
        F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.coalesce(F.md5("text"), F.lit("none")).alias("_hash"),
    ]


def _least_of_groups(docs: DataFrame) -> DataFrame:
    """(_none, _id, _hash): the least document of each group of near-duplicates."""
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))  # cut, so that numbers stay
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    whole = rows.select("_row", F.struct(order.alias("order"), *_content()).alias("least"))
    groups = whole.join(near_copies.groups(rows, "_row"), "_row")
    return cut(groups.groupBy("group").agg(F.min("least").alias("least")).select("least._none", "least._id", "least._hash"), slim=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that also start earlier; documents with nothing left go.

    Rows without an id count as the last and are cut each by itself.
    """
    return suffix_dedup.cut_repeats(docs.select(*COLUMNS), window=100).where(F.length("text") > 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; rows that share an id, or have none, are packed each by itself."""
    return packing.pack(docs, queries.tokenizer(queries.WORD_BPE), width=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is in the shared folder until the next stage has read it."""
    docs = queries.table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _drop(spark, f"{base}/{k - 1}")
    return docs


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later stage reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
