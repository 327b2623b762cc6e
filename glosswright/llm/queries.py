"""The thin queries over this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.llm import ann_forest, bpe, golay_simhash, language_id, line_crf, packing, pivot_join, suffix_dedup, token_counts, toxicity, training
from glosswright.session import workers_find_package

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"), window=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), limit=1024)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", folds=4, held=2)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (training.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, "doc_id", "text", "lang", folds=4, held=2)
    return language_id.predict(docs, model).select(
        "doc_id", (training.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_forest.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.fit(docs, labels, "doc_id", "text", "quality", folds=5, held=0)
    scored = line_crf.score(docs, model)
    return scored.select(
        "doc_id", (training.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), width=2048, end_id=1, ids=False)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_join.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, apart=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_suffix_dedup, op2_token_counts, op3_toxicity, op4_bpe, op5_language_id,
            op6_ann, op7_quality, op8_packing, op9_embedding_dedup, op10_simhash,
        )
    }


#: Links within a label by brute force, components by a recursive union of what is reachable.
_SQL_9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links,
       min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r GROUP BY r.a
"""

#: Every 100-byte string by its position, over bytes written as hex digits.
_SQL_1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (  -- blocks of 1000 starts: cutting windows out of short strings is cheap
  SELECT doc_id, 1000 * b AS base, substr(h, 2000 * b + 1, 2198) AS h
  FROM d, LATERAL (SELECT unnest(range(0, greatest(0, (length(h) // 2 - 99 + 999) // 1000)::BIGINT)) AS b) t
), w AS (
  SELECT doc_id, base + s AS s, md5_number(substr(h, 2 * s + 1, 200)) AS k
  FROM p, LATERAL (SELECT unnest(range(0, least(1000, length(h) // 2 - 99)::BIGINT)) AS s) t
), f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM w),
r AS (SELECT doc_id, s FROM f WHERE nth > 1),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS nr FROM g),
span AS (SELECT doc_id, nr, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, nr),
gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
         row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM span
), kept AS (
  SELECT gap.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN back = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS k
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


#: The true neighbours, by brute force: what the search returns on tables that it goes through whole.
_SQL_6 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ann": _SQL_6, "op1_suffix_dedup": _SQL_1, "op9_embedding_dedup": _SQL_9}
