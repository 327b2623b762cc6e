"""The pipeline's stages on a small table, and the first four against what they must keep."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = spark.createDataFrame(
        [(10**9, "12 34 !?", None, None, None), (10**9 + 1, None, "en", "s", 0), (10**9 + 2, "", None, "s", 0)], docs.schema
    )
    rows = docs.union(extra).union(docs.limit(1).withColumn("doc_id", F.lit(10**9 + 3).cast("long")))
    kept = {}
    at = rows
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
            kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        at = out
    assert not kept["language_id"] & {10**9, 10**9 + 1, 10**9 + 2} and 10**9 + 3 in kept["language_id"]
    assert kept["simhash_near_dedup"] <= kept["toxicity"] <= kept["language_id"] and 10**9 + 3 not in kept["simhash_near_dedup"]
    assert {r["doc_id"] for r in at.select("doc_id").distinct().collect()} == kept["suffix_array_dedup"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
