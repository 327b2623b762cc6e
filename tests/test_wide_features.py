"""Vocabularies that no process holds."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glosswright.plans import features, layout_queries


def lines(spark):
    rows = [(k, f"alpha beta beta w{k % 7} 30 mg the x{k}") for k in range(40)] + [(40, ""), (41, None), (1, "alpha alpha")]
    return spark.createDataFrame(rows, "row_id long, text string").repartition(3)


def test_queries_have_no_bound(spark, monkeypatch, tmp_path):
    def bounded(*a, **k):
        raise ValueError("a vocabulary on the driver")

    monkeypatch.setattr(features, "fit_features", bounded)
    lines(spark).withColumnRenamed("row_id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    assert layout_queries.feature_idf(spark, str(tmp_path)).count() > 2
    assert layout_queries.feature_vectors(spark, str(tmp_path)).count() == 42 + 21


@pytest.mark.parametrize("block", [5, 1 << 21])
def test_table_gives_what_the_model_gives(spark, monkeypatch, block):
    monkeypatch.setattr(features, "BLOCK", block)
    spec = features.FeatureSpec(stopwords=("the",), least=5)
    rows = lines(spark).where("text IS NOT NULL")
    m, v = features.fit_features(rows, spec), features.term_table(rows, spec)
    assert sorted((r["term"], r["idf"]) for r in v.collect()) == list(zip(m.vocabulary, m.idf))
    want = m.transform(rows).select("row_id", "text", vector_to_array("features").alias("f")).collect()
    got = features.sparse_features(rows, v, spec).collect()
    place = {w: k for k, w in enumerate(m.vocabulary)}
    wide = lambda r: [dict(zip((place[w] for w in r["terms"]), r["weights"])).get(k, 0.0) for k in range(len(place))] + r["manual"]
    assert all(r["terms"] == sorted(r["terms"]) for r in got)
    assert sorted((r["row_id"], r["text"], tuple(wide(r))) for r in got) == sorted((r["row_id"], r["text"], tuple(r["f"])) for r in want)


def test_lines_without_words_stay(spark):
    rows = lines(spark)
    out = features.sparse_features(rows, features.term_table(rows), keep=["row_id"])
    assert sorted(r["row_id"] for r in out.where(F.size("terms") == 0).collect()) == [40, 41]
