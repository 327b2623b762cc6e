"""A classifier's fit reads rows whose lineage is cut; vocabularies reach the JVM whole."""

import pytest
from pyspark.sql import functions as F

from glosswright.plans import features, models


class Watch:
    """An estimator that keeps what it was fitted on."""

    def fit(self, rows):
        self.rows = rows
        return self


def rows_of(spark, n):
    words = ["yeast", "strain", "grew", "in", "medium", "with", "sugar"]
    return spark.createDataFrame([(k, " ".join(words[(k * j) % 7] for j in range(1, 9)), int(k % 3 == 0)) for k in range(n)], "row_id long, text string, label int").repartition(24, "row_id")


def test_fit_reads_rows_without_lineage(spark):
    rows, seen = rows_of(spark, 300), Watch()
    c = models.SentenceClassifier(lambda n, width: seen, features.FeatureSpec(least=2), ratio=1).fit(rows)
    plan = seen.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "InMemoryRelation" not in plan
    assert seen.rows.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 1) < 48
    got = {r["row_id"]: r["scaled"].toArray().tolist() for r in seen.rows.collect()}
    want = {r["row_id"]: r["scaled"].toArray().tolist() for r in c.scale(c.features.transform(rows)).collect()}
    assert len(got) == 200 and all(got[k] == want[k] for k in got)
    assert {r["row_id"] for r in rows.where("label = 1").collect()} <= set(got)


def test_fit_without_lineage_learns_the_same(spark, monkeypatch):
    rows = rows_of(spark, 240).withColumn("label", (F.col("text").startswith("yeast")).cast("int"))
    cut = models.SentenceClassifier(spec=features.FeatureSpec(least=2)).fit(rows)
    monkeypatch.setattr(models, "cut_for_fit", lambda x: x)
    whole = models.SentenceClassifier(spec=features.FeatureSpec(least=2)).fit(rows)
    assert cut.model.coefficients.toArray() == pytest.approx(whole.model.coefficients.toArray(), rel=1e-3, abs=1e-3)
    a, b = ([r["prediction"] for r in m.predict(rows).orderBy("row_id").collect()] for m in (cut, whole))
    assert a == b


@pytest.mark.parametrize("words", [["a"], ["a", "b.*", "$", "é", "\\n", ""], ["", "z"], ["new\nline", "a"]])
def test_counter_has_the_vocabulary(spark, words):
    made = features.counter(words, "tokens", "n")
    assert list(made.vocabulary) == words and made.getInputCol() == "tokens" and made.getOutputCol() == "n" and made.getVocabSize() == len(words)
    tokens = [*words, words[0], "in none"]
    n = made.transform(spark.createDataFrame([(tokens,)], "tokens array<string>")).first()["n"].toArray()
    assert n.tolist() == [2.0] + [1.0] * (len(words) - 1)
