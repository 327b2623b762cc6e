"""Sentence classifiers: the families, grid search over shuffle splits, leave-one-document-out, word tagger."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.operators import evaluation, sampling, tagging
from glosswright.plans.features import FeatureModel, FeatureSpec, Scaler, fit_features, fit_scaler
from glosswright.session import shared_folder

#: Rows of a partition that a fit reads.
PART_ROWS = 1 << 19


def linear_svm(c: float, n: int, features: str = "features") -> Estimator:
    return LinearSVC(featuresCol=features, labelCol="label", regParam=1 / (c * max(n, 1)), maxIter=100)


def logistic(c: float, n: int, penalty: str = "l1", features: str = "features", iterations: int = 100) -> Estimator:
    """L1, L2 or no penalty; the strength is 1 / (C n) since the loss is a mean here."""
    reg = 0.0 if penalty == "none" else 1 / (c * max(n, 1))
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=reg, elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=iterations)


def forest(trees: int = 141, share: float = 0.9, features: str = "features") -> Estimator:
    return RandomForestClassifier(featuresCol=features, labelCol="label", numTrees=trees, subsamplingRate=share, maxDepth=12, seed=42)  # M9


def perceptron(width: int, hidden: tuple[int, ...] = (50,), features: str = "features", iterations: int = 100) -> Estimator:
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol="label", layers=[width, *hidden, 2], maxIter=iterations, seed=42)  # M11


class RadialFeatures:
    """Random Fourier features of the radial kernel (Rahimi and Recht, 2007): there is no kernel machine in MLlib (M8)."""

    def __init__(self, width: int, size: int = 512, gamma: float | None = None, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, math.sqrt(2 * (gamma or 1 / max(width, 1))), (width, size))
        self.b = rng.uniform(0, 2 * math.pi, size)

    def transform(self, rows: DataFrame, vector: str = "features", out: str = "radial") -> DataFrame:
        w, b = self.w, self.b

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_list()) if len(x) else np.zeros((0, len(w)))
            return pd.Series(list(math.sqrt(2 / len(b)) * np.cos(m @ w + b)))

        return rows.withColumn(out, array_to_vector(project(vector_to_array(vector))))


class SigmoidFeatures:
    """Values of the sigmoid kernel tanh(gamma x.z + shift) with some rows as landmarks (M8): a linear machine on them is
    that kernel's in the span of the landmarks, of which there are at most ``size``."""

    def __init__(self, rows: DataFrame, vector: str = "features", size: int = 256, gamma: float | None = None, shift: float = 0.0, key: str = "row_id"):
        got = sampling.smallest_hashes(rows, size, key).select(vector_to_array(vector).alias("v")).collect()  # size vectors
        self.z = np.array([r["v"] for r in got])
        self.gamma, self.shift = gamma or 1 / max(1, self.z.shape[-1]), shift

    def transform(self, rows: DataFrame, vector: str = "features", out: str = "sigmoid") -> DataFrame:
        z, gamma, shift = self.z, self.gamma, self.shift

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_list()) if len(x) else np.zeros((0, z.shape[1]))
            return pd.Series(list(np.tanh(gamma * m @ z.T + shift)))

        return rows.withColumn(out, array_to_vector(project(vector_to_array(vector))))


def scores(predictions: DataFrame) -> dict[str, float]:
    """Precision, recall and F1 of label 1; 0 where undefined."""
    one = F.lit(1.0)
    r = predictions.agg(
        F.sum(F.when((F.col("label") == one) & (F.col("prediction") == one), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("prediction") == one, 1).otherwise(0)).alias("said"), F.sum(F.when(F.col("label") == one, 1).otherwise(0)).alias("true"),
    ).first()
    p = (r["tp"] or 0) / r["said"] if r["said"] else 0.0
    q = (r["tp"] or 0) / r["true"] if r["true"] else 0.0
    return {"precision": p, "recall": q, "f1": 2 * p * q / (p + q) if p + q else 0.0}


def grid_search(rows: DataFrame, make: Callable[..., Estimator], grid: dict[str, list], splits: int = 5, test: float = 0.1, workers: int = 6, key: str = "row_id") -> tuple[Model, dict, list[dict]]:
    """(model refitted on all rows, its parameters, a report) over shuffle splits.

    A split's test rows are those whose key hashes into its share, so splits are the
    same on every run; combinations are fitted side by side.
    """
    names = sorted(grid)
    combos = [dict(zip(names, v)) for v in product(*(grid[n] for n in names))]
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(1_000)) < int(test * 1_000)

    def one(task):
        combo, k = task
        model = make(**combo).fit(rows.where(~draw(k)))
        return scores(model.transform(rows.where(draw(k))))

    tasks = [(c, k) for c in combos for k in range(splits)]
    with ThreadPool(workers) as pool:
        got = pool.map(one, tasks)
    report = []
    for i, c in enumerate(combos):
        mine = got[i * splits : (i + 1) * splits]
        report.append(c | {f"mean_{m}": sum(x[m] for x in mine) / splits for m in ("precision", "recall", "f1")})
    best = max(report, key=lambda r: r["mean_f1"])
    params = {n: best[n] for n in names}
    return make(**params).fit(rows), params, report


def cut_for_fit(rows: DataFrame) -> DataFrame:
    """The rows without their lineage, for a fit that reads them many times.

    A lineage with a model of many terms would be sent with every task of every
    iteration.  The table is in the shared folder, in as many partitions as there are
    cores, or as hold PART_ROWS rows each: every partition adds a dense gradient.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    return rows.coalesce(max(spark.sparkContext.defaultParallelism, rows.count() // PART_ROWS)).checkpoint(eager=True)


class SentenceClassifier:
    """Features, scaling, down-sampled negatives and a classifier; ``predict`` scores new rows."""

    def __init__(self, make: Callable[[int, int], Estimator] | None = None, spec: FeatureSpec | None = None, ratio: int = 3, key: str = "row_id"):
        self.center = make is not None  # the default is linear and has an intercept
        self.make = make or (lambda n, width: logistic(1.0, n, "l2", "scaled"))
        self.spec, self.ratio, self.key = spec or FeatureSpec(), ratio, key

    def fit(self, rows: DataFrame, text: str = "text") -> SentenceClassifier:
        self.features = fit_features(rows, self.spec, text)
        x = self.features.transform(rows, text).withColumn("label", F.col("label").cast("double"))
        x = (x if self.center else x.select(self.key, "label", "features")).cache()
        self.scale = fit_scaler(x, center=self.center)
        part = self.scale(sampling.balanced(x, self.key, ratio=self.ratio))
        part = cut_for_fit(part if self.center else part.select("label", "scaled"))
        n, width = part.count(), len(part.first()["scaled"]) if not part.isEmpty() else 0
        x.unpersist()
        self.model = self.make(n, width).fit(part)
        return self

    def predict(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return self.model.transform(self.scale(self.features.transform(rows, text)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes features, scaler and classifier below ``path``."""
        self.features.save(spark, f"{path}/features")
        PipelineModel([self.scale.model, self.model]).write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SentenceClassifier:
        """A fitted classifier as ``save`` wrote it."""
        out = cls()
        out.features = FeatureModel.load(spark, f"{path}/features")
        out.spec = out.features.spec
        scale, out.model = PipelineModel.load(f"{path}/model").stages
        out.scale = Scaler(scale)
        return out

    def highlights(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Rows predicted to be of interest."""
        return self.predict(rows, text).where(F.col("prediction") == 1.0)


def leave_one_out(rows: DataFrame, fold: str, make: Callable[[], SentenceClassifier] = SentenceClassifier, workers: int = 4) -> list[dict]:
    """A report row for each fold: trained on the others, scored on it.

    The loop is over folds, which are as many models; each model's work is distributed.
    """
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]

    def one(value):
        held = rows.where(F.col(fold) == F.lit(value))
        p = make().fit(evaluation.others(rows, fold, value)).predict(held)
        s = scores(p)
        return {"fold": value, "precision": s["precision"], "recall": s["recall"]}

    with ThreadPool(workers) as pool:
        return pool.map(one, folds)


def word_tagger(features: int = 1 << 14, iterations: int = 60) -> Pipeline:
    """Character n-grams of a word with its neighbours, hashed, and a softmax: stands in for a recurrent net."""
    def chars(n):
        return NGram(n=n, inputCol="_c", outputCol=f"_g{n}")

    return Pipeline(stages=[
        StringIndexer(inputCol="tag", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="sample", outputCol="_c", pattern="(?s).", gaps=False, toLowercase=False), chars(2), chars(3),
        SQLTransformer(statement="SELECT *, concat(_c, _g2, _g3) AS _all FROM __THIS__"),
        HashingTF(inputCol="_all", outputCol="features", numFeatures=features),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-4, maxIter=iterations),
    ])


def tag_words(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Adds the most likely tag."""
    names = F.array(*map(F.lit, [*model.stages[0].labels, ""]))
    return model.transform(samples).withColumn("predicted_tag", F.element_at(names, F.col("prediction").cast("int") + 1))



def tag_sentence(model: PipelineModel, spark: SparkSession, sentence: str) -> DataFrame:
    """(pos, word, predicted_tag) of a literal sentence (M21): words, their samples, the most likely tags."""
    one = spark.createDataFrame([(0, sentence)], "id int, sentence string")
    words = one.select("id", F.posexplode(t.nonblank_words("sentence")).alias("pos", "word"))
    near = tagging.context(words, ["id"], "pos")
    samples = near.withColumn("sample", F.substring(tagging.sample_text("before", "word", "after"), 1, tagging.SAMPLE_LENGTH)).withColumn("tag", F.lit(""))
    return tag_words(model, samples).select("pos", "word", "predicted_tag")


def fit_tagger(samples: DataFrame, key: str = "row_id", held: float = 0.2, iterations: tuple[int, ...] = (10, 30, 60), features: int = 1 << 14) -> tuple[PipelineModel, list[dict]]:
    """(tagger, history): trained with a validation part and an early stop.

    A part of the samples, by the hash of their key, is held back; training goes on
    from one number of iterations to the next while that part's accuracy rises.
    """
    test = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000)) < int(held * 1_000)
    best, done = None, []
    for n in iterations:
        model = word_tagger(features, n).fit(samples.where(~test))
        right = lambda rows: tag_words(model, rows).agg(F.avg((F.col("tag") == F.col("predicted_tag")).cast("double"))).first()[0] or 0.0
        done.append({"iterations": n, "accuracy": right(samples.where(~test)), "val_accuracy": right(samples.where(test))})
        if best is not None and done[-1]["val_accuracy"] <= max(r["val_accuracy"] for r in done[:-1]):
            break
        best = model
    return best, done
