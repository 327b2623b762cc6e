"""Feature extraction as an estimator and its model: tf-idf, bucket and marker counts, embedding."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.functions import text as t
from glosswright.operators import terms

#: Tokens of a block of lines, within which uses of a term are put together before they are shuffled.
BLOCK = 1 << 21


@dataclass(frozen=True)
class FeatureSpec:
    """Lexicons and switches; the embedding column, if any, comes with the rows."""

    stopwords: tuple[str, ...] = ()
    units: tuple[str, ...] = t.UNITS
    least: int = 5
    embedding: str | None = None
    lowercase: bool = True


def _line_words(text: str, spec: FeatureSpec) -> Column:
    own = t.before_marker(text)
    return t.normal_tokens(own) if spec.lowercase else F.filter(F.split(own, "\\s+"), lambda w: ~w.isin("", "`", "'", "?"))


def _seen(term: str, spec: FeatureSpec) -> Column:
    """Whether the vocabulary sees a word: asked of distinct words, it costs little."""
    return t.token_bucket(term, spec.units).isNull() & ~F.col(term).isin(*spec.stopwords)


def line_features(rows: DataFrame, spec: FeatureSpec, text: str = "text") -> DataFrame:
    """Adds tokens (what the vocabulary sees) and manual counts of every line (M1)."""
    words = _line_words(text, spec)
    out = rows.withColumn("_words", terms.drop_stopwords(words, list(spec.stopwords)) if spec.stopwords else words)
    out = out.withColumn("_tagged", terms.tagged(F.col("_words"), spec.units)).withColumn("_b", terms.counted(F.col("_tagged")))
    manual = [F.col(f"_b.`{b}`").cast("double") for b in t.BUCKETS] + [t.marker_count(text, m).cast("double") for m in t.MARKERS]
    return out.withColumn("tokens", F.col("_b.rest")).withColumn("manual", F.array(*manual)).drop("_words", "_tagged", "_b")


def counter(vocabulary: list[str], tokens: str, out: str) -> CountVectorizerModel:
    """Counts of a vocabulary's terms, which go to the JVM as one text: term by term, 100,000 take several seconds."""
    if any("\n" in x for x in vocabulary):
        return CountVectorizerModel.from_vocabulary(vocabulary, inputCol=tokens, outputCol=out)
    terms = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(vocabulary), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", terms)
    model._set(vocabSize=len(vocabulary))
    return model.setInputCol(tokens).setOutputCol(out)


class FeatureModel:
    """A frozen vocabulary with idf; ``transform`` adds ``features`` (M3, M4)."""

    def __init__(self, spec: FeatureSpec, vocabulary: list[str], idf: list[float]):
        self.spec, self.vocabulary, self.idf = spec, vocabulary, idf

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Order of places: tf-idf by vocabulary, bucket counts, marker counts, embedding."""
        out = line_features(rows, self.spec, text).withColumn("_manual", array_to_vector("manual"))
        parts = ["_manual"]
        if self.vocabulary:
            count = counter(self.vocabulary, "tokens", "_tf")
            weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf")
            out, parts = weigh.transform(count.transform(out)), ["_tfidf", "_manual"]
        if self.spec.embedding:
            out = out.withColumn("_emb", array_to_vector(F.transform(self.spec.embedding, lambda x: x.cast("double"))))
            parts.append("_emb")
        out = VectorAssembler(inputCols=parts, outputCol="features").transform(out)
        return out.drop("_manual", "_tf", "_tfidf", "_emb", "manual", "tokens")

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes lexicons, switches, terms and idf below ``path``."""
        spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        spark.createDataFrame(list(zip(self.vocabulary, self.idf)), "term string, idf double").write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        """What ``save`` wrote."""
        spec = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(spark.read.text(f"{path}/spec").first()["value"]).items()}
        vocab = sorted(spark.read.parquet(f"{path}/vocabulary").collect(), key=lambda r: r["term"])
        return cls(FeatureSpec(**spec), [r["term"] for r in vocab], [r["idf"] for r in vocab])


def _blocks(batches):
    """(lines, terms, line, term, uses): batches cut into blocks, with their distinct terms and each term's lines, by term."""
    for b in batches:
        ends = np.cumsum(b.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + BLOCK, "right")) - at)
            part, at = b.slice(at, n), at + n
            lists = part.column("tokens")
            coded = lists.flatten().dictionary_encode()
            line = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pair, uses = np.unique(coded.indices.to_numpy().astype(np.int64) * n + line, return_counts=True)
            yield part, coded.dictionary, (pair % n).astype(np.int32), pair // n, uses.astype(np.int32)


def term_table(rows: DataFrame, spec: FeatureSpec | None = None, text: str = "text") -> DataFrame:
    """(term, idf) of terms with at least ``least`` uses in all rows, repeated ones too (M2): a table of any length."""
    spec = spec or FeatureSpec()

    def count(batches):
        for _, names, _, term, uses in _blocks(batches):
            cf = np.bincount(term, uses, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(cf), pa.array(np.bincount(term, minlength=len(names)))], names=["term", "cf", "df"])

    words = rows.select(_line_words(text, spec).alias("tokens")).mapInArrow(count, "term string, cf long, df long")
    used = words.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).where((F.col("cf") >= spec.least) & _seen("term", spec))
    return used.select("term", F.log(F.lit(rows.count()) / F.col("df")).alias("idf"))


def sparse_features(rows: DataFrame, vocabulary: DataFrame, spec: FeatureSpec | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``keep`` (all and ``manual``), and ``terms`` with their ``weights``: tf-idf of the line's vocabulary terms in their order (M3, M4).

    What ``FeatureModel`` adds, for a vocabulary of any length: no process holds it.
    A block of lines asks for each of its distinct terms once, with the lines that use
    it, and gets them back in one group, which is no larger than a block.
    """
    spec = spec or FeatureSpec()
    lines = line_features(rows, spec, text).withColumn("tokens", _line_words(text, spec)).select(*(keep if keep is not None else [*rows.columns, "manual"]), "tokens")
    names = ["block", "term", "line", "uses", "lines"]

    def ask(batches):
        task = TaskContext.get().partitionId() << 32
        for k, (part, found, line, term, uses) in enumerate(_blocks(batches)):
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(found))))).astype(np.int32))
            block = pa.array(np.full(len(found), task + k))
            asked = [block, found, pa.ListArray.from_arrays(ends, pa.array(line)), pa.ListArray.from_arrays(ends, pa.array(uses)), pa.nulls(len(found), pa.binary())]
            yield pa.RecordBatch.from_arrays(asked, names=names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (own := part.drop_columns("tokens")).schema) as out:
                out.write_batch(own)
            # no term has a space, so the lines' own record joins nothing, and isn't with others' in one task
            own = [pa.array([task + k]), pa.array([f"{task + k} lines"]), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.array([sink.getvalue().to_pybytes()])]
            yield pa.RecordBatch.from_arrays(own, names=names)

    def gather(group):
        own = group.filter(group.column("lines").is_valid()).column("lines")[0].as_py()
        part = pa.ipc.open_stream(own).read_all()
        got = group.filter(group.column("idf").is_valid()).sort_by("term").combine_chunks()
        line, uses = (got.column(x).combine_chunks() for x in ("line", "uses"))
        of = np.repeat(np.arange(len(line)), line.value_lengths().to_numpy())
        line = line.flatten().to_numpy()
        by = np.argsort(line, kind="stable")
        of = of[by]
        weight = got.column("idf").to_numpy()[of] * uses.flatten().to_numpy()[by]
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(line, minlength=part.num_rows)))).astype(np.int32))
        part = part.append_column("terms", pa.ListArray.from_arrays(ends, got.column("term").combine_chunks().take(pa.array(of))))
        return part.append_column("weights", pa.ListArray.from_arrays(ends, pa.array(weight)))

    schema = T.StructType([*lines.drop("tokens").schema, *T.StructType.fromDDL("terms array<string>, weights array<double>")])
    asked = lines.mapInArrow(ask, "block long, term string, line array<int>, uses array<int>, lines binary")
    known = asked.join(vocabulary.where(_seen("term", spec)).select("term", "idf"), "term", "left").where("idf IS NOT NULL OR lines IS NOT NULL")
    return known.groupBy("block").applyInArrow(gather, schema)


def fit_features(rows: DataFrame, spec: FeatureSpec | None = None, text: str = "text", most: int = 1 << 20) -> FeatureModel:
    """Learns vocabulary and idf from all rows, repeated ones too (M2): terms of at least ``least`` uses, in the order of the term.

    The vocabulary becomes a part of the model and goes to the driver, so it has a
    bound: more than ``most`` terms are an error, for none is dropped in silence.
    ``term_table`` and ``sparse_features`` have no bound.
    """
    spec = spec or FeatureSpec()
    found = term_table(rows, spec, text).persist()
    if found.count() > most:
        found.unpersist()
        raise ValueError(f"over {most} terms: raise ``most`` or the uses that a term needs")
    vocab = found.toArrow().sort_by("term")  # a row object for each term would take ten times as much of the driver
    found.unpersist()
    return FeatureModel(spec, vocab.column("term").to_pylist(), vocab.column("idf").to_pylist())


class Scaler:
    """A fitted scaler; called with rows it adds the scaled column."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).drop("_scaled")


def fit_scaler(rows: DataFrame, vector: str = "features", out: str = "scaled", center: bool = True) -> Scaler:
    """A scaler to mean 0 and population deviation 1 (A16, M5); a constant place becomes 0.

    Without ``center`` the mean stays: sparse vectors stay sparse, and a linear model
    with an intercept learns the same.
    """
    n = rows.count()
    model = StandardScaler(withMean=center, withStd=True, inputCol=vector, outputCol="_scaled").fit(rows)
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # the library divides by the sample's deviation
    widen = ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(model.mean)), inputCol="_scaled", outputCol=out)
    return Scaler(PipelineModel([model, widen]))
