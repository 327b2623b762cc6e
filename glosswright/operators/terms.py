"""Term statistics: frequencies, vocabulary, tf-idf, lexicon filters and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import text as t


def terms(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term): every token of the lower-cased text."""
    return docs.select(doc, F.explode(t.nonblank_words(F.lower(text))).alias("term"))


def term_frequency(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf): counts within a document (A1)."""
    return tokens.groupBy(doc, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, n_docs: int | Column, least: int = 5) -> DataFrame:
    """(term, cf, df, idf) of terms with a corpus frequency of ``least`` or more; idf = ln(N / df) (A2, A3)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return (
        tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where(F.col("cf") >= least)
        .withColumn("idf", F.log(n / F.col("df")))
    )


def tf_idf(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """tf with weight = idf x tf for vocabulary terms."""
    return tf.join(vocab.select("term", "idf"), "term").withColumn("weight", F.col("idf") * F.col("tf"))


def top_terms(weighted: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """Each document's k heaviest terms; equals in the order of the term."""
    w = Window.partitionBy(doc).orderBy(F.desc("weight"), "term")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def without_stopwords(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens that aren't in the lexicon, repeats kept."""
    return tokens.join(stopwords.select("term").distinct(), "term", "left_anti")


def drop_stopwords(words: Column, stopwords: list[str]) -> Column:
    """The same on an array column, for a lexicon of fixed size."""
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def unit_hits(words: Column, units: list[str]) -> Column:
    """How many tokens are units."""
    return F.size(F.filter(words, lambda w: w.isin(*units)))


def _in(bucket: str):
    return lambda x: x["b"] == F.lit(bucket)


def tagged(words: Column, units=t.UNITS) -> Column:
    """Tokens with their buckets, empty for none."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), F.coalesce(t.token_bucket(w, units), F.lit("")).alias("b")))


def bucketed(words: Column, units=t.UNITS) -> Column:
    """A struct of bucket counts, and ``rest``: the tokens in none (A5)."""
    return counted(tagged(words, units))


def counted(tagged: Column) -> Column:
    """The same of tagged tokens: in a column of their own they are tagged once, not for each field."""
    counts = [F.size(F.filter(tagged, _in(b))).alias(b) for b in t.BUCKETS]
    rest = F.transform(F.filter(tagged, _in("")), lambda x: x["w"])
    return F.struct(*counts, rest.alias("rest"))


def bucket_counts(tokens: DataFrame, doc: str = "doc_id", units=t.UNITS) -> DataFrame:
    """(doc, bucket, n) in long form."""
    return tokens.withColumn("bucket", t.token_bucket("term", units)).where("bucket is not null").groupBy(doc, "bucket").agg(F.count("*").alias("n"))
