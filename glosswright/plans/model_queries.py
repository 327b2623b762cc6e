"""Queries that fit models: rows only, since no SQL says what they learn."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswright.operators import sentences
from glosswright.plans.models import SentenceClassifier
from glosswright.plans.registry import query, table


@query()
def highlight_classifier(spark, sf_dir):
    """Sentences of labelled documents, the classifier fitted on half of the sources, applied to the others."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    s = docs.select("doc_id", "source", F.col("quality").alias("label"), F.posexplode(sentences.split_text("text")).alias("sent_no", "text"))
    s = s.withColumn("row_id", F.xxhash64("doc_id", "sent_no"))
    even = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(2)) == 0
    model = SentenceClassifier(ratio=1).fit(s.where(even))
    out = model.predict(s.where(~even)).groupBy("source")
    return out.agg(F.count("*").alias("n_sentences"), F.sum(F.col("prediction").cast("long")).alias("n_predicted"), F.sum("label").alias("n_labelled"))
