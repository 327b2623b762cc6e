"""Word tags: context windows, character samples, class lists and tagged samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import text as t

BEL = "\u0007"
SAMPLE_LENGTH = 100


def context(words: DataFrame, keys: list[str], order: str, word: str = "word") -> DataFrame:
    """Each word with the one before and after it, '' beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    return words.withColumn("before", F.coalesce(F.lag(word).over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead(word).over(w), F.lit("")))


def sample_text(before: str | Column, word: str | Column, after: str | Column) -> Column:
    """The word between bells with its neighbours, escaped to ASCII."""
    return t.escaped(F.concat(before, F.lit(" " + BEL), word, F.lit(BEL + " "), after))


def character_sample(text: Column, length: int = SAMPLE_LENGTH) -> Column:
    """Codes of the first ``length`` characters, zeros after the end."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.slice(F.concat(chars, F.array_repeat(F.lit(0), length)), 1, length)


def class_list(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """(idx, tag): sorted distinct tags from 1; '' is 0, no tag."""
    names = tags.where(F.col(tag).isNotNull() & (F.col(tag) != "")).select(F.col(tag).alias("tag")).distinct()
    numbered = names.withColumn("idx", F.row_number().over(Window.orderBy("tag")))  # one row a class
    none = tags.sparkSession.createDataFrame([("", 0)], "tag string, idx int")
    return none.unionByName(numbered).select("idx", "tag")


def class_index(rows: DataFrame, classes: DataFrame, tag: str = "tag") -> DataFrame:
    """Rows with their class number; a tag that isn't listed drops its row."""
    return rows.join(classes.withColumnRenamed("tag", tag), tag)


def class_frequency(rows: DataFrame, classes: DataFrame, tag: str = "tag") -> DataFrame:
    """(idx, tag, n) of all classes, with zeros."""
    n = rows.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    return classes.join(n, "tag", "left").select("idx", "tag", F.coalesce("n", F.lit(0)).alias("n"))


def tagged_only(samples: DataFrame, tags: str = "tags") -> DataFrame:
    """Samples with any tag."""
    return samples.where(F.exists(tags, lambda x: x != ""))


def tagged_words(samples: DataFrame, key: str, words: str = "words", tags: str = "tags") -> DataFrame:
    """(key, pos, word, tag); samples whose arrays differ in length are dropped."""
    same = samples.where(F.size(words) == F.size(tags))
    return same.select(key, F.posexplode(F.arrays_zip(F.col(words).alias("word"), F.col(tags).alias("tag"))).alias("pos", "z")).select(key, "pos", "z.word", "z.tag")


def sentence_samples(sents: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sent_no, words, tags): the words and tags of every sentence with any tag.

    ``sents`` hold first_word and n_words; ``words`` hold word_no, word and tag.
    """
    spans = sents.select(*keys, "sent_no", F.explode(F.sequence(F.col("first_word"), F.col("first_word") + F.col("n_words") - 1)).alias("word_no"))
    got = F.sort_array(F.collect_list(F.struct("word_no", "word", "tag")))
    out = spans.join(words, [*keys, "word_no"]).groupBy(*keys, "sent_no").agg(got.alias("z"))
    return tagged_only(out.select(*keys, "sent_no", F.col("z.word").alias("words"), F.col("z.tag").alias("tags")))
