"""Precision and recall, by fold, and scaling with the population's deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(scored: DataFrame, fold: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(fold, precision, recall); 0 where nothing is predicted or true."""
    hit = F.sum(F.when((F.col(label) == 1) & (F.col(predicted) == 1), 1).otherwise(0))
    said, true = F.sum(F.when(F.col(predicted) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return scored.groupBy(fold).agg(
        F.coalesce(F.try_divide(hit, said), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit, true), F.lit(0.0)).alias("recall")
    )


def macro_average(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def others(rows: DataFrame, fold: str, value) -> DataFrame:
    """All folds but one."""
    return rows.where(F.col(fold) != F.lit(value))


def statistics_without(rows: DataFrame, fold: str, label: str = "label") -> DataFrame:
    """(fold, n, positives) of all rows outside each fold, by one aggregation and a total: no fold meets another."""
    own = rows.groupBy(fold).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    total = own.agg(F.sum("_n").alias("_tn"), F.sum("_p").alias("_tp"))  # one row
    return own.crossJoin(F.broadcast(total)).select(fold, (F.col("_tn") - F.col("_n")).alias("n"), (F.col("_tp") - F.col("_p")).alias("positives"))


def scaler(rows: DataFrame, vector: str = "features") -> DataFrame:
    """(dim, mean, std) of an array column's places; population deviation."""
    return rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std")
    )
