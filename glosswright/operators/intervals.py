"""Intervals and runs by window functions.  Intervals are half-open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _group(new: Column, w) -> Column:
    return F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 5) -> DataFrame:
    """One row for intervals that follow each other by less than ``gap``.

    The distance counts from the furthest end so far, so a nested interval doesn't
    shorten what holds it.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) - reach >= gap)
    return rows.withColumn("_n", new).withColumn("_g", _group(F.col("_n"), w)).groupBy(*keys, "_g").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")
    ).drop("_g")


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers as (first, last), both inclusive; repeats count once."""
    w = Window.partitionBy(*keys).orderBy(value)
    flat = rows.select(*keys, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return flat.groupBy(*keys, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_g")


def complement(rows: DataFrame, keys: list[str], bound: Column, start: str = "start", end: str = "end", low: int = 0) -> DataFrame:
    """What disjoint or overlapping intervals leave free of [low, bound)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.select(*keys, F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(low)).alias("_a"), F.col(start).alias("_b"))
    after = rows.select(*keys, start, end, bound.alias("_bound")).withColumn("_a", F.max(end).over(upto)).withColumn("_l", F.lead(start).over(w))
    tail = after.where("_l is null").select(*keys, "_a", F.col("_bound").alias("_b"))
    return before.unionByName(tail).where("_a < _b").select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))


def subtract(rows: DataFrame, holes: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals without the holes that lie in or across them (F19); whole ones stay, covered ones go.

    Cuts at every border of both sides, then keeps the pieces within an interval
    and outside all holes: no pair of an interval and a hole is formed.
    """
    def borders(side: DataFrame, name: str) -> DataFrame:
        own = side.where(F.col(start) < F.col(end)).select(*keys, start, end)
        return own.select(*keys, F.explode(F.array(
            F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"))
        )).alias("b")).select(*keys, "b.at", F.col("b.step").alias(name))

    a, b = borders(rows, "_in"), borders(holes, "_out")
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys, "at").agg(
        F.sum(F.coalesce("_in", F.lit(0))).alias("_in"), F.sum(F.coalesce("_out", F.lit(0))).alias("_out"), F.max(F.col("_in")).alias("_s")
    )
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = both.withColumn("_d", F.sum("_in").over(upto)).withColumn("_h", F.sum("_out").over(upto)).withColumn(end, F.lead("at").over(w))
    pieces = depth.where(F.col(end).isNotNull()).withColumn("_on", (F.col("_d") > 0) & (F.col("_h") == 0))
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    return pieces.withColumn("_g", _group(new, w)).where("_on").groupBy(*keys, "_g").agg(F.min("at").alias(start), F.max(end).alias(end)).drop("_g")


def merge_line_boxes(boxes: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Consecutive boxes on one line as their bounding box."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(F.lag(line).over(w) != F.col(line), F.lit(True))
    return boxes.withColumn("_n", new).withColumn("_g", _group(F.col("_n"), w)).groupBy(*keys, "_g", line).agg(
        F.min(order).alias(order), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_boxes")
    ).drop("_g")


def rows_of_boxes(boxes: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """Boxes whose tops lie within ``tolerance`` of a row's first, as bounding boxes; without width they go.

    Rows are found by a fold over the tops in order, since where one begins depends
    on where the last began.
    """
    tops = F.array_sort(F.collect_set("y0"))
    start = F.array().cast("array<double>")
    firsts = F.aggregate("_tops", start, lambda a, y: F.when((F.size(a) == 0) | (y - F.element_at(a, -1) > tolerance), F.concat(a, F.array(y))).otherwise(a))
    heads = boxes.where("x0 <> x1").groupBy(*keys).agg(tops.alias("_tops")).select(*keys, firsts.alias("_heads"))
    head = F.array_max(F.filter("_heads", lambda h: h <= F.col("y0")))
    return boxes.where("x0 <> x1").join(heads, keys).withColumn("_r", head).groupBy(*keys, "_r").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_boxes")
    ).drop("_r")


def smaller_runs(runs: DataFrame, keys: list[str], order: str = "start", most: int = 5) -> DataFrame:
    """Font runs that look like subscripts: smaller than the run before, under ``most`` characters."""
    w = Window.partitionBy(*keys).orderBy(order)
    return runs.withColumn("_before", F.lag("size").over(w)).where((F.col("size") < F.col("_before")) & (F.col("end") - F.col("start") < most)).drop("_before")
