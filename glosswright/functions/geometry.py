"""Column functions on rectangles with x0, y0, x1, y1, y downwards unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(r: str) -> Column:
    return (F.col(f"{r}.x1") - F.col(f"{r}.x0")) * (F.col(f"{r}.y1") - F.col(f"{r}.y0"))


def overlap_area(a: str, b: str) -> Column:
    """Area that both cover, 0 if they are apart."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def covered(a: str, b: str) -> Column:
    """The share of a that b covers; null for an a without area."""
    return F.try_divide(overlap_area(a, b), area(a))


def touches(a: str, b: str) -> Column:
    """Whether closed rectangles share a point."""
    return (
        (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{b}.x0") <= F.col(f"{a}.x1"))
        & (F.col(f"{a}.y0") <= F.col(f"{b}.y1")) & (F.col(f"{b}.y0") <= F.col(f"{a}.y1"))
    )


def holds_point(r: str, x: Column, y: Column) -> Column:
    return x.between(F.col(f"{r}.x0"), F.col(f"{r}.x1")) & y.between(F.col(f"{r}.y0"), F.col(f"{r}.y1"))


def flipped(r: str, height: Column, left: Column | None = None) -> Column:
    """A y-upward rectangle as a y-downward one, inverted sides set right (P20)."""
    shift = F.lit(0.0) if left is None else left
    xs = [F.col(f"{r}.x0") - shift, F.col(f"{r}.x1") - shift]
    ys = [height - F.col(f"{r}.y0"), height - F.col(f"{r}.y1")]
    return F.struct(
        F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1")
    )
