"""Spatial joins: a distance predicate turned into an equi-join on buckets of space.

Catalyst plans a bare distance predicate as a nested loop.  Here every point of the left side has one
bucket, every shape of the right side goes to the buckets its bounding box touches, the join is on the
bucket and the exact predicate is what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = ("_bx", "_by", "_bz")


def point_buckets(points: DataFrame, coords: tuple[Column, Column, Column], side: float) -> DataFrame:
    return points.withColumns({b: F.floor(c / side).cast("long") for b, c in zip(BUCKET, coords, strict=True)})


def box_buckets(shapes: DataFrame, low: tuple[Column, Column, Column], high: tuple[Column, Column, Column], side: float) -> DataFrame:
    """Each shape once for every bucket that its bounding box touches."""
    out = shapes
    for b, lo, hi in zip(BUCKET, low, high, strict=True):
        out = out.withColumn(b, F.explode(F.sequence(F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long"))))
    return out


def bucketed_join(points: DataFrame, shapes: DataFrame, coords, low, high, side: float, near: Column, how: str = "inner") -> DataFrame:
    """``points`` x ``shapes`` where ``near`` holds; ``how`` may be inner, left_semi or left_anti.

    A shape touches about (size / side + 2) ** 3 buckets, so ``side`` should be near the usual extent of a
    shape.  A crowded bucket is a hot key of an ordinary equi-join, which adaptive execution splits.
    """
    left = point_buckets(points, coords, side)
    right = box_buckets(shapes, low, high, side)
    on = near
    for b in BUCKET:
        on = on & (left[b] == right[b])
    return left.join(right, on, how).drop(*BUCKET)
