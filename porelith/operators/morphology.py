"""Dilation, erosion, opening and closing with a ball, by thresholds on bounded distances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridSpec
from ..plans.names import unused
from .distance import squared_distance_to
from .voxels import set_walls


def struct_ratio(resolution: tuple[float, ...], radius: float) -> list[int]:
    """Half widths of the ball in voxels."""
    if len(resolution) not in (2, 3):
        raise ValueError("a resolution has two or three axes")
    if radius < min(resolution):
        raise ValueError("the radius is below the resolution")
    return [math.ceil(radius / h) for h in resolution]


def struct_element(spark: SparkSession, resolution: tuple[float, ...], radius: float) -> DataFrame:
    """The digital ball as a table of offsets (dx, dy and, in three dimensions, dz)."""
    ratio = struct_ratio(resolution, radius)
    if len(set(resolution)) > 1:
        raise ValueError("a digital ball needs the same resolution on all axes")
    names = ("dx", "dy", "dz")[: len(ratio)]
    out = spark.range(1).select()
    for n, r in zip(names, ratio, strict=True):
        out = out.select("*", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias(n))
    square = sum((F.col(n) * F.col(n) for n in names), F.lit(0))
    return out.where(square <= (radius / resolution[0]) ** 2)


def check_radii(grid: GridSpec, radii) -> None:
    """ValueError for a ball that is wider than the grid."""
    for r in radii:
        if any(w > n for w, n in zip(struct_ratio(grid.resolution, r), grid.voxels_shape, strict=True)):
            raise ValueError(f"radius {r} reaches beyond the grid")


def _check(grid: GridSpec, radius: float) -> None:
    struct_ratio(grid.resolution, radius)


def _near(img: DataFrame, grid: GridSpec, radius: float, v: str, value: int) -> tuple[DataFrame, str]:
    """The image with the squared distance to the nearest voxel of ``value``, exact up to the radius, and that column's name."""
    _check(grid, radius)
    seed, d2 = unused(img, "_seed"), unused(img, "_d2")
    return squared_distance_to(img.withColumn(seed, F.col(v) == value), grid, [seed], [d2], [radius]), d2


def dilate(img: DataFrame, grid: GridSpec, radius: float, v: str = "v") -> DataFrame:
    """1 within ``radius`` (bound included) of a voxel of value 1, else 0; walls stay 0."""
    near, d2 = _near(img, grid, radius, v, 1)
    return set_walls(near.withColumn(v, (F.col(d2) <= radius * radius).cast("int")).drop(d2), grid, v)


def erode(img: DataFrame, grid: GridSpec, radius: float, v: str = "v") -> DataFrame:
    """1 where no voxel of value 0 lies within ``radius``; beyond END faces nothing erodes."""
    near, d2 = _near(img, grid, radius, v, 0)
    return near.withColumn(v, (F.col(d2) > radius * radius).cast("int")).drop(d2)


addition, subtraction = dilate, erode


def opening(img: DataFrame, grid: GridSpec, radius: float, v: str = "v") -> DataFrame:
    return dilate(erode(img, grid, radius, v), grid, radius, v)


def closing(img: DataFrame, grid: GridSpec, radius: float, v: str = "v") -> DataFrame:
    return erode(dilate(img, grid, radius, v), grid, radius, v)


def dilate_by_offsets(img: DataFrame, grid: GridSpec, radius: float, v: str = "v") -> DataFrame:
    """The same dilation by moving every voxel of value 1 over the ball's offsets: no passes, for small balls."""
    ratio = struct_ratio(grid.resolution, radius)
    if len(set(grid.resolution)) > 1:
        raise ValueError("a digital ball needs the same resolution on all axes")
    moved = img.where(F.col(v) == 1).select(*AXES)
    for name, r in zip(AXES, ratio, strict=True):
        moved = moved.withColumn(f"d{name}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    moved = moved.where(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in AXES), F.lit(0)) <= (radius / grid.resolution[0]) ** 2)
    cols = []
    for a, name in enumerate(AXES):
        lo, hi = grid.extent(a)
        to = F.col(name) + F.col(f"d{name}")
        cols.append((F.pmod(to - lo, F.lit(hi - lo)) + lo if grid.periodic[a] else to).cast("int").alias(name))
    found = unused(img, "_hit")
    hit = moved.select(*cols).distinct().withColumn(found, F.lit(1))
    return set_walls(img.join(hit, list(AXES), "left").withColumn(v, F.coalesce(found, F.lit(0))).drop(found), grid, v)
