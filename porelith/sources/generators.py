"""Synthetic images and packings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridSpec
from ..operators.distance import along
from ..operators.particles import add_periodic, contains_cylinder, contains_sphere, trim_intersecting, values_by_type
from ..operators.voxels import set_reservoir, set_walls
from ..plans.spatial import bucketed_join


def _share(p: float) -> None:
    if not 0 <= p <= 1:
        raise ValueError("a share lies between 0 and 1")


def unit_of_voxel(seed: int, vid: Column | None = None) -> Column:
    """A number in [0, 1) from the voxel's id, the same in any partitioning and any SQL engine with MD5."""
    vid = F.col("vid") if vid is None else vid
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), vid.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def random_binary(spark: SparkSession, grid: GridSpec, p_zero: float = 0.5, seed: int = 0) -> DataFrame:
    """vid, x, y, z, v with v = 0 in a share of ``p_zero``; each voxel is drawn by itself, at any scale."""
    _share(p_zero)
    return grid.voxels(spark).withColumn("v", (unit_of_voxel(seed) >= p_zero).cast("int"))


def random_binary_numpy(spark: SparkSession, shape: tuple[int, ...], p_zero: float = 0.5, seed: int | None = None) -> DataFrame:
    """The image that NumPy's default generator draws; made on the driver, so for images that fit there."""
    _share(p_zero)
    values = np.random.default_rng(seed).choice([0, 1], size=shape, p=[p_zero, 1 - p_zero])
    return from_array(spark, values)


def from_array(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """An image from an array of two or three axes."""
    at = np.indices(values.shape).reshape(values.ndim, -1).astype(np.int32)
    columns = {a: at[i] for i, a in enumerate(AXES[: values.ndim])}
    flat = values.ravel()
    columns["v"] = flat.astype(np.int32) if flat.dtype.kind in "biu" else flat.astype(np.float64)
    return spark.createDataFrame(pa.table(columns))


def to_array(img: DataFrame, shape: tuple[int, ...], v: str = "v", start: tuple[int, ...] = (0, 0, 0)) -> np.ndarray:
    """An image as an array on the driver; for images that fit there."""
    table = img.select(*AXES[: len(shape)], F.col(v).alias("v")).toArrow()
    out = np.zeros(shape, table["v"].to_numpy().dtype)
    out[tuple(table[a].to_numpy() - s for a, s in zip(AXES[: len(shape)], start, strict=False))] = table["v"].to_numpy()
    return out


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def smooth(img: DataFrame, grid: GridSpec, sigma: float, v: str = "v") -> DataFrame:
    """Gaussian smoothing by a pass along each axis; images are mirrored at their faces, edge voxel included."""
    if sigma == 0:
        return img.withColumn(v, F.col(v).cast("double"))
    w = gaussian_kernel(sigma)
    r = len(w) // 2

    def kernel(cols):
        f = cols[v].astype(np.float64)
        wide = np.pad(f, ((0, 0), (r, r)), mode="symmetric")
        out = np.zeros_like(f)
        for k, c in enumerate(w):
            out += c * wide[:, k : k + f.shape[1]]
        return {v: out}

    out = img
    for axis in range(3):
        lo, hi = grid.extent(axis)
        out = along(out, {AXES[axis]: hi - lo}, kernel, [v], [v])
    return out


def smoothed_random_binary(spark: SparkSession, grid: GridSpec, p_zero: float = 0.5, smoothness: float = 1.0, seed: int = 0) -> DataFrame:
    """A random image, smoothed and cut at one half."""
    _share(p_zero)
    if smoothness < 0:
        raise ValueError("smoothness is not negative")
    return smooth(random_binary(spark, grid, p_zero, seed), grid, smoothness).withColumn("v", (F.col("v") > 0.5).cast("int"))


def linear(spark: SparkSession, grid: GridSpec, axis: int) -> DataFrame:
    """v is the index along an axis."""
    return grid.voxels(spark).withColumn("v", F.col(AXES[axis]).cast("double"))


def _centres(grid: GridSpec) -> tuple[Column, Column, Column]:
    return tuple(grid.centre(a) for a in range(3))


def _finish(img: DataFrame, grid: GridSpec, invert: bool) -> DataFrame:
    return set_walls(img.withColumn("v", 1 - F.col("v")) if invert else img, grid)


def spheres_image(particles: DataFrame, grid: GridSpec, invert: bool = False) -> DataFrame:
    """v = 0 where a voxel's centre lies in a sphere, surface included, else 1."""
    spark = particles.sparkSession
    shapes = particles.select(*(F.col(a).alias(f"c{a}") for a in AXES), F.col("r").alias("cr"))
    low, high = (tuple(F.col(f"c{a}") + s * F.col("cr") for a in AXES) for s in (-1, 1))
    return _voxelized(grid.voxels(spark), shapes, grid, low, high, _side(particles, "r", grid), contains_sphere(*_centres(grid)), invert)


def cylinders_image(rows: DataFrame, grid: GridSpec) -> DataFrame:
    """v = 0 where a voxel's centre lies in a flat-capped cylinder."""
    shapes = rows.select(*(f"{a}{i}" for i in (1, 2) for a in AXES), F.col("r").alias("cr"))
    low = tuple(F.least(f"{a}1", f"{a}2") - F.col("cr") for a in AXES)
    high = tuple(F.greatest(f"{a}1", f"{a}2") + F.col("cr") for a in AXES)
    return _voxelized(grid.voxels(rows.sparkSession), shapes, grid, low, high, _side(rows, "r", grid), contains_cylinder(*_centres(grid)), False)


def _side(shapes: DataFrame, r: str, grid: GridSpec) -> float:
    """Buckets as wide as the mean shape, eight voxels at least and an eighth of the grid at most."""
    mean = shapes.agg(F.avg(r)).first()[0] or 0.0
    h = max(grid.resolution)
    return float(min(max(2 * mean, 8 * h), max(max(grid.lengths) / 8, 8 * h)))


def _voxelized(base: DataFrame, shapes: DataFrame, grid: GridSpec, low, high, side: float, near: Column, invert: bool) -> DataFrame:
    # clip boxes to the grid: a shape touches no buckets that no voxel has
    spans = [(grid.box[a][0] + grid.extent(a)[0] * grid.resolution[a], grid.box[a][0] + grid.extent(a)[1] * grid.resolution[a]) for a in range(3)]
    lo = tuple(F.greatest(c, F.lit(s)) for c, (s, _) in zip(low, spans, strict=True))
    hi = tuple(F.least(c, F.lit(e)) for c, (_, e) in zip(high, spans, strict=True))
    meets = F.lit(True)
    for a, b in zip(lo, hi, strict=True):
        meets = meets & (a <= b)
    hit = bucketed_join(base, shapes.where(meets), _centres(grid), lo, hi, side, near, "left_semi").select("vid", F.lit(0).alias("v"))
    out = base.join(hit, "vid", "left").withColumn("v", F.coalesce("v", F.lit(1))).select("vid", *AXES, "v")
    return _finish(out, grid, invert)


def atoms_image(particles: DataFrame, radii: dict[int, float], grid: GridSpec) -> DataFrame:
    """As spheres_image, with radii by type; a type without one is an error."""
    return spheres_image(values_by_type(particles, radii, "r"), grid)


def atom_file_image(spark: SparkSession, path: str, radii: dict[int, float], grid: GridSpec, type_map=None, periodic: bool = False) -> DataFrame:
    """From a LAMMPS dump: types mapped, radii looked up, atoms trimmed to the box, images added, voxelized."""
    from .readers import read_lammps

    atoms = read_lammps(spark, path, type_map).select(F.col("id").alias("pid"), *AXES, "type", "mass")
    sized = trim_intersecting(values_by_type(atoms, radii, "r"), grid.box)
    return spheres_image(add_periodic(sized, grid) if periodic else sized, grid)


def inkbottle(spark: SparkSession, grid: GridSpec, r_y: float = 1.0, r_z: float = 1.0) -> DataFrame:
    """The ink bottle: pore before x = 0, and where the cross-section's ellipse reaches; reservoirs are pore."""
    x, y, z = _centres(grid)
    # fixed values: the constants of the bottle's radius
    r = 0.01 * F.cos(0.01 * x) + 0.5 * F.sin(x) + 0.75
    inside = y * y / (r * F.lit(r_y)) / (r * F.lit(r_y)) + z * z / (r * F.lit(r_z)) / (r * F.lit(r_z)) <= 1
    img = grid.voxels(spark).withColumn("v", F.when((x < 0) | inside, F.lit(1)).otherwise(F.lit(0)))
    return set_walls(set_reservoir(img, grid, 1), grid)


# -- lattices
# Basis points, neighbours of a sphere (coordination) and share of space in percent (packing) of each lattice.
class Lattice:
    """Spheres on a lattice: ``basis`` in units of the constant, and the radius at which they touch."""

    basis: tuple[tuple[float, float, float], ...] = ()
    coordination, packing = 0, 0

    def __init__(self, constant: float):
        self.constant = constant

    @property
    def radius(self) -> float:
        return 0.0

    def spheres(self, spark: SparkSession, grid: GridSpec) -> DataFrame:
        """pid, x, y, z, r of as many cells from the origin as cover the box, and one more."""
        a = self.constant
        out = spark.range(1).select()
        for name, length in zip("ijk", grid.lengths, strict=True):
            out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(int(length // a)))).alias(name))
        points = F.array(*(F.struct(*(F.lit(float(c)).alias(f"b{n}") for c, n in zip(b, AXES, strict=True))) for b in self.basis))
        cells = out.select("i", "j", "k", F.explode(points).alias("b"))
        at = cells.select(*((F.col(n) * F.lit(float(a)) + F.col(f"b.b{c}") * F.lit(float(a))).alias(c) for n, c in zip("ijk", AXES, strict=True))).distinct()
        return at.select(F.xxhash64(*AXES).alias("pid"), *AXES, F.lit(float(self.radius)).alias("r"))


class SimpleCubic(Lattice):
    basis, coordination, packing = ((0, 0, 0),), 6, 52

    @property
    def radius(self) -> float:
        return self.constant / 2


class BodyCenteredCubic(Lattice):
    basis, coordination, packing = ((0, 0, 0), (0.5, 0.5, 0.5)), 8, 68

    @property
    def radius(self) -> float:
        return self.constant * math.sqrt(3) / 4


class FaceCenteredCubic(Lattice):
    basis, coordination, packing = ((0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)), 12, 74

    @property
    def radius(self) -> float:
        return self.constant * math.sqrt(2) / 4
