"""Minkowski functionals from the histogram of 2 x 2 (x 2) configurations.

A configuration is a number with a bit for each corner of a cell that is in the phase: corner (i, j, k) is bit
i + 2 j + 4 k.  The last layer of each axis starts no cell.  All measures are sums over the at most 256 rows of
that histogram: boundary length and surface by Crofton's formula from the crossings of lattice chords, mean
curvature by the Euler numbers of lattice sections, the Euler number itself by local shares.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import permutations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridSpec
from .voxels import own

Vector = tuple[int, ...]


# -- the histogram
def _masks(img: DataFrame, shape: tuple[int, ...], axes: tuple[str, ...], by: list[str]) -> DataFrame:
    """(by, mask, n) of the cells with a corner among the rows of ``img``: each voxel sends its bit to its cells."""
    bits = [(d, 1 << _corner(d)) for d in product((0, 1), repeat=len(axes))]
    corner = F.explode(F.array(*(F.struct(*(F.lit(c).alias(f"d{a}") for a, c in zip(axes, d, strict=True)), F.lit(b).alias("bit")) for d, b in bits)))
    sent = img.select(*by, *axes, corner.alias("_c")).select(*by, *((F.col(a) - F.col(f"_c.d{a}")).alias(a) for a in axes), F.col("_c.bit").alias("bit"))
    for a, n in zip(axes, shape, strict=True):
        sent = sent.where((F.col(a) >= 0) & (F.col(a) < n - 1))
    return sent.groupBy(*by, *axes).agg(F.bit_or("bit").alias("mask")).groupBy(*by, "mask").agg(F.count(F.lit(1)).alias("n"))


def configurations(img: DataFrame, shape: tuple[int, ...], phase: Column | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(mask, n) over all cells of the grid.  ``phase``: a condition, v is true by default.

    Only phase voxels are moved; cells that get no bit are counted by subtraction.
    """
    phase = F.col("v").cast("boolean") if phase is None else phase
    masks = _masks(img.where(phase), shape, axes, [])
    total = math.prod(n - 1 for n in shape)
    empty = masks.agg((F.lit(total).cast("long") - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit(0).alias("mask"), "n")
    return masks.unionByName(empty)


def histogram(masks: DataFrame, size: int) -> np.ndarray:
    """The rows of ``configurations`` (at most 256) as an array."""
    h = np.zeros(size, np.int64)
    for r in masks.groupBy("mask").agg(F.sum("n").alias("n")).collect():
        h[r["mask"]] = r["n"]
    return h


def _corner(d: Vector) -> int:
    return sum(c << i for i, c in enumerate(d))


def _dimensions(h: np.ndarray) -> int:
    return {16: 2, 256: 3}[len(h)]


def _with(h: np.ndarray, corners: list[int]) -> np.ndarray:
    """How many cells have 0, 1, ... of ``corners`` in the phase."""
    m = np.arange(len(h))
    return np.bincount(sum(m >> c & 1 for c in corners), h, len(corners) + 1)


# -- lattice directions
def directions(dimensions: int) -> list[Vector]:
    """One of each pair of opposite lattice directions to the neighbours of a cell, the last step that is not 0 upwards."""
    steps = product((-1, 0, 1), repeat=dimensions)
    return [d for d in steps if any(d) and [c for c in d if c][-1] > 0]


def direction_weights(spacing: tuple[float, ...]) -> dict[Vector, float]:
    """Share of the circle or sphere nearest to each lattice direction of a grid with this spacing; opposite ones are alike."""
    half = _on_circle(spacing) if len(spacing) == 2 else _on_sphere(spacing)
    return half | {tuple(-c for c in d): w for d, w in half.items()}


def _on_circle(spacing) -> dict[Vector, float]:
    """Half the angle between the directions before and after."""
    angle = {d: math.atan2(d[1] * spacing[1], d[0] * spacing[0]) % math.pi for d in directions(2)}
    order = sorted(angle, key=angle.get)
    gap = [(angle[order[(i + 1) % len(order)]] - angle[d]) % math.pi for i, d in enumerate(order)]
    return {d: (gap[i - 1] + gap[i]) / 2 / (2 * math.pi) for i, d in enumerate(order)}


def _on_sphere(spacing) -> dict[Vector, float]:
    """Areas of the cells, bounded by great circles halfway to the other directions.

    The corners of a cell are the points with three equally near directions and none nearer; its area follows from its angles.
    """
    steps = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
    unit = {d: np.array(d) * spacing / np.linalg.norm(np.array(d) * spacing) for d in steps}
    out = {}
    for d in directions(3):
        u = unit[d]
        others = [e for e in steps if e != d]
        corners = []
        for i, e in enumerate(others):
            for f in others[i + 1 :]:
                p = np.cross(unit[e] - u, unit[f] - u)
                if (norm := np.linalg.norm(p)) < 1e-12:
                    continue
                p = p / norm if p @ u > 0 else -p / norm
                if p @ u > 0 and all(unit[g] @ p <= u @ p + 1e-9 for g in others) and not any(np.allclose(p, q, atol=1e-9) for q in corners):
                    corners.append(p)
        a = np.cross(u, [1.0, 0, 0] if abs(u[0]) < 0.9 else [0, 1.0, 0])
        b = np.cross(u, a)
        corners.sort(key=lambda p: math.atan2(p @ b, p @ a))
        angles = 0.0
        for i, p in enumerate(corners):
            before, after = corners[i - 1], corners[(i + 1) % len(corners)]
            s, t = before - (before @ p) * p, after - (after @ p) * p
            angles += math.acos(np.clip(s @ t / np.linalg.norm(s) / np.linalg.norm(t), -1, 1))
        out[d] = (angles - (len(corners) - 2) * math.pi) / (4 * math.pi)
    return out


# -- densities
def volume_density(h: np.ndarray) -> float:
    """The share of cells whose first corner is in the phase; also the area density in two dimensions."""
    return float(_with(h, [0])[1] / h.sum()) if h.sum() else 0.0


def crossing_density(h: np.ndarray, spacing: tuple[float, ...]) -> float:
    """Borders crossed by the chords of all directions, by the chords' length; directions count by their shares."""
    weights = direction_weights(spacing)
    crossed = length = 0.0
    for d in directions(_dimensions(h)):
        start = tuple(int(c < 0) for c in d)
        chord = [_corner(start), _corner(tuple(s + c for s, c in zip(start, d, strict=True)))]
        crossed += weights[d] * _with(h, chord)[1]
        length += weights[d] * h.sum() * math.hypot(*(c * s for c, s in zip(d, spacing, strict=True)))
    return crossed / length if length else 0.0


def surface_density(h: np.ndarray, spacing: tuple[float, float, float]) -> float:
    """Twice the crossings by length (Crofton)."""
    return 2 * crossing_density(h, spacing)


def length_density(h: np.ndarray, spacing: tuple[float, float]) -> float:
    """pi / 2 times the crossings by length (Crofton), over 2 pi, as the functional of the plane is normalised."""
    return crossing_density(h, spacing) / 4


def sections(normal: Vector) -> list[list[int]]:
    """The corners of a cell in each plane across ``normal`` that holds three at least, from the lowest plane up."""
    planes: dict[int, list[int]] = {}
    for c in product((0, 1), repeat=3):
        planes.setdefault(sum(map(math.prod, zip(c, normal, strict=True))), []).append(_corner(c))
    return [planes[k] for k in sorted(planes) if len(planes[k]) > 2]


def curvature_density(h: np.ndarray, spacing: tuple[float, float, float]) -> float:
    """The mean, over directions, of the Euler number by area of the sections across them (Crofton).

    Sections are lattices of parallelograms or of triangles.  Of parallelograms one plane a cell is enough; the
    Euler number is that of Gray's bit quads, (Q1 - Q3) / 4, between 4- and 8-neighbourhoods.  Triangles stand on
    their base in one plane and on their tip in the next.  Let each corner count for a third in the tip-down ones
    and each edge for a third in one kind and two thirds in the other: corners - edges + faces is then a third of
    the upper triangles with one corner less those lower ones with two.  In both cases that is, over m corners,
    the sections with one corner less those with all but one.
    """
    weights = direction_weights(spacing)
    total = 0.0
    for normal in directions(3):
        planes = sections(normal)
        low, m = planes[0], len(planes[0])
        high = low if m == 4 else planes[-1]
        a, b, c = (np.array([k & 1, k >> 1 & 1, k >> 2]) * spacing for k in low[:3])
        euler = (_with(h, high)[1] - _with(h, low)[m - 1]) / m
        total += weights[normal] * euler / np.linalg.norm(np.cross(b - a, c - a))  # the area of one corner of the lattice
    return float(8 * math.pi * total / h.sum()) if h.sum() else 0.0


#: 24 times the share of the Euler number (26-neighbourhoods) of a configuration, one for each of
#: the 22 kinds of configurations that no turn or reflection of the cell makes alike, by its least number.
EULER26 = {
    0: 0, 1: 3, 3: 0, 6: 6, 7: -3, 15: 0, 22: 9, 23: -6, 24: 6, 25: 3, 27: -6, 30: 0, 31: -3,
    60: 0, 61: -8, 63: 0, 105: 12, 107: -3, 111: -6, 126: -12, 127: 3, 255: 0,
}


@lru_cache
def euler26_table() -> np.ndarray:
    """EULER26 for all 256 configurations."""
    out = np.zeros(256, np.int64)
    for order in permutations(range(3)):
        for flip in range(8):
            moved = [sum((c >> a & 1) << i for i, a in enumerate(order)) ^ flip for c in range(8)]
            for mask, value in EULER26.items():
                out[sum(1 << moved[c] for c in range(8) if mask >> c & 1)] = value
    return out


def _first_corner(m: np.ndarray, *others: int) -> np.ndarray:
    return np.logical_and.reduce([m >> c & 1 for c in (0, *others)]).astype(np.int64)


@lru_cache
def euler6_table() -> np.ndarray:
    """A configuration's share of the Euler number of 6-neighbourhoods, seen from its first corner: corner, edges, faces, cell."""
    m = np.arange(256)
    edges = sum(_first_corner(m, a) for a in (1, 2, 4))
    faces = sum(_first_corner(m, a, b, a | b) for a, b in ((1, 2), (1, 4), (2, 4)))
    return _first_corner(m) - edges + faces - (m == 255)


@lru_cache
def euler_tables_2d() -> tuple[np.ndarray, np.ndarray]:
    """Shares of the Euler number: seen from the first corner, and (times 12) of all four corners alike."""
    m = np.arange(16)
    four = _first_corner(m) - _first_corner(m, 1) - _first_corner(m, 2) + (m == 15)
    corners = sum(m >> c & 1 for c in range(4))
    edges = sum((m >> a & 1) * (m >> b & 1) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3)))
    return four, 3 * corners - 6 * edges + 12 * (m == 15)


def euler26_density(h: np.ndarray, spacing) -> float:
    return float((euler26_table() * h).sum() / (24 * h.sum() * math.prod(spacing))) if h.sum() else 0.0


def euler6_density(h: np.ndarray, spacing) -> float:
    return float(3 / (4 * math.pi) * (euler6_table() * h).sum() / (h.sum() * math.prod(spacing))) if h.sum() else 0.0


def euler8_density(h: np.ndarray, spacing) -> float:
    return float((euler_tables_2d()[1] * h).sum() / (12 * math.pi * h.sum() * math.prod(spacing))) if h.sum() else 0.0


# -- functionals
def functionals_of(h: np.ndarray, shape: tuple[int, ...], resolution: tuple[float, ...], norm: bool = False) -> tuple[float, ...]:
    """Volume, surface, curvature and Euler characteristic; area, length and Euler characteristic in two dimensions.

    With ``norm`` divided by the grid's volume (area).  In the plane the densities refer to the cells, whose number
    is one less an axis.
    """
    factor = min(resolution)
    spacing = tuple(r / factor for r in resolution)
    n = len(shape)
    if n == 3:
        densities = [volume_density(h), surface_density(h, spacing), curvature_density(h, spacing), euler26_density(h, spacing)]
        covered = shape
    else:
        densities = [volume_density(h), length_density(h, spacing), euler8_density(h, spacing)]
        covered = [s - 1 for s in shape]
    whole = math.prod(covered) * math.prod(spacing)
    if norm:
        full = math.prod(shape) * math.prod(spacing)
        return tuple(float(whole * d / full / factor**k) for k, d in enumerate(densities))
    return tuple(float(whole * d * factor ** (n - k)) for k, d in enumerate(densities))


def functionals(img: DataFrame, grid: GridSpec, phase: Column | None = None) -> tuple[float, float, float, float]:
    """Volume, surface area, mean curvature and Euler characteristic of a phase (v true by default)."""
    h = histogram(configurations(own(img, grid), grid.voxels_shape, phase), 256)
    return functionals_of(h, grid.voxels_shape, grid.resolution)


def functionals_2d(img: DataFrame, shape: tuple[int, int], resolution: tuple[float, float] = (1.0, 1.0), phase: Column | None = None, norm: bool = False) -> tuple[float, float, float]:
    """Area, length and Euler characteristic of an image with columns x and y."""
    return functionals_of(histogram(configurations(img, shape, phase, ("x", "y")), 16), shape, resolution, norm)


# -- functions of a threshold
def functions(img: DataFrame, shape: tuple[int, ...], resolution: tuple[float, ...], opening: bool = True, v: str = "v", norm: bool = False, between: tuple[int, int] | None = None) -> list[tuple]:
    """(threshold, functionals ...) for every threshold from the least to the greatest value of a map, or ``between`` two others.

    Of an opening map the phase is what lies above the threshold, of a closing map what does not.  The
    thresholds are evaluated in one job: a voxel sends its bits once for each threshold at which it is in.  What
    reaches the driver are at most 256 (16) rows a threshold.
    """
    low, high = between or map(int, img.agg(F.min(v), F.max(v)).first())
    axes = AXES[: len(shape)]
    inside = F.col(v) > F.col("_t") if opening else F.col(v) <= F.col("_t")
    spread = img.withColumn("_t", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(inside)
    total = math.prod(n - 1 for n in shape)
    found = {t: np.zeros(1 << (1 << len(axes)), np.int64) for t in range(low, high + 1)}
    for r in _masks(spread, shape, axes, ["_t"]).collect():
        found[r["_t"]][r["mask"]] = r["n"]
    for h in found.values():
        h[0] = total - h.sum()
    return [(t, *functionals_of(h, shape, resolution, norm)) for t, h in found.items()]


def functions_open(img: DataFrame, shape, resolution, v: str = "v", norm: bool = False, between: tuple[int, int] | None = None) -> list[tuple]:
    return functions(img, shape, resolution, True, v, norm, between)


def functions_close(img: DataFrame, shape, resolution, v: str = "v", norm: bool = False, between: tuple[int, int] | None = None) -> list[tuple]:
    return functions(img, shape, resolution, False, v, norm, between)
