"""Euclidean distances by separable passes along lines.

The squared distance to the nearest solid voxel is the minimum over three axes in turn of f(i) + (h (i - j))^2.
A pass deals the voxels by line or plane, so these are whole in a task, and works on many at once as one array;
memory is bounded by VOXELS_AT_ONCE voxels or a plane.  Periodic axes take the shorter way round.  Exact and
anisotropic; a radius bounds the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES, GridSpec
from ..plans.names import unused

VOXELS_AT_ONCE = 1_000_000
#: Planes of at most so many voxels are dealt whole, which saves a shuffle.
PLANE_VOXELS = 4_000_000
#: Up to so many steps lines are shifted; beyond it envelopes are faster.
FEW_STEPS = 64


def along(img: DataFrame, lengths: dict[str, int], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], reads: list[str], writes: list[str], drops: tuple[str, ...] = (), axes: tuple[str, ...] = AXES) -> DataFrame:
    """Columns ``writes`` of doubles from ``kernel``, which gets and gives arrays of groups x ``lengths``.

    ``lengths`` names one axis (lines) or two (planes) and their voxels.  The image must have every voxel of
    every group once; columns other than ``drops`` pass through.  Groups are dealt by the other axes, so each
    is whole in one task; a task holds about VOXELS_AT_ONCE voxels at a time.
    """
    rest = [c for c in axes if c not in lengths]
    shape, size = (-1, *lengths.values()), int(np.prod(list(lengths.values())))
    keep = [c for c in img.columns if c not in writes and c not in drops]
    schema = T.StructType([img.schema[c] for c in keep] + [T.StructField(w, T.DoubleType()) for w in writes])
    names = img.columns

    def solve(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows.column(names.index(c)).to_numpy().reshape(shape)
        for k, name in enumerate(lengths):
            i = get(name)
            steps = np.arange(shape[k + 1]).reshape([-1 if d == k else 1 for d in range(len(lengths))])
            if (i != i.flat[0] + steps).any():
                raise ValueError("lines must have each voxel once")
        new = kernel({c: get(c) for c in reads})
        cols = [rows.column(names.index(c)).combine_chunks() for c in keep] + [pa.array(np.ascontiguousarray(new[w], dtype=np.float64).ravel(), pa.float64()) for w in writes]
        return pa.Table.from_arrays(cols, names=schema.names).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= max(VOXELS_AT_ONCE, size):
                table = pa.Table.from_batches(held)
                full = n // size * size
                yield solve(table.slice(0, full))
                rest_rows = table.slice(full)
                held, n = rest_rows.to_batches(), rest_rows.num_rows
        if n:
            if n % size:
                raise ValueError("lines must have each voxel once")
            yield solve(pa.Table.from_batches(held))

    dealt = img.repartition(*rest) if rest else img.repartition(1)
    return dealt.sortWithinPartitions(*rest, *lengths).mapInArrow(run, schema)


def nearest_zero(solid: np.ndarray, h: float, periodic: bool) -> np.ndarray:
    """Squared distance along the last axis to its nearest True; infinite without one."""
    n = solid.shape[-1]
    i = np.arange(n, dtype=np.float64)
    last = np.maximum.accumulate(np.where(solid, i, -np.inf), axis=-1)
    first = np.minimum.accumulate(np.where(solid, i, np.inf)[..., ::-1], axis=-1)[..., ::-1]
    if periodic:
        last = np.maximum(last, last[..., -1:] - n)
        first = np.minimum(first, first[..., :1] + n)
    d = np.minimum(i - last, first - i) * h
    return d * d


def widen(f: np.ndarray, h: float, periodic: bool, reach: int | None = None) -> np.ndarray:
    """min over j of f(j) + (h (i - j))^2 along axis 1, for distances up to ``reach`` steps.

    Where the greatest value lets few steps matter, lines are shifted step by step; else by lower envelopes, in time
    that is linear in the voxels.
    """
    n = f.shape[1]
    steps = min(n // 2 if periodic else n - 1, n if reach is None else reach)
    most = f.max(initial=0.0)
    if np.isfinite(most):
        steps = min(steps, int(np.sqrt(most) / h) + 1)
    return envelopes(f, h, periodic) if steps > FEW_STEPS else _shifted(f, h, periodic, steps)


def _shifted(f: np.ndarray, h: float, periodic: bool, steps: int) -> np.ndarray:
    out = f.copy()
    for s in range(1, steps + 1):
        step = (s * h) ** 2
        if step >= out.max(initial=0.0):
            break
        if periodic:
            np.minimum(out, np.roll(f, s, axis=1) + step, out=out)
            np.minimum(out, np.roll(f, -s, axis=1) + step, out=out)
        else:
            np.minimum(out[:, s:], f[:, :-s] + step, out=out[:, s:])
            np.minimum(out[:, :-s], f[:, s:] + step, out=out[:, :-s])
    return out


def _stacks(g: np.ndarray, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of values ``g`` at ``sites`` the lower envelope: its last place, the columns in order and where each begins."""
    top = np.full(len(g), -1)
    site, begin = np.zeros(g.shape, np.int64), np.full(g.shape, -np.inf)
    for q in range(len(sites)):
        rows = np.flatnonzero(np.isfinite(g[:, q]))
        start = np.full(len(rows), -np.inf)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            held = top[r] >= 0
            todo, r = todo[held], r[held]
            j = site[r, top[r]]
            cross = ((g[r, q] + sites[q] ** 2) - (g[r, j] + sites[j] ** 2)) / (2 * (sites[q] - sites[j]))
            drop = cross <= begin[r, top[r]]
            start[todo] = np.where(drop, -np.inf, cross)
            todo = todo[drop]
            top[rows[todo]] -= 1
        top[rows] += 1
        site[rows, top[rows]], begin[rows, top[rows]] = q, start
    return top, site, begin


def envelopes(f: np.ndarray, h: float, periodic: bool) -> np.ndarray:
    """The same minimum over whole lines: the lower envelope of the parabolas on a line's finite values.

    All lines advance together.  Each holds a stack of the parabolas that are lowest somewhere so far; a new one
    drops those that it undercuts where they begin.  Afterwards every voxel reads the parabola of its stretch.
    """
    if f.ndim > 2:  # the other axes are lines of their own
        lines = np.moveaxis(f, 1, -1)
        return np.moveaxis(envelopes(lines.reshape(-1, f.shape[1]), h, periodic).reshape(lines.shape), -1, 1)
    n = f.shape[1]
    turns = (-n, 0, n) if periodic else (0,)
    sites = np.concatenate([np.arange(n) + t for t in turns]) * h
    values = np.tile(f, (1, len(turns)))
    live = np.flatnonzero(np.isfinite(values).any(1))
    out = np.full(f.shape, np.inf)
    if not len(live):
        return out
    g = values[live]
    top, site, begin = _stacks(g, sites)
    every = np.arange(len(g))
    at, low = np.zeros(len(g), np.int64), np.empty((len(g), n))
    for i in range(n):
        x = i * h
        while True:
            more = at < top
            more[more] = begin[every[more], at[more] + 1] < x
            if not more.any():
                break
            at[more] += 1
        j = site[every, at]
        low[:, i] = g[every, j] + (x - sites[j]) ** 2
    out[live] = low
    return out


def envelope_1d(f, h: float = 1.0, periodic: bool = False) -> np.ndarray:
    """``widen`` of a single line."""
    return widen(np.asarray(f, float)[None, :], h, periodic)[0]


def nearest_1d(values, h: float = 1.0, periodic: bool = False, lower: float = np.inf, upper: float = np.inf) -> np.ndarray:
    """Squared distances of one line to its zeros; ``lower`` and ``upper`` are distances from its ends to zeros beyond."""
    v = np.asarray(values)[None, :] == 0
    d2 = nearest_zero(v, h, periodic)[0]
    i = np.arange(v.shape[1])
    return np.minimum(d2, np.minimum((i * h + lower) ** 2, ((v.shape[1] - 1 - i) * h + upper) ** 2))


def squared_distance_to(img: DataFrame, grid: GridSpec, seeds: list[str], outs: list[str], radii: list[float | None] | None = None) -> DataFrame:
    """For each boolean column of ``seeds`` the squared distance to its nearest True voxel, infinite without one.

    All columns go through the passes together, and the seeds are dropped: planes of y and z first (or lines of
    z and then of y, where a plane is too large), then lines of x.  With radii, values up to a radius are exact
    and the others infinite.
    """
    radii = radii or [None] * len(seeds)
    n = {a: grid.extent(k)[1] - grid.extent(k)[0] for k, a in enumerate(AXES)}
    h, wraps = dict(zip(AXES, grid.resolution, strict=True)), dict(zip(AXES, grid.periodic, strict=True))

    def clip(d2: np.ndarray, r: float | None) -> np.ndarray:
        if r is not None:
            d2[d2 > r * r * (1 + 1e-12)] = np.inf
        return d2

    def lines(axis: str):
        def kernel(cols):
            return {o: clip(widen(cols[o], h[axis], wraps[axis], None if r is None else int(np.ceil(r / h[axis] - 1e-9))), r) for o, r in zip(outs, radii, strict=True)}

        return kernel

    def first(cols):
        return {o: clip(nearest_zero(cols[s].astype(bool), h["z"], wraps["z"]), r) for s, o, r in zip(seeds, outs, radii, strict=True)}

    drops = tuple(seeds)
    if n["y"] * n["z"] <= PLANE_VOXELS:
        out = along(img, {"y": n["y"], "z": n["z"]}, lambda cols: lines("y")(first(cols)), seeds, outs, drops)
    else:
        out = along(along(img, {"z": n["z"]}, first, seeds, outs, drops), {"y": n["y"]}, lines("y"), outs, outs)
    return along(out, {"x": n["x"]}, lines("x"), outs, outs)


def squared_edt(img: DataFrame, grid: GridSpec, v: str = "v", out: str = "d2") -> DataFrame:
    """Add ``out``, the squared distance of each voxel to the nearest voxel of value 0; null if there is none anywhere.

    Faces of END and WALL type are no solid by themselves.
    """
    seed = unused(img, "_seed")
    found = squared_distance_to(img.withColumn(seed, F.col(v) == 0), grid, [seed], [out])
    return found.withColumn(out, F.when(F.col(out) < float("inf"), F.col(out)))


def edt(img: DataFrame, grid: GridSpec, v: str = "v", out: str = "distance") -> DataFrame:
    """Add ``out``, the distance to the nearest voxel of value 0."""
    return squared_edt(img, grid, v, out).withColumn(out, F.sqrt(out))


def boundary_hulls(img: DataFrame, grid: GridSpec, axis: int, count: int = 5, forward: bool = True, f: str = "d2") -> DataFrame:
    """x, y, z, height, begin and place of the first ``count`` parabolas of each line's lower envelope, counted from its lower end or its upper.

    A voxel's parabola is f + (h (i - its index)) ** 2; null and infinite values have none.  ``begin`` is the index, in
    general no whole one, from which it is the lowest, null for the lowermost.  What a neighbour of a block needs to go on with.
    """
    if axis not in (0, 1, 2):
        raise ValueError("axes are 0, 1 and 2")
    lo, hi = grid.extent(axis)
    h = grid.resolution[axis]

    def kernel(cols):
        g = cols["_f"]
        top, site, begin = _stacks(g, np.arange(g.shape[1]) * h)
        out = {c: np.full(g.shape, np.nan) for c in ("_begin", "_place")}
        line, k = np.nonzero(np.arange(g.shape[1]) <= top[:, None])
        out["_begin"][line, site[line, k]] = begin[line, k] / h + lo
        out["_place"][line, site[line, k]] = k if forward else top[line] - k
        return out

    found = along(img.select(*AXES, F.col(f).cast("double").alias("_f")), {AXES[axis]: hi - lo}, kernel, ["_f"], ["_begin", "_place"]).where(F.col("_place") < count)
    return found.select(*AXES, F.col("_f").alias("height"), F.when(F.col("_begin") > float("-inf"), F.col("_begin")).alias("begin"), F.col("_place").cast("int").alias("place"))


def correctors(img: DataFrame, grid: GridSpec, axis: int, v: str = "v") -> DataFrame:
    """For each line of each block along an axis: the distances from its first and last voxel to the nearest 0 beyond the block.

    Columns: the other two axes, ``block`` (its place along the axis), ``lower`` and ``upper``, null without a 0;
    periodic axes go on at the other end, back into the block itself if need be.  With them ``nearest_1d`` of a block's line is exact over the whole grid.
    Only the first and last 0 of a line in a block are shuffled.
    """
    if axis not in (0, 1, 2):
        raise ValueError("axes are 0, 1 and 2")
    rest = [AXES[a] for a in range(3) if a != axis]
    zero = F.when(F.col(v) == 0, F.col(AXES[axis]))
    per = img.groupBy(*rest, grid.block_of(axis).alias("block")).agg(F.min(zero).alias("_min"), F.max(zero).alias("_max"))
    line = Window.partitionBy(*rest).orderBy("block")  # one row a block
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    below, above = F.max("_max").over(before), F.min("_min").over(after)
    if grid.periodic[axis]:
        n = grid.voxels_shape[axis]
        on, back = line.rowsBetween(0, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, 0)
        below, above = F.coalesce(below, F.max("_max").over(on) - n), F.coalesce(above, F.min("_min").over(back) + n)
    ends = [(grid.block_start(axis, i), grid.block_start(axis, i) + grid.block_voxels(axis, i) - 1) for i in range(grid.blocks[axis])]
    first, last = (F.element_at(F.array(*(F.lit(e[k]) for e in ends)), F.col("block").cast("int") + 1) for k in (0, 1))
    h = F.lit(grid.resolution[axis])
    return per.select(*rest, F.col("block").cast("int").alias("block"), ((first - below) * h).alias("lower"), ((above - last) * h).alias("upper"))


def squared_edt_2d(img: DataFrame, shape: tuple[int, int], periodic=(False, False), resolution=(1.0, 1.0), v: str = "v", out: str = "d2") -> DataFrame:
    """As squared_edt for an image with columns x and y."""
    first = along(img.withColumn("_seed", F.col(v) == 0), {"y": shape[1]}, lambda c: {out: nearest_zero(c["_seed"].astype(bool), resolution[1], periodic[1])}, ["_seed"], [out], ("_seed",), ("x", "y"))
    both = along(first, {"x": shape[0]}, lambda c: {out: widen(c[out], resolution[0], periodic[0])}, [out], [out], (), ("x", "y"))
    return both.withColumn(out, F.when(F.col(out) < float("inf"), F.col(out)))


def squared_edt_relational(img: DataFrame, grid: GridSpec, v: str = "v", out: str = "d2") -> DataFrame:
    """The same distances by joins of lines with themselves; plain DataFrame operations, for small grids."""
    zero = img.where(F.col(v) == 0).select(*AXES, F.lit(0.0).alias("_f"))
    rows = zero
    for axis in (2, 1, 0):
        name, rest = AXES[axis], [a for i, a in enumerate(AXES) if i != axis]
        lo, hi = grid.extent(axis)
        spread = rows.withColumn("_j", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        gap = F.abs(F.col("_j") - F.col(name))
        gap = F.least(gap, F.lit(hi - lo) - gap) if grid.periodic[axis] else gap
        h2 = grid.resolution[axis] ** 2
        rows = spread.select(*rest, F.col("_j").cast("int").alias(name), (F.col("_f") + gap * gap * F.lit(h2)).alias("_f")).groupBy(*AXES).agg(F.min("_f").alias("_f"))
    return img.join(rows.withColumnRenamed("_f", out), list(AXES), "left")
