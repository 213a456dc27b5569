"""Voxel images: DataFrames with x, y, z and a value column (``v`` unless said otherwise).

Reservoir voxels lie outside [0, n) on their axis; operators that count own voxels leave them out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, Boundary, GridSpec


def own(img: DataFrame, grid: GridSpec) -> DataFrame:
    """The image without reservoirs."""
    return img.where(~grid.in_reservoir()) if grid.reservoir else img


unpad = own


def pad_constant(img: DataFrame, pad: tuple[tuple[int, int], ...], value, grid: GridSpec, v: str = "v") -> DataFrame:
    """The image with rows of ``value`` around it."""
    spans = [F.explode(F.sequence(F.lit(-a), F.lit(n + b - 1))) for (a, b), n in zip(pad, grid.voxels_shape, strict=True)]
    spark = img.sparkSession
    frame = spark.range(1).select(spans[0].alias("x")).select("x", spans[1].alias("y")).select("x", "y", spans[2].alias("z"))
    rim = reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) >= n) for c, n in zip(AXES, grid.voxels_shape, strict=True)])
    return img.select(*AXES, v).unionByName(frame.where(rim).withColumn(v, F.lit(value).cast(img.schema[v].dataType)))


def window(img: DataFrame, start: tuple[int, int, int], shape: tuple[int, int, int], grid: GridSpec) -> DataFrame:
    """The voxels of a window that may wrap around, with local indices lx, ly, lz."""
    local = [F.pmod(F.col(a) - s, F.lit(n)) for a, s, n in zip(AXES, start, grid.voxels_shape, strict=True)]
    copies = img
    for a, at, size, n in zip(AXES, local, shape, grid.voxels_shape, strict=True):
        copies = copies.withColumn(f"l{a}", F.explode(F.sequence(at, F.lit(at_most(size, n)) + at, F.lit(n)))).where(F.col(f"l{a}") < size)
    return copies


def at_most(size: int, n: int) -> int:
    """The greatest multiple of n that a window of ``size`` can reach beyond a first turn."""
    return ((size + n - 1) // n) * n


def deconstruct(img: DataFrame, grid: GridSpec, pad: tuple[int, int, int] = (1, 1, 1), v: str = "v") -> DataFrame:
    """(block, lx, ly, lz, x, y, z, v): every block's voxels with its halo, wrapped where periodic, walls set to 0.

    Each voxel goes to the blocks that need it, by arithmetic on its index; no join.
    """
    if grid.reservoir:
        raise ValueError("blocks are cut from an image without reservoirs")
    out = img.select(*AXES, v)
    for a, name in enumerate(AXES):
        spans = []
        for i in range(grid.blocks[a]):
            block = grid.block(_rank_on_axis(grid, a, i), pad)
            spans.append((i, block.start[a], block.shape[a]))
        n = grid.voxels_shape[a]
        options = []
        for i, start, size in spans:
            for turn in (-1, 0, 1):
                local = F.col(name) - start + turn * n
                options.append(F.when((local >= 0) & (local < size), F.struct(F.lit(i).alias("b"), local.cast("int").alias("l"))))
        out = out.withColumn(f"_{name}", F.explode(F.array_compact(F.array(*options))))
    _, by, bz = grid.blocks
    rank = (F.col("_x.b") * by + F.col("_y.b")) * bz + F.col("_z.b")
    out = out.select(rank.cast("int").alias("block"), *(F.col(f"_{a}.l").alias(f"l{a}") for a in AXES), *AXES, v, *(F.col(f"_{a}.b").alias(f"_b{a}") for a in AXES))
    wall = F.lit(False)
    for a, name in enumerate(AXES):
        for side in (0, 1):
            if grid.boundary[a][side] == Boundary.WALL:
                last = grid.blocks[a] - 1
                block = grid.block(_rank_on_axis(grid, a, last if side else 0), pad)
                edge = block.shape[a] - 1 if side else 0
                wall = wall | ((F.col(f"_b{name}") == (last if side else 0)) & (F.col(f"l{name}") == edge))
    return out.withColumn(v, F.when(wall, F.lit(0).cast(img.schema[v].dataType)).otherwise(F.col(v))).drop(*(f"_b{a}" for a in AXES))


def _rank_on_axis(grid: GridSpec, axis: int, i: int) -> int:
    index = [0, 0, 0]
    index[axis] = i
    _, by, bz = grid.blocks
    return (index[0] * by + index[1]) * bz + index[2]


def halo(img: DataFrame, grid: GridSpec, pad: tuple[int, int, int], v: str = "v") -> DataFrame:
    """What the neighbours send each block: the rows of ``deconstruct`` that are not the block's own."""
    cut = deconstruct(img, grid, pad, v)
    owner = (grid.block_of(0) * grid.blocks[1] + grid.block_of(1)) * grid.blocks[2] + grid.block_of(2)
    inside = F.lit(True)
    for a in range(3):
        per = [grid.block(r, pad).own[a] for r in range(grid.n_blocks)]
        low = F.element_at(F.array(*(F.lit(p[0]) for p in per)), F.col("block") + 1)
        high = F.element_at(F.array(*(F.lit(p[1]) for p in per)), F.col("block") + 1)
        inside = inside & (F.col(f"l{AXES[a]}") >= low) & (F.col(f"l{AXES[a]}") < high)
    return cut.withColumn("owner", owner).where(~inside)


def set_walls(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """0 on the outermost slices of WALL faces."""
    return img.withColumn(v, F.when(grid.wall_slices(), F.lit(0).cast(img.schema[v].dataType)).otherwise(F.col(v)))


def set_reservoir(img: DataFrame, grid: GridSpec, value, v: str = "v") -> DataFrame:
    return img.withColumn(v, F.when(grid.in_reservoir(), F.lit(value).cast(img.schema[v].dataType)).otherwise(F.col(v)))


def renumber(img: DataFrame, conversion: DataFrame | dict, v: str = "v") -> DataFrame:
    """New values from a (v, new) table; values that it lacks become 0."""
    if isinstance(conversion, dict):
        conversion = img.sparkSession.createDataFrame([(int(a), int(b)) for a, b in conversion.items()], f"{v} bigint, new bigint")
        conversion = F.broadcast(conversion)
    names = [c for c in img.columns if c != v]
    return img.join(conversion, v, "left").select(*names, F.coalesce("new", F.lit(0)).alias(v))


def thresholded(img: DataFrame, low, value, other=None, v: str = "v") -> DataFrame:
    """Values up to ``low`` become ``value``, those above ``other`` or, without it, stay."""
    kind = img.schema[v].dataType
    above = F.col(v) if other is None else F.lit(other).cast(kind)
    return img.withColumn(v, F.when(F.col(v) <= low, F.lit(value).cast(kind)).otherwise(above))


def _is_at(at: tuple[int, ...]) -> Column:
    """The voxel of two or three indices."""
    here = F.lit(True)
    for a, i in zip(AXES, at, strict=False):
        here = here & (F.col(a) == i)
    return here


def pixel(img: DataFrame, at: tuple[int, ...]) -> DataFrame:
    """The row of one voxel, of an image of two or three axes."""
    return img.where(_is_at(at))


def with_pixel(img: DataFrame, at: tuple[int, ...], value, v: str = "v") -> DataFrame:
    """One voxel set to a value."""
    return img.withColumn(v, F.when(_is_at(at), F.lit(value).cast(img.schema[v].dataType)).otherwise(F.col(v)))


def label_phases(img: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """(label, v): the value of each label; of several the greatest."""
    return img.groupBy(label).agg(F.max(v).alias(v))


def phase_count(phases: DataFrame, v: str = "v") -> DataFrame:
    """(v, n): labels of each value."""
    return phases.groupBy(v).agg(F.count(F.lit(1)).alias("n"))


def histogram(img: DataFrame, grid: GridSpec | None = None, v: str = "v") -> DataFrame:
    """(v, n) over own voxels."""
    return (own(img, grid) if grid else img).groupBy(v).agg(F.count(F.lit(1)).alias("n"))


def extremes(img: DataFrame, grid: GridSpec | None = None, v: str = "v") -> DataFrame:
    """One row: the least and the greatest value, over own voxels if a grid is given."""
    return (own(img, grid) if grid else img).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def phase_exists(img: DataFrame, phase: int, v: str = "v") -> bool:
    return not img.where(F.col(v) == phase).isEmpty()


def has_solid(img: DataFrame, v: str = "v") -> bool:
    """Whether a voxel is 0; an image without one has no distances."""
    return phase_exists(img, 0, v)


def axis_means(img: DataFrame, grid: GridSpec, over: int | tuple[int, int], v: str = "v") -> DataFrame:
    """Means over one axis or two, by the others, of own voxels."""
    axes = (over,) if isinstance(over, int) else tuple(over)
    if len(axes) not in (1, 2) or len(set(axes)) != len(axes):
        raise ValueError("one axis, or two that differ")
    if not all(a in (0, 1, 2) for a in axes):
        raise ValueError("axes are 0, 1 and 2")
    rest = [AXES[a] for a in range(3) if a not in axes]
    n = 1
    for a in axes:
        n *= grid.voxels_shape[a]
    return own(img, grid).groupBy(*rest).agg((F.sum(v) / F.lit(float(n))).alias("mean"))


def all_axis_means(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """All six marginals in one pass: x, y, z (null where averaged over) and mean."""
    sets = own(img, grid).groupingSets([["x"], ["y"], ["z"], ["x", "y"], ["x", "z"], ["y", "z"]], *map(F.col, AXES))
    return sets.agg(F.avg(F.col(v).cast("double")).alias("mean"))


#: Reductions over all rows, by name.
REDUCTIONS = {
    "sum": lambda c, k: F.sum(c), "prod": lambda c, k: F.product(c), "max": lambda c, k: F.max(c), "min": lambda c, k: F.min(c),
    "land": lambda c, k: F.bool_and(c != 0), "lor": lambda c, k: F.bool_or(c != 0), "lxor": lambda c, k: F.count_if(c != 0) % 2 == 1,
    "band": lambda c, k: F.bit_and(c), "bor": lambda c, k: F.bit_or(c), "bxor": lambda c, k: F.bit_xor(c),
    "minloc": lambda c, k: F.min(F.struct(c.alias("value"), k.alias("at"))), "maxloc": lambda c, k: F.max_by(F.struct(c.alias("value"), k.alias("at")), F.struct(c, -k)),
}


def reduced(df: DataFrame, op: str, value: str = "v", at: str | None = None) -> DataFrame:
    """One row, ``result``; minloc and maxloc give the value and the first place ``at`` which it is."""
    if op not in REDUCTIONS:
        raise ValueError(f"unknown reduction: {op}")
    return df.agg(REDUCTIONS[op](F.col(value), F.col(at) if at else F.lit(0)).alias("result"))


# -- lines
def line(img: DataFrame, axis: int, at: tuple[int, int], forward: bool = True, v: str = "v") -> DataFrame:
    """(i, v) along an axis through the given place on the other two, in order."""
    rest = [a for a in range(3) if a != axis]
    name = AXES[axis]
    rows = img.where((F.col(AXES[rest[0]]) == at[0]) & (F.col(AXES[rest[1]]) == at[1])).select(F.col(name).alias("i"), v)
    return rows.orderBy("i" if forward else F.desc("i"))


def _span(grid: GridSpec, axis: int, which: str, pad: int) -> tuple[int, int]:
    lo, hi = grid.extent(axis)
    if which == "all":
        return lo, hi
    if which not in ("own", "pad"):
        raise ValueError("voxels are all, own or pad")
    if pad <= 0:
        raise TypeError("own and pad need a halo")
    skip = pad if which == "own" else 2 * pad
    return lo + skip, hi - skip


def nearest_index(img: DataFrame, grid: GridSpec, axis: int, label: int, which: str = "all", pad: int = 0, v: str = "v") -> DataFrame:
    """For each line along an axis: the first index with the label from below and from above, -1 without one.

    ``own`` leaves out ``pad`` voxels at each end, ``pad`` twice as many.
    """
    if axis not in (0, 1, 2):
        raise ValueError("axes are 0, 1 and 2")
    rest = [AXES[a] for a in range(3) if a != axis]
    lo, hi = _span(grid, axis, which, pad)
    i = F.col(AXES[axis])
    hit = F.when((F.col(v) == label) & (i >= lo) & (i < hi), i)
    return img.groupBy(*rest).agg(F.coalesce(F.min(hit), F.lit(-1)).alias("lower"), F.coalesce(F.max(hit), F.lit(-1)).alias("upper"))


def nearest_distance(img: DataFrame, grid: GridSpec, axis: int, label: int, which: str = "all", pad: int = 0, v: str = "v") -> DataFrame:
    """As nearest_index, but the distance from the face to the voxel's centre, infinite without one."""
    found = nearest_index(img, grid, axis, label, which, pad, v)
    h, (lo, hi) = grid.resolution[axis], grid.extent(axis)
    inf = F.lit(float("inf"))
    return found.select(
        *[c for c in found.columns if c not in ("lower", "upper")],
        F.when(F.col("lower") >= 0, (F.col("lower") - lo + 0.5) * h).otherwise(inf).alias("lower"),
        F.when(F.col("upper") >= 0, (hi - F.col("upper") - 0.5) * h).otherwise(inf).alias("upper"),
    )


def face_values(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """(axis, side, vid, v) of the voxels on the six faces."""
    parts = []
    for a in range(3):
        for s in (0, 1):
            parts.append(img.where(grid.on_face(a, s)).select(F.lit(a).alias("axis"), F.lit(s).alias("side"), grid.vid().alias("vid"), v))
    return reduce(DataFrame.unionByName, parts)


def boundary_labels(img: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    """(label, on_boundary, vids): the labels' voxels on the grid's faces."""
    on = reduce(lambda a, b: a | b, [grid.on_face(a, s) for a in range(3) for s in (0, 1)])
    hit = F.when(on, grid.vid())
    return img.groupBy(label).agg(F.bool_or(on).alias("on_boundary"), F.array_sort(F.collect_set(hit)).alias("vids"))


def matched_pairs(left: DataFrame, right: DataFrame, label: str = "label", skip_zero: bool = True) -> DataFrame:
    """Distinct label pairs (a, b) of two images that share voxels, by global voxel id."""
    a, b = (df.select("vid", F.col(label).alias(n)) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, "vid")
    return (both.where("a != 0 and b != 0") if skip_zero else both).select("a", "b").distinct()


def adjacency(pairs: DataFrame) -> DataFrame:
    """(a, neighbours) of label pairs."""
    return pairs.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def phase(img: DataFrame, value: int, v: str = "v") -> Column:
    return F.col(v) == value


def porosity(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """One row: the share of own voxels that are pore."""
    return own(img, grid).agg((F.count_if(F.col(v) == 1) / F.lit(float(grid.size))).alias("porosity"))


def volume_fraction(img: DataFrame, grid: GridSpec, value: int, v: str = "v") -> DataFrame:
    return own(img, grid).agg((F.count_if(F.col(v) == value) / F.lit(float(grid.size))).alias("fraction"))


def saturation(img: DataFrame, grid: GridSpec, value: int, v: str = "v") -> DataFrame:
    """The share of the pore space (values above 0) that has the value; NaN without any pore."""
    pores = F.count_if(F.col(v) > 0)
    share = F.when(pores > 0, F.count_if(F.col(v) == value) / pores).otherwise(F.lit(float("nan")))
    return own(img, grid).agg(share.alias("saturation"))
