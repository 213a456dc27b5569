"""Connected components of voxel images and filters by the faces that they touch.

The image is cut into tiles of whole lines along z.  A task labels a tile: lines are cut into runs of equal value,
runs of neighbouring lines that touch (26 neighbours, the same value) are edges, and each voxel gets the least vid
of its part.  Voxels on the tiles' borders and periodic faces alone make the graph that joins parts of several
tiles.  A label is the least vid of its component plus 1.  Value 0 is background and has label 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES, GridSpec
from ..plans.graph import connected_components as graph_components
from ..plans.joins import BROADCAST_ROWS
from ..plans.names import unused
from ..plans.ranks import places
from ..plans.staging import staged

#: A graph of at most so many edges between tiles is solved on the driver; the edges are counted first.
SMALL_EDGES = 3_000_000
#: Voxels of a tile, which bound a task's memory; a line is never cut.
TILE_VOXELS = 4_000_000


def runs(img: DataFrame, grid: GridSpec, v: str = "v", root: str | None = None) -> DataFrame:
    """(x, y, v, z0, z1, run): maximal runs of equal nonzero value along z; run is the vid of the first voxel, or its ``root``."""
    line = Window.partitionBy("x", "y").orderBy("z")
    full = img.where(F.col(v) != 0).select(*AXES, F.col(v).alias("v"), (F.col(root) if root else F.lit(None).cast("long")).alias("_root"))
    last, at = F.lag("v").over(line), F.lag("z").over(line)
    new = (last.isNull() | (last != F.col("v")) | (at != F.col("z") - 1)).cast("int")
    out = full.withColumn("_new", new).withColumn("_k", F.sum("_new").over(line)).groupBy("x", "y", "_k").agg(F.first("v").alias("v"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("_root").alias("_root"))
    return out.withColumn("run", F.coalesce("_root", grid.vid(F.col("x"), F.col("y"), F.col("z0")))).drop("_k", "_root")


def run_edges(run_table: DataFrame, grid: GridSpec) -> DataFrame:
    """(src, dst) of runs that touch."""
    spans = [grid.extent(a) for a in range(3)]
    # half of the neighbouring lines; the line itself too if z wraps around
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)] + ([(0, 0)] if grid.periodic[2] else [])
    moved = run_table.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))))
    cols = {}
    inside = F.lit(True)
    for a, (name, (lo, hi)) in enumerate(zip(("x", "y"), spans, strict=False)):
        to = F.col(name) + F.col(f"_s.d{name}")
        if grid.periodic[a]:
            to = F.pmod(to - lo, F.lit(hi - lo)) + lo
        else:
            inside = inside & (to >= lo) & (to < hi)
        cols[f"_{name}"] = to.cast("int")
    left = moved.where(inside).select(F.col("run").alias("src"), F.col("v").alias("_v"), F.col("z0").alias("_z0"), F.col("z1").alias("_z1"), *(c.alias(n) for n, c in cols.items()))
    if grid.periodic[2]:
        n = spans[2][1] - spans[2][0]
        turns = F.explode(F.array(F.lit(-n), F.lit(0), F.lit(n)))
        left = left.withColumn("_t", turns).withColumn("_z0", F.col("_z0") + F.col("_t")).withColumn("_z1", F.col("_z1") + F.col("_t"))
    touch = (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")) & (F.col("_v") == F.col("v")) & (F.col("_z0") <= F.col("z1") + 1) & (F.col("z0") <= F.col("_z1") + 1)
    return left.join(run_table, touch).where("src != run").select("src", F.col("run").alias("dst")).distinct()


def least_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component: roots hook to lesser roots, then paths are halved, until edges join equals."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def solve(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, component) of an edge table, on the driver up to ``small`` edges, else by star contraction."""
    edges = staged(edges, "edges")
    if edges.count() > small:
        return graph_components(edges)
    pairs = edges.toArrow()
    nodes, labels = least_labels(pairs["src"].to_numpy(), pairs["dst"].to_numpy())
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(labels, pa.int64())}))


def touching(first: np.ndarray, last: np.ndarray, value: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of equal value that touch across neighbouring lines; runs are given by their first and last vid, in order."""
    nx, ny, nz = shape
    line = first // nz
    sources, targets = [], []
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        r = np.flatnonzero((line // ny + dx < nx) & (line % ny + dy >= 0) & (line % ny + dy < ny))
        step, start = (dx * ny + dy) * nz, line[r] * nz
        begin = np.searchsorted(last, np.maximum(first[r] - 1, start) + step, "left")
        end = np.searchsorted(first, np.minimum(last[r] + 1, start + nz - 1) + step, "right")
        n = np.maximum(end - begin, 0)
        src = np.repeat(r, n)
        dst = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        same = value[src] == value[dst]
        sources.append(src[same])
        targets.append(dst[same])
    return np.concatenate(sources), np.concatenate(targets)


def least_vids(vid: np.ndarray, value: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """The least vid of the part that each voxel belongs to, among the voxels given; -1 for value 0."""
    out = np.full(len(vid), -1, np.int64)
    on = np.flatnonzero(value != 0)
    on = on[np.argsort(vid[on], kind="stable")]
    if not len(on):
        return out
    w, c = vid[on], value[on]
    new = np.ones(len(on), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (c[1:] != c[:-1]) | (w[1:] % shape[2] == 0)
    at = np.flatnonzero(new)
    first, last = w[at], w[np.append(at[1:], len(w)) - 1]
    part = np.arange(len(at))
    nodes, least = least_labels(*touching(first, last, c[at], shape))
    part[nodes] = least
    out[on] = first[part][np.cumsum(new) - 1]
    return out


def tiles(grid: GridSpec, voxels: int = TILE_VOXELS) -> tuple[int, int]:
    """Planes of x and lines of y of a tile."""
    nx, ny, nz = (hi - lo for lo, hi in map(grid.extent, range(3)))
    lines = min(ny, max(1, voxels // nz))
    return min(nx, max(1, voxels // (lines * nz))), lines


def _by_tile(img: DataFrame, grid: GridSpec, v: str, root: str, tile: tuple[int, int]) -> DataFrame:
    """The image with ``root``, the least vid of each voxel's part of its tile, -1 for value 0."""
    spans = [grid.extent(a) for a in range(3)]
    shape = tuple(hi - lo for lo, hi in spans)
    names = img.columns
    plain = img.toDF(*(f"c{i}" for i in range(len(names))))
    column = {n: f"c{names.index(n)}" for n in (*AXES, v)}
    schema = T.StructType([*plain.schema.fields, T.StructField("root", T.LongType())])

    def label(rows: pa.Table) -> pa.Table:
        get = lambda n: rows.column(column[n]).to_numpy().astype(np.int64)
        x, y, z = (get(a) - lo for a, (lo, _) in zip(AXES, spans, strict=True))
        value = pc.fill_null(rows.column(column[v]), 0).to_numpy()
        found = least_vids((x * shape[1] + y) * shape[2] + z, value, shape)
        return rows.select(schema.names[:-1]).append_column("root", pa.array(found))

    key = [F.floor((F.col(column[a]) - lo) / n).alias(f"t{a}") for a, (lo, _), n in zip(AXES, spans, tile, strict=False)]
    return plain.groupBy(*key).applyInArrow(label, schema).toDF(*names, root)


def components(img: DataFrame, grid: GridSpec, v: str = "v", label: str = "label", small: int = SMALL_EDGES, tile: int = TILE_VOXELS) -> DataFrame:
    """Add ``label``: 0 for value 0 or null, else the least vid of the component plus 1.

    ``tile``: voxels of a tile; ``small``: see solve.  A voxel that is missing is background.
    """
    base = img.drop(label)
    names, root = [F.col(f"`{c}`") for c in base.columns], unused(base, "_root")
    cut = tiles(grid, tile)
    local = _by_tile(base, grid, v, root, cut)
    border = F.lit(False)
    for a, (name, n) in enumerate(zip(AXES, (*cut, 0), strict=True)):
        lo, hi = grid.extent(a)
        if grid.periodic[a]:
            border = border | F.col(name).isin(lo, hi - 1)
        if 0 < n < hi - lo:
            border = border | F.pmod(F.col(name) - lo, F.lit(n)).isin(0, n - 1)
    if not grid.any_periodic and cut == tuple(hi - lo for lo, hi in map(grid.extent, (0, 1))):
        return local.select(*names, (F.col(root) + 1).alias(label))
    local = staged(local, "local")
    edges = run_edges(staged(runs(local.where(border), grid, v, root), "runs"), grid)
    moved = staged(solve(edges, small).where("node != component").toDF(root, "_to"), "moved")
    to = unused(local, "_to")
    moved = moved.withColumnRenamed("_to", to)
    joined = local.join(F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved, root, "left")
    return joined.select(*names, (F.coalesce(F.col(to), F.col(root)) + 1).alias(label))


def numbered(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Labels as 1, 2, ... in order of their least voxel; 0 stays."""
    sizes = staged(labelled.where(F.col(label) != 0).groupBy(label).agg(F.count(F.lit(1)).alias("_rows")), "labels")
    order = places(sizes, [F.col(label)], "_n")
    names = [c for c in labelled.columns if c != label]
    return labelled.join(order, label, "left").select(*names, F.coalesce(F.col("_n") + 1, F.lit(0)).cast("long").alias(label))


def count(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: the number of components."""
    return labelled.where(F.col(label) != 0).agg(F.count_distinct(label).alias("n"))


def inlet_labels(labelled: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    """Labels on any inlet face (END faces only)."""
    return labelled.where(grid.on_faces(grid.inlet) & (F.col(label) != 0)).select(label).distinct()


def outlet_labels(labelled: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    return labelled.where(grid.on_faces(grid.outlet) & (F.col(label) != 0)).select(label).distinct()


def inlet_outlet_labels(labelled: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    """(label, inlet, outlet) of every label."""
    return labelled.where(F.col(label) != 0).groupBy(label).agg(F.bool_or(grid.on_faces(grid.inlet)).alias("inlet"), F.bool_or(grid.on_faces(grid.outlet)).alias("outlet"))


def inlet_outlet_connections(labelled: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    """Labels on an inlet and an outlet face."""
    return inlet_labels(labelled, grid, label).intersect(outlet_labels(labelled, grid, label))


def _filtered(img: DataFrame, grid: GridSpec, phase: int | None, v: str, keep) -> DataFrame:
    """Values of the components whose labels ``keep`` (labelled image, label column) names, 0 elsewhere."""
    zero = F.lit(0).cast(img.schema[v].dataType)
    label, kept = unused(img, "_label"), unused(img, "_keep")
    chosen = img if phase is None else img.withColumn(v, F.when(F.col(v) == phase, F.col(v)).otherwise(zero))
    labelled = staged(components(chosen, grid, v, label), "labelled")
    out = labelled.join(keep(labelled, label).withColumn(kept, F.lit(True)), label, "left")
    return out.withColumn(v, F.when(F.col(kept), F.col(v)).otherwise(zero)).select(*img.columns)


def inlet_connected(img: DataFrame, grid: GridSpec, phase: int | None = None, v: str = "v") -> DataFrame:
    """Values of components that touch an inlet face, 0 elsewhere; ``phase``: of that value only."""
    return _filtered(img, grid, phase, v, lambda x, label: inlet_labels(x, grid, label))


def outlet_connected(img: DataFrame, grid: GridSpec, phase: int | None = None, v: str = "v") -> DataFrame:
    return _filtered(img, grid, phase, v, lambda x, label: outlet_labels(x, grid, label))


def inlet_outlet_connected(img: DataFrame, grid: GridSpec, phase: int | None = None, v: str = "v") -> DataFrame:
    return _filtered(img, grid, phase, v, lambda x, label: inlet_outlet_connections(x, grid, label))


def isolated(img: DataFrame, grid: GridSpec, phase: int | None = None, v: str = "v") -> DataFrame:
    """Values of components that touch neither an inlet nor an outlet face."""
    return _filtered(img, grid, phase, v, lambda x, label: inlet_outlet_labels(x, grid, label).where("not inlet and not outlet").select(label))
