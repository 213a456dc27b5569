"""Writers: Parquet blocks and VTK XML files, one piece a block, written by the executors.

VTK pieces hold little-endian arrays appended after the XML, raw in memory and in base64 in files, which are
texts that Spark's own writer commits on any of its file systems; the driver only renames them.  Each piece is one
task's work and bounded by the block; the index that names the pieces is a few lines and written last, by the
driver, so an index exists only if all pieces do.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridSpec

#: VTK's names of NumPy types and its cell types.
VTK_TYPES = {"int8": "Int8", "uint8": "UInt8", "int16": "Int16", "uint16": "UInt16", "int32": "Int32", "uint32": "UInt32", "int64": "Int64", "uint64": "UInt64", "float32": "Float32", "float64": "Float64"}
VTK_CELLS = {"vertex": 1, "line": 3, "polyline": 4, "triangle": 5, "quad": 9, "tetra": 10, "hexahedron": 12}
EXTENSIONS = {"ImageData": "vti", "RectilinearGrid": "vtr", "StructuredGrid": "vts", "UnstructuredGrid": "vtu"}


class VtkPiece:
    """One VTK XML file in memory: elements, then the appended arrays."""

    def __init__(self, kind: str):
        if kind not in EXTENSIONS:
            raise ValueError(f"kind is one of {sorted(EXTENSIONS)}")
        self.kind, self.lines, self.arrays = kind, [], []

    def open(self, name: str, **attributes) -> None:
        self.lines.append("<" + " ".join([name, *(f'{k}="{_words(v)}"' for k, v in attributes.items())]) + ">")

    def close(self, name: str) -> None:
        self.lines.append(f"</{name}>")

    def comment(self, text: str) -> None:
        self.lines.append(f"<!-- {text.replace('--', '- -')} -->")

    def array(self, name: str, values: np.ndarray, components: int = 1) -> None:
        """A DataArray whose bytes follow in the appended part."""
        values = np.ascontiguousarray(values)
        if values.dtype.name not in VTK_TYPES:
            raise ValueError(f"VTK has no type for {values.dtype}")
        if values.dtype.byteorder == ">":
            values = values.astype(values.dtype.newbyteorder("<"))
        self.lines.append(f'<DataArray type="{VTK_TYPES[values.dtype.name]}" Name="{name}" NumberOfComponents="{components}" format="appended" offset="{{{len(self.arrays)}}}"/>')
        self.arrays.append(struct.pack("<Q", values.nbytes) + values.tobytes())

    def data(self, where: str, arrays: dict[str, np.ndarray]) -> None:
        """A PointData or CellData element."""
        if arrays:
            self.open(where, Scalars=next(iter(arrays)))
            for name, values in arrays.items():
                self.array(name, values.ravel(), 1)
            self.close(where)

    def _file(self, encoding: str, parts: list[bytes]) -> bytes:
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        lines = [line.format(*starts) if line.startswith("<DataArray") else line for line in self.lines]
        head = ['<?xml version="1.0"?>', f'<VTKFile type="{self.kind}" version="1.0" byte_order="LittleEndian" header_type="UInt64">', *lines, f'<AppendedData encoding="{encoding}">']
        return "\n".join(head).encode() + b"\n_" + b"".join(parts) + b"\n</AppendedData>\n</VTKFile>\n"

    def bytes(self) -> bytes:
        return self._file("raw", self.arrays)

    def text(self) -> str:
        """The same file with its arrays in base64."""
        return self._file("base64", [base64.b64encode(a) for a in self.arrays]).decode()


def _words(value) -> str:
    return " ".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value)


def image_piece(arrays: dict[str, np.ndarray], start=(0, 0, 0), origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), text: bool = False) -> bytes | str:
    """A .vti of cell data; arrays are indexed [x, y, z] and stored x fastest.  ``text``: in base64."""
    shapes = {a.shape for a in arrays.values()}
    if len(shapes) != 1:
        raise ValueError("all arrays of an image have one shape")
    (shape,) = shapes
    extent = [v for s, n in zip(start, shape, strict=True) for v in (s, s + n)]
    p = VtkPiece("ImageData")
    p.open("ImageData", WholeExtent=extent, Origin=list(origin), Spacing=list(spacing))
    p.open("Piece", Extent=extent)
    p.data("CellData", {k: a.ravel(order="F") for k, a in arrays.items()})
    p.close("Piece")
    p.close("ImageData")
    return p.text() if text else p.bytes()


def rectilinear_piece(x, y, z, cell_data=None, point_data=None, text: bool = False) -> bytes | str:
    """A .vtr on three arrays of coordinates."""
    extent = [v for c in (x, y, z) for v in (0, len(c) - 1)]
    p = VtkPiece("RectilinearGrid")
    p.open("RectilinearGrid", WholeExtent=extent)
    p.open("Piece", Extent=extent)
    p.open("Coordinates")
    for n, c in zip(AXES, (x, y, z), strict=True):
        p.array(n, np.asarray(c, float))
    p.close("Coordinates")
    p.data("PointData", {k: a.ravel(order="F") for k, a in (point_data or {}).items()})
    p.data("CellData", {k: a.ravel(order="F") for k, a in (cell_data or {}).items()})
    p.close("Piece")
    p.close("RectilinearGrid")
    return p.text() if text else p.bytes()


def structured_piece(x, y, z, cell_data=None, point_data=None, text: bool = False) -> bytes | str:
    """A .vts on three-dimensional arrays of point coordinates."""
    extent = [v for n in np.shape(x) for v in (0, n - 1)]
    p = VtkPiece("StructuredGrid")
    p.open("StructuredGrid", WholeExtent=extent)
    p.open("Piece", Extent=extent)
    p.open("Points")
    p.array("points", np.column_stack([np.asarray(c, float).ravel(order="F") for c in (x, y, z)]), 3)
    p.close("Points")
    p.data("PointData", {k: a.ravel(order="F") for k, a in (point_data or {}).items()})
    p.data("CellData", {k: a.ravel(order="F") for k, a in (cell_data or {}).items()})
    p.close("Piece")
    p.close("StructuredGrid")
    return p.text() if text else p.bytes()


def grid_piece(x, y, z, cell_data=None, point_data=None) -> bytes:
    """Rectilinear for coordinates of one axis each, structured for arrays of three."""
    dims = {np.ndim(c) for c in (x, y, z)}
    if dims == {1}:
        return rectilinear_piece(x, y, z, cell_data, point_data)
    if dims == {3}:
        return structured_piece(x, y, z, cell_data, point_data)
    raise ValueError("coordinates have one or three axes")


def unstructured_piece(points: np.ndarray, connectivity, offsets, types, point_data=None, cell_data=None, text: bool = False, comment: str | None = None) -> bytes | str:
    """A .vtu of points and cells; ``offsets`` are the ends of the cells in ``connectivity``."""
    points = np.asarray(points, float).reshape(-1, 3)
    p = VtkPiece("UnstructuredGrid")
    if comment is not None:
        p.comment(comment)
    p.open("UnstructuredGrid")
    p.open("Piece", NumberOfPoints=len(points), NumberOfCells=len(types))
    p.open("Points")
    p.array("points", points, 3)
    p.close("Points")
    p.open("Cells")
    p.array("connectivity", np.asarray(connectivity, np.int64))
    p.array("offsets", np.asarray(offsets, np.int64))
    p.array("types", np.asarray(types, np.uint8))
    p.close("Cells")
    p.data("PointData", point_data or {})
    p.data("CellData", cell_data or {})
    p.close("Piece")
    p.close("UnstructuredGrid")
    return p.text() if text else p.bytes()


def points_piece(points: np.ndarray, data: dict[str, np.ndarray] | None = None, text: bool = False, comment: str | None = None) -> bytes | str:
    n = len(points)
    return unstructured_piece(points, np.arange(n), np.arange(1, n + 1), np.full(n, VTK_CELLS["vertex"]), data, None, text, comment)


def lines_piece(points: np.ndarray, point_data=None, cell_data=None) -> bytes:
    """Segments between points 0-1, 2-3 and so on."""
    n = len(points)
    if n % 2:
        raise ValueError("segments need an even number of points")
    return unstructured_piece(points, np.arange(n), np.arange(2, n + 1, 2), np.full(n // 2, VTK_CELLS["line"]), point_data, cell_data)


def polylines_piece(points: np.ndarray, points_of_line, point_data=None, cell_data=None) -> bytes:
    """Lines through consecutive points, so many each."""
    if sum(points_of_line) != len(points):
        raise ValueError("the lines must use all points")
    return unstructured_piece(points, np.arange(len(points)), np.cumsum(points_of_line), np.full(len(points_of_line), VTK_CELLS["polyline"]), point_data, cell_data)


def triangulated_piece(points: np.ndarray, triangles, point_data=None, cell_data=None) -> bytes:
    """A surface of triangles given by point numbers; see ``delaunay``."""
    t = np.asarray(triangles).reshape(-1, 3)
    return unstructured_piece(points, t.ravel(), np.arange(3, 3 * len(t) + 1, 3), np.full(len(t), VTK_CELLS["triangle"]), point_data, cell_data)


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles of points in the plane by insertion (Bowyer and Watson); for the sizes that are drawn."""
    xy = np.asarray(xy, float)
    span = max(np.ptp(xy, axis=0).max(), 1.0) * 1e3
    mid = xy.mean(0)
    p = np.vstack([xy, mid + [[-span, -span], [span, -span], [0, span]]])
    n = len(xy)
    triangles = {(n, n + 1, n + 2)}
    for i in range(n):
        bad = [t for t in triangles if _in_circle(p[list(t)], p[i])]
        edges: dict[tuple, int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1
        triangles -= set(bad)
        triangles |= {(*e, i) for e, k in edges.items() if k == 1}
    return np.array([t for t in triangles if max(t) < n], int).reshape(-1, 3)


def _in_circle(t: np.ndarray, q: np.ndarray) -> bool:
    m = t - q
    det = np.linalg.det(np.column_stack([m, (m * m).sum(1)]))
    turn = (t[1, 0] - t[0, 0]) * (t[2, 1] - t[0, 1]) - (t[1, 1] - t[0, 1]) * (t[2, 0] - t[0, 0])
    return det > 0 if turn > 0 else det < 0


def cylinder_piece(x0, y0, z0, z1, radius, layers: int, sides: int = 16, cell_data=None, point_data=None) -> bytes:
    """The mantle of an upright cylinder as quads."""
    angle = 2 * np.pi * np.arange(sides) / sides
    ring = np.column_stack([x0 + radius * np.cos(angle), y0 + radius * np.sin(angle)])
    points = np.vstack([np.column_stack([ring, np.full(sides, z)]) for z in np.linspace(z0, z1, layers + 1)])
    quads = [(k * sides + i, k * sides + (i + 1) % sides, (k + 1) * sides + (i + 1) % sides, (k + 1) * sides + i) for k in range(layers) for i in range(sides)]
    q = np.array(quads)
    return unstructured_piece(points, q.ravel(), np.arange(4, 4 * len(q) + 1, 4), np.full(len(q), VTK_CELLS["quad"]), point_data, cell_data)


# -- indices
def parallel_index(kind: str, pieces: list[tuple[str, list[int] | None]], whole: list[int] | None = None, points: dict[str, str] | None = None, cells: dict[str, str] | None = None, **attributes) -> bytes:
    """The index of a data set of ``kind``: (file, extent) of each piece, extents of the grids that have one, and arrays by name with NumPy types."""
    if kind not in EXTENSIONS:
        raise ValueError(f"kind is one of {sorted(EXTENSIONS)}")
    array = lambda name, t, n=1: f'<PDataArray type="{VTK_TYPES[t]}" Name="{name}" NumberOfComponents="{n}"/>'
    extent = {} if whole is None else {"WholeExtent": whole}
    lines = [f"<P{kind} " + " ".join(f'{k}="{_words(v)}"' for k, v in {**extent, "GhostLevel": 0, **attributes}.items()) + ">"]
    for where, arrays in (("PPointData", points), ("PCellData", cells)):
        if arrays:
            lines += [f'<{where} Scalars="{next(iter(arrays))}">', *(array(n, t) for n, t in arrays.items()), f"</{where}>"]
    if kind == "RectilinearGrid":
        lines += ["<PCoordinates>", *(array(a, "float64") for a in AXES), "</PCoordinates>"]
    elif kind != "ImageData":
        lines += ["<PPoints>", array("points", "float64", 3), "</PPoints>"]
    lines += [f'<Piece {"" if e is None else f"""Extent="{_words(e)}" """}Source="{f}"/>' for f, e in pieces]
    head = ['<?xml version="1.0"?>', f'<VTKFile type="P{kind}" version="1.0" byte_order="LittleEndian" header_type="UInt64">']
    return ("\n".join([*head, *lines, f"</P{kind}>", "</VTKFile>"]) + "\n").encode()


def image_index(pieces: list[tuple[str, list[int]]], whole: list[int], origin, spacing, arrays: dict[str, str]) -> bytes:
    """A .pvti: (file, extent) of each piece."""
    return parallel_index("ImageData", pieces, whole, cells=arrays, Origin=list(origin), Spacing=list(spacing))


def points_index(pieces: list[str], arrays: dict[str, str]) -> bytes:
    """A .pvtu."""
    return parallel_index("UnstructuredGrid", [(f, None) for f in pieces], points=arrays)


def collection(files: list[tuple[str, float]], group: str = "") -> bytes:
    """A .pvd: files with their times, in order of time."""
    sets = [f'<DataSet timestep="{float(t)}" group="{group}" part="0" file="{f}"/>' for f, t in sorted(files, key=lambda x: x[1])]
    head = ['<?xml version="1.0"?>', '<VTKFile type="Collection" version="1.0" byte_order="LittleEndian">', "<Collection>"]
    return ("\n".join([*head, *sets, "</Collection>", "</VTKFile>"]) + "\n").encode()


def save_collection(spark: SparkSession, path: str, files: list[tuple[str, float]], group: str = "") -> None:
    """``path``.pvd."""
    _put(spark, f"{path}.pvd", collection(files, group))


# -- Spark
def _put(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def _pieces_table(df: DataFrame, block: str, make) -> DataFrame:
    """(block, content): what ``make`` gives for the rows of each block, bytes or text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(rows[block].iloc[0]), make(rows))], columns=["block", "content"])

    return df.groupBy(block).applyInPandas(run, "block int, content string")


def _write_pieces(pieces: DataFrame, folder: str, extension: str) -> list[str]:
    """One file a block in ``folder``, written and committed by the executors; the driver gives them their names."""
    spark = pieces.sparkSession
    parts = f"{folder}/_parts"
    pieces.write.mode("overwrite").partitionBy("block").text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for found in fs.globStatus(path(f"{parts}/block=*/part-*")) or []:
        block = int(found.getPath().getParent().getName().removeprefix("block="))
        names.append(f"piece-{block:06d}.{extension}")
        fs.delete(path(f"{folder}/{names[-1]}"), False)
        fs.rename(found.getPath(), path(f"{folder}/{names[-1]}"))
    fs.delete(path(parts), True)
    return sorted(names)


def save_image(img: DataFrame, grid: GridSpec, path: str, extra: dict[str, str] | None = None, v: str = "v") -> None:
    """``path``.pvti and a folder of .vti pieces, one a block of ``grid``; ``extra``: more columns by their names in the file."""
    columns = {"img": v, **(extra or {})}
    missing = [c for c in columns.values() if c not in img.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    blocked = img.select(((grid.block_of(0) * grid.blocks[1] + grid.block_of(1)) * grid.blocks[2] + grid.block_of(2)).alias("block"), *AXES, *columns.values())

    def make(rows: pd.DataFrame) -> bytes:
        at = [rows[a].to_numpy() for a in AXES]
        start = [int(a.min()) for a in at]
        shape = [int(a.max()) - s + 1 for a, s in zip(at, start, strict=True)]
        arrays = {}
        for name, c in columns.items():
            values = rows[c].to_numpy()
            out = np.zeros(shape, values.dtype if values.dtype.kind != "b" else np.uint8)
            out[tuple(a - s for a, s in zip(at, start, strict=True))] = values
            arrays[name] = out
        return image_piece(arrays, start, grid.origin, grid.resolution, text=True)

    folder = f"{path}_proc"
    names = _write_pieces(_pieces_table(blocked, "block", make), folder, "vti")
    spans = blocked.groupBy("block").agg(*(f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max)))).orderBy("block").collect()
    extents = [[v for a in AXES for v in (r[f"{a}0"], r[f"{a}1"] + 1)] for r in spans]
    whole = [f(e[i] for e in extents) for i, f in enumerate((min, max) * 3)]
    kinds = {n: _numpy_name(img.schema[c].dataType.simpleString()) for n, c in columns.items()}
    base = folder.rpartition("/")[2]
    _put(img.sparkSession, f"{path}.pvti", image_index([(f"{base}/{n}", e) for n, e in zip(names, extents, strict=True)], whole, grid.origin, grid.resolution, kinds))


def _numpy_name(kind: str) -> str:
    return {"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8", "float": "float32", "double": "float64", "boolean": "uint8"}[kind]


def save_extended_image(img: DataFrame, grid: GridSpec, path: str, pad: tuple[int, int, int], v: str = "v") -> None:
    """A folder of .vti pieces that keep each block's halo."""
    from ..operators.voxels import deconstruct

    cut = deconstruct(img, grid, pad, v)
    starts = {r: grid.block(r, pad).start for r in range(grid.n_blocks)}

    def make(rows: pd.DataFrame) -> bytes:
        at = [rows[f"l{a}"].to_numpy() for a in AXES]
        out = np.zeros([int(a.max()) + 1 for a in at], rows[v].to_numpy().dtype)
        out[tuple(at)] = rows[v].to_numpy()
        return image_piece({"img": out}, starts[int(rows["block"].iloc[0])], grid.origin, grid.resolution, text=True)

    _write_pieces(_pieces_table(cut, "block", make), f"{path}_proc", "vti")


def save_particles(particles: DataFrame, path: str, pieces: int = 1) -> None:
    """``path``.pvtu and a folder of .vtu pieces with radius, own and label where there are such columns."""
    columns = {n: c for n, c in (("radius", "r"), ("own", "own"), ("label", "type")) if c in particles.columns}
    dealt = particles.select(F.pmod(F.xxhash64(*AXES), F.lit(pieces)).cast("int").alias("block"), *AXES, *(F.col(c).cast("double" if n == "radius" else "int").alias(n) for n, c in columns.items()))

    def make(rows: pd.DataFrame) -> bytes:
        return points_piece(rows[list(AXES)].to_numpy(), {n: rows[n].fillna(0).to_numpy() for n in columns}, text=True)

    folder = f"{path}_proc"
    names = _write_pieces(_pieces_table(dealt, "block", make), folder, "vtu")
    base = folder.rpartition("/")[2]
    _put(particles.sparkSession, f"{path}.pvtu", points_index([f"{base}/{n}" for n in names], {n: "float64" if n == "radius" else "int32" for n in columns}))


def plot_pore_sizes(curve: DataFrame, path: str, kind: str = "pdf") -> None:
    """A PNG of a pore-size curve, if matplotlib is there."""
    if kind not in ("pdf", "cdf"):
        raise ValueError("kind is pdf or cdf")
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = curve.orderBy("radius").select("radius", kind).toPandas()
    figure, axes = plt.subplots()
    axes.plot(rows["radius"], rows[kind], "o-")
    axes.set_xlabel("radius")
    axes.set_ylabel(kind)
    figure.savefig(path)
    plt.close(figure)
