"""Queries that write files of each format from the tables and read them again; the SQL states what must come back."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.grid import AXES, GridSpec
from .operators import bins, particles
from .plans.staging import shared_root
from .queries import _BLOCKS, _CLOUD, _CLOUD_GRID, _EVENT_BINS, _LINE, CLOUD, NX, NY, NZ, cloud, line_image
from .registry import query
from .sources import generators, readers, sinks, vtk_files

#: The line grid in five blocks.
FIVE = GridSpec((NX, NY, NZ), box=((0, NX), (0, NY), (0, NZ)), blocks=(5, 1, 1))


def _folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/staged-{uuid.uuid4().hex}/{name}"


def _text(lines: DataFrame, path: str, order: str, **options) -> str:
    """(order, value) as one text file; returns the file's folder."""
    writer = lines.repartition(1).sortWithinPartitions(order).select("value").write
    writer.options(**options).text(path)
    return path


# -- LAMMPS dumps
_ATOM = f"SELECT pid AS id, CAST(pid % 7 AS INT) AS mol, type, mass, (pid % 3 - 1) * 0.5::DOUBLE AS charge, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({_CLOUD})"


def _dump(spark, sf_dir, **options) -> str:
    """The cloud as a dump, with a line too short to be an atom and a second frame behind it."""
    rows = cloud(spark, sf_dir).withColumns({"mol": F.col("pid") % 7, "charge": (F.col("pid") % 3 - 1) * 0.5})
    n = rows.count()
    head = ["ITEM: TIMESTEP", "1500", "ITEM: NUMBER OF ATOMS", str(n), "ITEM: BOX BOUNDS pp pp pp", "-1 1", "-1.5 1.25", "-2 2", "ITEM: ATOMS id mol type mass q x y z"]
    more = [*enumerate(head, -100), (-50, "too short"), *enumerate(["ITEM: TIMESTEP", "1600", "ITEM: ATOMS id mol type mass q x y z", "1 1 1 1 1 1 1 1"], 10**15)]
    atoms = rows.select("pid", F.format_string("%d %d %d %.3f %.2f %.6f %.6f %.6f 0 0", "pid", "mol", "type", "mass", "charge", *AXES).alias("value"))
    return _text(spark.createDataFrame(more, "pid bigint, value string").unionByName(atoms), _folder(spark, "dump"), "pid", **options)


@query(f"SELECT gz, 1500.0::DOUBLE AS timestep, a.* FROM ({_ATOM}) a, (VALUES (false), (true)) t(gz)")
def lammps_atoms(spark, sf_dir):
    """A plain and a gzipped dump."""
    parts = [readers.read_lammps(spark, _dump(spark, sf_dir, compression=c)).select(F.lit(c == "gzip").alias("gz"), "timestep", "id", "mol", "type", "mass", "charge", *AXES) for c in ("none", "gzip")]
    return parts[0].unionByName(parts[1])


@query(f"SELECT id, CAST(type * 10 + 2 * charge + 1 AS INT) AS type, charge FROM ({_ATOM})")
def lammps_mapped_types(spark, sf_dir):
    """New types by type and charge."""
    types = [r["type"] for r in cloud(spark, sf_dir).select("type").distinct().collect()]
    mapped = {(t, q): int(10 * t + 2 * q + 1) for t in types for q in (-0.5, 0.0, 0.5)}
    return readers.read_lammps(spark, _dump(spark, sf_dir), mapped).select("id", "type", "charge")


@query("SELECT * FROM (VALUES (0, -1.0::DOUBLE, 1.0::DOUBLE), (1, -1.5, 1.25), (2, -2.0, 2.0)) t(axis, lo, hi)")
def lammps_boxes(spark, sf_dir):
    return readers.lammps_box(spark, _dump(spark, sf_dir)).select(F.col("axis").cast("int").alias("axis"), "lo", "hi")


@query(f"SELECT x, y, z, CASE WHEN EXISTS (SELECT 1 FROM ({_ATOM}) p WHERE (g.cx - p.x) * (g.cx - p.x) + (g.cy - p.y) * (g.cy - p.y) + (g.cz - p.z) * (g.cz - p.z) <= ((p.type + 1) / 32.0::DOUBLE) * ((p.type + 1) / 32.0::DOUBLE)) THEN 0 ELSE 1 END AS v FROM ({_CLOUD_GRID}) g")
def atom_file_image(spark, sf_dir):
    """The dump, voxelized with radii by type."""
    radii = {r["type"]: (r["type"] + 1) / 32 for r in cloud(spark, sf_dir).select("type").distinct().collect()}
    return generators.atom_file_image(spark, _dump(spark, sf_dir), radii, CLOUD).select(*AXES, "v")


# -- atom maps, curves, elements, checks
_NATIONS = "SELECT CAST(n_nationkey AS INT) AS id, 'E' || CAST(n_regionkey AS VARCHAR) AS element, replace(n_name, ' ', '_') AS name FROM nation"
_POINTS = f"SELECT id AS atom_id, name, CAST(i AS BIGINT) AS idx, round((i + 1) * 0.05::DOUBLE, 6) AS r, CAST((id * 7 + i * 3) % 11 AS DOUBLE) AS value FROM ({_NATIONS}), range(40) t(i)"


def _curves(spark, sf_dir) -> str:
    """A folder with an atom map of the nations and a curve of 40 points for each."""
    folder = _folder(spark, "curves")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("id"), F.concat(F.lit("E"), F.col("n_regionkey").cast("string")).alias("element"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("name")).collect()
    put = lambda name, text: sinks._put(spark, f"{folder}/{name}", text.encode())
    put("atom_map.txt", "".join(f"{r['id']} {r['element']} {r['name']}\n" for r in rows))
    for r in rows:
        put(f"{r['name']}.rdf", "".join(f"{(i + 1) * 0.05:.6e}\t{(r['id'] * 7 + i * 3) % 11:.3e}\n" for i in range(40)))
    return folder


@query(_NATIONS)
def atom_map_file(spark, sf_dir):
    return readers.read_atom_map(spark, f"{_curves(spark, sf_dir)}/atom_map.txt")


@query(f"SELECT atom_id, name, idx, r, value AS g FROM ({_POINTS})")
def curve_folder(spark, sf_dir):
    return readers.read_rdf(spark, _curves(spark, sf_dir)).select("atom_id", "name", F.col("idx").cast("long").alias("idx"), "r", "g")


@query(f"""SELECT atom_id, idx, r, round(value / (4 / 3.0::DOUBLE * pi() * ((lo + (idx + 1) * w) ** 3 - (lo + idx * w) ** 3) * total) * (4 / 3.0::DOUBLE * pi()) * hi ** 3, 6) AS g
FROM (SELECT *, min(r) OVER p AS lo, max(r) OVER p AS hi, (max(r) OVER p - min(r) OVER p) / 40 AS w, sum(value) OVER p AS total FROM ({_POINTS}) WINDOW p AS (PARTITION BY atom_id))""")
def binned_curve_folder(spark, sf_dir):
    """Counts by distance, normalised to g(r)."""
    return readers.read_binned_distances(spark, _curves(spark, sf_dir)).select("atom_id", F.col("idx").cast("long").alias("idx"), "r", F.round("g", 6).alias("g"))


@query("SELECT * FROM (VALUES ('name', 'H', 1.2855::DOUBLE), ('name', 'Cl', 1.758), ('number', '6', 1.7155), ('number', '8', 1.559), ('file', 'N', 1.5), ('file', 'H', 1.25)) t(by_, asked, radius)")
def uff_radii(spark, sf_dir):
    """Radii by name, by atomic number and from a file; unknown ones and bad lines are left out."""
    path = _folder(spark, "uff")
    sinks._put(spark, path, b"Z name diameter\n1 H 2.5\nshort line\n7 N 3.0\n8 O x\n")
    parts = [
        particles.uff_radius(spark, names=["H", "Cl", "Xx"]).select(F.lit("name").alias("by_"), F.col("name").alias("asked"), "radius"),
        particles.uff_radius(spark, numbers=[6, 8, 99]).select(F.lit("number").alias("by_"), F.col("z").cast("string").alias("asked"), "radius"),
        particles.uff_radius(spark, names=["N", "H", "O"], path=path).select(F.lit("file").alias("by_"), F.col("name").alias("asked"), "radius"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('file', true), ('no file', false), ('folder', true), ('file as folder', false), ('count', true), ('wrong count', false)) t(what, fine)")
def path_checks(spark, sf_dir):
    folder = _folder(spark, "checks")
    sinks._put(spark, f"{folder}/a", b"x")

    def fine(check, *args) -> bool:
        try:
            check(*args)
            return True
        except (FileNotFoundError, ValueError):
            return False

    rows = [
        ("file", fine(readers.require_path, spark, f"{folder}/a")), ("no file", fine(readers.require_path, spark, f"{folder}/b")), ("folder", fine(readers.require_path, spark, folder, True)),
        ("file as folder", fine(readers.require_path, spark, f"{folder}/a", True)), ("count", fine(readers.require_count, 3, 3)), ("wrong count", fine(readers.require_count, 2, 3)),
    ]
    return spark.createDataFrame(rows, "what string, fine boolean")


# -- images
@query(f"{_LINE} SELECT CAST(x // 10 AS INT) AS piece, x, y, z, v AS img, x + v * 0.5::DOUBLE AS more FROM img")
def saved_image(spark, sf_dir):
    """Image pieces with two arrays, one piece a block."""
    path = _folder(spark, "image")
    sinks.save_image(line_image(spark, sf_dir).withColumn("m", F.col("x") + F.col("v") * 0.5), FIVE, path, {"more": "m"})
    rows = vtk_files.read_image(spark, f"{path}_proc/*.vti", {"img": "int", "more": "double"})
    return rows.select(F.regexp_extract("file", r"piece-(\d+)", 1).cast("int").alias("piece"), *AXES, "img", "more")


@query(f"SELECT 'Piece' AS tag, 'image_proc/piece-00000' || b || '.vti' AS name, concat_ws(' ', b * 10, b * 10 + 10, 0, {NY}, 0, {NZ}) AS detail, 'PImageData' AS kind FROM range(5) t(b) UNION ALL SELECT 'PDataArray', 'img', 'Int32', 'PImageData'")
def saved_image_index(spark, sf_dir):
    path = _folder(spark, "image")
    sinks.save_image(line_image(spark, sf_dir), FIVE, path)
    return vtk_files.read_index(spark, f"{path}.pvti")


@query(f"{_LINE} SELECT CAST(b AS INT) AS block, CAST(l AS INT) AS lx, y AS ly, z AS lz, CAST(b * 25 + l - 1 AS INT) AS x, v FROM img, (VALUES (0), (1)) t(b), range(27) r(l) WHERE img.x = (b * 25 + l - 1 + {NX}) % {NX}")
def saved_extended_image(spark, sf_dir):
    """Image pieces that keep their halo, which reaches beyond the periodic faces."""
    path = _folder(spark, "wide")
    sinks.save_extended_image(line_image(spark, sf_dir), _BLOCKS, path, (1, 1, 1))
    rows = vtk_files.read_image(spark, f"{path}_proc/*.vti", {"img": "int"})
    return rows.select(F.regexp_extract("file", r"piece-(\d+)", 1).cast("int").alias("block"), "lx", "ly", "lz", "x", F.col("img").alias("v"))


@query(f"{_LINE} SELECT CAST(x // 10 AS INT) AS block, x, y, z, v FROM img")
def vtk_pieces(spark, sf_dir):
    """The line image as raw VTK pieces in memory, one a block, parsed again."""
    blocked = line_image(spark, sf_dir).select(FIVE.block_of(0).alias("block"), *AXES, "v")

    def make(rows):
        import pandas as pd

        out = np.zeros((10, NY, NZ), np.int32)
        first = int(rows["x"].min())
        out[rows["x"].to_numpy() - first, rows["y"].to_numpy(), rows["z"].to_numpy()] = rows["v"].to_numpy()
        root, ((_, _, _, values),) = vtk_files.parse(sinks.image_piece({"img": out}, (first, 0, 0)))
        x0 = int(root.find("ImageData/Piece").get("Extent").split()[0])
        x, y, z = (i.ravel(order="F") for i in np.indices(out.shape))
        return pd.DataFrame({"block": rows["block"].iloc[0], "x": x + x0, "y": y, "z": z, "v": values})

    return blocked.groupBy("block").applyInPandas(make, "block int, x int, y int, z int, v int")


# -- particles and bins
@query(f"SELECT x, y, z, r AS radius, CAST(x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2 AS INT) AS own, type AS label FROM ({_CLOUD})")
def saved_particles(spark, sf_dir):
    """Point pieces with radius, own and label."""
    path = _folder(spark, "points")
    sinks.save_particles(particles.with_own(cloud(spark, sf_dir), ((-0.2, 0.2),) * 3), path, 4)
    return vtk_files.read_points(spark, f"{path}_proc/*.vtu", {"radius": "double", "own": "int", "label": "int"})


@query("SELECT 'PDataArray' AS tag, name, detail, 'PUnstructuredGrid' AS kind FROM (VALUES ('points', 'Float64'), ('radius', 'Float64'), ('own', 'Int32'), ('label', 'Int32')) t(name, detail) UNION ALL SELECT 'Piece', 'points_proc/piece-00000' || b || '.vtu', NULL, 'PUnstructuredGrid' FROM range(4) t(b)")
def saved_particles_index(spark, sf_dir):
    path = _folder(spark, "points")
    sinks.save_particles(particles.with_own(cloud(spark, sf_dir), ((-0.2, 0.2),) * 3), path, 4)
    return vtk_files.read_index(spark, f"{path}.pvtu")


@query("SELECT 0 AS label, 12.5::DOUBLE + b * 25.0::DOUBLE AS center, CAST(count(value) AS DOUBLE) AS value FROM range(20) t(b) LEFT JOIN events ON CAST(floor(value / 25.0::DOUBLE) AS INT) = b GROUP BY b")
def saved_bins(spark, sf_dir):
    path = _folder(spark, "bins")
    bins.save(bins.count_locations(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("value", "x"), "x", _EVENT_BINS), path)
    return spark.read.csv(path, sep="\t", header=True, schema="center double, value double").select(F.lit(0).alias("label"), "center", "value")


# -- meshes
def _meshes(spark, sf_dir) -> list[tuple[str, bytes | str]]:
    """Every kind of piece, made of the keys 0, 1, ... of the regions."""
    k = np.array(sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()), float)
    points = np.column_stack([k, k * k, -k])
    x, y, z = np.meshgrid(k, 2 * k, [0.0, 1.0], indexing="ij")
    number = np.arange(len(k), dtype=np.int32)
    return [
        ("rectilinear", sinks.grid_piece(k, 2 * k, np.array([0.0, 1.0]), {"c": np.arange((len(k) - 1) ** 2, dtype=np.int64)}, {"p": x})),
        ("structured", sinks.grid_piece(x, y, z, {"c": np.ones((len(k) - 1) ** 2, np.float32)}, {"p": y})),
        ("points", sinks.points_piece(points, {"n": number}, comment="five -- points")),
        ("points in text", sinks.points_piece(points, {"n": number}, text=True)),
        ("lines", sinks.lines_piece(points[:4], {"n": number[:4]}, {"c": number[:2]})),
        ("polylines", sinks.polylines_piece(points, [2, len(k) - 2], {"n": number}, {"c": number[:2]})),
        ("triangles", sinks.triangulated_piece(points, [(0, 1, 2), (1, 2, 3)], {"n": number}, {"c": number[:2]})),
        ("unstructured", sinks.unstructured_piece(points, [0, 1, 2, 3, 4], [1, 5], [sinks.VTK_CELLS["vertex"], sinks.VTK_CELLS["tetra"]])),
        ("cylinder", sinks.cylinder_piece(0.0, 0.0, 0.0, 3.0, 0.5, 3, 4)),
    ]


_K = "(SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region)"
_N = "(SELECT count(*) FROM region)"


@query(f"""WITH s AS (SELECT count(*) AS n, sum(k) AS k, sum(k * k) AS k2 FROM {_K}), t AS (SELECT * FROM s, (VALUES
 ('rectilinear', 'Coordinates', 'x', 1), ('rectilinear', 'Coordinates', 'y', 2), ('rectilinear', 'Coordinates', 'z', 3), ('rectilinear', 'CellData', 'c', 4), ('rectilinear', 'PointData', 'p', 5),
 ('structured', 'Points', 'points', 6), ('structured', 'CellData', 'c', 7), ('structured', 'PointData', 'p', 8), ('points', 'Points', 'points', 9), ('points', 'PointData', 'n', 1), ('points', 'Cells', 'connectivity', 1), ('points', 'Cells', 'offsets', 10), ('points', 'Cells', 'types', 11),
 ('points in text', 'Points', 'points', 9), ('points in text', 'PointData', 'n', 1), ('points in text', 'Cells', 'connectivity', 1), ('points in text', 'Cells', 'offsets', 10), ('points in text', 'Cells', 'types', 11),
 ('lines', 'Points', 'points', 12), ('lines', 'PointData', 'n', 13), ('lines', 'CellData', 'c', 14), ('lines', 'Cells', 'connectivity', 13), ('lines', 'Cells', 'offsets', 15), ('lines', 'Cells', 'types', 15),
 ('polylines', 'Points', 'points', 9), ('polylines', 'PointData', 'n', 1), ('polylines', 'CellData', 'c', 14), ('polylines', 'Cells', 'connectivity', 1), ('polylines', 'Cells', 'offsets', 16), ('polylines', 'Cells', 'types', 17),
 ('triangles', 'Points', 'points', 9), ('triangles', 'PointData', 'n', 1), ('triangles', 'CellData', 'c', 14), ('triangles', 'Cells', 'connectivity', 18), ('triangles', 'Cells', 'offsets', 19), ('triangles', 'Cells', 'types', 20),
 ('unstructured', 'Points', 'points', 9), ('unstructured', 'Cells', 'connectivity', 1), ('unstructured', 'Cells', 'offsets', 21), ('unstructured', 'Cells', 'types', 22),
 ('cylinder', 'Points', 'points', 23), ('cylinder', 'Cells', 'connectivity', 24), ('cylinder', 'Cells', 'offsets', 25), ('cylinder', 'Cells', 'types', 26)) v(piece, section, name, f))
SELECT piece, section, name, CASE WHEN name = 'points' THEN 3 ELSE 1 END AS components,
 CAST(CASE f WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN 2 WHEN 4 THEN (n - 1) ** 2 WHEN 5 THEN 2 * n * n WHEN 6 THEN 6 * n * n WHEN 7 THEN (n - 1) ** 2 WHEN 8 THEN 2 * n * n WHEN 9 THEN 3 * n WHEN 10 THEN n WHEN 11 THEN n WHEN 12 THEN 12 WHEN 13 THEN 4 WHEN 14 THEN 2 WHEN 15 THEN 2 WHEN 16 THEN 2 WHEN 17 THEN 2 WHEN 18 THEN 6 WHEN 19 THEN 2 WHEN 20 THEN 2 WHEN 21 THEN 2 WHEN 22 THEN 2 WHEN 23 THEN 48 WHEN 24 THEN 48 WHEN 25 THEN 12 ELSE 12 END AS BIGINT) AS n,
 CAST(CASE f WHEN 1 THEN k WHEN 2 THEN 2 * k WHEN 3 THEN 1 WHEN 4 THEN (n - 1) ** 2 * ((n - 1) ** 2 - 1) / 2 WHEN 5 THEN 2 * n * k WHEN 6 THEN 2 * n * k + 4 * n * k + n * n WHEN 7 THEN (n - 1) ** 2 WHEN 8 THEN 4 * n * k WHEN 9 THEN k2 WHEN 10 THEN k + n WHEN 11 THEN n WHEN 12 THEN 14 WHEN 13 THEN 6 WHEN 14 THEN 1 WHEN 15 THEN 6 WHEN 16 THEN 2 + n WHEN 17 THEN 8 WHEN 18 THEN 9 WHEN 19 THEN 9 WHEN 20 THEN 10 WHEN 21 THEN 6 WHEN 22 THEN 11 WHEN 23 THEN 24 WHEN 24 THEN 12 * 4 * 15 / 6 * 3 WHEN 25 THEN 4 * 78 ELSE 12 * 9 END AS DOUBLE) AS total FROM t""")
def vtk_meshes(spark, sf_dir):
    """Length and sum of every array of every kind of piece, parsed again."""
    rows = []
    for piece, content in _meshes(spark, sf_dir):
        for section, name, components, values in vtk_files.parse(content if isinstance(content, bytes) else content.encode())[1]:
            rows.append((piece, section, name, components, len(values), round(float(values.sum(dtype=float)), 9) + 0.0))
    return spark.createDataFrame(rows, "piece string, section string, name string, components int, n bigint, total double")


@query("""SELECT 'DataSet' AS tag, 'frame-' || CAST(r_regionkey AS VARCHAR) || '.vtu' AS name, CAST(CAST(r_regionkey * 0.5 AS DOUBLE) AS VARCHAR) AS detail, 'Collection' AS kind FROM region
UNION ALL SELECT 'Piece', 'a.vtr', '0 2 0 2 0 1', 'PRectilinearGrid' UNION ALL SELECT 'PDataArray', n, 'Float64', 'PRectilinearGrid' FROM (VALUES ('x'), ('y'), ('z')) v(n) UNION ALL SELECT 'PDataArray', 'c', 'Int64', 'PRectilinearGrid'
UNION ALL SELECT 'Piece', 'b.vts', '0 2 0 2 0 1', 'PStructuredGrid' UNION ALL SELECT 'PDataArray', 'points', 'Float64', 'PStructuredGrid' UNION ALL SELECT 'PDataArray', 'p', 'Float32', 'PStructuredGrid'""")
def vtk_indices(spark, sf_dir):
    """A collection of frames, and the indices of a rectilinear and a structured grid."""
    folder = _folder(spark, "indices")
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect()]
    sinks.save_collection(spark, f"{folder}/frames", [(f"frame-{k}.vtu", k * 0.5) for k in keys])
    extent = [0, 2, 0, 2, 0, 1]
    sinks._put(spark, f"{folder}/a.pvtr", sinks.parallel_index("RectilinearGrid", [("a.vtr", extent)], extent, cells={"c": "int64"}))
    sinks._put(spark, f"{folder}/b.pvts", sinks.parallel_index("StructuredGrid", [("b.vts", extent)], extent, points={"p": "float32"}))
    found = [vtk_files.read_index(spark, f"{folder}/{n}") for n in ("frames.pvd", "a.pvtr", "b.pvts")]
    return found[0].unionByName(found[1]).unionByName(found[2])
