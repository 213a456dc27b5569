"""Particles, bins, curves, grids, readers, writers, graphs and ranks."""

import base64
import gzip
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelith.functions import grid as grids
from porelith.functions.grid import Boundary, GridSpec
from porelith.operators import bins, particles, rdf, voxels
from porelith.plans import joins, ranks
from porelith.plans.graph import connected_components
from porelith.plans.staging import shared_root, staged
from porelith.sources import generators, readers, sinks
from porelith.streaming import bins as stream_bins

PERIODIC = ((Boundary.PERIODIC,) * 2,) * 3


# -- grids
def test_grid_model():
    g = GridSpec((10, 20, 30), box=((0, 1), (0, 4), (-3, 3)))
    assert g.lengths == (1, 4, 6) and g.volume == 24 and g.resolution == pytest.approx((0.1, 0.2, 0.2))
    assert g.coordinates(0)[:2] == pytest.approx([0.05, 0.15])
    assert not g.any_periodic and GridSpec((4, 4, 4), boundary=PERIODIC).any_periodic
    for bad in ({"box": ((1, 0), (0, 1), (0, 1))}, {"blocks": (9, 1, 1)}, {"boundary": ((Boundary.PERIODIC, Boundary.END),) * 3}):
        with pytest.raises(ValueError):
            GridSpec((4, 4, 4), **bad)
    with pytest.raises(ValueError):
        GridSpec((1, 4, 4))


def test_features():
    assert len(grids.FEATURES) == 26 and len(grids.FACES) == 6 and len(grids.EDGES) == 12 and len(grids.CORNERS) == 8
    assert grids.feature_id((0, 0, 0)) == 26 and grids.feature_id((-1, -1, -1)) == 0
    assert len({grids.feature_id(d) for d in grids.FEATURES}) == 26
    assert grids.boundary_order([Boundary.PERIODIC, Boundary.END, Boundary.WALL]) == Boundary.END
    assert grids.faces_of((1, 0, -1)) == [(1, 0, 0), (0, 0, -1)]
    assert grids.edges_of((1, 1, -1)) == [(1, 1, 0), (1, 0, -1), (0, 1, -1)]
    assert grids.argument_order((0, 1, 0)) == (1, 0, 2) and grids.is_forward((0, -1, 0)) and grids.face_index((0, 0, 1)) == 5


def test_blocks():
    g = GridSpec((10, 10, 11), boundary=((Boundary.END,) * 2, (Boundary.WALL,) * 2, (Boundary.PERIODIC,) * 2), blocks=(2, 2, 2), inlet=((True, False), (True, False), (False,) * 2), reservoir=3)
    assert g.block_index(5) == (1, 0, 1) and g.block_voxels(2, 1) == 6
    b = g.block(0, (1, 1, 1))
    assert b.own_shape == (5, 5, 5) and b.padding == ((0, 1), (1, 1), (1, 1))
    assert b.reservoir_padding == ((3, 0), (0, 0), (0, 0))  # the wall's inlet flag does not count
    assert b.start == (-3, -1, -1) and b.shape == (9, 7, 7) and b.own == ((3, 8), (1, 6), (1, 6))
    ranks_ = g.block_map()
    assert ranks_[(-1, 0, 0)] == -1 and ranks_[(0, -1, 0)] == -2 and ranks_[(0, 0, -1)] == 1 and ranks_[(-1, -1, 0)] == -1
    assert b.boundary[0] == (Boundary.END, Boundary.INTERNAL)
    f = b.feature((0, 0, -1))
    assert f["periodic"] and f["shift"] == (0, 0, 1) and f["own"][2] == (1, 2) and f["halo"][2] == (0, 1)
    assert b.feature((-1, 0, -1))["boundary"] == Boundary.END
    assert b.member((0, 0, -1), "rank") == 1
    with pytest.raises(KeyError):
        b.member((2, 0, 0), "rank")
    with pytest.raises(AttributeError):
        b.member((0, 0, 1), "colour")
    assert b.extended((2, 2, 2)) == ((0, 2), (0, 2), (2, 2))
    cells = b.cells((2, 2, 2))
    assert len(cells) == 8 and sum(math.prod(e - s for s, e in c["voxels"]) for c in cells) == math.prod(b.shape)


def test_coordinates_to_voxels(spark):
    g = GridSpec((10, 10, 10))
    at = spark.createDataFrame([(0.0,), (0.55,), (0.999,)], "c double")
    assert [r[0] for r in at.select(g.index_of(0, F.col("c"))).collect()] == [0, 5, 9]
    for bad in (-0.1, 1.0):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad,)], "c double").select(g.index_of(0, F.col("c"))).collect()


def test_reservoirs_and_walls(spark):
    g = GridSpec((4, 4, 4), inlet=((True, False), (False,) * 2, (False,) * 2), reservoir=2)
    img = g.voxels(spark).withColumn("v", F.lit(1))
    assert img.count() == 96 and voxels.own(img, g).count() == 64
    assert voxels.set_reservoir(img, g, 9).where("v = 9").count() == 32
    w = GridSpec((4, 4, 4), boundary=((Boundary.WALL,) * 2, (Boundary.END,) * 2, (Boundary.END,) * 2))
    assert voxels.set_walls(w.voxels(spark).withColumn("v", F.lit(1)), w).where("v = 0").count() == 32
    padded = voxels.pad_constant(w.voxels(spark).withColumn("v", F.lit(1)), ((1, 1), (0, 0), (0, 2)), 5, w)
    assert padded.count() == 6 * 4 * 6 and padded.where("v = 5").count() == 144 - 64


def test_windows_wrap(spark):
    g = GridSpec((4, 4, 4))
    img = generators.linear(spark, g, 0)
    rows = voxels.window(img, (3, 0, 0), (3, 2, 2), g)
    assert rows.count() == 12 and {(r["lx"], r["v"]) for r in rows.collect()} == {(0, 3.0), (1, 0.0), (2, 1.0)}
    assert voxels.window(img, (-1, 0, 0), (6, 1, 1), g).count() == 6


def test_reductions_and_labels(spark):
    df = spark.createDataFrame([(3, 0), (5, 1), (5, 2), (0, 3)], "v int, i int")
    assert voxels.reduced(df, "prod").first()[0] == 0 and voxels.reduced(df, "bxor").first()[0] == 3
    assert tuple(voxels.reduced(df, "maxloc", at="i").first()[0]) == (5, 1)
    assert tuple(voxels.reduced(df, "minloc", at="i").first()[0]) == (0, 3)
    assert voxels.reduced(df, "lxor").first()[0] is True
    with pytest.raises(ValueError):
        voxels.reduced(df, "median")
    pairs = voxels.matched_pairs(spark.createDataFrame([(1, 4), (2, 0), (3, 4)], "vid long, label long"), spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "vid long, label long"))
    assert [tuple(r) for r in pairs.collect()] == [(4, 7)]
    assert voxels.adjacency(pairs).first()["neighbours"] == [7]
    with pytest.raises(ValueError):
        voxels.axis_means(df, GridSpec((2, 2, 2)), (1, 1))


# -- particles
def test_periodic_spheres(spark):
    g = GridSpec((10, 10, 10), boundary=PERIODIC)
    rows = particles.spheres(spark, [(0.5, 0.5, 0.5, 0.2), (0.05, 0.5, 0.5, 0.1), (0.05, 0.95, 0.05, 0.1)], masses=[1, 2, 3])
    got = particles.add_periodic(rows, g)
    assert {r["pid"]: r["n"] for r in got.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 1, 1: 2, 2: 8}
    assert {r["mass"] for r in got.where("pid = 2").collect()} == {3.0}


def test_atoms(spark):
    got = particles.atoms(spark, [(0, 0, 0), (1, 1, 1)], {1: 0.5, 15: 0.25}, [1, 15], {1: 2.0, 15: 3.0})
    assert sorted((r["r"], r["mass"]) for r in got.collect()) == [(0.25, 3.0), (0.5, 2.0)]
    with pytest.raises(Exception, match="no value"):
        particles.atoms(spark, [(0, 0, 0)], {1: 0.5}, [2]).collect()
    with pytest.raises(ValueError):
        particles.uff_radius(spark)
    assert particles.uff_radius(spark, names=["H", "Q"]).first()["radius"] == pytest.approx(2.571 / 2)
    assert particles.uff_radius(spark, numbers=[8]).first()["radius"] == pytest.approx(3.118 / 2)


def test_neighbours_are_strictly_nearer(spark):
    rows = particles.spheres(spark, [(0.1, 0, 0, 1), (0.2, 0, 0, 1), (-0.3, 0, 0, 1)])
    point = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "qid long, x double, y double, z double")
    assert [r["pid"] for r in particles.neighbours(point, rows, 0.2).collect()] == [0]
    r = random.Random(1)
    many = particles.spheres(spark, [[r.uniform(-1, 1) for _ in range(3)] + [0.1] for _ in range(120)])
    probe = many.select(F.col("pid").alias("qid"), "x", "y", "z")
    got = {(x["qid"], x["pid"]) for x in particles.neighbours(probe, many, 0.4).collect()}
    at = {x["pid"]: np.array([x["x"], x["y"], x["z"]]) for x in many.collect()}
    assert got == {(a, b) for a in at for b in at if np.linalg.norm(at[a] - at[b]) < 0.4}


# -- bins and curves
def test_bins(spark):
    b = bins.BinSpec(0.0, 10.0, 5)
    assert b.width == 2 and b.centers == [1, 3, 5, 7, 9]
    assert sum(b.volumes(radial=True)) == pytest.approx(bins.sphere_volume(10)) and b.volumes(3.0) == [6.0] * 5
    rows = spark.createDataFrame([(0.0, 3.0), (1.9, 12.5), (10.0, 7.0), (-1.0, 7.0), (9.99, 256.0)], "x double, mass double")
    assert [r["value"] for r in bins.count_locations(rows, "x", b).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    masses = bins.sum_masses(rows, "x", b)
    assert masses.agg(F.sum("value")).first()[0] == 3 + 12.5 + 256
    assert bins.accumulated(masses, masses).agg(F.sum("value")).first()[0] == 543
    zero = bins.count_locations(rows.limit(0), "x", b)
    assert {r["g"] for r in bins.radial_distribution(zero, b).collect()} == {0.0}


def test_bins_saved(spark, tmp_path):
    b = bins.BinSpec(0.0, 4.0, 4, label=2)
    bins.save(bins.count_locations(spark.createDataFrame([(1.5,)], "x double"), "x", b), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, inferSchema=True).orderBy("center").collect()
    assert [(r["center"], r["value"], r["label"]) for r in got] == [(0.5, 0.0, 2), (1.5, 1.0, 2), (2.5, 0.0, 2), (3.5, 0.0, 2)]


def test_distance_bins(spark):
    probe = particles.spheres(spark, [(0, 0, 0, 1)])
    atoms = particles.atoms(spark, [(0.9, 0, 0), (0, 1.7, 0), (0, 0, 2.5)], {1: 2.0}, [1, 1, 1])
    got = rdf.bin_distances(probe, atoms, [bins.BinSpec(0, 2, 10, label=1)]).orderBy("bin").collect()
    assert [r["value"] for r in got] == [0, 0, 0, 0, 1, 0, 0, 0, 1, 0]


def test_curves(spark):
    r = np.linspace(0, 5, 26)
    g = np.concatenate([np.zeros(5), np.linspace(0, 2, 10), np.linspace(2, 1, 11)])
    curves = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(r, g, strict=True))], "atom_id int, idx int, r double, g double")
    asked = [-1.0, 0.33, 2.71, 4.99, 9.0]
    got = rdf.interpolate(spark.createDataFrame([(1, x) for x in asked], "atom_id int, r double"), curves).collect()
    np.testing.assert_allclose([x["g"] for x in sorted(got, key=lambda x: x["r"])], np.interp(asked, r, g))
    pmf = {x["idx"]: x["pmf"] for x in rdf.with_potential(curves).collect()}
    assert pmf[0] == math.inf and pmf[14] == pytest.approx(-rdf.K_B * 300 * math.log(2))
    low = rdf.bounds(curves, 0.5).first()
    assert (low["lower"], low["upper"]) == (0, int(np.argmax(g > 1)))
    assert rdf.bounded(curves, eps=0.5).count() == low["upper"] - low["lower"]
    assert rdf.max_radius_index(curves, 1.5).first()["idx"] == int(np.argmax(g > 1.5))
    for bad in (rdf.max_radius_index(curves, 99), rdf.min_radius_index(curves, -1)):
        with pytest.raises(Exception, match="no such g"):
            bad.collect()
    up = curves.where("idx between 5 and 14 and g > 0")
    at = rdf.with_potential(up).select("atom_id", "pmf")
    back = {round(x["r"], 6) for x in rdf.radius_from_potential(at, up).collect()}
    assert back == {round(float(x["r"]), 6) for x in up.collect()}


# -- readers
LAMMPS = "ITEM: TIMESTEP\n7\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n-1 1\n-1 1\n-2 2\nITEM: ATOMS id mol type mass q x y z\n1 1 1 1.5 0.1  0.0 0.0 0.0\n2 1 3 2.5 -0.1 0.5 0.5 0.5\n3 1 3 2.5 -0.1 0.9 0.9 0.9\n"


def test_lammps(spark, tmp_path):
    (tmp_path / "a.lammps").write_text(LAMMPS)
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write(LAMMPS)
    for name in ("a.lammps", "b.gz"):
        path = str(tmp_path / name)
        rows = readers.read_lammps(spark, path).orderBy("id").collect()
        assert [(r["id"], r["type"], r["mass"], r["charge"], r["x"], r["timestep"]) for r in rows] == [(1, 1, 1.5, 0.1, 0.0, 7.0), (2, 3, 2.5, -0.1, 0.5, 7.0)]
        assert [(r["lo"], r["hi"]) for r in readers.lammps_box(spark, path).orderBy("axis").collect()] == [(-1, 1), (-1, 1), (-2, 2)]
        spark.dataSource.register(readers.LammpsSource)
        assert spark.read.format("lammps_dump").load(path).count() == 2
    path = str(tmp_path / "a.lammps")
    assert [r["type"] for r in readers.read_lammps(spark, path, {(1, 0.1): 8, (3, -0.1): 9}).orderBy("id").collect()] == [8, 9]
    with pytest.raises(Exception, match="no new type"):
        readers.read_lammps(spark, path, {(1, 0.1): 8}).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_lammps(spark, str(tmp_path / "none"))
    grid = GridSpec((10, 10, 10), box=((-1, 1),) * 3)
    img = generators.atom_file_image(spark, path, {1: 0.4, 3: 0.5}, grid)
    assert voxels.porosity(img, grid).first()["porosity"] < 1


def test_sphere_files(spark, tmp_path):
    good = tmp_path / "good"
    good.write_text("0 1\n0 2\n0 3\n0.5 0.5 0.5 0.25\n1\t1 1 0.5\n")
    rows, box = readers.read_xyzr(spark, str(good))
    assert box == ((0, 1), (0, 2), (0, 3)) and sorted(r["r"] for r in rows.collect()) == [0.25, 0.5]
    for body, what in (("0.5 0.5 0.5\n", "a sphere is"), ("a b c d\n", "not a number")):
        bad = tmp_path / f"bad{len(body)}"
        bad.write_text("0 1\n0 2\n0 3\n" + body)
        with pytest.raises(Exception, match=what):
            readers.read_xyzr(spark, str(bad))[0].collect()
    short = tmp_path / "short"
    short.write_text("0 1 2\n")
    with pytest.raises(ValueError):
        readers.read_xyzr(spark, str(short))


def test_curve_folders(spark, tmp_path):
    (tmp_path / "atom_map.txt").write_text("1 O OW\n2 H HW\n")
    for name in ("OW", "HW"):
        (tmp_path / f"{name}.rdf").write_text("".join(f"{i * 0.1:.2f}\t{i % 5:.1e}\n" for i in range(50)))
    got = readers.read_rdf(spark, str(tmp_path))
    assert got.count() == 100 and {r["atom_id"] for r in got.select("atom_id").distinct().collect()} == {1, 2}
    g = readers.read_binned_distances(spark, str(tmp_path)).where("atom_id = 1").orderBy("idx").collect()
    b = bins.BinSpec(0.0, 4.9, 50)
    counts = np.array([i % 5 for i in range(50)], float)
    np.testing.assert_allclose([r["g"] for r in g], counts / (np.array(b.volumes(radial=True)) * counts.sum()) * bins.sphere_volume(4.9), rtol=1e-9)
    with pytest.raises(FileNotFoundError):
        readers.read_rdf(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        readers.require_count(3, 4)


def test_uff_file(spark, tmp_path):
    (tmp_path / "uff").write_text("Z name diameter\n1 H 2.0\nshort\n6 C 3.0\n")
    assert {r["name"]: r["radius"] for r in particles.uff_table(spark, str(tmp_path / "uff")).collect()} == {"H": 1.0, "C": 1.5}


# -- generators
def test_random_images(spark):
    g = GridSpec((20, 20, 20))
    img = generators.random_binary(spark, g, 0.3, 1)
    assert abs(img.where("v = 0").count() / 8000 - 0.3) < 0.03
    assert img.exceptAll(generators.random_binary(spark, g, 0.3, 1)).count() == 0
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            generators.random_binary(spark, g, bad)
    with pytest.raises(ValueError):
        generators.smoothed_random_binary(spark, g, 0.5, -1)
    want = np.random.default_rng(4).choice([0, 1], size=(5, 6), p=[0.5, 0.5])
    got = generators.random_binary_numpy(spark, (5, 6), 0.5, 4)
    np.testing.assert_array_equal(generators.to_array(got, (5, 6)), want)


def test_smoothing_is_separable_gaussian(spark):
    values = np.random.default_rng(1).random((6, 5, 7))
    g = GridSpec((6, 5, 7))
    got = generators.to_array(generators.smooth(generators.from_array(spark, values), g, 0.8), values.shape)
    w = generators.gaussian_kernel(0.8)
    want = values
    for a in range(3):
        r = len(w) // 2
        pad = [(r, r) if b == a else (0, 0) for b in range(3)]
        wide = np.pad(want, pad, mode="symmetric")
        want = sum(c * np.take(wide, range(k, k + values.shape[a]), axis=a) for k, c in enumerate(w))
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize(("kind", "n", "radius"), [(generators.SimpleCubic, 125, 0.125), (generators.BodyCenteredCubic, 250, 0.25 * math.sqrt(3) / 4), (generators.FaceCenteredCubic, 500, 0.25 * math.sqrt(2) / 4)])
def test_lattices(spark, kind, n, radius):
    rows = kind(0.25).spheres(spark, GridSpec((4, 4, 4)))
    assert rows.count() == n and rows.first()["r"] == pytest.approx(radius)
    assert generators.Lattice(1.0).basis == () and kind.coordination in (6, 8, 12)


# -- writers
def parse(content: bytes):
    if b'"base64"' in content:
        head, _, body = content.partition(b'<AppendedData encoding="base64">\n_')
        starts = [int(x) for x in re.findall(rb'offset="(\d+)"', head)] + [body.index(b"\n</AppendedData>")]
        arrays = [base64.b64decode(body[a:b]) for a, b in itertools.pairwise(starts)]
        assert all(struct.unpack("<Q", x[:8])[0] == len(x) - 8 for x in arrays)
        return head.decode(), [x[8:] for x in arrays]
    head, _, body = content.partition(b'<AppendedData encoding="raw">\n_')
    sizes, at = [], 0
    while body[at : at + 1] != b"\n" or not body[at:].startswith(b"\n</AppendedData>"):
        (n,) = struct.unpack("<Q", body[at : at + 8])
        sizes.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return head.decode(), sizes


def test_vtk_pieces(spark, tmp_path):
    values = np.arange(24, dtype=np.int32).reshape(2, 3, 4)
    head, arrays = parse(sinks.image_piece({"img": values}, (1, 0, 0)))
    assert 'WholeExtent="1 3 0 3 0 4"' in head
    np.testing.assert_array_equal(np.frombuffer(arrays[0], np.int32), values.ravel(order="F"))
    with pytest.raises(ValueError):
        sinks.image_piece({"a": values, "b": values[0]})
    points = np.random.default_rng(0).random((6, 3))
    for content, n in ((sinks.points_piece(points, {"radius": np.ones(6)}), 5), (sinks.lines_piece(points), 4), (sinks.polylines_piece(points, [2, 4]), 4), (sinks.triangulated_piece(points, sinks.delaunay(points[:, :2])), 4), (sinks.cylinder_piece(0, 0, 0, 1, 0.5, 3), 4), (sinks.grid_piece(np.arange(3.0), np.arange(2.0), np.arange(2.0)), 3)):
        assert len(parse(content)[1]) == n
    x, y, z = np.meshgrid(np.arange(3.0), np.arange(2.0), np.arange(2.0), indexing="ij")
    assert len(parse(sinks.grid_piece(x, y, z))[1]) == 1
    assert len(sinks.delaunay(np.array([[0, 0], [1, 0], [0, 1], [1, 1.1]]))) == 2
    with pytest.raises(ValueError):
        sinks.lines_piece(points[:3])


def test_vtk_files(spark, tmp_path):
    g = GridSpec((4, 4, 4), blocks=(2, 1, 1))
    img = generators.linear(spark, g, 0).withColumn("more", F.lit(2))
    sinks.save_image(img, g, str(tmp_path / "img"), {"other": "more"})
    assert len(list((tmp_path / "img_proc").glob("*.vti"))) == 2
    index = (tmp_path / "img.pvti").read_text()
    assert index.count("<Piece") == 2 and 'WholeExtent="0 4 0 4 0 4"' in index
    head, arrays = parse(next((tmp_path / "img_proc").glob("*000001.vti")).read_bytes())
    assert 'Extent="2 4 0 4 0 4"' in head and len(arrays) == 2
    with pytest.raises(ValueError):
        sinks.save_image(img, g, str(tmp_path / "bad"), {"x": "nothing"})
    sinks.save_extended_image(img.select("x", "y", "z", "v"), GridSpec((4, 4, 4), boundary=PERIODIC, blocks=(2, 1, 1)), str(tmp_path / "wide"), (1, 1, 1))
    assert len(list((tmp_path / "wide_proc").glob("*.vti"))) == 2
    rows = particles.with_own(particles.spheres(spark, [(0.1 * k, 0, 0, 0.1) for k in range(9)]), ((0, 0.5),) * 3)
    sinks.save_particles(rows, str(tmp_path / "p"), 3)
    assert (tmp_path / "p.pvtu").exists() and list((tmp_path / "p_proc").glob("*.vtu"))


# -- plans
def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    words = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")).collect()
    assert {(x["node"], x["component"]) for x in words} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_keyed_join_paths_agree(spark, monkeypatch):
    big = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "k int, v int")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("v").alias("top"))
    want = sorted(map(tuple, joins.keyed_join(big, small, ["k"], "w", 300).select("k", "v", "w", "top").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(joins, "HOT_SHARE", 0.2)
    got = sorted(map(tuple, joins.keyed_join(big, small, ["k"], "w", 300).select("k", "v", "w", "top").collect()))
    assert got == want and len(got) == 300


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PER_BUCKET", 4)
    monkeypatch.setattr(ranks, "FAN", 5)
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("key")).withColumn("u", ranks.unit_hash(F.lit("s"), "id"))
    got = ranks.positions(df, "key", "u", ["id"]).collect()
    for key in ("true", "false"):
        rows = sorted((r["u"], r["id"], r["pos"]) for r in got if r["key"] == key)
        assert [p for _, _, p in rows] == list(range(len(rows)))


def test_staged_tables_are_whole(spark):
    df = spark.range(100).withColumn("s", F.lit(None).cast("string"))
    assert staged(df, "t").count() == 100 and staged(df.limit(0), "t").dtypes == df.dtypes
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_root(spark) == set_by_cluster if set_by_cluster else shared_root(spark).startswith("file:")


def test_streamed_bins(spark, tmp_path):
    df = spark.createDataFrame([(float(k % 10), 2.0) for k in range(50)], "x double, m double")
    df.write.parquet(str(tmp_path / "in"))
    frames = stream_bins.append_particles(spark, str(tmp_path / "in"), "x double, m double")
    stream_bins.to_memory(stream_bins.binned_stream(frames, bins.BinSpec(0, 10, 5), "x", weight="m"), "streamed").awaitTermination()
    assert {r["bin"]: r["value"] for r in spark.table("streamed").collect()} == {b: 20.0 for b in range(5)}


def test_logger(tmp_path):
    from porelith.functions import runtime

    log = runtime.setup_logger("porelith-test", str(tmp_path))
    again = runtime.setup_logger("porelith-test", str(tmp_path))
    assert log is again and len(log.handlers) == 2
    log.info("here")
    assert "driver INFO here" in (tmp_path / "porelith-test.log").read_text()


def test_streamed_windows_drop_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    schema = "ts timestamp, x double"
    for k, minutes in enumerate(([0, 5, 70], [200], [10, 210])):  # the 10 comes after the watermark has passed it
        rows = [(start + timedelta(minutes=m), 1.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frames = stream_bins.append_particles(spark, str(tmp_path / "in"), schema)
        values = stream_bins.binned_stream(frames, bins.BinSpec(0, 2, 2), "x", event_time="ts", delay="30 minutes", window="1 hour")
        out = values.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.trigger(availableNow=True).start().awaitTermination()
        assert k < 3
    got = {(r["start"].hour, r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 2.0), (1, 1.0)}


def test_rows_alike_are_numbered_and_orders_ranked(spark, monkeypatch):

    df = staged(spark.createDataFrame([("a", k) for k in range(50)] + [("b", 1), ("c", 2)], "k string, v int").repartition(6), "rows")
    got = ranks.numbered_alike(df, "k", "nth").collect()
    assert sorted(r["nth"] for r in got if r["k"] == "a") == list(range(50)) and {r["nth"] for r in got if r["k"] != "a"} == {0}
    assert {r["nth"] for r in ranks.numbered_alike(df.where("k != 'a'"), "k", "nth").collect()} == {0}
    monkeypatch.setattr(ranks, "PER_RANGE", 7)
    monkeypatch.setattr(ranks, "FAN", 3)
    got = ranks.places(df, [F.col("k").desc(), F.col("v")]).collect()
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["pos"])] == [("c", 2), ("b", 1)] + [("a", k) for k in range(50)]
    assert sorted(r["pos"] for r in got) == list(range(52))
    assert ranks.places(df.limit(0), [F.col("k")]).count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k} {'x' * (k % 40)}\n" for k in range(5000)))
    (tmp_path / "b.txt").write_text("short\n")
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("".join(f"line {k}\n" for k in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = readers._numbered(spark, str(tmp_path)).collect()
        odd = readers._numbered(spark, str(tmp_path), F.col("value").rlike("[13579] ")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5301 and all(r["line"] == int(r["value"].split()[1]) for r in got if r["value"] != "short")
    assert sorted(r["line"] for r in odd if r["file"].endswith("a.txt")) == list(range(2500))
    assert all(2 * r["line"] + 1 == int(r["value"].split()[1]) for r in odd if r["file"].endswith("a.txt"))
