import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelith.functions.grid import Boundary, GridSpec, voxel_id
from porelith.operators import components, distance, minkowski, morphology, particles, porosimetry, voxels
from porelith.sources import generators as g

PERIODIC = ((Boundary.PERIODIC,) * 2,) * 3


def brute_edt2(solid, h, periodic):
    at = np.argwhere(solid)
    out = np.full(solid.shape, np.inf)
    for i in np.ndindex(solid.shape):
        d = np.abs(at - np.array(i))
        for a in range(3):
            if periodic[a]:
                d[:, a] = np.minimum(d[:, a], solid.shape[a] - d[:, a])
        if len(d):
            out[i] = ((d * np.array(h)) ** 2).sum(1).min()
    return out


def flood(values, periodic):
    """Component of every voxel by brute force, as the least C-order id plus 1."""
    n = values.shape
    label = np.where(values != 0, np.arange(values.size).reshape(n), -1)
    changed = True
    while changed:
        changed = False
        for i in np.ndindex(n):
            if values[i] == 0:
                continue
            for d in np.ndindex(3, 3, 3):
                j = [a + b - 1 for a, b in zip(i, d)]
                for a in range(3):
                    if periodic[a]:
                        j[a] %= n[a]
                if all(0 <= a < b for a, b in zip(j, n)):
                    j = tuple(j)
                    if values[j] == values[i] and label[j] < label[i]:
                        label[i] = label[j]
                        changed = True
    return np.where(values != 0, label + 1, 0)


def test_single_sphere(spark):
    grid = GridSpec((10, 10, 10))
    img = g.spheres_image(particles.spheres(spark, [(0.5, 0.5, 0.5, 0.25)]), grid)
    assert img.where("v = 1").count() == 944
    inverted = g.spheres_image(particles.spheres(spark, [(0.5, 0.5, 0.5, 0.25)]), grid, invert=True)
    assert inverted.where("v = 1").count() == 56
    assert voxels.porosity(img, grid).first()["porosity"] == pytest.approx(0.944)


def test_cylinders(spark):
    grid = GridSpec((100, 100, 100))
    rows = [(0.5, 0.5, -0.05, 0.5, 0.5, 1.05, 0.15), (0.25, 0.25, 0.55, 0.75, 0.75, 0.85, 0.15)]
    assert g.cylinders_image(particles.cylinders(spark, rows), grid).where("v = 1").count() == 893668


@pytest.mark.parametrize("periodic", [(False,) * 3, (True, False, True), (True,) * 3])
def test_edt_matches_brute_force(spark, periodic):
    values = (np.random.default_rng(3).random((6, 7, 8)) > 0.1).astype(int)
    kinds = tuple((Boundary.PERIODIC,) * 2 if p else (Boundary.END,) * 2 for p in periodic)
    grid = GridSpec((6, 7, 8), box=((0, 6), (0, 3.5), (0, 16)), boundary=kinds)
    img = g.from_array(spark, values)
    want = brute_edt2(values == 0, grid.resolution, periodic)
    for f in (distance.squared_edt, distance.squared_edt_relational):
        got = g.to_array(f(img, grid), values.shape, "d2")
        np.testing.assert_allclose(got, want)


def test_edt_of_large_planes_goes_by_lines(spark, monkeypatch):
    monkeypatch.setattr(distance, "PLANE_VOXELS", 10)
    monkeypatch.setattr(distance, "VOXELS_AT_ONCE", 30)
    values = (np.random.default_rng(4).random((5, 6, 7)) > 0.1).astype(int)
    grid = GridSpec((5, 6, 7), box=((0, 5), (0, 6), (0, 7)))
    got = g.to_array(distance.squared_edt(g.from_array(spark, values), grid), values.shape, "d2")
    np.testing.assert_allclose(got, brute_edt2(values == 0, grid.resolution, (False,) * 3))
    with pytest.raises(Exception, match="each voxel once"):
        distance.squared_edt(g.from_array(spark, values).where("x + y + z != 4"), grid).count()


def test_edt_without_solid_is_null(spark):
    grid = GridSpec((3, 3, 3))
    img = g.from_array(spark, np.ones((3, 3, 3), int))
    assert distance.edt(img, grid).where("distance is not null").count() == 0


def test_edt_lines():
    np.testing.assert_allclose(distance.nearest_1d([1, 1, 0, 1, 1, 1]), [4, 1, 0, 1, 4, 9])
    np.testing.assert_allclose(distance.nearest_1d([0, 1, 1, 1, 1], periodic=True), [0, 1, 4, 4, 1])
    np.testing.assert_allclose(distance.envelope_1d([0, np.inf, np.inf, 1]), [0, 1, 2, 1])


def test_edt_2d(spark):
    values = (np.random.default_rng(5).random((9, 7)) > 0.15).astype(int)
    got = g.to_array(distance.squared_edt_2d(g.from_array(spark, values).select("x", "y", "v"), (9, 7), (True, False), (1.0, 2.0)).withColumn("z", F.lit(0)), (9, 7), "d2", (0, 0))
    at = np.argwhere(values == 0)
    for i in np.ndindex(9, 7):
        d = np.abs(at - np.array(i))
        d[:, 0] = np.minimum(d[:, 0], 9 - d[:, 0])
        assert got[i] == ((d * [1, 2]) ** 2).sum(1).min()


@pytest.mark.parametrize("periodic", [(False,) * 3, (True,) * 3, (False, True, False)])
def test_components_match_flood_fill(spark, periodic):
    values = np.random.default_rng(7).choice([0, 1, 2], size=(5, 6, 7), p=[0.7, 0.2, 0.1])
    kinds = tuple((Boundary.PERIODIC,) * 2 if p else (Boundary.END,) * 2 for p in periodic)
    grid = GridSpec((5, 6, 7), boundary=kinds)
    img = g.from_array(spark, values)
    for tile in (components.TILE_VOXELS, 100, 20, 1):  # whole, planes, lines of y, single lines
        got = g.to_array(components.components(img, grid, tile=tile), values.shape, "label")
        np.testing.assert_array_equal(got, flood(values, periodic))
    np.testing.assert_array_equal(g.to_array(components.components(img, grid, small=0, tile=60), values.shape, "label"), flood(values, periodic))
    odd = img.where("x + y + z != 7").withColumns({"a.b": F.lit(1), "_root": F.lit(2), "_to": F.lit(3)})
    holes = values.copy()
    holes[np.indices(values.shape).sum(0) == 7] = 0
    got = components.components(odd, grid, tile=100)
    assert got.where("`a.b` = 1 and _root = 2 and _to = 3").count() == odd.count()
    np.testing.assert_array_equal(g.to_array(got, values.shape, "label"), flood(holes, periodic))
    found = components.runs(img, grid)
    from porelith.plans.graph import connected_components

    edges = components.run_edges(found, grid)
    a = {r.node: r.component for r in connected_components(edges).collect()}
    b = {r.node: r.component for r in components.solve(edges).collect()}
    assert a == b


def test_face_filters(spark):
    values = np.zeros((6, 4, 4), int)
    values[:, 0, 0] = 1  # through
    values[:3, 2, 2] = 1  # inlet only
    values[2:4, 2, 0] = 1  # neither (26 neighbours keep it apart from y = 0)
    values[2:4, 0, 3] = 1
    grid = GridSpec((6, 4, 4), inlet=((True, False), (False,) * 2, (False,) * 2), outlet=((False, True), (False,) * 2, (False,) * 2))
    img = g.from_array(spark, values)
    count = lambda f: f(img, grid).where("v = 1").count()
    assert count(components.inlet_connected) == 9
    assert count(components.outlet_connected) == 6
    assert count(components.inlet_outlet_connected) == 6
    assert count(components.isolated) == 4


def test_morphology_matches_brute_force(spark):
    values = (np.random.default_rng(9).random((8, 8, 8)) > 0.97).astype(int)
    grid = GridSpec((8, 8, 8), box=((0, 8),) * 3)
    img = g.from_array(spark, values)
    for r in (1.0, 1.5, 2.3):
        want = brute_edt2(values == 1, grid.resolution, (False,) * 3) <= r * r
        np.testing.assert_array_equal(g.to_array(morphology.dilate(img, grid, r), (8, 8, 8)), want)
        np.testing.assert_array_equal(g.to_array(morphology.dilate_by_offsets(img, grid, r), (8, 8, 8)), want)
        inv = g.from_array(spark, 1 - values)
        np.testing.assert_array_equal(g.to_array(morphology.erode(inv, grid, r), (8, 8, 8)), ~want)
    assert morphology.struct_element(spark, (1.0, 1.0, 1.0), 3).count() == 123
    with pytest.raises(ValueError):
        morphology.struct_element(spark, (1.0, 1.0, 2.0), 3)
    with pytest.raises(ValueError):
        morphology.struct_ratio((1.0,), 3)


def test_pore_sizes(spark):
    assert porosimetry.pore_radii(0, 10, 4) == pytest.approx([10, 20 / 3, 10 / 3, 0])
    assert porosimetry.pore_radii(1, 10, 4, "log") == pytest.approx([10, 4.6416, 2.1544, 1], abs=1e-4)
    for bad in ((5, 1, 3, "linear"), (1, 5, 0, "linear"), (0.5, 5, 3, "log"), (1, 5, 3, "cubic")):
        with pytest.raises(ValueError):
            porosimetry.pore_radii(*bad)
    values = np.ones((10, 10, 10), int)
    values[0], values[9], values[:, 0], values[:, 9], values[:, :, 0], values[:, :, 9] = 0, 0, 0, 0, 0, 0
    values[4, 4, 4] = 0
    grid = GridSpec((10, 10, 10), box=((0, 10),) * 3)
    img = g.from_array(spark, values)
    radii = [1.0, 1.5, 2.0]
    d2 = brute_edt2(values == 0, grid.resolution, (False,) * 3)
    want = np.zeros(values.shape)
    for r in radii:
        opened = brute_edt2(d2 > r * r, grid.resolution, (False,) * 3) <= r * r
        want = np.where((values == 1) & opened, r, want)
        one = g.to_array(porosimetry.porosimetry(img, grid, r), values.shape)
        np.testing.assert_array_equal(one, opened)
    got = porosimetry.pore_size_distribution(img, grid, radii)
    np.testing.assert_array_equal(g.to_array(got, values.shape, "radius"), want)
    curve = porosimetry.pore_size_curve(got).orderBy("radius").collect()
    assert curve[0]["cdf"] == pytest.approx(1) and sum(r["pdf"] for r in curve) == pytest.approx(1)


@pytest.mark.parametrize("blocks", [4, 1])
def test_correctors_make_blocks_exact(spark, blocks):
    grid = GridSpec((3, 12, 2), blocks=(1, blocks, 1), boundary=((Boundary.END,) * 2, (Boundary.PERIODIC,) * 2, (Boundary.END,) * 2), box=((0, 3), (0, 6), (0, 2)))
    rng = np.random.default_rng(5)
    v = (rng.random((3, 12, 2)) > 0.2).astype(int)
    v[0, :, 0], v[1, :, 1] = 1, 1
    v[1, 7, 1] = 0
    img = spark.createDataFrame([(*map(int, at), int(v[at])) for at in np.ndindex(v.shape)], "x int, y int, z int, v int")
    rows = distance.correctors(img, grid, 1).collect()
    assert len(rows) == 3 * 2 * blocks
    m = 12 // blocks
    for r in rows:
        line = v[r["x"], :, r["z"]]
        whole = distance.nearest_1d(line, 0.5, True)
        ends = [np.inf if r[c] is None else r[c] for c in ("lower", "upper")]
        assert distance.nearest_1d(line[m * r["block"] : m * (r["block"] + 1)], 0.5, False, *ends) == pytest.approx(whole[m * r["block"] : m * (r["block"] + 1)])
    with pytest.raises(ValueError):
        distance.correctors(img, grid, 3)
    assert distance.correctors(img.where("false"), grid, 1).count() == 0


def test_hulls_go_on_where_lines_end(spark):
    grid = GridSpec((2, 2, 30), box=((0, 2), (0, 2), (0, 60)))
    rng = np.random.default_rng(6)
    f = rng.integers(0, 200, (2, 2, 30)).astype(float)
    f[0, 0, :] = np.inf
    f[1, 1, 4:20] = np.inf
    img = spark.createDataFrame([(*map(int, at), float(f[at])) for at in np.ndindex(f.shape)], "x int, y int, z int, d2 double")
    rows = distance.boundary_hulls(img, grid, 2, 99).collect()
    assert not [r for r in rows if (r["x"], r["y"]) == (0, 0)]
    for x, y in ((0, 1), (1, 0), (1, 1)):
        mine = sorted((r["place"], r["z"], r["height"]) for r in rows if (r["x"], r["y"]) == (x, y))
        assert [p for p, _, _ in mine] == list(range(len(mine))) and [z for _, z, _ in mine] == sorted(z for _, z, _ in mine)
        lowest = [min(h + (2 * (i - z)) ** 2 for _, z, h in mine) for i in range(30)]
        assert lowest == pytest.approx(distance.envelope_1d(f[x, y], 2.0))
    few = distance.boundary_hulls(img, grid, 2, 2, False).where("x = 0 and y = 1").orderBy("place").collect()
    assert [r["z"] for r in few] == [z for _, z, _ in sorted(((r["place"], r["z"], 0) for r in rows if (r["x"], r["y"]) == (0, 1)), reverse=True)[:2]]


def test_drainage_of_the_inkbottle(spark):
    # fixed values: pressures and the saturations that belong to them
    grid = GridSpec((140, 30, 30), box=((0.0, 14.0), (-1.5, 1.5), (-1.5, 1.5)), inlet=((False, True), (False,) * 2, (False,) * 2), outlet=((True, False), (False,) * 2, (False,) * 2), reservoir=10)
    table, _ = porosimetry.drainage(g.inkbottle(spark, grid), grid, [1.61322, 1.60194, 1.58965, 1.5943])
    rows = table.orderBy("step").collect()
    assert [r["pressure"] for r in rows] == [1.58965, 1.5943, 1.60194, 1.61322]
    assert [r["saturation"] for r in rows] == pytest.approx([0.914608928, 0.914608928, 0.914608928, 0.903539715], abs=1e-8)


def test_drainage_arguments(spark):
    grid = GridSpec((8, 4, 4))
    img = g.linear(spark, grid, 0).withColumn("v", F.lit(1))
    for bad in ({"contact_angle": 20}, {"method": "other"}):
        with pytest.raises(ValueError):
            porosimetry.drainage(img, grid, 1.0, **bad)
    assert porosimetry.probe_radius(1) == 2 and porosimetry.probe_radius(0) == 0
    assert porosimetry.probe_radius(1, 1, 20) == pytest.approx(1.87938524)
    assert porosimetry.capillary_pressure(0.5) == 4


def test_minkowski(spark):
    w = minkowski.direction_weights((1.0, 1.0, 1.0))
    assert sum(w.values()) == pytest.approx(1)
    assert w[(1, 0, 0)] == pytest.approx(0.045778, abs=1e-5) and w[(1, 1, 1)] == pytest.approx(0.035196, abs=1e-5)
    grid = GridSpec((100, 100, 100))
    img = g.spheres_image(particles.spheres(spark, [(0.5, 0.5, 0.5, 0.5)]), grid)
    got = minkowski.functionals(img, grid, F.col("v") == 0)
    for a, b in zip(got, (4 / 3 * math.pi * 0.125, math.pi, 8.8, -2.0), strict=True):
        assert abs(a - b) < 0.15
    values = np.random.default_rng(1).integers(0, 2, (4, 5, 6))
    h = minkowski.histogram(minkowski.configurations(g.from_array(spark, values), values.shape), 256)
    want = np.zeros(256, int)
    for x, y, z in np.ndindex(3, 4, 5):
        want[sum(int(values[x + i, y + j, z + k]) << (i + 2 * j + 4 * k) for i in (0, 1) for j in (0, 1) for k in (0, 1))] += 1
    np.testing.assert_array_equal(h, want)


def test_voxel_ids_and_lines(spark):
    assert voxel_id((1, 2, 7), (5, 6, 5)) == 42
    assert voxel_id((-1, -1, -1), (10, 10, 10)) == 999
    grid = GridSpec((10, 10, 10))
    assert {r["n"] for r in voxels.histogram(g.linear(spark, grid, 1)).collect()} == {100}
    img = g.from_array(spark, np.array([[[0, 0, 1, 1, 0]]]))
    small = GridSpec((2, 2, 5))
    r = voxels.nearest_index(img, small, 2, 1).first()
    assert (r["lower"], r["upper"]) == (2, 3)
    assert voxels.nearest_index(img, small, 2, 5).first()["lower"] == -1
    with pytest.raises(ValueError):
        voxels.nearest_index(img, small, 3, 1)
    with pytest.raises(TypeError):
        voxels.nearest_index(img, small, 2, 1, "own")


def test_deconstruct_wraps(spark):
    values = np.arange(64).reshape(4, 4, 4)
    grid = GridSpec((4, 4, 4), boundary=PERIODIC, blocks=(2, 1, 1))
    cut = voxels.deconstruct(g.from_array(spark, values), grid)
    one = g.to_array(cut.where("block = 0").select(F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("lz").alias("z"), "v"), (4, 6, 6))
    np.testing.assert_array_equal(one, np.pad(values, 1, mode="wrap")[:4])
    sent = voxels.halo(g.from_array(spark, values), grid, (1, 1, 1))
    assert sent.where("block = 0").count() == 4 * 6 * 6 - 2 * 4 * 4


def test_euler6_counts_corners_edges_faces_and_cells(spark):
    """Masks 103 and 231 count -1: 3 corners more or less do not cancel 2 faces.  Held against the whole complex."""
    table = minkowski.euler6_table()
    assert table[103] == table[231] == -1
    r = np.random.default_rng(5)
    a = np.pad(r.integers(0, 2, (7, 6, 5)).astype(bool), 1)
    cells = sum(
        (-1) ** (i + j + k) * int((a & np.roll(a, -i, 0) & np.roll(a, -j, 1) & np.roll(a, -k, 2) & np.roll(a, (-i, -j), (0, 1)) & np.roll(a, (-i, -k), (0, 2)) & np.roll(a, (-j, -k), (1, 2)) & np.roll(a, (-i, -j, -k), (0, 1, 2))).sum())
        for i in (0, 1) for j in (0, 1) for k in (0, 1)
    )
    m = sum(np.roll(a, (-i, -j, -k), (0, 1, 2)).astype(int) << (i + 2 * j + 4 * k) for i in (0, 1) for j in (0, 1) for k in (0, 1))
    assert cells == table[m].sum()


def test_euler26_has_22_kinds():
    assert len(minkowski.EULER26) == 22
    kinds = minkowski.euler26_table()
    for step in (1, 2, 4):  # reflections change nothing
        turned = [sum(1 << (c ^ step) for c in range(8) if m >> c & 1) for m in range(256)]
        assert (kinds == kinds[turned]).all()


@pytest.mark.parametrize("periodic", [False, True])
def test_envelopes_equal_shifts(periodic):
    r = np.random.default_rng(8)
    for n, share in ((1, 1.0), (2, 0.5), (37, 0.05), (64, 0.4), (64, 1.0)):
        f = np.where(r.random((40, n)) < share, (r.integers(0, 30, (40, n)) * 0.7) ** 2, np.inf)
        want = distance._shifted(f, 0.7, periodic, n)
        np.testing.assert_allclose(distance.envelopes(f, 0.7, periodic), want, atol=1e-9)
        solid = f[:5, :, None] * np.ones((1, 1, 3))
        np.testing.assert_allclose(distance.envelopes(solid, 0.7, periodic), distance._shifted(solid, 0.7, periodic, n), atol=1e-9)


def test_sparse_solids_go_by_envelopes(spark, monkeypatch):
    monkeypatch.setattr(distance, "FEW_STEPS", 2)
    values = np.ones((9, 8, 11), int)
    values[1, 2, 3] = values[7, 0, 9] = 0
    for wraps in (False, True):
        kinds = ((Boundary.PERIODIC if wraps else Boundary.END,) * 2,) * 3
        grid = GridSpec((9, 8, 11), box=((0, 9), (0, 4), (0, 22)), boundary=kinds)
        got = g.to_array(distance.squared_edt(g.from_array(spark, values), grid), values.shape, "d2")
        np.testing.assert_allclose(got, brute_edt2(values == 0, grid.resolution, (wraps,) * 3))


def test_clashing_columns(spark):
    """Columns named like our own are the user's: kept where columns pass through, and never taken for distances."""
    values = np.ones((6, 5, 5), int)
    values[3, 2, 2] = 0
    grid = GridSpec((6, 5, 5), box=((0, 6), (0, 5), (0, 5)), inlet=((True, False), (False,) * 2, (False,) * 2))
    img = g.from_array(spark, values)
    clash = img.withColumns({c: F.lit(7.0) for c in ("d2", "_label", "_keep", "_seed", "_d2", "_core")})
    np.testing.assert_array_equal(g.to_array(porosimetry.porosimetry(clash, grid, 1.0), values.shape), g.to_array(porosimetry.porosimetry(img, grid, 1.0), values.shape))
    np.testing.assert_array_equal(g.to_array(porosimetry.pore_size_distribution(clash, grid, [1.0], inlet=True), values.shape, "radius"), g.to_array(porosimetry.pore_size_distribution(img, grid, [1.0], inlet=True), values.shape, "radius"))
    for f in (components.inlet_connected, lambda i, s: morphology.dilate(i, s, 1.0), lambda i, s: morphology.erode(i, s, 1.0)):
        got = f(clash, grid)
        assert got.where("_label = 7 and _keep = 7 and _seed = 7 and _d2 = 7 and d2 = 7").count() == 150
        np.testing.assert_array_equal(g.to_array(got, values.shape), g.to_array(f(img, grid), values.shape))
