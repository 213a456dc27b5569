"""Queries that list the grid model as tables: axes, blocks, paddings, cells and the features of blocks.

The model is one grid of 10 x 10 x 11 voxels in 2 x 3 x 2 blocks with an END and a WALL face on x and y, periodic
z, an inlet on x and an outlet on y.  The SQL computes every entry from the table ``spec`` of its three axes.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from .functions import grid as grids
from .functions.grid import AXES, Boundary, GridSpec
from .registry import query

GRID = GridSpec(
    (10, 10, 11), box=((0.0, 10.0), (-1.0, 4.0), (0.0, 22.0)), blocks=(2, 3, 2), reservoir=2,
    boundary=((Boundary.END, Boundary.WALL), (Boundary.WALL, Boundary.END), (Boundary.PERIODIC, Boundary.PERIODIC)),
    inlet=((True, False), (True, False), (False, False)), outlet=((False, True), (False, True), (False, False)),
)
PAD = (2, 1, 1)

#: The axes with their voxels n, box, blocks b, faces' types, inlets, outlets and pad.
_SPEC = """WITH RECURSIVE spec(axis, n, lo, hi, b, lower, upper, in0, in1, out0, out1, pad) AS (VALUES (0, 10, 0.0::DOUBLE, 10.0::DOUBLE, 2, 'end', 'wall', true, false, false, true, 2),
 (1, 10, -1.0, 4.0, 3, 'wall', 'end', true, false, false, true, 1), (2, 11, 0.0, 22.0, 2, 'periodic', 'periodic', false, false, false, false, 1))"""

#: rank, axis and all that a block has on it; a flag counts on END faces only.
_BLOCKS = f"""{_SPEC}, placed AS (SELECT CAST(rank AS INT) AS rank, spec.*, CAST(CASE axis WHEN 0 THEN rank // 6 WHEN 1 THEN rank // 2 % 3 ELSE rank % 2 END AS INT) AS i FROM range(12) r(rank), spec),
edged AS (SELECT *, i = 0 AS first, i = b - 1 AS last, (hi - lo) / n AS h, n // b * i AS own_start, n // b + CASE WHEN i = b - 1 THEN n % b ELSE 0 END AS own_n FROM placed),
typed AS (SELECT *, CASE WHEN first THEN lower ELSE 'internal' END AS k0, CASE WHEN last THEN upper ELSE 'internal' END AS k1, first AND in0 AND lower = 'end' AS inlet0, last AND in1 AND upper = 'end' AS inlet1, first AND out0 AND lower = 'end' AS outlet0, last AND out1 AND upper = 'end' AS outlet1 FROM edged),
padded AS (SELECT *, CASE k0 WHEN 'end' THEN 0 WHEN 'wall' THEN 1 ELSE pad END AS p0, CASE k1 WHEN 'end' THEN 0 WHEN 'wall' THEN 1 ELSE pad END AS p1, CASE WHEN inlet0 THEN 2 ELSE 0 END AS r0, CASE WHEN inlet1 THEN 2 ELSE 0 END AS r1 FROM typed),
blocks AS (SELECT *, own_start - p0 - r0 AS start, own_n + p0 + p1 + r0 + r1 AS shape FROM padded)"""


@query(f"{_SPEC} SELECT axis, n, hi - lo AS length, lo AS origin, (hi - lo) / n AS resolution, (lo + hi) / 2 AS centroid, lower = 'periodic' AND upper = 'periodic' AS periodic, (SELECT product(hi - lo) FROM spec) AS volume, round(sqrt((SELECT sum((hi - lo) * (hi - lo)) FROM spec)) / 2, 9) AS radius FROM spec")
def grid_axes(spark, sf_dir):
    rows = [(a, GRID.voxels_shape[a], GRID.lengths[a], GRID.origin[a], GRID.resolution[a], GRID.centroid[a], GRID.periodic[a], GRID.volume, round(GRID.radius, 9)) for a in range(3)]
    return spark.createDataFrame(rows, "axis int, n int, length double, origin double, resolution double, centroid double, periodic boolean, volume double, radius double")


@query(f"{_SPEC} SELECT axis, CAST(i AS INT) AS i, lo + (i + 0.5::DOUBLE) * ((hi - lo) / n) AS coordinate FROM spec, range(11) t(i) WHERE i < n")
def grid_coordinates(spark, sf_dir):
    return spark.createDataFrame([(a, i, c) for a in range(3) for i, c in enumerate(GRID.coordinates(a))], "axis int, i int, coordinate double")


@query("""SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, CAST(CASE WHEN i = -1 OR j = 3 THEN -1 WHEN i = 2 OR j = -1 THEN -2 ELSE (i * 3 + j) * 2 + (k + 2) % 2 END AS INT) AS rank
FROM range(-1, 3) t1(i), range(-1, 4) t2(j), range(-1, 3) t3(k)""")
def block_ranks(spark, sf_dir):
    return spark.createDataFrame([(*at, rank) for at, rank in GRID.block_map().items()], "i int, j int, k int, rank int")


@query(f"{_BLOCKS} SELECT rank, axis, i, CAST(own_start AS INT) AS start, CAST(own_n AS INT) AS n, lo + own_start * h AS lo, lo + (own_start + own_n) * h AS hi, k0 AS lower, k1 AS upper, first, last, inlet0, inlet1, outlet0, outlet1 FROM blocks")
def block_axes(spark, sf_dir):
    """The own part of every block, axis by axis."""
    rows = []
    for r in range(GRID.n_blocks):
        b = GRID.block(r, PAD)
        for a in range(3):
            rows.append((r, a, b.index[a], GRID.block_start(a, b.index[a]), b.own_shape[a], *map(float, b.own_box[a]), *(k.value for k in b.boundary[a]), *b.global_boundary[a], *b.inlet[a], *b.outlet[a]))
    return spark.createDataFrame(rows, "rank int, axis int, i int, start int, n int, lo double, hi double, lower string, upper string, first boolean, last boolean, inlet0 boolean, inlet1 boolean, outlet0 boolean, outlet1 boolean")


@query(f"""{_BLOCKS} SELECT rank, axis, CAST(p0 AS INT) AS p0, CAST(p1 AS INT) AS p1, CAST(CASE WHEN k0 = 'end' OR k0 = 'wall' AND p0 = 1 THEN 0 ELSE 3 END AS INT) AS more0, CAST(CASE WHEN k1 = 'end' OR k1 = 'wall' AND p1 = 1 THEN 0 ELSE 3 END AS INT) AS more1,
CAST(r0 AS INT) AS r0, CAST(r1 AS INT) AS r1, CAST(start AS INT) AS start, CAST(shape AS INT) AS shape, CAST(p0 + r0 AS INT) AS own0, CAST(p0 + r0 + own_n AS INT) AS own1, lo + start * h AS lo, lo + (start + shape) * h AS hi FROM blocks""")
def padded_blocks(spark, sf_dir):
    """Paddings, reservoirs, windows and boxes of every padded block; more: three voxels of extra padding."""
    rows = []
    for r in range(GRID.n_blocks):
        b = GRID.block(r, PAD)
        for a in range(3):
            rows.append((r, a, *b.padding[a], *b.extended((3, 3, 3))[a], *b.reservoir_padding[a], b.start[a], b.shape[a], *b.own[a], *map(float, b.box[a])))
    return spark.createDataFrame(rows, "rank int, axis int, p0 int, p1 int, more0 int, more1 int, r0 int, r1 int, start int, shape int, own0 int, own1 int, lo double, hi double")


@query(f"""{_BLOCKS}, cut AS (SELECT *, c * (shape // 2) AS c0, CASE c WHEN 1 THEN shape ELSE shape // 2 END AS c1 FROM blocks, (VALUES (0), (1)) t(c))
SELECT x.rank, x.c AS i, y.c AS j, z.c AS k, CAST(x.c0 AS INT) AS x0, CAST(x.c1 AS INT) AS x1, CAST(y.c0 AS INT) AS y0, CAST(y.c1 AS INT) AS y1, CAST(z.c0 AS INT) AS z0, CAST(z.c1 AS INT) AS z1,
round((x.lo + x.start * x.h + x.lo + x.start * x.h + (x.c0 + x.c1) * x.h) / 2, 9) AS centre_x, round(sqrt(((x.c1 - x.c0) * x.h) ** 2 + ((y.c1 - y.c0) * y.h) ** 2 + ((z.c1 - z.c0) * z.h) ** 2), 9) AS diameter
FROM cut x JOIN cut y ON x.rank = y.rank JOIN cut z ON x.rank = z.rank WHERE x.axis = 0 AND y.axis = 1 AND z.axis = 2""")
def block_cells(spark, sf_dir):
    """Eight cells of every padded block, for pruning."""
    rows = []
    for r in range(GRID.n_blocks):
        for c in GRID.block(r, PAD).cells((2, 2, 2)):
            rows.append((r, *c["index"], *(v for span in c["voxels"] for v in span), round(c["centre"][0], 9), round(c["diameter"], 9)))
    return spark.createDataFrame(rows, "rank int, i int, j int, k int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int, centre_x double, diameter double")


@query("SELECT a.k AS a, b.k AS b, CASE WHEN 'end' IN (a.k, b.k) THEN 'end' WHEN 'wall' IN (a.k, b.k) THEN 'wall' WHEN 'periodic' IN (a.k, b.k) THEN 'periodic' ELSE 'internal' END AS winner FROM (VALUES ('end'), ('wall'), ('periodic'), ('internal')) a(k), (VALUES ('end'), ('wall'), ('periodic'), ('internal')) b(k)")
def boundary_precedence(spark, sf_dir):
    return spark.createDataFrame([(a.value, b.value, grids.boundary_order([a, b]).value) for a, b in product(Boundary, repeat=2)], "a string, b string, winner string")


_CODE = "(CASE {d}x WHEN -1 THEN 0 WHEN 1 THEN 9 ELSE 18 END + CASE {d}y WHEN -1 THEN 0 WHEN 1 THEN 3 ELSE 6 END + CASE {d}z WHEN -1 THEN 0 WHEN 1 THEN 1 ELSE 2 END)"
_STEPS = "(SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, CAST(dz AS INT) AS dz FROM range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz) WHERE abs(dx) + abs(dy) + abs(dz) > 0)"


@query(f"""SELECT {_CODE.format(d='d')} AS feature, dx, dy, dz, CASE abs(dx) + abs(dy) + abs(dz) WHEN 1 THEN 'face' WHEN 2 THEN 'edge' ELSE 'corner' END AS kind,
{_CODE.format(d='-d')} AS opposite, CAST(abs(dx) + abs(dy) + abs(dz) AS INT) AS faces, CAST(CASE abs(dx) + abs(dy) + abs(dz) WHEN 3 THEN 3 ELSE 0 END AS INT) AS edges,
CASE WHEN abs(dx) + abs(dy) + abs(dz) > 1 THEN -1 ELSE 2 * CASE WHEN dx <> 0 THEN 0 WHEN dy <> 0 THEN 1 ELSE 2 END + CASE WHEN dx + dy + dz > 0 THEN 1 ELSE 0 END END AS face,
CASE WHEN abs(dx) + abs(dy) + abs(dz) > 1 THEN '' WHEN dx <> 0 THEN '0 1 2' WHEN dy <> 0 THEN '1 0 2' ELSE '2 0 1' END AS argument_order, greatest(dx, dy, dz) <= 0 AS forward FROM {_STEPS}""")
def direction_features(spark, sf_dir):
    """The 26 faces, edges and corners with their numbers, opposites and the faces and edges that meet in them."""
    rows = []
    for d in grids.FEATURES:
        face = d in grids.FACES
        rows.append((grids.feature_id(d), grids.feature_id(grids.opposite(d)), len(grids.faces_of(d)), len(grids.edges_of(d)) if d in grids.CORNERS else 0, grids.face_index(d) if face else -1, " ".join(map(str, grids.argument_order(d))) if face else "", grids.is_forward(d)))
    more = spark.createDataFrame(rows, "feature int, opposite int, faces int, edges int, face int, argument_order string, forward boolean")
    return grids.offsets(spark).join(F.broadcast(more), "feature")


def _window(side: str) -> str:
    """SQL of the own and halo windows on an axis, whose columns are prefixed by ``side``; kind is that of the feature."""
    c = {k: f"{side}.{k}" for k in ("d", "shape", "p0", "p1")}
    p = f"CASE WHEN {c['d']} < 0 THEN {c['p0']} ELSE {c['p1']} END"
    depth = f"CASE WHEN kind = 'wall' THEN 1 ELSE greatest({p}, 1) END"
    skip = f"CASE WHEN ({p}) = 0 THEN 0 WHEN kind = 'wall' THEN 1 ELSE {p} END"
    edge = f"CASE WHEN kind = 'wall' THEN 1 ELSE {p} END"
    cols = {
        "own0": f"CASE WHEN {c['d']} = 0 THEN {c['p0']} WHEN {c['d']} < 0 THEN {skip} ELSE {c['shape']} - ({skip}) - ({depth}) END",
        "own1": f"CASE WHEN {c['d']} = 0 THEN {c['shape']} - {c['p1']} WHEN {c['d']} < 0 THEN ({skip}) + ({depth}) ELSE {c['shape']} - ({skip}) END",
        "halo0": f"CASE WHEN {c['d']} = 0 THEN {c['p0']} WHEN {c['d']} < 0 THEN 0 ELSE {c['shape']} - ({edge}) END",
        "halo1": f"CASE WHEN {c['d']} = 0 THEN {c['shape']} - {c['p1']} WHEN {c['d']} < 0 THEN {edge} ELSE {c['shape']} END",
    }
    return ", ".join(f"CAST({e} AS INT) AS {side}_{n}" for n, e in cols.items())


_FEATURES = f"""{_BLOCKS}, sided AS (SELECT *, CASE WHEN d < 0 THEN k0 WHEN d > 0 THEN k1 END AS k, CASE WHEN d < 0 THEN first WHEN d > 0 THEN last END AS edge, CASE WHEN d <> 0 AND lower = 'periodic' AND CASE WHEN d < 0 THEN first ELSE last END THEN -d ELSE 0 END AS shift,
 CASE WHEN i + d = -1 THEN lower WHEN i + d = b THEN upper END AS beyond, (i + d + b) % b AS ni FROM blocks, (VALUES (-1), (0), (1)) t(d)),
joined AS (SELECT x.rank, x.d AS dx, y.d AS dy, z.d AS dz, CASE WHEN 'end' IN (x.k, y.k, z.k) THEN 'end' WHEN 'wall' IN (x.k, y.k, z.k) THEN 'wall' WHEN 'periodic' IN (x.k, y.k, z.k) THEN 'periodic' ELSE 'internal' END AS kind,
 coalesce(x.edge, true) AND coalesce(y.edge, true) AND coalesce(z.edge, true) AS outermost, x.shift AS sx, y.shift AS sy, z.shift AS sz,
 CASE WHEN 'end' IN (x.beyond, y.beyond, z.beyond) THEN -1 WHEN 'wall' IN (x.beyond, y.beyond, z.beyond) THEN -2 ELSE (x.ni * 3 + y.ni) * 2 + z.ni END AS neighbour, x, y, z
 FROM sided x JOIN sided y ON x.rank = y.rank JOIN sided z ON x.rank = z.rank WHERE x.axis = 0 AND y.axis = 1 AND z.axis = 2 AND (x.d <> 0 OR y.d <> 0 OR z.d <> 0))
SELECT rank, {_CODE.format(d='d')} AS feature, {_CODE.format(d='-d')} AS opposite, kind, kind = 'periodic' AS periodic, outermost, CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, CAST(sz AS INT) AS sz, CAST(neighbour AS INT) AS neighbour, {', '.join(map(_window, AXES))} FROM joined"""


@query(_FEATURES)
def block_features(spark, sf_dir):
    """Type, periodic shift, neighbour, own window and halo of each face, edge and corner of every block."""
    rows = []
    for r in range(GRID.n_blocks):
        b = GRID.block(r, PAD)
        shifts = b.periodic_features()
        for d, f in b.features().items():
            assert shifts.get(d) == (f["shift"] if f["periodic"] else None) and b.member(d, "rank") == f["rank"]
            windows = [v for o, h in zip(f["own"], f["halo"], strict=True) for v in (*o, *h)]
            rows.append((r, f["id"], grids.feature_id(f["opposite"]), f["boundary"].value, f["periodic"], f["global"], *f["shift"], f["rank"], *windows))
    columns = ", ".join(f"{a}_{n} int" for a in AXES for n in ("own0", "own1", "halo0", "halo1"))
    return spark.createDataFrame(rows, f"rank int, feature int, opposite int, kind string, periodic boolean, outermost boolean, sx int, sy int, sz int, neighbour int, {columns}")


@query(f"{_SPEC} SELECT axis, CAST(c AS DOUBLE) AS coordinate, CAST(floor((c - lo) / ((hi - lo) / n)) AS INT) AS i FROM spec, (VALUES (0.0), (0.3), (1.75), (3.99)) t(c)")
def coordinate_voxels(spark, sf_dir):
    """The voxels that hold a coordinate."""
    at = spark.createDataFrame([(c,) for c in (0.0, 0.3, 1.75, 3.99)], "coordinate double")
    parts = [at.select(F.lit(a).alias("axis"), "coordinate", GRID.index_of(a, F.col("coordinate")).alias("i")) for a in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
