"""Particles as DataFrames: spheres and atoms (pid, x, y, z, r, type, mass, own), cylinders (cid, x1 ... z2, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES, Boundary, GridSpec
from ..plans.spatial import bucketed_join

SPHERES = "pid bigint, x double, y double, z double, r double, type int, mass double"
CYLINDERS = "cid bigint, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, r double"

Box = tuple[tuple[float, float], ...]


# -- predicates
def contains_sphere(x: Column, y: Column, z: Column) -> Column:
    """The point lies in the sphere cx, cy, cz, cr, surface included."""
    dx, dy, dz = x - F.col("cx"), y - F.col("cy"), z - F.col("cz")
    return dx * dx + dy * dy + dz * dz <= F.col("cr") * F.col("cr")


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def contains_cylinder(x: Column, y: Column, z: Column) -> Column:
    """The point lies in the flat-capped cylinder x1 ... z2, cr, surface included."""
    p1 = tuple(F.col(f"{a}1") for a in AXES)
    axis = tuple(F.col(f"{a}2") - F.col(f"{a}1") for a in AXES)
    w = tuple(c - p for c, p in zip((x, y, z), p1, strict=True))
    h = F.sqrt(dot(axis, axis))
    along = dot(w, axis) / h
    return (along >= 0) & (along <= h) & (dot(w, w) - along * along <= F.col("cr") * F.col("cr"))


def intersects_box(box: Box, r: str = "r") -> Column:
    """The particle's bounding box meets ``box``, bounds included."""
    out = F.lit(True)
    for a, (lo, hi) in zip(AXES, box, strict=True):
        out = out & (F.col(a) + F.col(r) >= lo) & (F.col(a) - F.col(r) <= hi)
    return out


def inside_box(box: Box) -> Column:
    """The centre lies in ``box``, bounds included."""
    out = F.lit(True)
    for a, (lo, hi) in zip(AXES, box, strict=True):
        out = out & F.col(a).between(lo, hi)
    return out


def crosses(box: Box, axis: int, side: int) -> Column:
    """The particle reaches beyond a face of ``box``."""
    a = AXES[axis]
    return F.col(a) + F.col("r") > box[axis][1] if side else F.col(a) - F.col("r") < box[axis][0]


def crosses_any(box: Box) -> Column:
    out = F.lit(False)
    for axis in range(3):
        for side in (0, 1):
            out = out | crosses(box, axis, side)
    return out


# -- lists
def spheres(spark: SparkSession, rows, radii=None, masses=None) -> DataFrame:
    """From (x, y, z, r) rows, or (x, y, z) rows and radii; masses are optional."""
    rows = [tuple(map(float, r)) for r in rows]
    if radii is not None:
        rows = [(*r[:3], float(q)) for r, q in zip(rows, radii, strict=True)]
    if any(len(r) != 4 for r in rows):
        raise ValueError("a sphere is x, y, z and r")
    masses = [None] * len(rows) if masses is None else [float(m) for m in masses]
    return spark.createDataFrame([(i, *r, None, m) for i, (r, m) in enumerate(zip(rows, masses, strict=True))], SPHERES)


def cylinders(spark: SparkSession, rows) -> DataFrame:
    """From rows of the two end points and the radius."""
    rows = [tuple(map(float, r)) for r in rows]
    if any(len(r) != 7 for r in rows):
        raise ValueError("a cylinder is two points and a radius")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CYLINDERS)


def values_by_type(atoms: DataFrame, values: dict[int, float], name: str) -> DataFrame:
    """Add ``name`` by atom type from a small table; a type without a value is an error when the rows are read."""
    table = atoms.sparkSession.createDataFrame([(int(k), float(v)) for k, v in values.items()], f"type int, {name} double")
    joined = atoms.drop(name).join(F.broadcast(table), "type", "left")
    missing = F.raise_error(F.concat(F.lit("no value for atom type "), F.col("type").cast("string"))).cast("double")
    return joined.withColumn(name, F.coalesce(F.col(name), missing))


def atoms(spark: SparkSession, coordinates, radii: dict[int, float], types, masses: dict[int, float] | None = None) -> DataFrame:
    """From coordinates and types, radii (and masses) looked up by type."""
    rows = [(i, *map(float, c), None, int(t), None) for i, (c, t) in enumerate(zip(coordinates, types, strict=True))]
    out = values_by_type(spark.createDataFrame(rows, SPHERES), radii, "r")
    out = out if masses is None else values_by_type(out, masses, "mass")
    return out.select("pid", *AXES, "r", "type", "mass")


def trim_intersecting(particles: DataFrame, box: Box) -> DataFrame:
    return particles.where(intersects_box(box))


def trim_within(particles: DataFrame, box: Box) -> DataFrame:
    return particles.where(inside_box(box))


def with_own(particles: DataFrame, box: Box) -> DataFrame:
    return particles.withColumn("own", inside_box(box))


def find_cylinders(rows: DataFrame, box: Box) -> DataFrame:
    """Cylinders whose bounding box meets ``box``."""
    out = F.lit(True)
    for a, (lo, hi) in zip(AXES, box, strict=True):
        out = out & (F.greatest(f"{a}1", f"{a}2") + F.col("r") >= lo) & (F.least(f"{a}1", f"{a}2") - F.col("r") <= hi)
    return rows.where(out)


def add_periodic(particles: DataFrame, grid: GridSpec, box: Box | None = None) -> DataFrame:
    """The particles with their images across periodic faces, those that meet ``box`` (the domain by default).

    A particle that reaches beyond the lower face of a periodic axis has an image one length up, and the other
    way round; images of several axes combine.  Other columns are kept on the images.
    """
    out = particles
    for axis, (a, length) in enumerate(zip(AXES, grid.lengths, strict=True)):
        if not grid.periodic[axis]:
            continue
        steps = F.array_compact(F.array(F.lit(0), F.when(crosses(grid.box, axis, 0), F.lit(1)), F.when(crosses(grid.box, axis, 1), F.lit(-1))))
        out = out.withColumn("_step", F.explode(steps)).withColumn(a, F.col(a) + F.col("_step") * F.lit(length)).drop("_step")
    return out.where(intersects_box(box or grid.box))


def initialize_spheres(particles: DataFrame, grid: GridSpec, box: Box | None = None, periodic: bool = False, own: bool = True, intersecting: bool = False, within: bool = False) -> DataFrame:
    """In this order: trim to those that meet the box, to those centred in it, add images, mark own."""
    box = box or grid.box
    out = trim_intersecting(particles, box) if intersecting else particles
    out = trim_within(out, box) if within else out
    out = add_periodic(out, grid, box) if periodic else out
    return with_own(out, box) if own else out


def initialize_atoms(particles: DataFrame, grid: GridSpec, box: Box | None = None, periodic: bool = False, own: bool = True, intersecting: bool = False, within: bool = False) -> DataFrame:
    """In this order: trim to those centred in the box, to those that meet it, add images, mark own."""
    box = box or grid.box
    out = trim_within(particles, box) if within else particles
    out = trim_intersecting(out, box) if intersecting else out
    out = add_periodic(out, grid, box) if periodic else out
    return with_own(out, box) if own else out


# -- counts
def sizes(particles: DataFrame) -> DataFrame:
    """One row: particles, own ones and the greatest radius (0 without any)."""
    own = F.count_if("own") if "own" in particles.columns else F.lit(None).cast("long")
    return particles.agg(F.count(F.lit(1)).alias("n"), own.alias("n_own"), F.coalesce(F.max("r"), F.lit(0.0)).alias("max_r"))


def sizes_by_type(particles: DataFrame) -> DataFrame:
    own = F.count_if("own") if "own" in particles.columns else F.lit(None).cast("long")
    return particles.groupBy("type").agg(F.count(F.lit(1)).alias("n"), own.alias("n_own"))


def of_type(particles: DataFrame, kind: int) -> DataFrame:
    return particles.where(F.col("type") == kind)


def rows(particles: DataFrame, own: bool = False, label: bool = False) -> DataFrame:
    """x, y, z, r and, if asked for, own and label (the type)."""
    return particles.select(*AXES, "r", *(["own"] if own else []), *([F.col("type").alias("label")] if label else []))


def coordinates(particles: DataFrame) -> DataFrame:
    return particles.select(*AXES)


def masses(particles: DataFrame) -> DataFrame:
    return particles.select("pid", "mass")


def with_masses(particles: DataFrame, table: DataFrame) -> DataFrame:
    """Masses from a (pid, mass) table."""
    return particles.drop("mass").join(table.select("pid", "mass"), "pid", "left")


def in_box(particles: DataFrame, box: Box) -> DataFrame:
    """The particles whose centre lies in ``box``."""
    return particles.where(inside_box(box))


def moved(particles: DataFrame, places: DataFrame) -> DataFrame:
    """The list replaced by that of ``places`` (pid, x, y, z); what else is known of a particle stays with it, null for new ones."""
    return places.select("pid", *AXES).join(particles.drop(*AXES), "pid", "left").select(*particles.columns)


# -- neighbours
def neighbours(points: DataFrame, particles: DataFrame, radius: float, square: bool = False) -> DataFrame:
    """(qid, pid, distance) of the particles strictly nearer than ``radius`` to each point (qid, x, y, z)."""
    right = particles.select("pid", *(F.col(a).alias(f"c{a}") for a in AXES))
    d = [F.col(a) - F.col(f"c{a}") for a in AXES]
    d2 = dot(tuple(d), tuple(d))
    low, high = (tuple(F.col(f"c{a}") + s * radius for a in AXES) for s in (-1, 1))
    found = bucketed_join(points.select("qid", *AXES), right, tuple(F.col(a) for a in AXES), low, high, 2 * radius, d2 < radius * radius)
    return found.select("qid", "pid", (d2 if square else F.sqrt(d2)).alias("distance"))


# -- elements
#: Universal Force Field elements, atomic numbers and diameters in Angstrom.
UFF = (("H", 1, 2.571), ("C", 6, 3.431), ("N", 7, 3.261), ("O", 8, 3.118), ("Cl", 17, 3.516))


def uff_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(z, name, radius) of the built-in elements, or of a file ``Z name diameter`` with a header."""
    if path is None:
        return spark.createDataFrame([(z, n, d / 2) for n, z, d in UFF], "z int, name string, radius double")
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(words.alias("w")).where(F.size("w") >= 3)
    return lines.select(F.expr("try_cast(w[0] as int)").alias("z"), F.col("w")[1].alias("name"), (F.expr("try_cast(w[2] as double)") / 2).alias("radius")).where("z is not null and radius is not null")


def elements_to_ids(elements: DataFrame, column: str = "element") -> DataFrame:
    """Add z, the atomic number, 0 for unknown elements."""
    table = uff_table(elements.sparkSession).select(F.col("name").alias(column), "z")
    return elements.join(F.broadcast(table), column, "left").withColumn("z", F.coalesce("z", F.lit(0)))


def uff_radius(spark: SparkSession, names=None, numbers=None, path: str | None = None) -> DataFrame:
    """(name or z, radius) of the given names or atomic numbers; unknown ones are left out."""
    if (names is None) == (numbers is None):
        raise ValueError("give names or atomic numbers")
    key, asked = ("name", names) if names is not None else ("z", numbers)
    wanted = spark.createDataFrame([(v,) for v in dict.fromkeys(asked)], f"{key} {'string' if key == 'name' else 'int'}")
    return uff_table(spark, path).join(F.broadcast(wanted), key).select(key, "radius")


def periodic_axes(boundary) -> tuple[bool, ...]:
    """An axis is periodic if both its faces are."""
    return tuple(a == Boundary.PERIODIC and b == Boundary.PERIODIC for a, b in boundary)
