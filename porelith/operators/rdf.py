"""Radial distribution: binning of distances, g(r) curves, potentials and their inversion.

Curves are tables (atom_id, idx, r, g), one row a point.  A curve has a few thousand points, an analysis many
curves; all curves are handled at once, by atom_id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES
from ..plans.spatial import bucketed_join

#: Boltzmann's constant in kJ / (mol K) and the usual temperature.
K_B, TEMPERATURE = 0.0083144621, 300.0


def bin_distances(probes: DataFrame, atoms: DataFrame, bins: list, radii: dict[int, float] | None = None) -> DataFrame:
    """(label, bin, center, value): pairs of a probe and an atom of type ``label``, by distance.

    Distances below a bin set's start or from its end on, and from the type's radius on, do not count.  The
    pairs come from a bucketed join and are counted by partial aggregation.
    """
    from .bins import frame

    spark = atoms.sparkSession
    spec = spark.createDataFrame([(b.label, float(b.start), float(b.end), b.width, b.n, float(min(b.end, (radii or {}).get(b.label, math.inf)))) for b in bins], "label int, _start double, _end double, _width double, _n int, _max double")
    reach = max(min(b.end, (radii or {}).get(b.label, math.inf)) for b in bins)
    right = atoms.select(F.col("type").alias("label"), *(F.col(a).alias(f"c{a}") for a in AXES)).join(F.broadcast(spec), "label")
    d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES), F.lit(0.0))
    low, high = (tuple(F.col(f"c{a}") + s * F.col("_max") for a in AXES) for s in (-1, 1))
    pairs = bucketed_join(probes.select(*AXES), right, tuple(F.col(a) for a in AXES), low, high, 2 * reach, d2 < F.col("_max") * F.col("_max"))
    found = pairs.select("label", F.floor((F.sqrt(d2) - F.col("_start")) / F.col("_width")).cast("int").alias("bin"), "_n").where("bin >= 0 and bin < _n")
    counts = found.groupBy("label", "bin").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return frame(spark, bins).join(counts, ["label", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def normalised(curves: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Add g to curves of counts whose bins run from the least to the greatest r of each curve."""
    w = Window.partitionBy(*by)
    n, lo, hi, total = F.count(F.lit(1)).over(w), F.min("r").over(w), F.max("r").over(w), F.sum(value).over(w)
    place = F.row_number().over(w.orderBy("idx")) - 1
    width = (hi - lo) / n
    a = lo + place * width
    b = a + width
    shell = F.lit(4 / 3 * math.pi) * (b * b * b - a * a * a)
    g = F.col(value) / (shell * total) * F.lit(4 / 3 * math.pi) * hi * hi * hi
    return curves.withColumn("g", F.when(total > 0, g).otherwise(0.0))


def _interpolated(points: DataFrame, curves: DataFrame, x: str, y: str, at: str, out: str) -> DataFrame:
    """``points`` (atom_id, at) with ``out``, linear between a curve's points in order of x and constant beyond them.

    Each pair of points is a segment; the first and the last reach to infinity.  A curve's range is cut into as
    many cells as it has points.  A segment goes to the cells that it touches, which are twice the points in all,
    and a point meets the segments of its cell only.
    """
    w = Window.partitionBy("atom_id").orderBy(x, "idx")  # a curve's points
    finite = F.when(F.abs(F.col(x)) < float("inf"), F.col(x))
    span = curves.groupBy("atom_id").agg(F.min(finite).alias("_from"), F.max(finite).alias("_to"), F.count(F.lit(1)).alias("_cells"))
    span = span.withColumn("_width", F.when(F.col("_to") > F.col("_from"), (F.col("_to") - F.col("_from")) / F.col("_cells")).otherwise(1.0)).drop("_to")
    cell = lambda c: F.greatest(F.lit(0.0), F.least(F.floor((c - F.col("_from")) / F.col("_width")).cast("double"), F.col("_cells").cast("double"))).cast("long")
    seg = curves.select("atom_id", F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"), F.lag(x).over(w).alias("_xl"))
    first = seg.where("_xl is null").select("atom_id", F.lit(float("-inf")).alias("_lo"), F.col("_x0").alias("_hi"), F.col("_x0"), F.col("_y0"), F.lit(None).cast("double").alias("_x1"), F.col("_y0").alias("_y1"))
    rest = seg.select("atom_id", F.col("_x0").alias("_lo"), F.coalesce("_x1", F.lit(float("inf"))).alias("_hi"), "_x0", "_y0", "_x1", F.coalesce("_y1", "_y0").alias("_y1"))
    s = first.unionByName(rest).where("_lo < _hi").join(span, "atom_id").withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi"))))).alias("s")
    p = points.join(span, "atom_id").withColumn("_cell", cell(F.col(at))).drop("_from", "_width", "_cells").alias("p")
    joined = p.join(s, (F.col("p.atom_id") == F.col("s.atom_id")) & (F.col("p._cell") == F.col("s._cell")) & (F.col(f"p.{at}") >= F.col("s._lo")) & (F.col(f"p.{at}") < F.col("s._hi")))
    slope = (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    flat = F.col("_x1").isNull() | F.col("_y0").eqNullSafe(F.col("_y1"))
    return joined.select(*(F.col(f"p.`{c}`") for c in points.columns), F.when(flat, F.col("_y0")).otherwise(F.col("_y0") + slope * (F.col(f"p.{at}") - F.col("_x0"))).alias(out))


def interpolate(points: DataFrame, curves: DataFrame, at: str = "r", out: str = "g") -> DataFrame:
    """g at the given distances; constant beyond the curve's ends."""
    return _interpolated(points, curves, "r", "g", at, out)


def with_potential(curves: DataFrame, k_b: float = K_B, temperature: float = TEMPERATURE) -> DataFrame:
    """Add pmf = -k T ln g, infinite where g is 0."""
    return curves.withColumn("pmf", F.when(F.col("g") == 0, F.lit(float("inf"))).otherwise(F.lit(-k_b * temperature) * F.log("g")))


def bounds(curves: DataFrame, eps: float = 0.0) -> DataFrame:
    """(atom_id, lower, upper): the first index with g below eps, and the first with g above 1 or else that of the greatest g.

    Without a g below eps the lower index is 0.
    """
    one = F.min(F.when(F.col("g") > 1, F.col("idx")))
    most = F.min_by("idx", F.struct(-F.col("g"), F.col("idx")))
    return curves.groupBy("atom_id").agg(F.coalesce(F.min(F.when(F.col("g") < eps, F.col("idx"))), F.lit(0)).alias("lower"), F.coalesce(one, most).alias("upper"))


def min_radius_index(curves: DataFrame, eps: float = 0.001) -> DataFrame:
    """(atom_id, idx) of the first g below eps; an error when read for a curve without one."""
    return curves.groupBy("atom_id").agg(F.min(F.when(F.col("g") < eps, F.col("idx"))).alias("idx")).withColumn("idx", _found("idx"))


def max_radius_index(curves: DataFrame, value: float) -> DataFrame:
    """(atom_id, idx) of the first g above ``value``; an error when read for a curve without one."""
    return curves.groupBy("atom_id").agg(F.min(F.when(F.col("g") > value, F.col("idx"))).alias("idx")).withColumn("idx", _found("idx"))


def _found(column: str):
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit("no such g on the curve")).cast("int"))


def bounded(curves: DataFrame, limits: DataFrame | None = None, eps: float = 0.0) -> DataFrame:
    """The points from the lower index up to, but without, the upper one."""
    limits = bounds(curves, eps) if limits is None else limits
    return curves.join(limits, "atom_id").where("idx >= lower and idx < upper").drop("lower", "upper")


def radius_from_potential(points: DataFrame, curves: DataFrame, at: str = "pmf", out: str = "r") -> DataFrame:
    """r at the given potentials: curves sorted by pmf, linear between points, constant beyond them."""
    finite = with_potential(curves)
    return _interpolated(points, finite, "pmf", "r", at, out)
