"""Porosimetry, pore sizes and drainage on one persisted distance table.

Erosion by a radius is a filter on the distance to the solid, so the distance is computed once for all
radii.  The dilations of a pore-size distribution go through the line passes together, one column a radius.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, GridSpec
from ..plans.staging import dropped, staged
from . import components, voxels
from .distance import squared_distance_to, squared_edt
from .morphology import check_radii

log = logging.getLogger("porelith")

#: Columns that go through the line passes at once.
RADII_AT_ONCE = 16
MODES = ("hybrid", "distance", "morph")


def pore_radii(low: float, high: float, n: int, spacing: str = "linear") -> list[float]:
    """``n`` radii from high to low, evenly spaced or evenly in the logarithm."""
    if n <= 0:
        raise ValueError("at least one radius is needed")
    if low >= high:
        raise ValueError("the least radius must be below the greatest")
    if spacing == "linear":
        return np.linspace(high, low, n).tolist()
    if spacing == "log":
        if low < 1:
            raise ValueError("logarithmic spacing starts at 1 or above")
        return np.logspace(math.log10(high), math.log10(low), n).tolist()
    raise ValueError(f"spacing is linear or log, not {spacing}")


def with_distance(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """x, y, z, v and d2, staged for reuse; d2 is infinite without any solid."""
    found = squared_edt(img.select(*AXES, v), grid, v, "d2")
    return staged(found.withColumn("d2", F.coalesce("d2", F.lit(float("inf")))), "distance")


def _pair(radius) -> tuple[float, float]:
    if isinstance(radius, (int, float)):
        return float(radius), float(radius)
    if isinstance(radius, (list, tuple)) and len(radius) == 2:
        return float(radius[0]), float(radius[1])
    raise ValueError("a radius is a number or an erosion and a dilation radius")


def _cores(base: DataFrame, grid: GridSpec, radius: float, inlet: bool, multiphase: DataFrame | None = None) -> DataFrame:
    """(x, y, z, _core): 1 at the centres of the balls that fit, and reach from the inlet if asked for."""
    core = base.select(*AXES, (F.col("d2") > radius * radius).cast("int").alias("_core"))
    if inlet:
        core = components.inlet_connected(core, grid, v="_core")
    if multiphase is not None and voxels.phase_exists(multiphase, 1):
        open_phase = components.inlet_connected(multiphase.select(*AXES, "v"), grid, 1).select(*AXES, F.col("v").alias("_open"))
        core = core.join(open_phase, list(AXES)).withColumn("_core", F.when(F.col("_open") == 1, F.col("_core")).otherwise(0)).drop("_open")
    return core


def porosimetry(img: DataFrame, grid: GridSpec, radius, inlet: bool = False, multiphase: DataFrame | None = None, mode: str = "hybrid", v: str = "v", distance: DataFrame | None = None) -> DataFrame:
    """1 where a ball that fits the pore space reaches.  ``distance``: what with_distance gave for the image.

    ``inlet``: balls' centres must connect to an inlet face.  ``multiphase`` (x, y, z, v): where it has phase
    1, centres must also lie in inlet-connected phase 1.  All modes give the same image.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    shrink, grow = _pair(radius)
    check_radii(grid, [shrink, grow])
    core = _cores(with_distance(img, grid, v) if distance is None else distance, grid, shrink, inlet, multiphase)
    near = squared_distance_to(core.withColumn("_seed", F.col("_core") == 1), grid, ["_seed"], ["_d2"], [grow])
    out = near.select(*AXES, (F.col("_d2") <= grow * grow).cast("int").alias(v))
    return voxels.set_walls(out, grid, v)


def default_radii(base: DataFrame, grid: GridSpec, n: int) -> list[float]:
    greatest = base.where("d2 < double('inf')").agg(F.sqrt(F.max("d2")).alias("m")).first()["m"] or 0.0
    return pore_radii(float(np.nextafter(min(grid.resolution), np.inf)), greatest * (1 - 1e-6), n)


def pore_size_distribution(img: DataFrame, grid: GridSpec, radii=None, num_radii: int = 25, inlet: bool = False, mode: str = "hybrid", v: str = "v") -> DataFrame:
    """(x, y, z, radius): the greatest of the radii whose opening covers a pore voxel, 0 for none and in solid."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    base = with_distance(img, grid, v)
    if radii is None:
        radii = default_radii(base, grid, num_radii)
    radii = sorted({float(r) for r in ([radii] if isinstance(radii, (int, float)) else radii)}, reverse=True)
    check_radii(grid, radii)
    out = base.withColumn("radius", F.lit(0.0))
    for i in range(0, len(radii), RADII_AT_ONCE):
        some = radii[i : i + RADII_AT_ONCE]
        seeds, outs = [f"_s{k}" for k in range(len(some))], [f"_o{k}" for k in range(len(some))]
        if inlet:  # a bit for each radius whose balls reach the voxel from the inlet
            parts = [_cores(base, grid, r, True).where("_core = 1").select(*AXES, F.lit(1 << k).alias("_bits")) for k, r in enumerate(some)]
            bits = reduce(DataFrame.unionByName, parts).groupBy(*AXES).agg(F.bit_or("_bits").alias("_bits"))
            out = staged(out.join(bits, list(AXES), "left"), "cores")
            fits = [F.coalesce(F.col("_bits").bitwiseAND(1 << k), F.lit(0)) != 0 for k in range(len(some))]
        else:
            fits = [F.col("d2") > r * r for r in some]
        marked = out.withColumns(dict(zip(seeds, fits, strict=True))).drop("_bits")
        near = squared_distance_to(marked, grid, seeds, outs, list(some))
        covered = [F.when(F.col(o) <= r * r, F.lit(r)) for o, r in zip(outs, some, strict=True)]
        out = near.withColumn("radius", F.greatest("radius", F.coalesce(*covered, F.lit(0.0)))).drop(*outs)
    return out.select(*AXES, F.when(F.col(v) == 1, F.col("radius")).otherwise(0.0).alias("radius"))


def pore_size_curve(sizes: DataFrame) -> DataFrame:
    """(radius, n, pdf, cdf) of an image of pore sizes, zeros left out; cdf is the share of voxels with at least the radius."""
    from pyspark.sql import Window

    counts = sizes.where("radius > 0").groupBy("radius").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    down = Window.orderBy(F.desc("radius")).rowsBetween(Window.unboundedPreceding, 0)  # a row a radius
    return counts.select("radius", "n", (F.col("n") / total).alias("pdf"), (F.sum("n").over(down) / total).alias("cdf"))


def probe_radius(pressure: float, gamma: float = 1.0, contact_angle: float = 0.0) -> float:
    return 0.0 if pressure == 0 else 2 * gamma / pressure * math.cos(math.radians(contact_angle))


def capillary_pressure(radius: float, gamma: float = 1.0) -> float:
    return 2 * gamma / radius


def multiphase_constant(img: DataFrame, phase: int = 1, v: str = "v") -> DataFrame:
    """``phase`` in the pores, 0 in the solid."""
    return img.withColumn(v, F.when(F.col(v) == 1, F.lit(phase)).otherwise(F.lit(0)))


def update_phases(img: DataFrame, grid: GridSpec, v: str = "v") -> DataFrame:
    """The reservoirs are filled with phase 1."""
    return voxels.set_reservoir(img, grid, 1, v)


def drainage(img: DataFrame, grid: GridSpec, pressures, gamma: float = 1.0, contact_angle: float = 0.0, method: str = "standard", mode: str = "hybrid", phases: DataFrame | None = None, save: str | None = None, v: str = "v") -> tuple[DataFrame, DataFrame]:
    """Morphological drainage: (step, pressure, saturation of phase 2) and the last phase image.

    ``img`` is the pore space; ``phases`` the start, phase 2 in all pores by default.  At each pressure, in
    ascending order, phase 1 enters where a ball of the radius that belongs to the pressure gets from the
    inlet and phase 2 is still connected to the outlet.  Every step's image is staged, so lineage stays short.
    ``save``: a folder for the images, one Parquet table a step.
    """
    pressures = [float(pressures)] if isinstance(pressures, (int, float)) else sorted(float(p) for p in pressures)
    if method not in ("standard", "contact_angle", "extended_contact_angle"):
        raise ValueError(f"unknown method: {method}")
    if method == "standard" and contact_angle != 0:
        raise ValueError("the standard method has a contact angle of 0")
    if method != "standard" and contact_angle == 0:
        log.warning("a contact angle of 0 gives the standard method's results")
    base = with_distance(img, grid, v)
    bound = base.agg(F.max("d2").alias("m")).first()["m"]
    greatest = math.sqrt(bound) if bound is not None else 0.0
    start = phases.select(*AXES, F.col("v")) if phases is not None else multiphase_constant(img.select(*AXES, F.col(v).alias("v")), 2)
    now = staged(start, "phases")
    found = []
    for step, p in enumerate(pressures):
        shrink = probe_radius(p, gamma, contact_angle)
        grow = shrink * abs(math.cos(math.radians(contact_angle))) if method == "extended_contact_angle" else shrink
        if min(shrink, grow) >= min(grid.resolution) and max(shrink, grow) <= greatest:
            entered = porosimetry(img, grid, (shrink, grow), True, now, mode, v, base).select(*AXES, F.col(v).alias("_in"))
            wetting = components.outlet_connected(now, grid, 2).select(*AXES, F.col("v").alias("_wet"))
            new = now.join(entered, list(AXES)).join(wetting, list(AXES))
            new = new.select(*AXES, F.when((F.col("_in") == 1) & (F.col("_wet") == 2), F.lit(1)).otherwise(F.col("v")).alias("v"))
        else:
            new = now
        new = staged(update_phases(new, grid, "v"), "phases")
        if new is not now:
            dropped(now)
        now = new
        if save:
            now.write.mode("overwrite").parquet(f"{save}/step-{step}")
        found.append((step, p, voxels.saturation(now, grid, 2).first()["saturation"]))
    table = img.sparkSession.createDataFrame(found, "step int, pressure double, saturation double")
    return table, now
