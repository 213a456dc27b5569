"""Histograms on fixed bins: counts along an axis, masses, radial shells.

A set of bins is a ``BinSpec``; its values are a DataFrame (label, bin, center, value).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BinSpec:
    start: float
    end: float
    n: int
    label: int = 0
    name: str | None = None

    @property
    def width(self) -> float:
        return (self.end - self.start) / self.n

    @property
    def centers(self) -> list[float]:
        return [self.start + (i + 0.5) * self.width for i in range(self.n)]

    def place(self, value: Column) -> Column:
        """The number of a value's bin if bins went on beyond both ends."""
        return F.floor((value - F.lit(float(self.start))) / F.lit(self.width)).cast("int")

    def index(self, value: Column) -> Column:
        """The bin of a value, null outside [start, end)."""
        i = self.place(value)
        return F.when((i >= 0) & (i < self.n), i)

    def volumes(self, area: float | None = None, radial: bool = False) -> list[float]:
        """Shells if radial, width x area if an area is given, else ones."""
        if radial:
            edges = [self.start + i * self.width for i in range(self.n + 1)]
            return [sphere_volume(b) - sphere_volume(a) for a, b in zip(edges, edges[1:], strict=False)]
        return [self.width * area if area is not None else 1.0] * self.n


def sphere_volume(radius: float) -> float:
    return 4 / 3 * math.pi * radius**3


def make_bins(starts, ends, numbers, labels, names=None) -> list[BinSpec]:
    """One BinSpec a label."""
    names = names or [None] * len(labels)
    return [BinSpec(float(s), float(e), int(n), int(k), m) for s, e, n, k, m in zip(starts, ends, numbers, labels, names, strict=True)]


def frame(spark: SparkSession, bins: list[BinSpec]) -> DataFrame:
    """(label, bin, center) of every bin."""
    spec = spark.createDataFrame([(b.label, b.n, float(b.start), b.width) for b in bins], "label int, n int, start double, width double")
    every = spec.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return every.select("label", "bin", (F.col("start") + (F.col("bin") + 0.5) * F.col("width")).alias("center"))


def binned(df: DataFrame, bin_spec: BinSpec, coordinate: str, weight: str | None = None) -> DataFrame:
    """(label, bin, center, value): rows (or the sum of ``weight``) in each bin, zeros included; the right edge is out."""
    what = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    got = df.select(bin_spec.index(F.col(coordinate)).alias("bin"), *([weight] if weight else [])).where("bin is not null").groupBy("bin").agg(what.alias("value"))
    every = frame(df.sparkSession, [bin_spec])
    return every.join(F.broadcast(got) if bin_spec.n <= 100_000 else got, "bin", "left").select("label", "bin", "center", F.coalesce("value", F.lit(0.0)).alias("value"))


def count_locations(particles: DataFrame, axis: str, bin_spec: BinSpec) -> DataFrame:
    return binned(particles, bin_spec, axis)


def sum_masses(particles: DataFrame, axis: str, bin_spec: BinSpec, mass: str = "mass") -> DataFrame:
    return binned(particles, bin_spec, axis, mass)


def accumulated(*values: DataFrame) -> DataFrame:
    """The sum of several value tables, bin by bin."""
    out = values[0]
    for v in values[1:]:
        out = out.unionByName(v)
    return out.groupBy("label", "bin").agg(F.first("center").alias("center"), F.sum("value").alias("value"))


def with_volumes(values: DataFrame, bin_spec: BinSpec, area: float | None = None, radial: bool = False) -> DataFrame:
    """Add volume, the bin's."""
    if radial:
        lo = F.lit(float(bin_spec.start)) + F.col("bin") * bin_spec.width
        hi = lo + bin_spec.width
        return values.withColumn("volume", F.lit(4 / 3 * math.pi) * (hi * hi * hi - lo * lo * lo))
    return values.withColumn("volume", F.lit(bin_spec.volumes(area)[0]))


def radial_distribution(values: DataFrame, bin_spec: BinSpec) -> DataFrame:
    """Add g, the value by shell volume against the mean over the whole sphere; 0 throughout if all values are."""
    from pyspark.sql import Window

    total = F.sum("value").over(Window.partitionBy("label"))  # a row a bin
    shells = with_volumes(values, bin_spec, radial=True)
    g = F.col("value") / (F.col("volume") * total) * F.lit(sphere_volume(bin_spec.end))
    return shells.withColumn("g", F.when(total > 0, g).otherwise(0.0)).drop("volume")


def save(values: DataFrame, folder: str) -> None:
    """Tab-separated center and value of each label, one folder a label."""
    values.select("label", "bin", "center", "value").repartition("label").sortWithinPartitions("label", "bin").drop("bin").write.mode("overwrite").partitionBy("label").option("header", True).csv(folder, sep="\t")
