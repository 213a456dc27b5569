"""Text formats of particles and curves, read by Spark.

Only headers (a handful of lines) reach the driver; rows are split and cast by the executors.  Paths may be
of any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grid import AXES
from ..operators.rdf import normalised
from ..plans.joins import keyed_join
from ..plans.staging import staged


def require_path(spark: SparkSession, path: str, folder: bool = False) -> None:
    """FileNotFoundError unless there is such a file (or folder)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) or folder and not fs.getFileStatus(target).isDirectory():
        raise FileNotFoundError(path)


def require_count(files: int, expected: int) -> None:
    if files != expected:
        raise ValueError(f"{files} files where {expected} are expected")


def _numbered(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """(file, line, value): lines, or those that meet ``only``, with their place among them in their file.

    Files are split like any text.  Each split counts its lines; a line's place is its place in the split plus the
    counts of the splits before, so no task reads a whole file (but for compressed ones).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value")
    lines = (lines if only is None else lines.where(only)).withColumn("_m", F.monotonically_increasing_id())
    per = staged(lines.groupBy("file", "_at").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_c")), "splits")
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    per = per.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first"))
    total = per.agg(F.sum("_c"), F.count(F.lit(1))).first()
    placed = keyed_join(lines, per, ["file", "_at"], "_c", int(total[0] or 0), int(total[1]))
    return placed.select("file", (F.col("_o") + F.col("_m")).alias("line"), "value")


def _head(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """(file, line, value) of the first lines of each file."""
    return _numbered(spark, path).where(F.col("line") < lines)


def _number(text: Column, what: str) -> Column:
    found = text.try_cast("double")
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not a number: "), F.coalesce(text, F.lit("null")))).cast("double"))


def read_xyzr(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[tuple[float, float], ...]]:
    """Spheres (pid, x, y, z, r) and the box: three lines ``min max``, then a line ``x y z r`` a sphere.

    ValueError for a bad header; a bad sphere line fails the rows' reading.  Blank lines are skipped.
    """
    require_path(spark, path)
    head = [r["value"].split() for r in spark.read.text(path).limit(3).collect()]
    if len(head) < 3 or any(len(h) != 2 for h in head):
        raise ValueError("the first three lines are the bounds of x, y and z")
    box = tuple((float(a), float(b)) for a, b in head)
    words = F.split(F.trim("value"), r"\s+")
    lines = _numbered(spark, path).where("line >= 3 and trim(value) != ''").select("line", words.alias("w"))
    arity = F.when(F.size("w") == 4, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("a sphere is x, y, z and r, line "), F.col("line").cast("string"))).cast("array<string>"))
    rows = lines.select("line", arity.alias("w")).select((F.col("line") - 3).cast("long").alias("pid"), *(_number(F.col("w")[i], a).alias(a) for i, a in enumerate((*AXES, "r"))))
    return rows, box


LAMMPS = "file string, timestep double, id bigint, mol int, type int, mass double, charge double, x double, y double, z double"


class LammpsReader(DataSourceReader):
    """One partition a file; rows are read line by line, plain or gzip, from a path that workers can open."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        if not files:
            raise FileNotFoundError(self.path)
        return [InputPartition(f) for f in files]

    def read(self, partition):
        import gzip

        with (gzip.open if partition.value.endswith(".gz") else open)(partition.value, "rt") as lines:
            yield from parse_lammps(partition.value, lines)


class LammpsSource(DataSource):
    """``spark.read.format("lammps_dump").load(path)``."""

    @classmethod
    def name(cls):
        return "lammps_dump"

    def schema(self):
        return LAMMPS

    def reader(self, schema):
        return LammpsReader(self.options)


def parse_lammps(name: str, lines):
    """Rows of the first frame of a dump; lines of fewer than eight words are skipped."""
    head = [next(lines) for _ in range(9)]
    time, left = float(head[1].split()[0]), int(head[3].split()[0])
    for line in lines:
        if left == 0:
            return
        w = line.split()
        if len(w) < 8:
            continue
        left -= 1
        yield (name, time, int(w[0]), int(w[1]), int(w[2]), float(w[3]), float(w[4]), float(w[5]), float(w[6]), float(w[7]))


def read_lammps(spark: SparkSession, path: str, type_map: dict[tuple[int, float], int] | None = None) -> DataFrame:
    """Atoms of dump files (plain or .gz): file, timestep, id, mol, type, mass, charge, x, y, z.

    Spark's text reader opens the files, so any of its file systems will do.  ``type_map`` gives new types by
    (type, charge); an atom that it lacks fails the reading.
    """
    require_path(spark, path)
    w = F.split(F.trim("value"), r"\s+")
    head = _head(spark, path, 9).where("line in (1, 3)").groupBy("file").agg(F.max(F.when(F.col("line") == 1, F.trim("value"))).cast("double").alias("timestep"), F.max(F.when(F.col("line") == 3, F.trim("value"))).cast("long").alias("_n"), F.lit(1).alias("_one"))
    head = staged(head, "heads")
    # atoms are the lines of eight words and more without a heading; beyond the announced number they belong to later frames
    atoms = _numbered(spark, path, (F.size(w) >= 8) & ~F.trim("value").startswith("ITEM:"))
    first = keyed_join(atoms, head, ["file"], "_n", int(head.agg(F.sum("_n")).first()[0] or 0)).where("line < _n").select("file", "timestep", w.alias("w"))
    out = first.select(
        "file", "timestep", F.col("w")[0].cast("long").alias("id"), F.col("w")[1].cast("int").alias("mol"), F.col("w")[2].cast("int").alias("type"),
        F.col("w")[3].cast("double").alias("mass"), F.col("w")[4].cast("double").alias("charge"), *(F.col("w")[5 + i].cast("double").alias(a) for i, a in enumerate(AXES)),
    )
    return out if type_map is None else map_types(out, type_map)


def map_types(atoms: DataFrame, type_map: dict[tuple[int, float], int]) -> DataFrame:
    """New types by exact (type, charge)."""
    table = atoms.sparkSession.createDataFrame([(int(t), float(q), int(n)) for (t, q), n in type_map.items()], "type int, charge double, _new int")
    joined = atoms.join(F.broadcast(table), ["type", "charge"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no new type for type and charge"), F.col("type").cast("string"), F.col("charge").cast("string"))).cast("int")
    return joined.withColumn("type", F.coalesce("_new", missing)).select(*atoms.columns)


def lammps_box(spark: SparkSession, path: str) -> DataFrame:
    """(file, axis, lo, hi) of each dump."""
    require_path(spark, path)
    w = F.split(F.trim("value"), r"\s+")
    return _head(spark, path, 8).where("line >= 5").select("file", (F.col("line") - 5).alias("axis"), w[0].cast("double").alias("lo"), w[1].cast("double").alias("hi"))


def read_atom_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, element, name) of a file with one atom a line."""
    require_path(spark, path)
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(w[0].cast("int").alias("id"), w[1].alias("element"), w[2].alias("name"))


def read_curves(spark: SparkSession, folder: str) -> DataFrame:
    """(atom_id, name, idx, r, value) from ``atom_map.txt`` and one ``<name>.rdf`` of two columns an atom."""
    folder = folder.rstrip("/")
    require_path(spark, folder, folder=True)
    names = read_atom_map(spark, f"{folder}/atom_map.txt").select(F.col("id").alias("atom_id"), "name")
    w = F.split(F.trim("value"), r"\s+")
    lines = _numbered(spark, f"{folder}/*.rdf").where("trim(value) != ''")
    name = F.regexp_extract("file", r"([^/]+)\.rdf$", 1)
    curves = lines.select(name.alias("name"), F.col("line").alias("idx"), w[0].cast("double").alias("r"), w[1].cast("double").alias("value"))
    return curves.join(F.broadcast(names), "name").select("atom_id", "name", "idx", "r", "value")


def read_rdf(spark: SparkSession, folder: str) -> DataFrame:
    """Radial distribution curves: atom_id, name, idx, r, g."""
    return read_curves(spark, folder).withColumnRenamed("value", "g")


def read_binned_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of counts, normalised to g(r): atom_id, name, idx, r, value, g.

    The bins of an atom run from its first to its last r.
    """
    return normalised(read_curves(spark, folder), by=["atom_id"])
