"""Positions in a total order within keys, without one task seeing a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import keyed_join
from .staging import staged

#: Rows that one window group should hold; a key with more is cut into several buckets.
PER_BUCKET = 512
#: Buckets whose counts are summed in one window group; above it the sums of such groups are summed.
FAN = 4096
#: Rows of one range of an order over a whole table.
PER_RANGE = 100_000


def unit_hash(*parts: Column | str, start: int = 1) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``|``: 52 bits, the same in every SQL engine.

    ``start``: the first of the 13 hexadecimal digits taken; 1 and 14 give independent numbers.
    """
    cols = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), start, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _before(column: str, keys: list[str], order: str) -> Column:
    """The sum of ``column`` over the rows of the same keys that come before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def positions(df: DataFrame, key: str, unit: str, ties: list[str], out: str = "pos", size: str = "n") -> DataFrame:
    """Add ``out``, the 0-based place of each row within ``key`` by (``unit``, ``ties``), and ``size``, the rows of the key.

    ``unit`` is spread over [0, 1), so a key of n rows falls into ceil(n / PER_BUCKET) buckets of about
    equal size.  Only the buckets' counts are summed along a key, in two levels; the rows are ranked within a
    bucket.  So even a key of 10 ** 11 rows is summed in groups of a few ten thousand numbers.
    ``df`` is read three times and should be staged; ``key`` must not be null.
    """
    counts = staged(df.groupBy(key).agg(F.count(F.lit(1)).alias(size)), "counts")
    totals = counts.agg(F.sum(size), F.count(F.lit(1))).first()
    total, keys = int(totals[0] or 0), int(totals[1])
    with_n = keyed_join(df, counts, [key], size, total, keys)
    bucketed = with_n.withColumn("_b", F.least(F.floor(F.col(unit) * F.ceil(F.col(size) / PER_BUCKET)), F.ceil(F.col(size) / PER_BUCKET) - 1))
    per = bucketed.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.floor(F.col("_b") / FAN))
    above = per.groupBy(key, "_g").agg(F.sum("_c").alias("_c"))
    above = above.select(key, "_g", _before("_c", [key], "_g").alias("_og"))
    inside = per.select(key, "_g", "_b", _before("_c", [key, "_g"], "_b").alias("_ob"))
    offsets = inside.join(above, [key, "_g"]).select(key, "_b", (F.col("_og") + F.col("_ob")).alias("_o"))
    within = Window.partitionBy(key, "_b").orderBy(unit, *ties)
    ranked = bucketed.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(offsets, [key, "_b"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def numbered_alike(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` (staged) with ``out``, the 0-based number of each row among those of the same ``key``, which must not be null.

    Which row gets which number is left open.  Counts by key and input partition are summed along a key, and
    rows are numbered within one key of one partition, so no task sees a whole key.
    """
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    rows = staged(df.withColumn("_p", F.spark_partition_id()), "parts")
    per = rows.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_c")).select(key, "_p", _before("_c", [key], "_p").alias("_o"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_p").orderBy(F.lit(0))) - 1)
    return local.join(per, [key, "_p"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")


def places(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """``df`` with ``out``, the 0-based place of each row in ``order``, a total one; the order is laid out in ranges, each sorted by itself."""
    ranges = max(1, -(-df.count() // PER_RANGE))
    ranged = staged(df.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.floor(F.col("_p") / FAN))
    above = per.groupBy("_g").agg(F.sum("_c").alias("_c")).select("_g", _before("_c", [], "_g").alias("_og"))
    starts = per.select("_g", "_p", _before("_c", ["_g"], "_p").alias("_op")).join(above, "_g").select("_p", (F.col("_og") + F.col("_op")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", rank).join(starts, "_p").withColumn(out, F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")
