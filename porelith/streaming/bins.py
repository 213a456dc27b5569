"""Bins that accumulate over frames: a streaming aggregation whose state is one row a label and bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bins import BinSpec


def binned_stream(frames: DataFrame, bin_spec: BinSpec, coordinate: str, label: Column | None = None, weight: str | None = None, event_time: str | None = None, delay: str = "10 minutes", window: str | None = None, beyond: bool = False) -> DataFrame:
    """(label, bin, value) and, with ``window``, its start: counts or sums so far.

    With an event time, rows later than ``delay`` are dropped and windows beyond it leave the state.  With ``beyond``
    every row counts: bins go on beyond both ends, and rows without a coordinate have the bin null.
    """
    rows = frames.withWatermark(event_time, delay) if event_time else frames
    at = F.col(coordinate)
    rows = rows.withColumn("label", label if label is not None else F.lit(bin_spec.label)).withColumn("bin", bin_spec.place(at) if beyond else bin_spec.index(at))
    rows = rows if beyond else rows.where("bin is not null")
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    if not window:
        return rows.groupBy("label", "bin").agg(value.alias("value"))
    by = rows.groupBy(F.window(event_time, window).alias("window"), "label", "bin").agg(value.alias("value"))
    return by.select(F.col("window.start").alias("start"), "label", "bin", "value")


def to_memory(values: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run over all that is there now and stop; the table ``name`` holds the result."""
    return values.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


def to_folder(values: DataFrame, folder: str) -> DataFrame:
    """Run over all that is there now and stop; the last state as a table that the executors write, however many bins it has."""
    kept = []

    def keep(batch: DataFrame, number: int) -> None:
        kept.append(f"{folder}/state-{number}")
        batch.write.mode("overwrite").parquet(kept[-1])

    run = values.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    spark = values.sparkSession
    return spark.read.schema(values.schema).parquet(kept[-1]) if kept else spark.createDataFrame([], values.schema)


def append_particles(spark, folder: str, schema: str) -> DataFrame:
    """A stream of particle frames that arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)
