"""Shards by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's place is its fractional rank
(rank + v) / rows of the source, where v in [0, 1) is a second hash of the row.  The order of all rows is that
of the fractional ranks, cut into runs whose lengths differ by one at most.  A source has one row in each step
of 1 / rows, so every run holds each source in the proportion of the whole, to within about a row; rows of
sources too small to reach every shard are strewn at random, not heaped up.  The law is ``rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered_alike, positions, unit_hash
from ..plans.staging import staged
from .common import attached

SHARDS, SEED = 16, "shards-1"


def source_key(source: str) -> F.Column:
    """A key that is never null: ``s`` and the name, or ``n``."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def row_key(key: str, text: str, source: str) -> F.Column:
    """Id, source and MD5 of the text as one string, never null."""
    return F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), source_key(source), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """_id, size, text_crc32, shard, slot and _row (row_key) of each row of ``docs``.

    Size is the text's UTF-8 bytes plus 1; null texts count as empty.  Rows without a source are a source of
    their own; null ids hash like empty ones.  Rows alike in id, source and text are interchangeable and hash by
    their number, so one id, or one row, on any number of rows is strewn like any other.  Only these few columns
    are shuffled, never texts, however long; ranks come from counts of buckets, so no task sees a whole source.
    An empty table gives none; other columns of ``docs`` are not touched.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        source_key(source).alias("_source"),
        row_key(key, text, source).alias("_row"),
    )
    slim = numbered_alike(staged(slim, "slim"), "_row", "_nth")
    hashed = lambda start: unit_hash(F.lit(seed), "_row", "_nth", start=start)
    slim = staged(slim.select("_id", "size", "text_crc32", "_source", "_row", hashed(1).alias("_u"), hashed(14).alias("_v")), "hashed")
    ties = ["_id", "size", "text_crc32"]
    ranked = positions(slim, "_source", "_u", ties).withColumn("_f", (F.col("pos") + F.col("_v")) / F.col("n")).drop("pos", "n", "_v")
    ranked = staged(ranked.withColumn("_all", F.lit(0)), "ranked")
    placed = positions(ranked, "_all", "_f", ["_source", "_u", *ties])
    shard = F.expr(f"(pos * {shards}) div n")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"pos - (shard * n + {shards - 1}) div {shards}")).select("_id", "size", "text_crc32", "shard", "slot", "_row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, per_file: int = 100_000, **names) -> None:
    """Write ``docs`` with all their columns under ``path``/shard=K, files in order of their slots, about ``per_file`` rows each.

    Columns of ``docs`` named shard or slot give way to those found.
    """
    key, text, source = (names.get(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source")))
    found = staged(sharded(docs, shards, **names).select("_row", "shard", "slot"), "shards")
    both = attached(docs, found, {"_row": row_key(key, text, source)}, ["shard", "slot"])
    both.repartition("shard", F.floor(F.col("slot") / per_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
