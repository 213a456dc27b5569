"""Mix sources to target weights by systematic sampling.

Every source gets a target of words: all words shared out by weight, but no more than CAP times the source's
own, the excess going to the others by weight.  A document's expected copies are target / size of its source.
The documents of a source stand in order of size class (quarter octaves) and seeded hash; the expected
copies are summed along that order, a random offset is added, and a document is emitted once for each integer
that its interval crosses.  The order by size makes every class count in proportion, so the words taken come
close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import keyed_join
from ..plans.names import unused
from ..plans.ranks import numbered_alike, places, positions, unit_hash
from ..plans.staging import staged
from .common import attached
from .sharding import row_key, source_key

CAP, SEED, WEIGHTS = 3, "mix-1", (1, 2, 3)


def word_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def size_class(size: str) -> Column:
    """The top three bits of size + 1 and their place: four classes an octave."""
    return F.expr(f"length(bin({size} + 1)) * 8 + shiftright({size} + 1, greatest(length(bin({size} + 1)) - 3, 0))").cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source key, source_size and target from (_source, _name, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn.  The share of a unit of weight rises as
    sources reach their cap and hand on the excess, until none is above; each round is one sum over the sources.
    """
    ranked = places(sizes, [F.col("_name").isNull(), F.col("_name")])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).cast("long")
    weighed = staged(ranked.select("_source", "source_size", w.alias("_w")), "weighed")
    limit = cap * F.col("source_size")
    whole = weighed.agg(F.sum("source_size"), F.sum("_w")).first()
    total, weight = int(whole[0] or 0), int(whole[1] or 0)
    unit, capped = total / weight if weight else 0.0, 0
    while True:
        n, size, w = weighed.where(F.lit(unit) * F.col("_w") > limit).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("_w")).first()
        if n == capped or w == weight:
            break
        unit, capped = (total - cap * size) / (weight - w), n
    return weighed.select("_source", "source_size", F.least(limit.cast("double"), F.lit(unit) * F.col("_w")).alias("target"))


def mixed(docs: DataFrame, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """_id, size (words), _source, source_size, target, copies and _row (row_key) of each row of ``docs``.

    Null and empty texts have size 0 and take part.  A source without words has target 0 and no copies.  Rows
    without a source are one source; null ids hash like empty ones.  Rows alike in id, source and text are
    interchangeable and hash by their number.  Texts, however long, are read once and never shuffled; an empty
    table gives no rows; other columns of ``docs`` are not touched.  The same table and seed give the same copies.
    """
    slim = docs.select(F.col(key).alias("_id"), word_count(text).alias("size"), F.col(source).cast("string").alias("_name"), source_key(source).alias("_source"), row_key(key, text, source).alias("_row"))
    slim = numbered_alike(staged(slim, "slim"), "_row", "_nth")
    slim = slim.withColumn("_class", size_class("size")).withColumn("_u", unit_hash(F.lit(seed), "_row", "_nth"))
    slim = staged(slim.select("_id", "size", "_name", "_source", "_class", F.concat_ws("|", F.col("_class").cast("string"), "_source").alias("_key"), "_u", "_row"), "hashed")
    by_class = staged(slim.groupBy("_key", "_source", "_name", "_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size")), "classes")
    goal = targets(by_class.groupBy("_source", "_name").agg(F.sum("_size").alias("source_size")))
    first = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)  # a few hundred classes at most
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    per = by_class.withColumn("_first", F.coalesce(F.sum("_n").over(first), F.lit(0))).join(goal, "_source").select("_key", "_n", "_first", "source_size", "target", rate.alias("_rate"), unit_hash(F.lit(seed), F.lit("offset"), F.col("_name")).alias("_offset"))
    per = staged(per, "targets")
    placed = positions(slim.select("_id", "size", "_source", "_key", "_u", "_row"), "_key", "_u", ["_id", "size"]).drop("n")
    total = per.agg(F.sum("_n"), F.count(F.lit(1))).first()
    full = keyed_join(placed, per, ["_key"], "_n", int(total[0] or 0), int(total[1]))
    at = F.col("_first") + F.col("pos")
    copies = F.floor((at + 1) * F.col("_rate") + F.col("_offset")) - F.floor(at * F.col("_rate") + F.col("_offset"))
    return full.select("_id", "size", "_source", "source_size", "target", copies.cast("long").alias("copies"), "_row")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, each as many times as the mix takes it."""
    key, text, source = (options.get(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source")))
    found = staged(mixed(docs, **options).select("_row", F.col("copies").alias(copies := unused(docs, "__copies"))), "copies")
    both = attached(docs, found, {"_row": row_key(key, text, source)}, [copies], f"{copies} > 0")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return both.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copies)).select(*names)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as many times as the mix takes it, 3 times at most; an empty table gives none."""
    return repeated(docs)
