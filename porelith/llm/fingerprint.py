"""Document fingerprints by a threshold-scaled sketch.

A text's shingles are its windows of five words (a shorter text is one shingle).  The sketch keeps every
shingle hash below a fixed fraction of the hash range, so sketches of any two texts, however unequal, are
samples of the same shingles: their union is the sketch of the union, and the share of one text's kept hashes
that another also keeps estimates without bias how much of it the other contains.  For texts so short that no
hash is kept, the least hash of all (the anchor, which merges by minimum) stands in.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

WORDS = 5
#: The fraction kept is 1 / SCALE.
SCALE = 8
PER_RANGE = 100_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """xxhash64 of each window of ``words`` words; of all words of a shorter text; none without a word."""
    ws = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.transform(
        F.array(ws),
        lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """struct(anchor bigint, kept array<bigint>): the least hash and the sorted hashes below the threshold."""
    limit = F.lit(-(2**63) + 2**64 // scale)
    return F.transform(F.array(shingle_hashes(text, words)), lambda h: F.struct(F.array_min(h).alias("anchor"), F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit))).alias("kept")))[0]


def shown(s: Column) -> Column:
    """The sketch as text: anchor, ``:`` and the kept hashes, 16 hexadecimal digits each; empty without a word."""
    return F.coalesce(F.concat(F.lpad(F.hex(s["anchor"]), 16, "0"), F.lit(":"), F.array_join(F.transform(s["kept"], F.hex), "")), F.lit(""))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has: 1 if both have none, 0 if one has none."""
    kept = F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"])
    anchors = (a["anchor"].eqNullSafe(b["anchor"])).cast("double")
    return F.when(F.size(a["kept"]) > 0, kept).otherwise(anchors).cast("double")


def merged(sketches: DataFrame, group: str, s: str = "sketch") -> DataFrame:
    """(group, hash): the sketch of each group's union, one row a hash, so that no group has to fit one task."""
    return sketches.select(group, F.explode(f"{s}.kept").alias("hash")).distinct()


#: What tells places in the order apart; null ids stand first.
PLACE = ["_some", "_id", "_h"]


def _placed(docs: DataFrame, key: str, text: str) -> tuple[list[Column], Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.col(key).isNotNull().alias("_some"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"), F.xxhash64(body).alias("_h")], body


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PLACE, _n, _prev (PLACE and _n as a struct) and _rows: each distinct (id, text) and the one before, in ascending order, the last before the first.

    Ids and hashes only: the order is laid out in ranges, each sorted by itself, and the ends of the ranges
    are matched in one small table.
    """
    place, body = _placed(docs, key, text)
    slim = docs.select(*place, F.length(body).cast("long").alias("_n"))
    slim = staged(slim.groupBy(*PLACE).agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")), "slim")
    n = slim.count()
    ranged = staged(slim.repartitionByRange(max(1, -(-n // PER_RANGE), min(32, -(-n // 1000))), *PLACE).withColumn("_p", F.spark_partition_id()), "ranged")
    row = F.struct(*PLACE, "_n")
    across = Window.orderBy("_p")  # one row a range
    last = F.last("_end").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ranged.groupBy("_p").agg(F.max(row).alias("_end")).select("_p", F.coalesce(F.lag("_end").over(across), last).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*PLACE)
    prev = ranged.withColumn("_prev", F.lag(row).over(within)).join(ends, "_p").withColumn("_prev", F.coalesce("_prev", "_before"))
    return prev.select(*PLACE, "_n", "_prev", "_rows")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PLACE, text, its sketch, edited text and the next document's sketch, one row for each row of ``docs``.

    The edit replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next
    document in ascending order of id.  Rows alike in id and text are one place in that order; different
    texts of one id follow by hash.  Texts and their sketches are shuffled once, and of each the piece and the
    sketch that its predecessor needs.
    """
    order = staged(neighbours(docs, key, text), "order")
    place, body = _placed(docs, key, text)
    full = docs.select(*place, body.alias("_text"), sketch(body).alias("_own"))
    again = not order.where("_rows > 1").isEmpty()
    full = full if again else full.repartition(*PLACE)  # one exchange for both joins; adaptive execution splits only its own
    heads = full.join(order, PLACE).select(*(F.col(f"_prev.{c}").alias(c) for c in PLACE), F.expr("substring(_text, 1, cast(_prev._n div 4 as int))").alias("_head"), F.col("_own").alias("_next"))
    if again:
        heads = heads.dropDuplicates(PLACE)
    cut = "concat(substring(_text, 1, cast(length(_text) - length(_text) div 4 as int)), _head)"
    return full.join(heads, PLACE).select(*PLACE, "_text", "_own", F.expr(cut).alias("_edited"), "_next")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts' fingerprints, those of the edited texts, and how much of each text's the edited and the next one contain.

    Null texts count as empty, null ids come first and come back as null.  Repeated rows are one place and get
    the same; an empty table gives no rows; other columns of ``docs`` are not touched.  Texts are whole, however
    long: a row's hashes take about ten times its words in bytes.
    """
    rows = edited(docs, key, text).withColumn("_b", sketch(F.col("_edited")))
    return rows.select(
        F.when(F.col("_some"), F.col("_id")).alias(key),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("_own")).alias("fingerprint"),
        shown(F.col("_b")).alias("edited_fingerprint"),
        containment(F.col("_own"), F.col("_b")).alias("near_edited"),
        containment(F.col("_own"), F.col("_next")).alias("near_next"),
    )
