"""Near-duplicate detection: BagMinHash signatures, bands, verified multiset overlap, classes.

A text is the multiset of its windows of five words (a shorter text is one window).  Likeness is the
weighted Jaccard index, the sum of the lesser counts over the sum of the greater ones; two texts are linked
from 0.8 on.

Signature.  Each window starts a hierarchy of Poisson processes over its discretised weight axis: one for
the weight interval [0, 1), one for [1, 2), [2, 4), [4, 8) and so on as far as its count reaches.  A process
emits points in order of time at a rate proportional to the interval's width; every point falls on one of
the SIZE signature components and on one place of the interval, and counts if that place lies below the
window's count.  A component keeps its earliest point.  Two texts agree in a component with the probability
of their likeness.  Only points before a time that depends on the text's weight are made; the rare text with
a component left empty is done again with twice that time, so the result is exact.

Bands of components find candidates; their width follows the threshold.  In a bucket nobody is compared with everybody: first all members
are compared with one pivot, that with most company elsewhere, and those linked to it are in its class.  Most
buckets are settled then: their members are of one class, or the triangle inequality of the distance
1 - likeness holds those of different classes apart.  Members of the other buckets are joined on their rarest
windows: two texts that are linked must share one among the first few in order of frequency, fewer for the
shorter text, and early enough in both.  That filter is exact, so no link between members of a bucket is lost,
and crowds that only share common passages never meet.  No bucket, however large, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.joins import keyed_join
from ..plans.names import unused
from ..plans.staging import dropped, staged
from .textblocks import BLOCK_BYTES, Block, blocks, each_block, mix

WORDS, LIKENESS = 5, 0.8
#: Components of a signature, and how likely at most a pair at the threshold is to share no band.
SIZE, MISSED = 120, 1e-3
#: Rows with one rare window that meet in one task; beyond it the window is split.
SPLIT = 2_000


def banding(threshold: float, size: int = SIZE) -> int:
    """Rows of a band: the most that divide ``size`` and miss a pair at ``threshold`` with MISSED at most; 5 (24 bands) at 0.8."""
    fits = [r for r in range(1, size + 1) if size % r == 0 and (1 - threshold**r) ** (size // r) <= MISSED]
    return max(fits, default=1)


def multisets(block: Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hash, text and count of the distinct windows, by text."""
    h, doc, _ = block.windows(k, short=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def digests(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums by which equal multisets are known; 0 for the empty one."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        with np.errstate(over="ignore"):
            part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h ^ np.uint64(salt)) + count.astype(np.uint64)), dtype=np.uint64)])
            out.append((part[ends[1:]] - part[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """The times of the earliest points, n x size; infinite for empty texts."""
    best = np.full(n * size, np.inf)
    weight = np.bincount(doc, count, n) if len(doc) else np.zeros(n)
    limit = np.where(weight > 0, (np.log(size) + 5) / np.maximum(weight, 1), 0.0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        base = np.flatnonzero(wanted[doc])
        level = 0
        while len(base):
            width, low = (1.0, 0.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            _points(best, h[base], doc[base], count[base], width, low, level, limit, size)
            level += 1
            base = base[count[base] > 2 ** (level - 1)]
        todo = todo[np.isinf(best.reshape(n, size)[todo]).any(1)]
        limit[todo] *= 2
    return best.reshape(n, size)


def _points(best, h, doc, count, width, low, level, limit, size) -> None:
    """All points of the processes of one weight interval before the texts' limits."""
    state = mix(h + np.uint64((level + 1) * 0xD1342543DE82EF95 % 2**64))
    time, until = np.zeros(len(h)), limit[doc]
    rate = size * width
    while len(state):
        state = mix(state)
        # 53 bits give the waiting time; 1 - u lies in (0, 1]
        time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) / 2.0**53)) / rate
        live = np.flatnonzero(time <= until)
        if not len(live):
            return
        state, time, until, doc, count = state[live], time[live], until[live], doc[live], count[live]
        where = mix(state ^ np.uint64(0xA0761D6478BD642F))
        component = ((where >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        cell = doc * size + component.astype(np.int64)
        if low:
            place = low + np.floor((where & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * width)
            hit = place < count
            np.minimum.at(best, cell[hit], time[hit])
        else:
            np.minimum.at(best, cell, time)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """n x (size / rows) 64-bit keys."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    key = np.broadcast_to(mix(np.arange(bits.shape[1], dtype=np.uint64)), bits.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ bits[:, :, j])
    return key.view(np.int64)


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = LIKENESS) -> DataFrame:
    """_id, digests d1, d2 and band keys of each row.  Null and empty texts have digests 0 and no bands."""
    rows_a_band = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                h, doc, count = multisets(block)
                d1, d2 = digests(h, doc, count, block.n)
                keys = band_keys(signatures(h, doc, count, block.n), rows_a_band)
                full = np.bincount(doc, minlength=block.n) > 0 if len(doc) else np.zeros(block.n, bool)
                at = np.concatenate([[0], np.cumsum(np.where(full, keys.shape[1], 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(d1), pa.array(d2), bands], ["_id", "d1", "d2", "bands"])

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "_id bigint, d1 bigint, d2 bigint, bands array<bigint>")


def likeness(a: Block, b: Block) -> np.ndarray:
    """Weighted Jaccard index of the texts of a with those of b, row by row; 1 if both are empty."""
    (h1, r1, c1), (h2, r2, c2) = multisets(a), multisets(b)
    h, r, c = np.concatenate([h1, h2]), np.concatenate([r1, r2]), np.concatenate([c1, c2])
    order = np.lexsort((h, r))
    h, r, c = h[order], r[order], c[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1])) if len(h) else np.zeros(0, np.int64)
    shared = np.bincount(r[same], np.minimum(c[same], c[same + 1]), a.n) if len(same) else np.zeros(a.n)
    total = np.bincount(r, c, a.n) if len(r) else np.zeros(a.n)
    return np.where(total > 0, shared / np.maximum(total - shared, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, like) of node pairs; texts: (nid, _text), one row a node.

    The text of b goes only to the salts that its partners fill, so a pivot with a third of all rows is
    spread over many tasks.
    """
    n = pairs.count()
    salts = max(8, min(8192, n // 5000))
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(salts)))
    left = salted.join(texts.select(F.col("nid").alias("a"), F.col("_text").alias("_ta")), "a")
    right = salted.select("b", "_s").distinct().join(texts.select(F.col("nid").alias("b"), F.col("_text").alias("_tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BLOCK_BYTES, "right")))
                part, i = batch.slice(i, j - i), j
                (_, _, x), (_, _, y) = next(blocks(part.column(2), 2**62)), next(blocks(part.column(3), 2**62))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(likeness(x, y))], ["a", "b", "like"])

    return left.join(right, ["b", "_s"]).select("a", "b", "_ta", "_tb").mapInArrow(run, "a bigint, b bigint, like double")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = LIKENESS) -> DataFrame:
    """One row for each row of ``docs``: ``key``, class_id and class_rows.

    class_id is the least key among the texts linked, directly or through others; class_rows their number.
    Texts with equal multisets of windows are one class from the start and compared once; so are all null,
    empty and blank texts.  Rows without a key belong to a class, but do not name it unless it has no other
    rows, and then class_id is null.  Repeated rows and extra columns do no harm; an empty table gives no rows.
    A very long text is one block and takes about a hundred times its words in bytes.  Bands follow ``threshold``.
    """
    rows = staged(signed(docs, text, key, threshold), "signed")
    firsts = rows.groupBy("d1", "d2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    reps = staged(firsts.withColumn("nid", F.monotonically_increasing_id()), "reps")

    keys = reps.select("nid", F.explode("bands").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(keys.join(counts, "key"), "members")
    company = members.groupBy("nid").agg(F.sum("n").alias("hub"))
    members_hub = staged(members.join(company, "nid").select("key", "nid", "hub"), "hubs")

    pivots = members_hub.groupBy("key").agg(F.max(F.struct("hub", "nid")).alias("_m")).select("key", F.col("_m.nid").alias("b"))
    compared = staged(members_hub.select("key", F.col("nid").alias("a")).join(pivots, "key").where("a != b"), "compared")
    labels, used = None, [members, members_hub, compared]
    if not compared.isEmpty():
        texts = staged(_texts(docs, text, key, reps, members_hub), "texts")
        found = staged(verified(compared.select("a", "b").distinct(), texts), "verified")
        labels = connected_components(found.where(F.col("like") >= threshold), "a", "b")
        left = staged(_unsettled(members_hub, compared, found, labels, threshold), "unsettled")
        used += [texts, found, left]
        if not left.isEmpty():
            pairs = staged(_by_rare_windows(left, texts, threshold), "pairs")
            more = staged(verified(pairs, texts).where(F.col("like") >= threshold), "more")
            of = left.select("nid", "label")
            classes_linked = more.join(of.toDF("a", "src"), "a").join(of.toDF("b", "dst"), "b").select("src", "dst")
            merged = connected_components(classes_linked)
            whole = labels.join(merged.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
            lone = merged.join(labels.select("node"), "node", "left_anti")  # classes of one text so far
            labels = staged(whole.unionByName(lone), "labels")
            used += [pairs, more]
    out = rows.select("_id", "d1", "d2")
    total = int(reps.agg(F.sum("copies")).first()[0] or 0)
    named = reps.select("d1", "d2", "rep", "copies", "nid")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("component", "nid"))
        per = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_rows"), F.count(F.lit(1)).alias("_k"))
        named = keyed_join(named, per, ["label"], "_k", reps.count())
    else:
        named = named.withColumn("class_id", F.col("rep")).withColumn("class_rows", F.col("copies"))
    named = staged(named.select("d1", "d2", "copies", "class_id", "class_rows"), "classes")
    for table in used:
        dropped(table)
    joined = keyed_join(out, named, ["d1", "d2"], "copies", total)
    return joined.select(F.col("_id").alias(key), "class_id", "class_rows")


def _texts(docs: DataFrame, text: str, key: str, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(nid, _text) of every node that shares a bucket, one row each, found again by id and digests."""
    wanted = members.select("nid").distinct().join(reps, "nid").select(F.col("rep").alias("_rep"), "d1", "d2", "nid")
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    near = rows.join(wanted.select("_rep").distinct(), rows["_id"].eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in each_block(batch, "_text"):
                d1, d2 = digests(*multisets(block), block.n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d1), pa.array(d2), part.column(1)], ["_id", "d1", "d2", "_text"])

    again = near.mapInArrow(run, "_id bigint, d1 bigint, d2 bigint, _text string")
    both = again.join(wanted, (again["_id"].eqNullSafe(wanted["_rep"])) & (again["d1"] == wanted["d1"]) & (again["d2"] == wanted["d2"]))
    return both.select("nid", "_text").dropDuplicates(["nid"])


def _unsettled(members: DataFrame, compared: DataFrame, found: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(nid, label) of members that may still have a link to another class of one of their buckets.

    The pivot has met all members of its bucket.  With d = 1 - likeness to it, two members at d and e are at
    least abs(d - e) apart, so a link needs steps of d (of width 1 - threshold) that are the same or adjacent.
    """
    step = 1 - threshold
    dist = compared.join(found, ["a", "b"]).select("key", F.col("a").alias("nid"), F.floor((1 - F.col("like")) / step + 1e-9).cast("int").alias("_d"))
    placed = dist.join(labels.select(F.col("node").alias("nid"), "component"), "nid", "left").select("key", "nid", "_d", F.coalesce("component", "nid").alias("label"))
    spread = placed.groupBy("key", "_d").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    near = spread.select("key", F.explode(F.array(F.col("_d") - 1, F.col("_d"), F.col("_d") + 1)).alias("_d"), "_lo", "_hi")
    near = near.groupBy("key", "_d").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return placed.join(near, ["key", "_d"]).where("_lo != label or _hi != label").select("nid", "label").distinct()


def window_tokens(texts: DataFrame) -> DataFrame:
    """(nid, w, token): one row for each occurrence of a window; the k-th occurrence of a window is a token of its own, w their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                h, doc, count = multisets(block)
                at = np.repeat(np.arange(len(h)), count)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                token = mix(h[at] + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                size = np.bincount(doc, count, block.n).astype(np.int64) if len(doc) else np.zeros(block.n, np.int64)
                nid = rows.column(0).to_numpy()[doc[at]] if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(size[doc[at]] if len(at) else nid), pa.array(token.view(np.int64))], ["nid", "w", "token"])

    return texts.select("nid", "_text").mapInArrow(run, "nid bigint, w bigint, token bigint")


def _by_rare_windows(left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of members of different classes that can be linked, by the exact prefix filter.

    Tokens are ordered by frequency, tokens of one text only first.  Texts x and y, y not longer, with likeness t
    share t / (1 + t) (|x| + |y|) tokens, and all of them lie behind the first shared one.  So that one is
    within the first |x| - t |x| + 1 of x and |y| - 2 t / (1 + t) |y| + 1 of y, and neither text has fewer
    tokens from there on than must be shared.  The rows of a token of more than SPLIT texts are dealt over
    several tasks: those of x by hash, with those of y in each.
    """
    tokens = window_tokens(texts.join(left.select("nid"), "nid", "left_semi"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("nid")  # a text's own tokens
    place = F.col("w") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "token")) - 1
    shared = tokens.join(counts, "token").withColumn("pos", place)
    t = threshold - 1e-9
    prefix = staged(shared.where(F.col("pos") <= F.col("w") - F.ceil(F.col("w") * t)).join(left, "nid").select("nid", "label", "w", "token", "pos", F.ceil(F.col("c") / SPLIT).alias("salts")), "prefix")
    x = prefix.select(F.col("nid").alias("a"), F.col("label").alias("_la"), F.col("w").alias("_wa"), F.col("pos").alias("_pa"), "token", F.pmod(F.xxhash64("nid"), "salts").alias("salt"))
    y = prefix.where(F.col("pos") <= F.col("w") - F.ceil(F.col("w") * (2 * t / (1 + t)))).select(F.col("nid").alias("b"), F.col("label").alias("_lb"), F.col("w").alias("_wb"), F.col("pos").alias("_pb"), F.col("token").alias("_token"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("_salt"))
    need = F.ceil((F.col("_wa") + F.col("_wb")) * (t / (1 + t)))
    fits = (x["token"] == y["_token"]) & (x["salt"] == y["_salt"]) & (F.col("_la") != F.col("_lb")) & (F.col("_wb") <= F.col("_wa")) & (F.col("_wb") >= F.col("_wa") * t) & (F.least(F.col("_wa") - F.col("_pa"), F.col("_wb") - F.col("_pb")) >= need)
    return x.join(y, fits).select("a", "b").distinct()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of ``docs``, that with the least doc_id, with all its columns, whatever their names.

    Null, empty and blank texts are one class.  An id on several rows is one document: if it names a class, one
    of its rows stays.  Rows without an id cannot be told apart and all stay.  An empty table gives no rows.
    """
    found = classes(docs)
    ids = staged(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("doc_id") == F.col("class_id")).alias("_first")).where("_first"), "kept")
    at = unused(docs, "__at")
    rows = docs.withColumn(at, F.col("doc_id").cast("long"))
    stay = rows.join(ids.where("_n = 1").select(F.col("doc_id").alias(at)), at, "left_semi").unionByName(rows.where(F.col(at).isNull()))
    many = ids.where("_n > 1").select(F.col("doc_id").alias(at))
    if not many.isEmpty():
        stay = stay.unionByName(rows.join(many, at, "left_semi").dropDuplicates([at]))
    return stay.select(*(F.col(f"`{c}`") for c in docs.columns))
