"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its host and path.

A logistic curve over simple shares of the text gives each document a probability of being good.  Hosts and
paths are rated from all their documents: a labelled training document counts by its label, any other by
that probability.  A host's posterior is its mean shrunk towards the global one, a path's its mean shrunk
towards its host's, each by as many imagined documents as the spread of the means between sites, beyond that
within them, tells (method of moments on grouped sums).  So sparse sites lean on their parents.  The score
adds to the log odds of the document those of its path's posterior against the global mean, less the
document's own part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import keyed_join
from ..plans.staging import staged
from .common import Logit, hand_back, lowest, remainder
from .quality_rules import count_block
from .textblocks import Block, each_block

#: Labelled rows that training takes (lowest hash of id and features), a documented bound.
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
#: How much the site's log odds weigh against the document's own.
SITE_WEIGHT = 0.5
FEATURES = 8


def features(block: Block) -> np.ndarray:
    """Shares that tell prose from junk, 0 for texts without words."""
    c = count_block(block)
    d, n = block.data, np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    upper = block.sums((d >= 65) & (d <= 90))
    digit = block.sums((d >= 48) & (d <= 57))
    sign = block.sums((d > 32) & (d < 127) & ~(((d | 32) >= 97) & ((d | 32) <= 122)) & ~((d >= 48) & (d <= 57)))
    return np.column_stack([
        np.log1p(c["n_words"]), c["n_symbols"] / chars, c["n_repeat_words"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        upper / chars, digit / chars, sign / chars, np.minimum(c["word_chars"] / n, 20),
    ])


def _measured(docs: DataFrame, names: list[str], text: str) -> DataFrame:
    """``names`` and the features of each row, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                x = features(block)
                at = np.arange(block.n + 1, dtype=np.int32) * FEATURES
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], [*names, "_x"])

    picked = docs.select(*names, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "_x array<double>"])
    return picked.mapInArrow(run, schema)


def _curve(x: Column, model: Logit) -> Column:
    z = F.lit(float(model.w[0]))
    for i in range(FEATURES):
        z = z + (x[i] - F.lit(float(model.mean[i]))) * F.lit(float(model.w[i + 1] / model.scale[i]))
    return F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _prior_strength(groups: DataFrame, mean: str, parent: str, n: str) -> float:
    """Imagined documents of a beta-binomial prior: between 1 and 10,000, 100 if there is nothing to tell it from."""
    # E[(mean - parent)^2] = v (1 + (n - 1) / (s + 1)) / n with v = parent (1 - parent); summed with weight n
    v = F.col(parent) * (1 - F.col(parent))
    row = groups.agg(F.sum(F.col(n) * F.pow(F.col(mean) - F.col(parent), 2)).alias("d"), F.sum(v).alias("v"), F.sum(v * (F.col(n) - 1)).alias("w")).first()
    if not row["w"] or row["d"] is None:
        return 100.0
    rho = (row["d"] - row["v"]) / row["w"]
    return float(np.clip(1 / rho - 1, 1, 10_000)) if rho > 0 else 10_000.0


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def rated(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``key``, held_out, doc_score, host_posterior, path_posterior, score and kept of each row of ``docs``.

    Labels of ids with crc32(id as text) mod 3 = 1 are never used, neither for the curve nor for sites.  An
    id labelled twice counts by its lower label.  Null and empty texts have features 0; null hosts and paths
    are sites of their own; rows without an id are rated, but no label speaks for them, and an id on several rows
    lends its label to each.  Without labels every document score is 1/2 and the sites change nothing.  Repeated
    rows are rated alike; an empty table gives no rows; other columns of ``docs`` are not touched.  A very long
    text is one block and takes about thirty times its bytes.
    Texts go through one pass; sums by site are aggregated before the shuffle, and hot sites are joined apart.
    """
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n")).alias("_host"), F.coalesce(F.concat(F.lit("p"), path.cast("string")), F.lit("n")).alias("_path"), F.col(text).alias("_body"))
    measured = staged(_measured(rows, ["_id", "_host", "_path"], "_body"), "features")
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).cast("int").alias("_y"))
    marked = marked.where(remainder("_id", 3) != 1)
    sample = lowest(measured.where("_id is not null").select("_id", "_x").distinct().join(marked, "_id"), ["_id", "_x"], train_rows)
    model = Logit().fit(np.array([r["_x"] for r in sample]) if sample else np.zeros((0, FEATURES)), np.array([r["_y"] for r in sample]))
    del sample
    hand_back()

    own = measured.select("_id", "_host", "_path", _curve(F.col("_x"), model).alias("_p")).join(marked, "_id", "left").withColumn("_e", F.coalesce(F.col("_y").cast("double"), F.col("_p")))
    own = staged(own.drop("_y"), "evidence")
    paths = staged(own.groupBy("_host", "_path").agg(F.sum("_e").alias("_se"), F.count(F.lit(1)).alias("_n")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_se").alias("_hse"), F.sum("_n").alias("_hn"), F.count(F.lit(1)).alias("_kinds"))
    hosts = staged(hosts, "hosts")
    total = hosts.agg(F.sum("_hse").alias("e"), F.sum("_hn").alias("n"), F.sum("_kinds").alias("k"), F.count(F.lit(1)).alias("h")).first()
    n, k = int(total["n"] or 0), int(total["k"] or 0)
    p0 = float(min(0.999, max(0.001, total["e"] / n))) if n else 0.5

    means = hosts.select((F.col("_hse") / F.col("_hn")).alias("m"), F.lit(p0).alias("g"), "_hn")
    s_host = _prior_strength(means, "m", "g", "_hn")
    hosts = hosts.withColumn("host_posterior", (F.col("_hse") + s_host * p0) / (F.col("_hn") + s_host))
    paths = keyed_join(paths, hosts.drop("_hse", "_hn"), ["_host"], "_kinds", k, int(total["h"] or 0)).drop("_kinds")
    s_path = _prior_strength(paths.select((F.col("_se") / F.col("_n")).alias("m"), "host_posterior", "_n"), "m", "host_posterior", "_n")

    full = keyed_join(own, paths, ["_host", "_path"], "_n", n, k)
    # the document's own evidence is left out of its site
    rest = (F.col("_se") - F.col("_e") + s_path * F.col("host_posterior")) / (F.col("_n") - 1 + s_path)
    z = _log_odds(F.col("_p")) + SITE_WEIGHT * (_log_odds(rest) - _log_odds(F.lit(p0)))
    score = F.lit(1.0) / (1 + F.exp(-z))
    return full.select(
        F.col("_id").alias(key), (remainder("_id", 3) == 1).alias("held_out"), F.col("_p").alias("doc_score"), "host_posterior",
        ((F.col("_se") + s_path * F.col("host_posterior")) / (F.col("_n") + s_path)).alias("path_posterior"), score.alias("score"), (score >= THRESHOLD).alias("kept"),
    )
