"""Quality rules whose cutoffs carry a guarantee on false rejections.

Every rule rejects a text when a share (symbols, repeated words, ...) exceeds a cutoff.  The cutoffs
are chosen on labelled holdouts.  A cutoff of a rule in a stratum is admissible if exact binomial tests
reject both "``risk`` or more of the good texts lie beyond it" and "``risk`` or fewer of the bad ones do",
each at ``level`` divided by the number of tests (2 x strata x rules x grid points, Bonferroni).  The
strictest admissible cutoff is taken; without one the rule is silent in that stratum.  So with probability
1 - ``level`` no rule rejects more than ``risk`` of the good texts of any stratum, and none is kept that
does no more than that to bad ones.  Strata are languages and never pooled: with so few good texts that no
count of theirs could pass, or none at all, all rules are silent there and the stratum costs no correction.

Texts go through one Arrow pass; only the counts are joined with the labels and aggregated on a fixed grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .common import rows_kept, table
from .textblocks import Block, each_block, mix

MIN_WORDS = 50
#: Rules (shares of 0 to 1000 in thousandths) and the grid of cutoffs tried.
RULES = ("symbols", "repeats", "lines")
GRID = (20, 50, 100, 150, 200, 250, 300, 400, 500)
RISK, LEVEL = 0.01, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


def count_block(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each text of a block.  n_lines: lines with a word."""
    start, end, doc = block.words()
    n = np.bincount(doc, minlength=block.n) if len(doc) else np.zeros(block.n, np.int64)
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = block.sums(in_word & ((block.data & 0xC0) != 0x80))
    h, of, first = block.windows(3, short=False)
    covered = np.zeros(len(doc) + 2, bool)
    if len(h):
        key = mix(h ^ mix(of.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            covered[first[twice] + j] = True
    repeats = np.bincount(doc[covered[: len(doc)]], minlength=block.n) if len(doc) else np.zeros(block.n, np.int64)
    lines, again = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    for i in range(block.n):
        full = [x for x in block.text(i).split(b"\n") if x.strip(_BLANK)]
        lines[i], again[i] = len(full), len(full) - len(set(full))
    return {"n_words": n, "word_chars": chars, "n_symbols": block.sums(_SYMBOL[block.data]), "n_dup_lines": again, "n_repeat_words": repeats, "n_lines": lines}


def shares(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rules' shares in thousandths, rounded down; 0 for a text without words."""
    per = lambda a, b: np.where(b > 0, 1000 * a // np.maximum(b, 1), 0)
    return {"symbols": per(c["n_symbols"], c["word_chars"]), "repeats": per(c["n_repeat_words"], c["n_words"]), "lines": per(c["n_dup_lines"], c["n_lines"])}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def counted(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and COUNTS for each row of ``docs``, by one Arrow pass over whole texts.  Null and empty texts count 0 throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                c = count_block(block)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.array(c[x], pa.int64()) for x in COUNTS], [*(f"k{i}" for i in range(len(keep))), *COUNTS])

    picked = docs.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keep)), F.col(text).alias("_text"))
    schema = ", ".join([*(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), *(f"{c} bigint" for c in COUNTS)])
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(x) for i, x in enumerate(keep)), *COUNTS)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), the regularised incomplete beta function, in time that hardly grows with n.

    Its continued fraction (NIST Digital Library of Mathematical Functions 8.17.22) is evaluated from the front by
    the products of numerators and denominators (Lentz).
    """
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1 - p
    if x > (a + 1) / (a + b + 2):  # there the fraction of the other tail is the fast one
        return 1 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    fraction, c, d, i = 1.0, 1.0, 0.0, 0
    while i < 2 or abs(c * d - 1) > 1e-14:
        i += 1
        m = i // 2
        t = -(a + m) * (a + b + m) * x if i % 2 else m * (b - m) * x
        t /= (a + i - 1) * (a + i)
        d = 1 / (1 + t * d)
        c = 1 + t / c
        fraction *= c * d
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return min(1.0, math.exp(front) / (a * fraction))


def share_columns() -> dict[str, F.Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"1000 * {a} div {b}")).otherwise(F.lit(0)).cast("long")
    return {"symbols": per("n_symbols", "word_chars"), "repeats": per("n_repeat_words", "n_words"), "lines": per("n_dup_lines", "n_lines")}


def cutoffs_of(rows: list[dict], risk: float, level: float) -> dict[str, dict[str, int]]:
    """The cutoffs from counts by stratum: n and b good and bad texts, ``g_rule_cutoff`` and ``b_rule_cutoff`` of them beyond."""
    alpha = level / max(1, 2 * len(rows) * len(RULES) * len(GRID))
    out: dict[str, dict[str, int]] = {}
    for row in rows:
        for r in RULES:
            fine = [g for g in GRID if binomial_cdf(row[f"g_{r}_{g}"], row["n"], risk) <= alpha and row[f"b_{r}_{g}"] and 1 - binomial_cdf(row[f"b_{r}_{g}"] - 1, row["b"], risk) <= alpha]
            out.setdefault(row["s"], {}).update({r: min(fine)} if fine else {})
    return out


def least_good(risk: float = RISK, level: float = LEVEL) -> int:
    """Good texts below which no count beyond a cutoff, not even 0, passes the test of a single stratum."""
    return math.ceil(math.log(level / (2 * len(RULES) * len(GRID))) / math.log1p(-risk))


def calibrate(rated: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[str, dict[str, int]]:
    """{stratum: {rule: cutoff in thousandths}} from the counts of holdout texts that pass the base, with stratum and good.

    All labelled rows are counted; what reaches the driver is one row for each stratum with least_good good texts.
    """
    of = share_columns()
    beyond = [F.count_if((of[r] > g) & (F.col("good") == y)).alias(f"{p}_{r}_{g}") for p, y in (("g", True), ("b", False)) for r in RULES for g in GRID]
    by = rated.groupBy(F.col("stratum").alias("s")).agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("b"), *beyond)
    return cutoffs_of([r.asDict() for r in by.where(F.col("n") >= least_good(risk, level)).collect()], risk, level)


def verdict(cutoffs: dict[str, dict[str, int]], stratum: F.Column) -> F.Column:
    """True where no cutoff of the row's stratum is exceeded; a stratum without cutoffs rejects nothing."""
    out = F.lit(False)
    for s, rules in sorted(cutoffs.items()):
        for r, g in rules.items():
            out = out | ((stratum == s) & (share_columns()[r] > g))
    return ~out


def stratum_of(lang: str = "lang") -> F.Column:
    return F.coalesce(F.concat(F.lit("lang:"), F.col(lang)), F.lit("none"))


def holdout(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Of ``counts`` (doc_id, stratum, COUNTS) the labelled rows that pass the base, with good.  An id labelled twice counts by its lower label."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return counts.where(~base_failed_column()).join(rated, "doc_id")


def base_failed_column() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Counts, shares and verdict of every row of ``docs`` (doc_id, text, lang).

    Null or empty texts have no words and fail the base; rows without an id are judged, but no label speaks for
    them.  Repeated rows are judged alike, each on its own.  A null language is a stratum of its own.  Where
    labels are too few the base alone decides.  An empty table gives no rows; other columns of ``docs`` are not
    touched.  A very long text is one block and takes about thirty times its bytes.
    """
    rows = staged(counted_with_stratum(docs), "counts")
    cutoffs = calibrate(holdout(rows, labels), risk=risk, level=level)
    failed = base_failed_column()
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(cutoffs, F.col("stratum")))


def counted_with_stratum(docs: DataFrame) -> DataFrame:
    return counted(docs.select("doc_id", "text", stratum_of().alias("stratum")), keep=("doc_id", "stratum"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns, whatever their names; an empty table gives none."""
    cutoffs = calibrate(holdout(counted_with_stratum(docs), table(spark, sf_dir, "labels")))

    def keep(block: Block, rows: pa.RecordBatch) -> np.ndarray:
        c = count_block(block)
        kept, share = ~base_failed(c), shares(c)
        langs = np.array(["none" if x is None else f"lang:{x}" for x in rows.column(0).to_pylist()], object)
        for s in set(langs):
            for r, g in cutoffs.get(s, {}).items():
                kept &= (langs != s) | (share[r] <= g)
        return kept

    return rows_kept(docs, keep, also=("lang",))
