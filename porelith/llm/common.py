"""Pieces that several operators share: reading, splits and a small logistic regression."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.names import unused
from ..plans.ranks import numbered_alike
from ..plans.staging import staged
from .textblocks import Block, each_block


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def lowest(df: DataFrame, keys: list[str], rows: int) -> list:
    """The ``rows`` rows whose ``keys`` hash lowest, on the driver, in that order.  ``keys`` tell all rows apart.

    The rows are counted and cut off by hash before they are sorted, so each task returns its share only.
    """
    h = F.xxhash64(*keys)
    n = df.count()
    if n > rows:
        df = df.where((h.cast("double") + 2.0**63) / 2.0**64 <= (rows + 6 * rows**0.5) / n)
    return df.orderBy(h, *keys).limit(rows).collect()


def hand_back() -> None:
    """Give memory that training has freed on the driver back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Logit:
    """Logistic regression on standardised columns, fitted by Newton steps with a ridge."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logit:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(y) or y.min() == y.max():  # one class only: a constant near its share
            self.mean, self.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
            p = (y.sum() + 0.5) / (len(y) + 1.0)
            self.w = np.concatenate([[np.log(p / (1 - p))], np.zeros(x.shape[1])])
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        a = np.hstack([np.ones((len(y), 1)), (x - self.mean) / self.scale])
        keep = np.diag([1e-6] + [self.ridge] * x.shape[1])
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = sigmoid(a @ w)
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.w[0] + ((np.asarray(x, float) - self.mean) / self.scale) @ self.w[1:])


def rows_kept(docs: DataFrame, keep: Callable[[Block, pa.RecordBatch], np.ndarray], text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` for which ``keep``, given a block of texts and the columns ``also`` of its rows, is true; all columns stay, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, others = names.index(text), [names.index(c) for c in also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, f"c{at}"):
                yield rows.filter(pa.array(keep(block, rows.select(others))))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def attached(docs: DataFrame, found: DataFrame, keys: dict[str, Column], values: list[str], where: str = "true") -> DataFrame:
    """``docs`` with ``values`` of ``found``, which has one row for each row of ``docs`` under ``keys`` (null-safe).

    Rows whose values fail ``where`` are left out.  Rows alike in all keys are paired by number, so each gets the
    values of one; where no keys are alike, the rows of ``docs`` are shuffled just once.  Columns of ``docs``
    named like ``values`` are replaced, others kept whatever their names.  ``found`` is read twice and should be staged.
    """
    names = [c for c in docs.columns if c not in values]
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    by, taken, number = (unused(docs, f"__{x}") for x in ("key", "taken", "number"))
    takes = {v: unused(docs, f"__v_{v}") for v in values}
    left = docs.select(*(F.col(f"`{c}`") for c in names), F.concat(*map(part, keys.values())).alias(by))
    right = found.select(F.concat(*(part(F.col(k)) for k in keys)).alias(by), *(F.col(v).alias(t) for v, t in takes.items()), F.expr(where).alias(taken))
    on = [by]
    if not right.groupBy(by).count().where("count > 1").isEmpty():
        left, right, on = numbered_alike(staged(left, "left"), by, number), numbered_alike(staged(right, "right"), by, number), [by, number]
    return left.join(right.where(taken), on).select(*(F.col(f"`{c}`") for c in names), *(F.col(t).alias(v) for v, t in takes.items()))
