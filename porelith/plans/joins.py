"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many rows is broadcast; the rows are counted first.
BROADCAST_ROWS = 20_000
#: A key with at least this share of the rows is hot.  So there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, rows: int | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each key.

    ``weight`` is a column of ``small`` with the number of rows of ``big`` that have the key and
    ``total`` their sum.  A ``small`` of at most BROADCAST_ROWS rows is broadcast.  Otherwise only
    the hot keys are (there cannot be more than 1 / HOT_SHARE of them), and the other rows meet in
    a shuffle in which no key has more than HOT_SHARE of all rows.  Keys must not be null.
    """
    rows = small.count() if rows is None else rows
    small_cols = [c for c in small.columns if c not in keys]
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    limit = max(1, int(total * HOT_SHARE))
    hot = small.where(F.col(weight) >= limit)
    cold = small.where(F.col(weight) < limit)
    out = big.columns + small_cols
    many = big.join(F.broadcast(hot), keys).select(*out)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).select(*out)
    return many.unionByName(rest)
