"""Joins with per-group values that no hot group can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with at least this share of all rows is hot, so there are at most 1,000.
HOT_SHARE = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per key; ``size`` rows of ``rows`` share it; null keys match).

    Groups with total / HOT_SHARE rows or more are at most HOT_SHARE and go by
    broadcast; the rest shuffle, and none of their keys is common.
    """
    names = {k: f"__key_{k}" for k in keys}
    renamed = groups.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in groups.columns])
    limit = max(1000, -(-total // HOT_SHARE))
    hot, cold = renamed.where(F.col(size) >= limit), renamed.where(F.col(size) < limit)
    on = [F.col(f"`{k}`").eqNullSafe(F.col(v)) for k, v in names.items()]
    first = rows.join(F.broadcast(hot), on, "inner")
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(cold, on, "inner")
    return first.unionByName(rest).drop(*names.values())
