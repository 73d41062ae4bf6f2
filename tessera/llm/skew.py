"""Joins of rows with the groups they belong to, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more than a 1,000th of all rows: there are fewer than 1,000 of them.
HOT_SHARE = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``key``; groups have one row per key and ``copies``, their number of rows.

    Groups that hold over a 1,000th of the ``total`` rows are broadcast, fewer than
    1,000 short rows at any size; the others are joined by a shuffle in which no key has more
    rows than that. ``copies`` is dropped.
    """
    large = F.col("copies") > F.lit(total / HOT_SHARE)
    hot, cold = F.broadcast(groups.where(large).drop("copies")), groups.where(~large).drop("copies")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
