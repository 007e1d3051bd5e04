"""Joins of many rows with a row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than this share of the rows is common; there are at most 1 / SHARE of them.
SHARE = 1 / 1000


def least(size: int) -> int:
    """A key of more of ``size`` rows is common."""
    return max(1000, int(size * SHARE))


def lookup(rows: DataFrame, dim: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` (``size`` of them) left-joined with ``dim``, which has a row a key at most.

    The rows of the common keys, a thousand at most, meet their entries by broadcast; the others by a shuffle in which no
    key is large."""
    return meet(rows, dim, key, rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least(size)).select(key))


def meet(rows: DataFrame, dim: DataFrame, key: str, common: DataFrame | None) -> DataFrame:
    """``lookup`` whose common keys are known; None stands for none."""
    if common is None:
        return rows.join(dim, key, "left")
    common = F.broadcast(common)
    hot = rows.join(common, key, "left_semi").join(F.broadcast(dim.join(common, key, "left_semi")), key, "left")
    rest = rows.join(common, key, "left_anti").join(dim, key, "left")
    return hot.unionByName(rest)
