"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def hot_keys(df: DataFrame, key: str, share: float = 0.005) -> list:
    """Keys that hold at least ``share`` of the rows: found in one pass in bounded memory, at most ``1/share`` of them.

    The list may contain a few keys that are not hot; salting those costs little and changes no result.
    """
    row = df.where(F.col(key).isNotNull()).select(key).freqItems([key], share).first()
    return [k for k in (row[0] if row and row[0] else []) if k is not None]


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", salts: int = 32, share: float = 0.005,
        hot: list | None = None
) -> DataFrame:
    """Equi-join on ``key``: rows of ``left`` with a hot key are dealt by ``spread`` over ``salts`` parts, and only
    the few matching rows of ``right`` are repeated. ``how`` is inner, left, left_semi or left_anti."""
    hot = hot_keys(left, key, share) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn(SALT, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = right.withColumn(SALT, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, SALT], how).drop(SALT)
