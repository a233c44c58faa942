"""Ordered top-k per key: always row_number over a total order, never a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their place. Spark cuts to k a task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1, "__place").drop("__place")


def reranked(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Ranks made contiguous again after a filter."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(rank)))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1 to 10000 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def with_truncation(df: DataFrame, order: list[Column | str], limit: int) -> tuple[DataFrame, bool]:
    """The first limit rows, and whether there are more: one row beyond is asked for."""
    more = len(df.select(F.lit(1)).limit(limit + 1).take(limit + 1)) > limit
    return df.orderBy(*order).limit(limit), more


def within(df: DataFrame, keys: list[str], order: list[Column | str], size: Column, most: int) -> DataFrame:
    """Rows of each key, in order, up to the first that would make the sizes' sum exceed most; the first row always stays."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    summed = F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__sum", summed).withColumn("__place", F.row_number().over(ordered)).filter((F.col("__sum") <= most) | (F.col("__place") == 1)).drop("__sum", "__place")


def one(df: DataFrame, **key: object) -> DataFrame:
    """The row of a key, or none."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return df.limit(1)
