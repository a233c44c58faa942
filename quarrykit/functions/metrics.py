"""Ranking metrics over arrays of gold and ranked items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at(gold: Column, ranked: Column, k: int) -> Column:
    """Share of gold among the first k; a repeated item counts once."""
    return F.size(F.array_intersect(gold, F.slice(ranked, 1, k))) / F.size(F.array_distinct(gold))


def first_rank(gold: Column, ranked: Column) -> Column:
    """The place of the first gold item, from 1; null if there is none."""
    places = F.transform(ranked, lambda item, i: F.when(F.array_contains(gold, item), i + 1))
    return F.array_min(places)


def reciprocal_rank(gold: Column, ranked: Column) -> Column:
    return F.coalesce(1 / first_rank(gold, ranked), F.lit(0.0))


def ndcg_at(gold: Column, ranked: Column, k: int) -> Column:
    """Discounted gain over the best possible one; a repeated item counts at its first place."""
    top = F.slice(ranked, 1, k)
    gains = F.transform(top, lambda item, i: F.when(F.array_contains(gold, item) & (F.array_position(top, item) == i + 1), 1 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    best = F.transform(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k))), lambda i: 1 / F.log2(i + F.lit(1.0)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return total(gains) / total(best)
