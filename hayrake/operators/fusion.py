"""Reciprocal-rank fusion of two or more score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.numeric import ranking_key


def term(q_key: str, score: Column, weight: float) -> Column:
    place = F.rank().over(Window.partitionBy(q_key).orderBy(ranking_key(score).desc()))
    return F.lit(weight) / (CONFIG.rrf + place)


def fuse(scores: DataFrame, q_key: str, weights: dict[str, float], out: str = "fused") -> DataFrame:
    """Add the weighted sum of reciprocal ranks; a weight of 1 returns that score unchanged."""
    whole = [c for c, w in weights.items() if w == 1 and len([x for x in weights.values() if x]) == 1]
    if whole:
        return scores.withColumn(out, F.col(whole[0]).cast("double"))
    parts = [term(q_key, F.col(c), w) for c, w in weights.items() if w]
    return scores.withColumn(out, sum(parts[1:], parts[0]))


def nested(scores: DataFrame, q_key: str, steps: list[tuple[str, float]], first: str, out: str = "fused") -> DataFrame:
    """Fuse ``first`` with each (column, weight) in turn; the running result has the rest of the weight and 12 digits."""
    df = scores.withColumn(out, F.col(first).cast("double"))
    for column, weight in steps:
        df = fuse(df, q_key, {column: weight, out: 1 - weight}, "_next").withColumn(out, F.round("_next", 12)).drop("_next")
    return df
