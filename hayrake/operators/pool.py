"""Candidate pools: stable top-k, zero fill, unions with source flags, differences, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ranking_key


def order(q_key: str, key: str, score: str = "score"):
    return Window.partitionBy(q_key).orderBy(ranking_key(F.col(score)).desc(), F.col(key))


def stable_topk(scores: DataFrame, k: int, q_key: str, key: str, score: str = "score") -> DataFrame:
    """The k best of every query, ties by key; the limit is pushed below the shuffle."""
    return scores.withColumn("place", F.row_number().over(order(q_key, key, score))).where(F.col("place") <= k)


def zero_fill(scores: DataFrame, queries: DataFrame, q_key: str, items: DataFrame, key: str, k: int) -> DataFrame:
    """Scores with the k lowest item keys added at 0, as a scan over the whole corpus would have them."""
    lowest = items.select(key).orderBy(key).limit(k)
    blank = queries.select(q_key).distinct().crossJoin(lowest).withColumn("score", F.lit(0.0))
    missing = blank.join(scores, [q_key, key], "left_anti")
    return scores.select(q_key, key, "score").unionByName(missing)


def union_channels(channels: dict[str, DataFrame], q_key: str, key: str) -> DataFrame:
    """(q_key, key, from_<channel>...): the distinct candidates of all channels, one grouping."""
    rows = [df.select(q_key, key, F.lit(name).alias("channel")) for name, df in channels.items()]
    flags = [F.max((F.col("channel") == name).cast("int")).alias(f"from_{name}") for name in channels]
    return reduce(DataFrame.unionByName, rows).groupBy(q_key, key).agg(*flags)


def wide_scores(scores: dict[str, DataFrame], q_key: str, key: str, blank: DataFrame | None = None) -> DataFrame:
    """(q_key, key, <name>...): the scores of all channels side by side, 0 where a channel has none; one grouping.

    ``blank`` pairs are added with zeros, as a scan over the whole corpus would have them.
    """
    rows = [df.select(q_key, key, F.lit(name).alias("channel"), "score") for name, df in scores.items()]
    if blank is not None:
        rows.append(blank.select(q_key, key, F.lit("").alias("channel"), F.lit(0.0).alias("score")))
    columns = [F.coalesce(F.max(F.when(F.col("channel") == name, F.col("score"))), F.lit(0.0)).alias(name) for name in scores]
    return reduce(DataFrame.unionByName, rows).groupBy(q_key, key).agg(*columns)


def top_of_any(wide: DataFrame, q_key: str, key: str, columns: list[str], k: int, positive: bool = False) -> DataFrame:
    """Rows that are among the k best of their query in at least one column, ties by key; with ``positive`` only scores above 0 count.

    Every column's k are cut in the tasks before anything is shuffled, so ``wide`` had better be stored.
    """
    return wide.join(keys_of_any(wide, q_key, key, columns, k, positive), [q_key, key], "left_semi")


def keys_of_any(wide: DataFrame, q_key: str, key: str, columns: list[str], k: int, positive: bool = False) -> DataFrame:
    """(q_key, key) of the rows of ``top_of_any``, which need not be joined with all scores for it."""
    tops = [stable_topk(wide.where(F.col(c) > 0) if positive else wide, k, q_key, key, c).select(q_key, key) for c in columns]
    return reduce(DataFrame.unionByName, tops).distinct()


def difference(left: DataFrame, right: DataFrame, q_key: str, key: str) -> DataFrame:
    return left.join(right, [q_key, key], "left_anti")


def log_rank(q_key: str, score: Column) -> Column:
    """log1p of the competition rank over the query's pool."""
    return F.log1p(F.rank().over(Window.partitionBy(q_key).orderBy(ranking_key(score).desc())))


def relative_scores(scores: DataFrame, q_key: str, key: str, at: int = 50, reference: int = 512, best: DataFrame | None = None) -> DataFrame:
    """Gaps to the first and the at-th score, the score in deviations of the ``reference`` best ones, and the place.

    ``best`` may give scores that have the ``max(at, reference)`` best of every query, so that all need not be sorted for them.
    """
    ranked = scores.withColumn("place", F.row_number().over(order(q_key, key)))
    best = stable_topk(scores if best is None else best, max(at, reference), q_key, key)
    per = best.groupBy(q_key).agg(
        F.max("score").alias("top"),
        F.max(F.when(F.col("place") == at, F.col("score"))).alias("nth"),
        F.avg(F.when(F.col("place") <= reference, F.col("score"))).alias("mean"),
        F.stddev_pop(F.when(F.col("place") <= reference, F.col("score"))).alias("dev"),
    )
    s = F.col("score")
    return ranked.join(per, q_key).select(
        q_key, key, (F.col("top") - s).alias("gap_first"), (s - F.col("nth")).alias("gap_nth"), F.when(F.col("dev") > 1e-9, (s - F.col("mean")) / F.col("dev")).alias("standard"), "place"
    )
