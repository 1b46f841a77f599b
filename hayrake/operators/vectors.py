"""Dense vectors: exact top-k of a stated query set in blocks, centroids, neighbour shares."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .best import Best

#: Queries and items of one product.
BLOCK, ROWS = 2048, 512
#: Most queries of one pass over the items, whose vectors are broadcast; and most cells (queries x k) that a task keeps in it.
MOST, CELLS = 200_000, 1 << 23


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def exact_topk(items: DataFrame, key: str, queries: DataFrame, q_key: str, vector: str, k: int, skip_self: bool = False) -> DataFrame:
    """(q_key, key, score, place): the k items of greatest dot product for every query, ties by key; keys are whole numbers."""
    best = _block_topk(items, key, queries, q_key, vector, k, "bigint", skip_self)
    place = F.row_number().over(Window.partitionBy(q_key).orderBy(F.desc("score"), key))
    return best.withColumn("place", place).where(F.col("place") <= k)


def text_key_topk(
    items: DataFrame, key: str, queries: DataFrame, q_key: str, vector: str, k: int, bias: DataFrame | None = None, q_group: str | None = None, group: str | None = None, digits: int = 9
) -> DataFrame:
    """The same for text query keys, scores rounded to ``digits``.

    ``bias`` (q_group, group, bias) adds a term that depends on the groups of both sides, such as their places.
    """
    best = _block_topk(items, key, queries, q_key, vector, k, "string", False, bias, q_group, group, digits)
    place = F.row_number().over(Window.partitionBy(q_key).orderBy(F.desc("score"), key))
    return best.withColumn("place", place).where(F.col("place") <= k)


def _block_topk(items, key, queries, q_key, vector, k, kind, skip_self, bias=None, q_group=None, group=None, digits=None) -> DataFrame:
    """The k best of every task and query, in as many passes over the items as the number of queries asks for.

    A pass takes MOST queries, or fewer where k is large: what is broadcast and what a task keeps are bounded by MOST and CELLS.
    """
    most = max(1, min(MOST, CELLS // k))
    ask = lambda part: _one_pass(items, key, part, q_key, vector, k, kind, skip_self, bias, q_group, group, digits)
    passes = -(-queries.count() // most)
    if passes <= 1:
        return ask(queries)
    # ranges of the key's hash hold about equal numbers; some room keeps each below the bound
    passes += 1 + passes // 4
    at = F.pmod(F.xxhash64(F.col(q_key).cast(kind)), F.lit(passes))
    parts = [ask(queries.where(at == n)) for n in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def _one_pass(items, key, queries, q_key, vector, k, kind, skip_self, bias, q_group, group, digits) -> DataFrame:
    """The k best of every task for one stated set of queries.

    Queries are sorted into blocks of BLOCK rows.  Every task multiplies ROWS items with one block at a time in double precision
    and keeps k per query, so one scan of the items serves all blocks, and a task holds one product whatever the batches' size.
    """
    spark = items.sparkSession
    columns = [F.col(q_key).cast(kind).alias("q"), F.col(vector).alias("v"), *([F.col(q_group).cast("string").alias("g")] if bias is not None else [])]
    rows = queries.select(*columns).orderBy("q").toArrow()
    if not rows.num_rows:
        return spark.createDataFrame([], f"{q_key} {kind}, {key} bigint, score double")
    dim = len(rows["v"][0])
    matrix = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    names = rows["q"].combine_chunks()
    added, groups = None, {}
    if bias is not None:
        found = {(r[0], r[1]): r[2] for r in bias.select(F.col(q_group).cast("string"), F.col(group).cast("string"), "bias").collect()}
        groups = {g: n for n, g in enumerate(sorted({g for _, g in found}))}
        added = np.array([[found.get((q, g), -np.inf) for g in groups] for q in rows["g"].to_pylist()], np.float64)
    shared = spark.sparkContext.broadcast((names, matrix, added, groups))
    schema = f"{q_key} {kind}, {key} bigint, score double"

    def run(batches):
        ids, whole, extra, numbers = shared.value
        own = ids.to_numpy() if skip_self else None
        best = Best(len(ids), k)
        for whole_batch in batches:
            for b in (whole_batch.slice(n, ROWS) for n in range(0, whole_batch.num_rows, ROWS)):
                keys = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                at = np.array([numbers[g] for g in b.column(2).to_pylist()]) if extra is not None else None
                for lo in range(0, len(ids), BLOCK):
                    s = whole[lo : lo + BLOCK] @ x.T
                    if digits is not None:
                        s = np.round(s, digits)
                    if at is not None:
                        s = np.round(s + extra[lo : lo + BLOCK][:, at], digits or 15)
                    if skip_self:
                        s[own[lo : lo + BLOCK, None] == keys[None, :]] = -np.inf
                    best.add(lo, s, keys)
        yield from best.batches(ids, q_key, key)

    side = [F.col(key).cast("bigint"), F.col(vector), *([F.col(group).cast("string")] if bias is not None else [])]
    return items.select(*side).mapInArrow(run, schema)


def centroids(items: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean): means by position; a partial sum per task and cell."""
    return items.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def softmax_shares(neighbours: DataFrame, q_key: str, label: str, temperature: float = 0.1) -> DataFrame:
    """Share of each label among a query's neighbours, weighted by exp(score / temperature)."""
    top = F.max("score").over(Window.partitionBy(q_key))
    w = neighbours.withColumn("w", F.exp((F.col("score") - top) / temperature))
    by = w.groupBy(q_key, label).agg(F.sum("w").alias("w"))
    return by.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(q_key))).drop("w")


def with_missing(wanted: DataFrame, stored: DataFrame, key: str, encode) -> DataFrame:
    """Rows of the store for the wanted keys, and of ``encode`` for those that it lacks; each distinct key once."""
    keys = wanted.select(key).distinct()
    have = stored.join(keys, key, "left_semi")
    return have.unionByName(encode(keys.join(stored.select(key), key, "left_anti")).select(*have.columns))
