"""Recall and its cuts, strata, attribution, selection and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.numeric import length_bin
from ..sources.tables import sorted_side


def recall(predictions: DataFrame, truth: DataFrame, q_key: str, key: str) -> DataFrame:
    """(q_key, n, recall) of every query with truth; ``predictions`` and ``truth`` are pairs."""
    hit = truth.join(predictions.select(q_key, key).distinct().withColumn("hit", F.lit(1)), [q_key, key], "left")
    return hit.groupBy(q_key).agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))


def recall_curve(ranked: DataFrame, truth: DataFrame, q_key: str, key: str, cuts: list[int]) -> DataFrame:
    """(k, recall): macro recall at each cut from one ranking with column place."""
    joined = truth.join(ranked.select(q_key, key, "place"), [q_key, key], "left")
    at = [F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in cuts]
    per = joined.groupBy(q_key).agg(*at)
    wide = per.agg(*[F.avg(F.col(f"`{k}`")).alias(str(k)) for k in cuts])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("recall")) for k in cuts])).alias("r")).select("r.*")


def ndcg(ranked: DataFrame, truth: DataFrame, q_key: str, key: str, k: int) -> DataFrame:
    """(q_key, ndcg) at cut k of every query with truth, for gains of 0 and 1; ``ranked`` has column place."""
    hit = truth.join(ranked.where(F.col("place") <= k).select(q_key, key, "place"), [q_key, key], "left")
    gained = F.sum(F.coalesce(1 / F.log2(F.col("place") + 1.0), F.lit(0.0)))
    per = hit.groupBy(q_key).agg(gained.alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.select(q_key, (F.col("dcg") / ideal).alias("ndcg"))


def stratum(text: Column, filters: Column, has_centre: Column, edges=CONFIG.bins) -> list[Column]:
    return [length_bin(F.length(text), edges).alias("bin"), (F.length(F.coalesce(filters, F.lit(""))) > 0).alias("filtered"), has_centre.alias("centred")]


def matched_recall(per_query: DataFrame, target: DataFrame, strata: list[str]) -> DataFrame:
    """Mean recall weighted so that strata have the target's shares; a target stratum without queries is an error."""
    want = target.groupBy(*strata).agg(F.count("*").alias("want")).crossJoin(target.agg(F.count("*").alias("w_all")))
    have = per_query.groupBy(*strata).agg(F.count("*").alias("have"), F.sum("recall").alias("r"))
    both = want.join(have, strata, "left").crossJoin(per_query.agg(F.count("*").alias("h_all")))
    missing = F.when(F.col("have").isNull(), F.raise_error(F.lit("a target stratum has no query"))).otherwise(F.lit(0))
    w = (F.col("want") / F.col("w_all")) / (F.col("have") / F.col("h_all"))
    sums = both.agg((F.sum(w * F.col("r")) / F.sum(w * F.col("have"))).alias("recall"), F.sum(missing).alias("missing"), F.sum(w * w * F.col("have")).alias("w2"), F.sum(w * F.col("have")).alias("w1"))
    return sums.select("recall", (F.col("w1") * F.col("w1") / F.col("w2")).alias("effective"), "missing")


def blend_regimes(unseen: float | Column, held: float | Column, known: float) -> Column:
    return (1 - known) * (F.lit(unseen) if isinstance(unseen, float) else unseen) + known * (F.lit(held) if isinstance(held, float) else held)


def _poisson_steps(n: int = 8) -> list[float]:
    """Where the distribution function of Poisson(1) stands at 0, 1, 2 and so on."""
    steps, p, cut = [], 0.36787944117144233, 0.0
    for k in range(n):
        cut += p
        steps.append(cut)
        p /= k + 1
    return steps


POISSON = _poisson_steps()


def bootstrap(deltas: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of the mean delta; a query's Poisson(1) weight in a draw comes from a SHA-256 that any engine can repeat.

    ``deltas`` has one row per query; every draw is a partial sum of its task before the shuffle.
    """
    text = F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col(key).cast("string"))
    u = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = sum([(F.col("u") >= s).cast("int") for s in POISSON], F.lit(0))
    rows = deltas.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u)
    means = rows.groupBy("draw").agg((F.sum(F.col("delta") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.count("*").alias("draws"))


def changes(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("worsened"))


def attribution(truth: DataFrame, pool: DataFrame, answer: DataFrame, q_key: str, key: str) -> DataFrame:
    """(stage, n): positives lost before the pool, lost at selection, or found."""
    p = pool.select(q_key, key).distinct().withColumn("in_pool", F.lit(1))
    a = answer.select(q_key, key).distinct().withColumn("in_answer", F.lit(1))
    stage = F.when(F.col("in_answer") == 1, "found").when(F.col("in_pool") == 1, "lost at selection").otherwise("lost before pool")
    return truth.join(p, [q_key, key], "left").join(a, [q_key, key], "left").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def admissible_best(configs: DataFrame, base: float | Column, slack: float = 0.005) -> DataFrame:
    """The best matched score among those that lose at most ``slack`` on unseen texts."""
    return configs.where(F.col("unseen") >= base - slack).orderBy(F.desc("matched"), F.asc("name")).limit(1)


def answers(ranked: DataFrame, q_key: str, key: str) -> DataFrame:
    """(q_key, answer): ids joined by a space in order of place."""
    rows = F.sort_array(F.collect_list(F.struct("place", F.col(key).cast("string").alias("id"))))
    return ranked.groupBy(q_key).agg(F.array_join(F.transform(rows, lambda r: r["id"]), " ").alias("answer"))


def validate(answers_: DataFrame, queries: DataFrame, corpus: DataFrame, q_key: str, key: str, most: int) -> DataFrame:
    """Counts of violations: missing, foreign and repeated queries, too many, repeated or unknown ids."""
    ids = F.split("answer", " ")
    each = answers_.select(q_key, F.explode(ids).alias("id"))
    unknown = each.join(sorted_side(corpus.select(F.col(key).cast("string").alias("id")).distinct()), "id", "left_anti").agg(F.count("*").alias("unknown"))
    own = answers_.agg(
        (F.count("*") - F.count_distinct(q_key)).alias("repeated_queries"),
        F.count_if(F.col("answer").isNull()).alias("nulls"),
        F.count_if(F.size(ids) > most).alias("too_many"),
        F.count_if(F.size(ids) != F.size(F.array_distinct(ids))).alias("repeated_ids"),
    )
    lost = queries.select(q_key).join(answers_, q_key, "left_anti").agg(F.count("*").alias("missing_queries"))
    foreign = answers_.join(queries.select(q_key), q_key, "left_anti").agg(F.count("*").alias("foreign_queries"))
    return own.crossJoin(unknown).crossJoin(lost).crossJoin(foreign)


def overlap(a: DataFrame, b: DataFrame, q_key: str, key: str) -> DataFrame:
    """Mean number of common ids per query of a."""
    n = a.select(q_key).distinct().agg(F.count("*").alias("n"))
    return a.join(b, [q_key, key], "left_semi").agg(F.count("*").alias("common")).crossJoin(n).select((F.col("common") / F.col("n")).alias("mean_common"))


def class_metrics(truth: DataFrame, predicted: DataFrame, q_key: str, label: str, cuts: list[int], floor: float = 1e-8) -> DataFrame:
    """One row: recall of the true labels at each cut, mean negative log-likelihood and share of labels of probability 0.

    ``truth`` (q_key, label, n) and ``predicted`` (q_key, label, p); means within a query, then over queries.
    """
    ranked = predicted.withColumn("place", F.rank().over(Window.partitionBy(q_key).orderBy(F.desc("p")))).select(q_key, label, "p", "place")
    both = truth.join(ranked, [q_key, label])
    n, all_ = F.col("n"), F.sum("n")
    at = [(F.sum(n * (F.col("place") <= k).cast("int")) / all_).alias(f"recall_{k}") for k in cuts]
    per = both.groupBy(q_key).agg(*at, (F.sum(n * -F.log(F.greatest("p", F.lit(floor)))) / all_).alias("nll"), (F.sum(n * (F.col("p") == 0).cast("int")) / all_).alias("unseen_share"))
    return per.agg(*[F.avg(c).alias(c) for c in per.columns[1:]])
