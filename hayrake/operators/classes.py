"""Class models on soft labels: naive Bayes as tables of log probabilities.

Inputs are (key, term, x): what a text holds, in shares; targets are (key, label, weight): a text's classes, shares of its evidence.
Both the model and what it says come from joins and sums, so there is no vocabulary to cut and no row goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_shares(texts: DataFrame, key: str, blocks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(key, term, x): the terms of each block as shares of the block, times its factor; terms of two blocks stay apart."""

    def marked(block: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(block).alias("block"), t.alias("t")))

    parts = [marked(block, terms) for block, (terms, _) in blocks.items()]
    counts = texts.select(key, F.explode(F.concat(*parts)).alias("e")).groupBy(key, "e.block", "e.t").agg(F.count("*").alias("n"))
    factor = F.create_map(*[F.lit(v) for b, (_, f) in blocks.items() for v in (b, float(f))])[F.col("block")]
    total = F.sum("n").over(Window.partitionBy(key, "block"))
    return counts.select(key, F.concat("block", F.lit(":"), "t").alias("term"), (factor * F.col("n") / total).alias("x"))


def fit_bayes(inputs: DataFrame, targets: DataFrame, key: str, label: str, alpha: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """The model: (label, prior, base) and (label, term, gain).

    A term that a class never had has the class's ``base``; one that it had has ``base + gain``.  Smoothing counts the terms of all
    inputs, so the number of rows is that of seen (class, term) pairs.
    """
    mass = inputs.join(targets.select(key, label, "weight"), key).groupBy(label, "term").agg(F.sum(F.col("x") * F.col("weight")).alias("m"))
    size = inputs.agg(F.count_distinct("term").alias("v"))
    sums = mass.groupBy(label).agg(F.sum("m").alias("m"))
    evidence = targets.groupBy(label).agg(F.sum("weight").alias("w"))
    every = evidence.agg(F.sum("w").alias("all_w"))
    base = F.log(F.lit(alpha) / (F.coalesce("m", F.lit(0.0)) + alpha * F.col("v")))
    priors = evidence.join(sums, label, "left").crossJoin(size).crossJoin(every).select(label, F.log(F.col("w") / F.col("all_w")).alias("prior"), base.alias("base"))
    return priors, mass.select(label, "term", F.log((F.col("m") + alpha) / alpha).alias("gain"))


def bayes_probabilities(inputs: DataFrame, model: tuple[DataFrame, DataFrame], key: str, label: str) -> DataFrame:
    """(key, label, p) of every text and class; terms that no class had say nothing."""
    priors, gains = model
    known = inputs.join(gains.select("term").distinct(), "term", "left_semi")
    length = inputs.select(key).distinct().join(known.groupBy(key).agg(F.sum("x").alias("length")), key, "left").na.fill(0.0, ["length"])
    said = known.join(gains, "term").groupBy(key, label).agg(F.sum(F.col("x") * F.col("gain")).alias("said"))
    # classes are few: every text meets every class once
    every = length.crossJoin(priors).join(said, [key, label], "left")
    log_p = F.col("prior") + F.col("base") * F.col("length") + F.coalesce("said", F.lit(0.0))
    own = Window.partitionBy(key)
    scaled = every.withColumn("e", log_p).withColumn("e", F.exp(F.col("e") - F.max("e").over(own)))
    return scaled.select(key, label, (F.col("e") / F.sum("e").over(own)).alias("p"))
