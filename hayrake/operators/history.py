"""Folds, gold sets, purges and the two history regimes, with hash-based order instead of a generator's state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed
from ..sources.tables import staged
from .relational import first_by, numbered, purge, within, without


def choose(keys: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """n distinct keys in seeded order; all of them, in none, where n is None."""
    if n is None:
        return keys.select(key).distinct()
    return keys.select(key).distinct().orderBy(hashed(seed, key), key).limit(n)


def folds(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key, fold): distinct keys dealt in turn in seeded order.

    The place in the order is the number of earlier keys: sorted ranges are counted apart and added up, so no
    task sees all keys.
    """
    ordered = keys.select(key).distinct().withColumn("_h", hashed(seed, key))
    return numbered(ordered, ["_h", key], "_no").select(key, F.pmod("_no", F.lit(n)).cast("int").alias("fold"))


def halves(keys: DataFrame, key: str, seed: int) -> DataFrame:
    return folds(keys, key, 2, seed).withColumn("side", F.when(F.col("fold") == 0, "development").otherwise("holdout"))


def gold(pairs: DataFrame, context: str, item: str, corpus: DataFrame) -> DataFrame:
    """(context, items): the chosen items that the corpus has, from pairs that are never purged."""
    return within(pairs, corpus, item).groupBy(context).agg(F.sort_array(F.collect_set(item)).alias("items"))


def labels(queries: DataFrame, gold_sets: DataFrame, context: str, kind: str = "array<bigint>") -> DataFrame:
    joined = queries.join(gold_sets, context, "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(kind)))


def select_contexts(pairs: DataFrame, text: str, context: str, n: int | None, seed: int, corpus: DataFrame | None = None, item: str | None = None) -> DataFrame:
    """One context for each of n texts, or of all where n is None, both in seeded order.

    With ``corpus`` only rows whose ``item`` it has count, so that a text has a positive that can be found.
    """
    pairs = pairs if corpus is None else within(pairs, corpus, item)
    texts = choose(pairs, text, n, seed)
    return first_by(within(pairs, texts, text).select(text, context).distinct(), [text], [hashed(seed, context), F.col(context)])


def context_sample(pairs: DataFrame, text: str, context: str, each: int, include: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``each`` contexts of a text; those of ``include`` first, then in seeded order, n in all."""
    marked = pairs.select(text, context).distinct().join(include.select(context).distinct().withColumn("first", F.lit(0)), context, "left")
    by = [F.coalesce("first", F.lit(1)), hashed(seed, context), F.col(context)]
    kept = first_by(marked, [text], by, each)
    return kept.orderBy(*by).limit(n).select(text, context)


def purge_history(history: DataFrame, texts: DataFrame, items: DataFrame, text: str, item: str, fraction: float, seed: int) -> DataFrame:
    """History without the held texts and without a seeded fraction of the given items."""
    return purge(history, **{text: texts, item: cold_items(items, item, fraction, seed)})


def cold_items(items: DataFrame, item: str, fraction: float, seed: int) -> DataFrame:
    """Items whose place in [0, 1), from eight hex digits of the hash, is below the fraction."""
    at = F.conv(F.substring(hashed(seed, item), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return items.select(item).distinct().where(at < fraction)


def for_queries(history: DataFrame, queries: DataFrame, mode: str, text: str, context: str, item: str, cold: DataFrame | None = None) -> DataFrame:
    """History that may be seen when these queries are asked.

    ``unseen_text`` drops every row of a query's text, ``held_context`` only its own context.
    """
    if mode not in ("unseen_text", "held_context"):
        raise ValueError(mode)
    out = without(history, queries, text if mode == "unseen_text" else context)
    return out if cold is None else without(out, cold, item)


def known_texts(queries: DataFrame, fit: DataFrame, text: str) -> DataFrame:
    seen = fit.select(text).distinct().withColumn("known", F.lit(True))
    return queries.join(seen, text, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def coverage(queries: DataFrame, fit: DataFrame, gold_sets: DataFrame, text: str, context: str, item: str) -> DataFrame:
    """Share of known texts, macro share of positives that the history has, own contexts left in it."""
    seen = fit.select(item).distinct().withColumn("seen", F.lit(1))
    each = gold_sets.join(queries.select(context).distinct(), context, "left_semi").select(context, F.explode("items").alias(item))
    share = each.join(seen, item, "left").groupBy(context).agg(F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("s"))
    known = known_texts(queries, fit, text).agg(F.avg(F.col("known").cast("double")).alias("known_texts"))
    own = queries.select(context).distinct().join(fit, context, "left_semi").agg(F.count("*").alias("own_contexts"))
    return known.crossJoin(share.agg(F.avg("s").alias("positives_seen"))).crossJoin(own)


def query_weights(sample: DataFrame, q_key: str) -> DataFrame:
    """Equal total weight of each query's positives and of its negatives, mean 1 over all rows."""
    w = F.lit(100.0) / F.count("*").over(Window.partitionBy(q_key, "y"))
    raw = sample.withColumn("weight", w)
    mean = raw.agg(F.avg("weight").alias("mean"))
    return raw.crossJoin(mean).withColumn("weight", F.col("weight") / F.col("mean")).drop("mean")


def regime_weights(groups: DataFrame, target: float) -> DataFrame:
    """Weights that bring the share of known texts to ``target``."""
    seen = groups.agg(F.avg(F.col("known").cast("double")).alias("o"))
    w = F.when(F.col("known"), target / F.col("o")).otherwise((1 - target) / (1 - F.col("o")))
    return groups.crossJoin(seen).withColumn("weight", w).drop("o")


def group_sample(marked: DataFrame, q_key: str, key: str, hard: dict[str, int], tail: int, seed: int) -> DataFrame:
    """Positives, the best wrong candidates by each score of ``hard``, and a seeded sample of the remaining ones.

    A candidate that several scores choose stands once; ``kind`` is positive, hard or tail.
    """
    wrong = lambda c: F.row_number().over(Window.partitionBy(q_key, "y").orderBy(F.col(c).desc(), F.col(key)))
    ranked = marked.select("*", *[wrong(c).alias(f"_n_{c}") for c in hard])
    chosen = F.lit(False)
    for c, n in hard.items():
        chosen = chosen | (F.col(f"_n_{c}") <= n)
    ranked = ranked.withColumn("_hard", (F.col("y") == 0) & chosen).withColumn("_rest", (F.col("y") == 0) & ~F.col("_hard"))
    at = hashed(seed, F.concat_ws("/", F.col(q_key).cast("string"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(q_key, "_rest").orderBy(at, F.col(key)))
    kind = F.when(F.col("y") == 1, "positive").when(F.col("_hard"), "hard").when(place <= tail, "tail")
    return ranked.withColumn("kind", kind).where("kind is not null").drop("_hard", "_rest", *[f"_n_{c}" for c in hard])


def sample_candidates(scores, q_key: str, key: str, positives: DataFrame, hard: int, tail: int, seed: int) -> DataFrame:
    """(q_key, key, score, y): rows among which ``group_sample`` by the score chooses as among all pairs, which are not sorted.

    ``scores(k, pairs, queries)`` gives the scores of all pairs, of the k best by task, of given pairs, or of given queries.  A query
    needs its positives, its best ones by the number of positives more than ``hard``, and as many more of the seeded order than
    hard and tail together.  Those are cut by the hash at four times their share; where that leaves too few, all pairs are taken.
    """
    known = positives.groupBy(q_key).agg(F.count("*").alias("p"))
    size = scores().groupBy(q_key).agg(F.count("*").alias("n")).join(known, q_key, "left")
    size = staged(size.select(q_key, F.least("n", F.coalesce("p", F.lit(0)) + hard + tail).alias("need"), "n"), "sample-sizes")
    at = hashed(seed, F.concat_ws("/", F.col(q_key).cast("string"), F.col(key).cast("string")))
    share = F.conv(F.substring(at, 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = staged(scores().join(size, q_key).where(share < 4.0 * F.col("need") / F.col("n")).select(q_key, key, "score"), "sample-drawn")
    few = size.join(drawn.groupBy(q_key).agg(F.count("*").alias("have")), q_key, "left").where(F.coalesce("have", F.lit(0)) < F.col("need")).select(q_key)
    parts = [drawn, scores(pairs=positives)]
    if few.limit(1).count():
        parts.append(scores(queries=few))
    most = hard + (positives.groupBy(q_key).count().agg(F.max("count")).first()[0] or 0)
    parts.append(scores(k=most))
    rows = reduce(DataFrame.unionByName, (x.select(q_key, key, "score") for x in parts)).groupBy(q_key, key).agg(F.max("score").alias("score"))
    return rows.join(positives.select(q_key, key).withColumn("y", F.lit(1)), [q_key, key], "left").na.fill(0, ["y"])


def leaks(seen: DataFrame, **blocked: DataFrame) -> DataFrame:
    """One row: for each named column, how many distinct blocked values the history still has."""
    counts = [within(seen.select(c).distinct(), values, c).agg(F.count("*").alias(c)) for c, values in blocked.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)
    return out


def assert_no_leak(seen: DataFrame, **blocked: DataFrame) -> DataFrame:
    """The history itself; an error where it has a blocked value, raised when it is read."""
    found = leaks(seen, **blocked)
    bad = F.when(sum([F.col(c) for c in blocked], F.lit(0)) > 0, F.raise_error(F.lit("the history holds blocked values"))).otherwise(F.lit(True))
    return seen.crossJoin(found.select(bad.alias("_clean"))).where("_clean").drop("_clean")


def assert_apart(rows: DataFrame, text: str, fold: str) -> DataFrame:
    """The rows themselves; an error where a text stands in several folds, so that a model would be asked what it has seen."""
    several = rows.groupBy(text).agg(F.count_distinct(fold).alias("n")).where("n > 1").agg(F.count("*").alias("several"))
    bad = F.when(F.col("several") > 0, F.raise_error(F.lit("a text stands in several folds"))).otherwise(F.lit(True))
    return rows.crossJoin(several.select(bad.alias("_clean"))).where("_clean").drop("_clean")


def cold_sweep(pairs: DataFrame, queries: DataFrame, gold_pairs: DataFrame, text: str, context: str, item: str, fractions, seed: int) -> DataFrame:
    """(mode, fraction, known_texts, positives_seen) for both regimes and each share of cold positives."""
    out = None
    for mode in ("unseen_text", "held_context"):
        for f in fractions:
            cold = cold_items(gold_pairs, item, f, seed)
            seen = for_queries(pairs, queries, mode, text, context, item, cold)
            known = known_texts(queries, seen, text).agg(F.avg(F.col("known").cast("double")).alias("known_texts"))
            have = gold_pairs.join(seen.select(item).distinct().withColumn("seen", F.lit(1)), item, "left").groupBy(context).agg(F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("v"))
            row = known.crossJoin(have.agg(F.avg("v").alias("positives_seen"))).select(F.lit(mode).alias("mode"), F.lit(float(f)).alias("fraction"), "known_texts", "positives_seen")
            out = row if out is None else out.unionByName(row)
    return out
