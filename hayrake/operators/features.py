"""Feature frames of (query, item) pairs, by name.  Missing values are null.

Blocks whose formulas are not public are reconstructions from their names and say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log1p_floor
from ..sources.tables import sorted_side
from .pool import log_rank
from .relational import entropy_and_peak, shares


def rank_block(pairs: DataFrame, q_key: str, scores: dict[str, str]) -> DataFrame:
    """log_<name>_rank of each score column over the query's whole pool."""
    return pairs.select("*", *[log_rank(q_key, F.col(c)).alias(f"log_{name}_rank") for name, c in scores.items()])


def text_block(pairs: DataFrame, query: str, title: str) -> DataFrame:
    q, t = F.col(query), F.col(title)
    return pairs.select("*", t.contains(q).cast("double").alias("query_in_title"), (t == q).cast("double").alias("query_equals_title"), F.length(q).alias("query_characters"))


def item_block(items: DataFrame, key: str, price: str, texts: dict[str, str]) -> DataFrame:
    logs = [log1p_floor(F.length(F.coalesce(F.col(c), F.lit("")))).alias(f"log_{n}_characters") for n, c in texts.items()]
    return items.select(key, log1p_floor(F.col(price).try_cast("double")).alias("log_price"), *logs)


def delta_block(pairs: DataFrame, new: str, old: str, name: str) -> DataFrame:
    return pairs.withColumn(f"{name}_delta", F.col(new) - F.col(old))


def history_block(history: DataFrame, text: str, label: str, classes: int) -> DataFrame:
    """Per known text: log pairs, entropy and peak of its labels."""
    counts = history.groupBy(text, label).agg(F.count("*").alias("n"))
    spread = entropy_and_peak(shares(counts, text), text, classes)
    pairs = counts.groupBy(text).agg(F.log1p(F.sum("n").cast("double")).alias("log_pairs"))
    return pairs.join(spread, text)


def item_history_block(history: DataFrame, item: str, text: str, place: str) -> DataFrame:
    """Per item: logs of its interactions, distinct texts and distinct search places (a reconstruction)."""
    return history.groupBy(item).agg(
        F.log1p(F.count("*").cast("double")).alias("log_count"),
        F.log1p(F.count_distinct(text).cast("double")).alias("log_texts"),
        F.log1p(F.count_distinct(place).cast("double")).alias("log_places"),
    )


def service_location_block(history: DataFrame, label: str, place: str) -> DataFrame:
    """Per class and item place: frequency of the place and of both together (a reconstruction)."""
    both = history.groupBy(label, place).agg(F.count("*").alias("n"))
    return both.select(
        label, place,
        F.log1p(F.col("n").cast("double")).alias("log_class_place"),
        F.log1p(F.sum("n").over(Window.partitionBy(place)).cast("double")).alias("log_place"),
        (F.col("n") / F.sum("n").over(Window.partitionBy(label))).alias("place_share"),
    )


def category_prior(pairs: DataFrame, score: str, wanted: str, own: str, boost: float = 0.0016) -> DataFrame:
    """A small addition where the category fits; category 0 fits everything (a reconstruction)."""
    fits = (F.col(wanted) == 0) | (F.col(wanted) == F.col(own))
    return pairs.withColumn(score, F.col(score) + F.when(fits, boost).otherwise(0.0))


def attributes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value): the ``name: value`` pairs of texts like "name: value; name: value", lower-cased, spaces made single.

    Pieces without a colon, a name or a value say nothing; a name that stands twice has both values.
    """
    pieces = rows.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), ";")).alias("piece"))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    split = pieces.where(F.col("piece").contains(":")).select(key, clean(F.regexp_extract("piece", r"^([^:]*):", 1)).alias("name"), clean(F.regexp_extract("piece", r"^[^:]*:(.*)$", 1)).alias("value"))
    return split.where((F.col("name") != "") & (F.col("value") != "")).distinct()


def attribute_match(pairs: DataFrame, q_key: str, key: str, wanted: DataFrame, had: DataFrame, name: str, column: str) -> DataFrame:
    """``pairs`` with ``column``: 1 where query and item have a common value of the attribute, 0 where they have other ones, null where one lacks it.

    Values of a pair meet by the pair's keys and the value, so no two value lists are multiplied.
    """
    q = wanted.where(F.col("name") == name).select(q_key, "value")
    i = had.where(F.col("name") == name).select(key, "value")
    asked = q.select(q_key).distinct().withColumn("_q", F.lit(1))
    owned = i.select(key).distinct().withColumn("_i", F.lit(1))
    hit = pairs.select(q_key, key).join(q, q_key).join(i, [key, "value"]).select(q_key, key).distinct().withColumn("_hit", F.lit(1.0))
    out = pairs.join(asked, q_key, "left").join(owned, key, "left").join(sorted_side(hit), [q_key, key], "left")
    value = F.when(F.col("_q").isNotNull() & F.col("_i").isNotNull(), F.coalesce("_hit", F.lit(0.0)))
    return out.withColumn(column, value).drop("_q", "_i", "_hit")


def class_candidate_block(p: DataFrame, q_key: str, label: str, supported: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Seven columns per text and class from probabilities (q_key, label, p): p, its log, the log of its rank, and the peak, margin
    and entropy of the text's distribution, with a mark for classes that ``supported`` has; what is not supported is null.
    """
    marked = p.join(supported.select(label).distinct().withColumn("_ok", F.lit(1)), label, "left")
    q = F.col("p")
    per = p.groupBy(q_key).agg(F.max("p").alias("peak"), F.get(F.sort_array(F.collect_list("p"), False), 1).alias("second"), F.sum(-q * F.log(F.greatest(q, F.lit(1e-12)))).alias("entropy"))
    out = marked.withColumn("log_rank", log_rank(q_key, F.round("p", 9))).join(per, q_key)
    only = lambda c: F.when(F.col("_ok") == 1, c)
    columns = {"probability": q, "log_probability": F.log(F.greatest(q, F.lit(floor))), "log_rank": F.col("log_rank"), "peak": F.col("peak"), "margin": F.col("peak") - F.coalesce("second", F.lit(0.0)), "entropy": F.col("entropy")}
    return out.select(q_key, label, *[only(c).alias(n) for n, c in columns.items()], F.coalesce("_ok", F.lit(0)).cast("double").alias("supported"))


def structural_block(pairs: DataFrame, q_key: str, key: str, wanted: DataFrame, had: DataFrame, kinds: dict[str, str], words: dict[str, str], km: str) -> DataFrame:
    """Ten columns from what texts state outright (a reconstruction): nothing here drops a candidate.

    ``kinds`` maps short names to attribute names: whether query and item agree, and whether the query states it.  ``words`` maps
    the flags to the word that either text must hold; ``pairs`` has both texts as q_text and i_text, the item's class and place,
    and the distance ``km``.  Frequencies are those of all items of ``had``'s frame ``pairs`` refers to, given as place_n, class_place_n, class_n.
    """
    out = pairs
    for short, name in kinds.items():
        out = attribute_match(out, q_key, key, wanted, had, name, f"{short}_match")
        stated = wanted.where(F.col("name") == name).select(q_key).distinct().withColumn(f"{short}_stated", F.lit(1.0))
        out = out.join(stated, q_key, "left").na.fill(0.0, [f"{short}_stated"])
    for flag, word in words.items():
        out = out.withColumn(flag, (F.lower("q_text").contains(word) | F.lower("i_text").contains(word)).cast("double"))
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    last = list(words)[-1]
    extra = {"place_log_count": log("place_n"), "class_place_log_count": log("class_place_n"), "class_place_share": F.col("class_place_n") / F.col("class_n"), f"{last}_log_distance": F.col(last) * log1p_floor(F.col(km))}
    return out.select(q_key, key, *[f"{s}_{x}" for s in kinds for x in ("match", "stated")], *words, *[c.alias(n) for n, c in extra.items()])
