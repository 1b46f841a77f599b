"""Location centres, distances, transitions and compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.numeric import haversine


def centres(items: DataFrame, location: str, lat: str, lon: str) -> DataFrame:
    return items.groupBy(location).agg(F.median(lat).alias("lat"), F.median(lon).alias("lon"))


def transitions(history: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, n, strength, p, support): how often searches at one place choose items at another."""
    return transition_rates(history.groupBy(source, target).agg(F.count("*").alias("n")), source, target)


def transition_rates(counts: DataFrame, source: str, target: str) -> DataFrame:
    """The same from counts (source, target, n)."""
    own = Window.partitionBy(source)
    total, top = F.sum("n").over(own), F.max("n").over(own)
    shrink = F.least(F.lit(1.0), total / CONFIG.transition_support)
    return counts.select(
        source, target, "n",
        (F.sqrt(F.col("n") / F.greatest(top, F.lit(1))) * shrink).alias("strength"),
        (F.col("n") / total).alias("p"),
        F.log1p(total.cast("double")).alias("support"),
    )


def distances(sources: DataFrame, source: str, targets: DataFrame, target: str) -> DataFrame:
    """Kilometres between all given places; both sides are tables of distinct places, not of rows."""
    a = sources.select(F.col(source), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = targets.select(F.col(target), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.crossJoin(b).select(source, target, haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def compatibility(km: DataFrame, moves: DataFrame, source: str, target: str) -> DataFrame:
    """The better of distance decay and transition strength; 1 at the place itself, and everywhere if all is 0."""
    joined = km.join(moves.select(source, target, "strength"), [source, target], "left")
    decay = F.coalesce(CONFIG.geo_weight * F.exp(-F.col("km") / CONFIG.geo_km), F.lit(0.0))
    geo = F.when(F.col(source) == F.col(target), 1.0).otherwise(F.greatest(decay, F.coalesce("strength", F.lit(0.0))))
    top = F.max("geo").over(Window.partitionBy(source))
    return joined.select(source, target, geo.alias("geo")).select(source, target, F.when(top == 0, 1.0).otherwise(F.col("geo")).alias("geo"))


def smoothed(history: DataFrame, cls: str, same: str, prior: float) -> DataFrame:
    """Same-place share per class, drawn to the global one by ``prior`` pseudo-counts (a reconstruction)."""
    whole = history.agg(F.avg(F.col(same).cast("double")).alias("g"))
    by = history.groupBy(cls).agg(F.count("*").alias("n"), F.sum(F.col(same).cast("int")).alias("k"))
    return by.crossJoin(whole).select(cls, "n", ((F.col("k") + prior * F.col("g")) / (F.col("n") + prior)).alias("share"))


def service_geography(history: DataFrame, cls: str, source: str, target: str, prior: float, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Five measures per class, drawn to the rates of all classes by ``prior`` pseudo-counts (a reconstruction; the weight is a parameter).

    (class, source, target, transition): how likely a choice from the source lies at the target.  (class, source, same, support,
    local_support, supported): the share of choices at the place itself, logs of the class's choices in all and from the source, and
    whether those from the source are at least ``least``.
    """
    moves = history.groupBy(cls, source, target).agg(F.count("*").alias("n"))
    whole = moves.groupBy(source, target).agg(F.sum("n").alias("g_n")).withColumn("g", F.col("g_n") / F.sum("g_n").over(Window.partitionBy(source))).select(source, target, "g")
    here = moves.groupBy(cls, source).agg(F.sum("n").alias("here"), F.sum(F.when(F.col(source) == F.col(target), F.col("n")).otherwise(0)).alias("same_n"))
    share = moves.agg((F.sum(F.when(F.col(source) == F.col(target), F.col("n")).otherwise(0)) / F.sum("n")).alias("g_same"))
    total = here.groupBy(cls).agg(F.sum("here").alias("all"))
    # every target that the source has at all, so that a class without a choice there has the shrunk global rate
    grid = here.join(whole, source).join(moves, [cls, source, target], "left")
    transition = (F.coalesce("n", F.lit(0)) + prior * F.col("g")) / (F.col("here") + prior)
    log = lambda c: F.log1p(F.col(c).cast("double"))
    per = here.join(total, cls).crossJoin(share)
    same = (F.col("same_n") + prior * F.col("g_same")) / (F.col("here") + prior)
    return grid.select(cls, source, target, transition.alias("transition")), per.select(cls, source, same.alias("same"), log("all").alias("support"), log("here").alias("local_support"), (F.col("here") >= least).cast("double").alias("supported"))


def context_centres(history: DataFrame, location: str, lat: str, lon: str) -> DataFrame:
    """Centre from interactions with support and the spread around it (a reconstruction)."""
    middle = centres(history, location, lat, lon)
    far = history.join(middle.withColumnsRenamed({"lat": "c_lat", "lon": "c_lon"}), location)
    km = haversine(F.col("c_lat"), F.col("c_lon"), F.col(lat), F.col(lon))
    return far.groupBy(location).agg(F.count("*").alias("support"), F.percentile(km, 0.5).alias("spread_p50"), F.percentile(km, 0.9).alias("spread_p90"))


def weighted_quantiles(counts: DataFrame, key: str, value: str, weight: str, **at: float) -> DataFrame:
    """(key, one column per name): the smallest value below which, with itself, at least that share of the key's weight lies.

    Values are counted per distinct one before they are ordered, so a key's partition holds its distinct values, not its rows.
    """
    summed = counts.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("_w"))
    own = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = summed.withColumn("_upto", F.sum("_w").over(own)).withColumn("_all", F.sum("_w").over(Window.partitionBy(key)))
    return upto.groupBy(key).agg(*[F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col(value))).alias(name) for name, share in at.items()])


def context_block(places: DataFrame, located: DataFrame, moves: DataFrame, support: float = CONFIG.transition_support) -> DataFrame:
    """Where searches of each place are centred and how they spread (a reconstruction from the columns' names).

    ``places`` (location), ``located`` (location, lat, lon) of items with coordinates, one row per item, ``moves``
    (search_location, item_location, n).  The centre is the median of the items at the place, code 0, else that of the items chosen
    from it, code 1, else none, code 2.  Distances from the centre to chosen items' places, by how often they were chosen, give the spread.
    """
    corpus = centres(located, "location", "lat", "lon").withColumnsRenamed({"lat": "c_lat", "lon": "c_lon"})
    at = located.groupBy("location").agg(F.median("lat").alias("p_lat"), F.median("lon").alias("p_lon")).withColumnRenamed("location", "item_location")
    known = moves.join(at, "item_location")
    middle = weighted_quantiles(known, "search_location", "p_lat", "n", h_lat=0.5).join(weighted_quantiles(known, "search_location", "p_lon", "n", h_lon=0.5), "search_location")
    base = places.select(F.col("location").alias("search_location")).join(corpus.withColumnRenamed("location", "search_location"), "search_location", "left").join(middle, "search_location", "left")
    source = F.when(F.col("c_lat").isNotNull(), 0).when(F.col("h_lat").isNotNull(), 1).otherwise(2)
    base = base.select("search_location", source.alias("context_source"), F.coalesce("c_lat", "h_lat").alias("context_lat"), F.coalesce("c_lon", "h_lon").alias("context_lon"))
    km = F.round(haversine(F.col("context_lat"), F.col("context_lon"), F.col("p_lat"), F.col("p_lon")), 6)
    far = known.join(base, "search_location").withColumn("km", km)
    spread = weighted_quantiles(far, "search_location", "km", "n", context_spread_p50=0.5, context_spread_p90=0.9)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("search_location"))
    dealt = moves.withColumn("p", share).groupBy("search_location").agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("search_location") == F.col("item_location"), F.col("p")).otherwise(0.0)).alias("context_same_share"),
        F.max("p").alias("context_peak_share"),
        F.sum(-F.col("p") * F.log("p")).alias("context_entropy"),
    )
    n = F.coalesce("_n", F.lit(0))
    return base.join(spread, "search_location", "left").join(dealt, "search_location", "left").select(
        "search_location", "context_lat", "context_lon", "context_source", F.log1p(n.cast("double")).alias("context_support"), "context_spread_p50", "context_spread_p90",
        (n / (n + support)).alias("context_confidence"), "context_same_share", "context_peak_share", "context_entropy", F.col("context_lat").isNotNull().cast("double").alias("context_available"),
    )
