"""Scalar expressions: safe parsing, logs, bins, distances, damping, fusion terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def log1p_floor(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def length_bin(n: Column, edges=CONFIG.bins) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (n >= edge).cast("int")
    return out


def clean_coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, lat), F.when(good, lon)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * CONFIG.earth_km * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def damped(floor: float, x: Column) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * x


def baseline_score(title: Column, body: Column, char: Column, filters: Column, geo: Column, cls: Column) -> Column:
    lexical = 0.3 * title + 0.5 * body + 0.2 * char + 0.03 * filters
    return lexical * F.sqrt(damped(CONFIG.geo_floor, geo)) * F.sqrt(damped(CONFIG.class_floor, cls))


def mixed_score(title: Column, body: Column, char: Column, geo: Column, cls: Column) -> Column:
    return (0.5 * title + 0.3 * body + 0.2 * char) * damped(CONFIG.geo_floor, geo) * damped(CONFIG.class_floor, cls)


def affinity(cosine: Column, geo: Column) -> Column:
    return F.exp((cosine - 1) / CONFIG.temperature) * damped(CONFIG.geo_floor, geo)


def ranking_key(score: Column) -> Column:
    """NaN and null below everything; Spark would put NaN first."""
    low = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(score.cast("double"), low), low)
