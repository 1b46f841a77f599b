"""Membership joins, look-ups, set aggregates and distribution measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def within(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def purge(df: DataFrame, **blocked: DataFrame) -> DataFrame:
    """Rows whose value is blocked in none of the named columns."""
    for column, values in blocked.items():
        df = without(df, values, column)
    return df


def look_up(df: DataFrame, other: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def distinct_pairs(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def first_by(df: DataFrame, keys: list[str], by: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every group in a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def numbered(df: DataFrame, by: list[Column | str], name: str = "row_id", start: int = 0) -> DataFrame:
    """The rows with ``name``, whole numbers without gaps from ``start`` on in the order of ``by``.

    Rows are dealt into sorted ranges and counted there; a row's number is the count of the ranges before its own and its place in
    it, so no task sees all rows.  The sorted table is stored, so that the places stay; equal rows get some order.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    ordered = staged(ordered, "numbered")
    part, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    number = (F.col("_start") + row + start).cast("bigint")
    return ordered.withColumn("_part", part).join(starts, "_part").select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], number.alias(name))


def shares(counts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Counts as shares of their key's total, which is at least one."""
    total = F.sum(count).over(Window.partitionBy(key))
    return counts.withColumn("p", F.col(count) / F.greatest(total, F.lit(1)))


def entropy_and_peak(shares_: DataFrame, key: str, classes: int | Column) -> DataFrame:
    """Entropy over the log of the number of classes, and the greatest share."""
    p = F.col("p")
    floor = F.log(F.greatest(F.lit(classes) if isinstance(classes, int) else classes, F.lit(2)).cast("double"))
    return shares_.groupBy(key).agg((F.sum(-p * F.log(F.greatest(p, F.lit(1e-12)))) / F.first(floor)).alias("entropy"), F.max("p").alias("peak"))


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows that only one of two versions of a frame has; both 0 if they are the same, repeated rows included."""
    only = lambda a, b, name: a.select(*left.columns).exceptAll(b.select(*left.columns)).agg(F.count("*").alias(name))
    return only(left, right, "only_left").crossJoin(only(right, left, "only_right"))
