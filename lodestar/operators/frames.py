"""Operators on DataFrames that the dialect's rewrites are built from, for use without SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dialect.lower import FUNCTIONS


def call(name: str, *args: str) -> Column:
    """A PostgreSQL function by name over SQL texts of its arguments, e.g. ``call("initcap", "p_name")``."""
    return F.expr(FUNCTIONS[name](*args))


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (nulls of a key are one group)."""
    place = "__place"
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) == 1).drop(place)


def over_groups(df: DataFrame, name: str, aggregate: Column, partition: list[str], order: Column, before: int, after: int) -> DataFrame:
    """A column of an aggregate over GROUPS BETWEEN before PRECEDING AND after FOLLOWING."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(order))
    frame = Window.partitionBy(*partition).orderBy("__rank").rangeBetween(-before, after)
    return df.withColumn("__rank", rank).withColumn(name, aggregate.over(frame)).drop("__rank")


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose [low, high] holds ``value``.

    The range becomes an equality of buckets of ``width`` with the range as residual test, so that the join is a
    hash or sort-merge join on a key; a right row is repeated for each bucket that its range touches.  ``width``
    should be about the ranges' usual length.  Null values and bounds, and empty ranges, match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    bucket = "__bucket"
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    dealt = right.filter(F.col(low) <= F.col(high)).withColumn(bucket, F.explode(F.sequence(first, last)))
    keyed = left.withColumn("__left_bucket", F.floor(F.col(value) / width))
    test = (F.col("__left_bucket") == F.col(bucket)) & F.col(value).between(F.col(low), F.col(high))
    return keyed.join(dealt, test, how).drop(bucket, "__left_bucket")
