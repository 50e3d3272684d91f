"""Running counts and medians of whole numbers, by slices of the value range, so that no group has to be sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(value: str) -> Column:
    """A number that never falls as the non-negative ``value`` rises: its binary digits' count and the first seven of them."""
    digits = f"length(bin({value}))"
    return F.expr(f"CAST({digits} * 128 + shiftright({value}, greatest({digits} - 7, 0)) AS INT)")


def running(df: DataFrame, keys: list[str], value: str, n: Column, order: list[Column], falling: bool = False) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over rows of the same ``keys`` that come earlier by slice of ``value``, then by ``order``.

    Slices, a few thousand at most for each key, are summed up; rows are sorted within a slice.
    """
    sliced = df.withColumn("value_slice", slice_of(value))
    by_slice = F.desc("value_slice") if falling else F.asc("value_slice")
    sums = sliced.groupBy(*keys, "value_slice").agg(F.sum(n).alias("of_slice"))
    earlier = F.sum("of_slice").over(Window.partitionBy(*keys).orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "value_slice", F.coalesce(earlier, F.lit(0)).alias("slices_before"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "value_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - n
    return sliced.withColumn("inside", inside).join(sums, [*keys, "value_slice"]).withColumn("before", F.col("slices_before") + F.col("inside")).drop("value_slice", "slices_before", "inside")


def middles_of_counts(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``middles`` of distinct values and how often each occurs, ``n``. Only the slices that a median lies in are sorted."""
    sliced = counted.withColumn("value_slice", slice_of(value))
    sums = sliced.groupBy(*keys, "value_slice").agg(F.sum("n").alias("of_slice"))
    by_key = Window.partitionBy(*keys)
    up_to = F.sum("of_slice").over(by_key.orderBy("value_slice").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"up_to": up_to, "all": F.sum("of_slice").over(by_key)})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    sums = sums.select(*keys, "value_slice", (F.col("up_to") - F.col("of_slice")).alias("slices_before"), "up_to", low.alias("low_place"), high.alias("high_place"))
    held = sums.where("(slices_before < low_place AND low_place <= up_to) OR (slices_before < high_place AND high_place <= up_to)").drop("up_to")
    placed = sliced.join(held, [*keys, "value_slice"])
    inside = F.sum("n").over(Window.partitionBy(*keys, "value_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("up_to", F.col("slices_before") + inside).withColumn("before", F.col("up_to") - F.col("n"))
    at = lambda place: F.max(F.when((F.col("before") < F.col(place)) & (F.col(place) <= F.col("up_to")), F.col(value)))
    return placed.groupBy(*keys).agg(at("low_place").cast("long").alias("low"), at("high_place").cast("long").alias("high"))


def middles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high): the lower and the upper median of the non-negative whole ``value``, exact; equal values are counted before they are ordered."""
    return middles_of_counts(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value)


def twice_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): twice the median, see ``middles``."""
    return middles(df, keys, value).select(*keys, (F.col("low") + F.col("high")).alias(name))
