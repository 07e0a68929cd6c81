"""Ranks and medians of large groups without one task for a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def matched(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with small on keys, nulls equal to nulls; small's keys go."""
    small = small.select(*(F.col(k).alias(f"_{k}_") for k in keys), *(c for c in small.columns if c not in keys))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])
    return rows.join(small, same).drop(*(f"_{k}_" for k in keys))


def numbered(rows: DataFrame, keys: list[str], spread: Column, order: list[str]) -> DataFrame:
    """rows with _rank (from 1 in each group of keys, by spread, then order) and _n, the group's size.

    spread is a text of evenly spread hexadecimal digits. Its first three cut a group into 4096 parts, which are sorted apart; only the
    parts' counts are added up in a group.
    """
    part = [*keys, "_part"]
    rows = rows.withColumn("_spread", spread).withColumn("_part", F.substring("_spread", 1, 3))
    whole = Window.partitionBy(*keys)
    counts = rows.groupBy(*part).agg(F.count("*").alias("_m"))
    counts = counts.select(*part, (F.sum("_m").over(whole.orderBy("_part")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("_spread", *order)) + F.col("_before")
    return matched(rows, counts, part).withColumn("_rank", rank).drop("_spread", "_part", "_before")


def numbered_all(rows: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """rows with their number from 1 in the order of all rows, which must tell rows apart or make them equal.

    Rows are dealt out and sorted by ranges of the order, from sampled bounds, whatever groups there are; they are saved with their
    places in a range, and only the ranges' counts, one for each task, are added up.
    """
    # a row's id is its task's number and its place in it
    at = F.monotonically_increasing_id()
    sorted_rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33).cast("int"), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    counts = sorted_rows.groupBy("_range").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_rows.join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def placed(rows: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """rows with _at, their number from 0 in each key by order (a number). Rows are numbered in parts of ``width`` of the order; a key's parts are added up."""
    part = [key, "_part"]
    rows = rows.withColumn("_part", F.floor(F.col(order) / width))
    counts = rows.groupBy(*part).agg(F.count("*").alias("_m"))
    counts = counts.select(*part, (F.sum("_m").over(Window.partitionBy(key).orderBy("_part")) - F.col("_m")).alias("_before"))
    return matched(rows, counts, part).withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1 + F.col("_before")).drop("_part", "_before")


def medians(rows: DataFrame, value: str, keys: list[str], width: float, n: str | None = None) -> DataFrame:
    """keys, median (double) of the values that are not null; with n, a value stands for so many. Values are counted first; bins of ``width`` find the middle, and only the middle bins' values are ranked."""
    many = F.count("*") if n is None else F.sum(n)
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("_bin"), F.col(value).alias("_v")).agg(many.alias("_n"))
    whole = Window.partitionBy(*keys)
    bins = values.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
    bins = bins.select(*keys, "_bin", (F.sum("_m").over(whole.orderBy("_bin")) - F.col("_m")).alias("_before"), "_m", F.sum("_m").over(whole).alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    bins = bins.where((F.col("_before") + F.col("_m") > low) & (F.col("_before") <= high))
    last = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v")) + F.col("_before")
    rows = matched(values, bins, [*keys, "_bin"]).withColumn("_last", last)
    at = lambda rank: F.max(F.when((F.col("_last") > rank) & (F.col("_last") - F.col("_n") <= rank), F.col("_v"))).cast("double")
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))
