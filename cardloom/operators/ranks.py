"""Values by their rank within groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import is_positive
from ..sources.scratch import kept


def values_at_ranks(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """The values at some ranks (from 1, in rising order) of each group: the group, ``n`` (its values), ``rank`` and the value.

    ``ranks`` makes an array of a few ranks from a group's ``n``; those beyond it give no rows. Null values do not count; a null
    group is a group. Equal values are counted before they are shuffled. Groups are cut into ranges of values, so one
    of many values is spread over tasks: the ranges' totals say which of them holds a rank, and only those are summed value by value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = kept(counted.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy(*by, "_p").agg(F.sum("_n").alias("_s")).withColumns({"_b": before, "n": F.sum("_s").over(group)})
    held = F.filter(F.array_distinct(ranks(F.col("n"))), lambda r: (r > F.col("_b")) & (r <= F.col("_b") + F.col("_s")))
    wanted = parts.select(*(F.col(c).alias(f"_{c}_") for c in by), F.col("_p").alias("_q"), "_b", "n", held.alias("_ranks")).where(F.size("_ranks") > 0)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by], F.col("_p") == F.col("_q"))
    upto = F.col("_b") + F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy(value))
    here = F.filter("_ranks", lambda r: (r > F.col("_e") - F.col("_n")) & (r <= F.col("_e")))
    return dealt.join(wanted, same).withColumn("_e", upto).select(*by, "n", F.explode(here).alias("rank"), value)


def group_upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the middle of its values above zero, of two the upper: the group and ``median``; a group without such has none."""
    there = values_at_ranks(rows.where(is_positive(F.col(value))), by, value, lambda n: F.array(F.floor(n / 2) + 1))
    found = there.select(*(F.col(c).alias(f"_{c}_") for c in by), F.col(value).alias("median"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by])
    return rows.select(*by).distinct().join(found, same, "left").select(*by, "median")
