"""Prices, margins and decisions as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Default settings: fixed values of the domain."""

    yen_divisor: float = 25.0
    selling_fee: float = 0.05
    buy: float = 30.0
    maybe: float = 15.0
    grading_fee: float = 220.0
    high_end_cost: float = 3250.0


def is_positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def upper_median(values: Column) -> Column:
    """The middle of the positive values; of two, the upper. None: null."""
    xs = F.array_sort(F.filter(values, is_positive))
    return F.get(xs, F.floor(F.size(xs) / 2).cast("int"))


def first_positive(*values: Column) -> Column:
    return F.coalesce(*(F.when(is_positive(v), v) for v in values))


def variant_price(primary: Column, alternate: Column) -> Column:
    """The alternate where there is no primary, or where it is 1 at least and three times the primary."""
    a, b = F.when(is_positive(primary), primary), F.when(is_positive(alternate), alternate)
    return F.when(a.isNull(), b).when((b >= 1) & (b >= a * 3), b).otherwise(a)


def cost_of(yen: Column, settings: Settings = Settings()) -> Column:
    return F.when(yen > 0, yen / settings.yen_divisor).otherwise(0.0) if settings.yen_divisor > 0 else F.lit(0.0)


def net_of(value: Column, cost: Column, settings: Settings = Settings()) -> Column:
    """Null where the value or the cost is missing; zero is missing."""
    there = F.coalesce((value != 0) & ~F.isnan(value) & (cost != 0) & ~F.isnan(cost), F.lit(False))
    return F.when(there, value * (1 - settings.selling_fee))


def margin_of(value: Column, cost: Column, settings: Settings = Settings()) -> Column:
    return (net_of(value, cost, settings) - cost) / cost * 100


def decide_margin(margin: Column, buy: Column | float, maybe: Column | float) -> Column:
    return F.when(margin >= buy, "BUY").when(margin >= maybe, "MAYBE").otherwise("SKIP")
