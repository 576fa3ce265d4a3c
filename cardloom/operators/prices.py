"""Listings and reference prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import is_positive
from ..sources.fixtures import CONDITIONS

#: Sources by priority for each kind of value.
RAW_PRIORITY = ("cardmarket", "tcgplayer", "pokeprices", "pricecharting")
GRADED_PRIORITY = ("pokeprices", "pricecharting")


def condition_rank(condition: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, CONDITIONS)), condition), F.lit(0))


def condition_at_least(listings: DataFrame, least: str) -> DataFrame:
    """Listings of this condition or a better one; unknown conditions go."""
    return listings.where(condition_rank(F.col("condition")) <= CONDITIONS.index(least) + 1)


def distinct_listings(listings: DataFrame) -> DataFrame:
    """One listing per article: the first by product, seller and price."""
    rest = [c for c in listings.columns if c != "article_id"]
    first = F.min(F.struct("product_id", "seller", "price", "condition")).alias("l")
    return listings.groupBy("article_id").agg(first).select("article_id", "l.*").select(*rest, "article_id")


def reference_listing(listings: DataFrame, requested: str) -> DataFrame:
    """Per product the cheapest listing of the requested condition, else of any better one; with counts."""
    exact = F.col("condition") == requested
    pick = F.min(F.struct((~exact).alias("other"), "price", "article_id", "condition", "seller")).alias("l")
    good = condition_at_least(listings.where(is_positive(F.col("price"))), requested)
    return good.groupBy("product_id").agg(pick, F.count_if(exact).alias("exact_count"), F.count(F.lit(1)).alias("listing_count")).select(
        "product_id", "l.price", "l.article_id", "l.condition", "l.seller", "exact_count", "listing_count")


def lowest_price(listings: DataFrame) -> DataFrame:
    return listings.groupBy("product_id").agg(F.min(F.when(is_positive(F.col("price")), F.col("price"))).alias("lowest"))


def _first_by(value: str, priority: Sequence[str]) -> Column:
    """Value and source of the first source by priority that has one; others follow in their order, without a source."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    key = F.when(place > 0, place).otherwise(F.lit(len(priority)) + 1 + F.col("source_order"))
    row = F.struct(key.alias("k"), F.col(value).alias("value"), F.when(place > 0, F.col("source")).alias("source"))
    return F.min(F.when(is_positive(F.col(value)), row))


def merge_references(prices: DataFrame) -> DataFrame:
    """One reference row per card from one row per card and source, by priority; one shuffle on the card."""
    kinds = {"raw": RAW_PRIORITY, "psa9": GRADED_PRIORITY, "psa10": GRADED_PRIORITY}
    merged = prices.groupBy("card_id").agg(
        *(_first_by(k, p).alias(k) for k, p in kinds.items()),
        F.array_sort(F.collect_set(F.when(F.coalesce("raw", "psa9", "psa10").isNotNull(), F.struct("source_order", "source")))).alias("s"))
    return merged.select(
        "card_id", *(c for k in kinds for c in (F.col(f"{k}.value").alias(k), F.col(f"{k}.source").alias(f"{k}_source"))),
        F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"))


def positive_prices(rows: DataFrame, price: str = "price") -> DataFrame:
    return rows.where(is_positive(F.col(price)))


def attach_prices(cards: DataFrame, prices: DataFrame) -> DataFrame:
    """Every card with its sources' rows in their order; a card without prices has an empty array."""
    rows = prices.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("source_order", "source", "raw", "psa9", "psa10"))).alias("prices"))
    joined = cards.join(rows.withColumnRenamed("card_id", "id"), "id", "left")
    return joined.withColumn("prices", F.coalesce("prices", F.array().cast(rows.schema["prices"].dataType)))
