"""Reference values: one row per provider, and their merge into one row per card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import first_positive, is_positive, upper_median, variant_price

#: Rates to DKK, and the sources of each value by priority.
EUR, USD = 7.46, 7.0
PRIORITY = {
    "raw": ("cardmarket", "tcgplayer", "pokeprices", "pricecharting"), "psa7": ("pricecharting",), "psa8": ("pricecharting",),
    "psa9": ("pokeprices", "pricecharting"), "psa95": ("pricecharting",), "psa10": ("pokeprices", "pricecharting"),
}
FILTERED = ("live_filtered", "filtered")


def _there(x: Column) -> Column:
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


def select_value(name: str, priority: tuple[str, ...]) -> Column:
    """Value and source: of the first source by priority that a row with a value lists; else the first value, without a source.

    A row lists all its ``sources``, so a value may be told by another source than its own."""
    ranks = F.transform(F.array(*map(F.lit, priority)), lambda s: F.when(F.array_contains("sources", s), F.array_position(F.array(*map(F.lit, priority)), s)))
    rank = F.coalesce(F.array_min(ranks), F.lit(len(priority) + 1))
    row = F.struct(rank.alias("rank"), F.col("ord"), F.col(name).alias("value"))
    best = F.min(F.when(_there(F.col(name)), row))
    return F.struct(best["value"].alias("value"), F.get(F.array(*map(F.lit, priority)), best["rank"].cast("int") - 1).alias("source"))


def merge_references(rows: DataFrame, require_filtered: bool = False) -> DataFrame:
    """One row per card from rows of providers: ``card_id``, ``ord``, the six values, ``raw_source``, ``status``, ``note``,
    ``sources`` (array) and ``urls`` (map).

    Status and note are of the first row whose raw value is the chosen one (no value equals no value)
    and which knows its source; else of the first row with a status. With ``require_filtered`` raw is
    the first filtered value alone. Rows go by ``ord``; one shuffle on the card.
    """
    unavailable = (F.col("status") == "filtered_unavailable") & F.array_contains("sources", "cardmarket")
    by_filter = F.min(F.when(F.col("status").isin(*FILTERED) & _there(F.col("raw")), F.struct("ord", F.col("raw").alias("value"), F.coalesce("raw_source", F.lit("cardmarket")).alias("source"))))
    raw = F.struct(by_filter["value"].alias("value"), F.coalesce(by_filter["source"], F.when(F.count_if(unavailable) > 0, "cardmarket")).alias("source"))
    entry = F.struct("ord", "raw", "raw_source", "status", "note", "sources", "urls")
    merged = rows.groupBy("card_id").agg(
        *((raw if require_filtered and k == "raw" else select_value(k, p)).alias(k) for k, p in PRIORITY.items()),
        F.array_sort(F.collect_list(entry), lambda a, b: a["ord"] - b["ord"]).alias("rows"))
    source, value = F.col("raw.source"), F.col("raw.value")
    chosen = F.filter("rows", lambda r: r["raw"].eqNullSafe(value) & (source.isNull() | r["raw_source"].eqNullSafe(source) | F.array_contains(r["sources"], source)))
    meta = F.coalesce(F.get(chosen, 0), F.get(F.filter("rows", lambda r: r["status"].isNotNull()), 0))
    urls = F.aggregate(
        "rows", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda acc, r: F.map_concat(acc, F.map_filter(r["urls"], lambda k, v: ~F.map_contains_key(acc, k))))
    return merged.withColumn("_meta", meta).select(
        "card_id", *(c for k in PRIORITY for c in (F.col(f"{k}.value").alias(k), F.col(f"{k}.source").alias(f"{k}_source"))),
        F.col("_meta.status").alias("status"), F.col("_meta.note").alias("note"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: r["sources"]))).alias("sources"), urls.alias("urls"))


def reference_with_late(rows: DataFrame, late: DataFrame) -> DataFrame:
    """Merge, and merge again with the late source for the cards that lack one of the values for grades 7 to 10."""
    first = merge_references(rows)
    whole = first.where(" AND ".join(f"coalesce({k} <> 0, false)" for k in ("psa7", "psa8", "psa9", "psa10")))
    both = rows.unionByName(late).join(whole.select("card_id"), "card_id", "left_anti")
    return whole.unionByName(merge_references(both))


def best_variant(*variants: Column) -> Column:
    """The upper median of the first variant that has a positive price; a variant is an array of prices."""
    return F.coalesce(*(upper_median(v) for v in variants))


def market_or_low(*groups: Column) -> Column:
    """The first price there is, by group its market, mid and low price."""
    return F.coalesce(*(g[name] for g in groups for name in ("market", "mkt", "low")))


def provider_reference(rows: DataFrame, filtered: bool = False) -> DataFrame:
    """The reference row of a provider's price fields (EUR ``primary`` and ``alternate`` arrays in order, USD
    ``variants``, ``filtered_eur``), rounded DKK.

    A secret card of a Japanese subset whose name holds ``ex`` and that costs less than 5 without an
    alternate price is priced in hundreds.
    """
    first, other = F.col("primary"), F.col("alternate")
    ordered = lambda xs: F.get(F.filter(xs, is_positive), 0)
    one, two = ordered(first), ordered(other)
    selected = variant_price(one, two)
    secret = (
        F.col("set_id").rlike(r"(?i)^SV\d+[a-z]$") & (F.col("local_id").try_cast("double") > F.nullif(F.col("official"), F.lit(0)))
        & F.col("name").rlike(r"(?i)(?<![A-Za-z0-9_])ex(?![A-Za-z0-9_])") & two.isNull() & (selected < 5) & (selected == one))
    eur = F.when(F.coalesce(secret, F.lit(False)), F.round(selected * 100)).otherwise(selected)
    priced = rows.withColumns({"_all": eur, "_eur": F.coalesce("filtered_eur", eur) if filtered else eur, "_usd": best_variant("holo", "normal", "reverse")})
    status = F.when(F.col("filtered_eur").isNotNull(), "filtered").when(F.col("_eur").isNotNull(), "aggregate")
    status = status.otherwise("filtered_unavailable") if filtered else F.when(F.col("_eur").isNotNull(), "aggregate")
    raw = F.col("_eur") * EUR if filtered else F.coalesce(F.col("_eur") * EUR, F.col("_usd") * USD)
    aggregate = F.round(F.col("_all") * EUR).cast("bigint").cast("string")
    note = F.when(status == "aggregate", "Aggregate price; language and condition apply at the market only.").when(
        status == "filtered_unavailable", F.when(aggregate.isNotNull(), F.concat(F.lit("Filtered price unavailable; the aggregate is "), aggregate, F.lit(" DKK."))).otherwise("Filtered price unavailable."))
    known = F.col("_eur").isNotNull() | F.col("_all").isNotNull() | F.col("product").isNotNull()
    return priced.select(
        "card_id", F.round(raw).alias("raw"), F.when(F.col("_eur").isNotNull(), "cardmarket").when(F.col("_usd").isNotNull(), "tcgplayer").alias("raw_source"),
        status.alias("status"), note.alias("note"),
        F.filter(F.array(F.when(known, F.lit("cardmarket")), F.when(F.col("_usd").isNotNull(), F.lit("tcgplayer"))), lambda x: x.isNotNull()).alias("sources"))


def guide_reference(rows: DataFrame) -> DataFrame:
    """Guide values in USD (``raw_usd``, ``psa9_usd``, ``psa10_usd``) as whole DKK; none and zero are null."""
    dkk = lambda c: F.when(F.col(c) > 0, F.round(F.col(c) * USD)).alias(c.removesuffix("_usd"))
    return rows.select("card_id", dkk("raw_usd"), dkk("psa9_usd"), dkk("psa10_usd"))


def overlay_manual(references: DataFrame, manual: DataFrame) -> DataFrame:
    """References with manual values over them; what a manual value gives has the source ``manual``."""
    m = manual.select("card_id", *(F.when(F.col(k) > 0, F.col(k)).alias(f"_{k}") for k in PRIORITY))
    joined = references.join(m, "card_id", "left")
    columns = {k: F.coalesce(f"_{k}", k) for k in PRIORITY} | {f"{k}_source": F.when(F.col(f"_{k}").isNotNull(), "manual").otherwise(F.col(f"{k}_source")) for k in PRIORITY}
    said = F.coalesce(*(F.col(f"_{k}") for k in PRIORITY)).isNotNull()
    sources = F.when(said, F.array_union("sources", F.array(F.lit("manual")))).otherwise(F.col("sources"))
    return joined.withColumns(columns | {"sources": sources, "is_manual": said}).drop(*(f"_{k}" for k in PRIORITY))


def grade_rows(references: DataFrame) -> DataFrame:
    """One row per card and grade that has a value, with its source."""
    pairs = F.array(*(F.struct(F.lit(k).alias("grade"), F.col(k).alias("value"), F.col(f"{k}_source").alias("source")) for k in PRIORITY))
    return references.select("card_id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def first_of(*prices: Column) -> Column:
    return first_positive(*prices)
