"""Landed answers of card and price providers, JSON of several shapes, as typed rows; what cannot be read is kept with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import first_positive, upper_median
from ..functions.records import at, first_record, is_number, is_record, records_of, text_at
from ..functions.text import set_of_path, variant_from_flags
from .references import EUR, USD

#: Where each kind of payload holds prices. A path ends at a record of prices, or, with ``*`` in it, at
#: one in every entry of a record, whose key is the variant; then the market and its unit.
PRICES = {
    "tcgdex": ((("pricing", "cardmarket"), "cardmarket", "EUR"), (("pricing", "tcgplayer", "*"), "tcgplayer", "USD")),
    "pokemontcg": ((("cardmarket", "prices"), "cardmarket", "EUR"), (("tcgplayer", "prices", "*"), "tcgplayer", "USD")),
    "tcgtracking": ((("tcg", "*"), "tcgplayer", "USD"), (("cardtrader", "*"), "cardtrader", "USD")),
    "pokeprices": (((), "pokeprices", "US cents"),),
}
#: Measures that are prices; other numbers of a record (ids) are not.
MEASURES = (
    "avg", "low", "trend", "avg1", "avg7", "avg30", "avg-holo", "low-holo", "trend-holo", "avg1-holo", "avg7-holo", "avg30-holo", "lowPrice", "midPrice", "highPrice", "marketPrice", "directLowPrice",
    "averageSellPrice", "trendPrice", "mid", "high", "market", "directLow", "mkt", "raw_usd", "psa9_usd", "psa10_usd")
#: The order in which a provider's prices in euros, and those of a variant in dollars, are asked for.
ORDERED_EUR, MEDIAN_USD = ("trendPrice", "avg7", "avg30", "averageSellPrice", "avg1"), ("market", "mid", "low", "directLow")
_ENTRY = "array<struct<market:string,unit:string,variant:string,measure:string,value:double>>"


def _entries(record: Column) -> Column:
    return F.coalesce(F.map_entries(F.try_variant_get(record, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def _priced(record: Column, market: str, unit: str, variant: Column) -> Column:
    known = F.filter(_entries(record), lambda e: e["key"].isin(*MEASURES) & F.coalesce(is_number(e["value"]), F.lit(False)))
    return F.transform(known, lambda e: F.struct(
        F.lit(market).alias("market"), F.lit(unit).alias("unit"), variant.alias("variant"), e["key"].alias("measure"), F.try_variant_get(e["value"], "$", "double").alias("value")))


def _variant_prices(market: str, unit: str) -> Callable[[Column], Column]:
    return lambda e: _priced(e["value"], market, unit, e["key"])


def _prices(record: Column, kind: str) -> Column:
    parts = []
    for path, market, unit in PRICES[kind]:
        if path and path[-1] == "*":
            named = F.filter(_entries(at(record, *path[:-1])), lambda e: F.coalesce(is_record(e["value"]), F.lit(False)))
            parts.append(F.flatten(F.transform(named, _variant_prices(market, unit))))
        else:
            parts.append(_priced(at(record, *path) if path else record, market, unit, F.lit("")))
    return F.concat(*parts).cast(_ENTRY)


def read_provider_prices(payloads: DataFrame, key: str, kind: str, json: str) -> DataFrame:
    """Prices of landed payloads, one row each: ``key``, ``kind``, ``market``, ``unit``, ``variant``, ``measure``, ``value`` and ``error``.

    The column ``kind`` says which of the shapes in ``PRICES`` a payload has. Numbers alone are prices; a record without any gives
    no rows. A payload that is no JSON, no record, or of no known kind has one row with an ``error`` and no price."""
    v = F.try_parse_json(json)
    reason = F.when(F.col(kind).isNull() | ~F.col(kind).isin(*PRICES), "unknown kind").when(v.isNull(), "malformed JSON").when(~is_record(v), "not a record")
    rows = payloads.select(key, F.col(kind).alias("kind"), v.alias("_v"), reason.alias("error"))
    found = F.array().cast(_ENTRY)
    for k in PRICES:
        found = F.when(F.col("kind") == k, _prices(F.col("_v"), k)).otherwise(found)
    good = rows.where("error is null").select(key, "kind", F.inline(found), F.lit(None).cast("string").alias("error"))
    none = {c: F.lit(None).cast(t) for c, t in good.dtypes if c not in (key, "kind", "error")}
    bad = rows.where("error is not null").select(key, "kind", "error").withColumns(none)
    return good.unionByName(bad.select(*good.columns))


def api_reference(payloads: DataFrame, key: str, json: str, filtered: bool = False) -> DataFrame:
    """The reference row of the second provider's payloads: ``key``, ``raw`` in whole DKK, ``raw_source``, ``status``, ``note``, ``sources``, ``url``.

    In euros the first price above zero in a fixed order; in dollars the upper median of the first variant, in the payload's
    order, that has a price. With a filter on language or condition there is no raw price, as the provider has none, and a note
    says the aggregate. A payload that is no record has neither price nor source."""
    v = F.try_parse_json(json)
    own = at(v, "cardmarket", "prices")
    eur = first_positive(*(F.when(is_number(at(own, m)), F.try_variant_get(at(own, m), "$", "double")) for m in ORDERED_EUR))
    order = F.map_keys(F.from_json(F.get_json_object(json, "$.tcgplayer.prices"), "map<string,string>"))
    variants = F.try_variant_get(at(v, "tcgplayer", "prices"), "$", "map<string,variant>")
    number = lambda r, m: F.when(is_number(at(r, m)), F.try_variant_get(at(r, m), "$", "double"))
    medians = F.transform(order, lambda k: upper_median(F.array(*(number(F.element_at(variants, k), m) for m in MEDIAN_USD))))
    usd = F.get(F.filter(medians, lambda x: x.isNotNull()), 0)
    rows = payloads.select(key, eur.alias("_eur"), usd.alias("_usd"), F.when(usd.isNotNull(), text_at(at(v, "tcgplayer"), "url")).alias("url"))
    euro, dollar = F.col("_eur"), F.col("_usd")
    whole = lambda x, rate: F.floor(x * rate + 0.5).cast("double")
    raw = F.lit(None).cast("double") if filtered else F.coalesce(whole(euro, EUR), whole(dollar, USD))
    note = F.when(euro.isNotNull(), F.concat(F.lit("Filtered price unavailable; the aggregate is "), whole(euro, EUR).cast("bigint").cast("string"), F.lit(" DKK."))) if filtered else F.lit(None).cast("string")
    return rows.select(
        key, raw.alias("raw"), F.when(euro.isNotNull(), "cardmarket").when(dollar.isNotNull(), "tcgplayer").alias("raw_source"),
        (F.lit("filtered_unavailable") if filtered else F.lit(None).cast("string")).alias("status"), note.alias("note"),
        F.array_compact(F.array(F.when(euro.isNotNull(), "cardmarket"), F.when(dollar.isNotNull(), "tcgplayer"))).alias("sources"), "url")


def cards_from_sets(sets: DataFrame, details: DataFrame, language: str, max_sets: int | None = None, set_ids: list[str] | None = None, latest_first: bool = False) -> DataFrame:
    """Cards of set documents: ``sets`` (``place``, ``json``: a set with its ``cards``), ``details`` (``card_id``, ``json``).

    A card counts if it has an id, a detail and an image; what the detail says comes before the set's brief. ``max_sets`` keeps the first
    sets that have a card, in their order or the latest first; sets without one do not count. The limit is taken over one
    row a set, by the best of each task. Malformed documents give no cards."""
    s = sets.select("place", first_record(F.try_parse_json("json")).alias("_s"))
    s = s.select("place", text_at(F.col("_s"), "id").alias("set_id"), text_at(F.col("_s"), "name").alias("_name"), F.coalesce(text_at(F.col("_s"), "releaseDate"), F.lit("")).alias("_date"), records_of(at(F.col("_s"), "cards")).alias("_cards")).where("set_id is not null")
    if set_ids:
        s = s.where(F.col("set_id").isin(*set_ids))
    briefs = s.select("place", "set_id", "_name", "_date", F.posexplode("_cards").alias("position", "_b")).withColumn("id", text_at(F.col("_b"), "id"))
    d = details.select(F.col("card_id").alias("id"), first_record(F.try_parse_json("json")).alias("_d")).where("_d is not null")
    b, x = F.col("_b"), F.col("_d")
    either = lambda k: F.coalesce(text_at(x, k), text_at(b, k), F.lit(""))
    flag = lambda k: F.coalesce(F.try_variant_get(at(x, "variants", k), "$", "boolean"), F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit(""))
    cards = briefs.where("id is not null").join(d, "id").withColumn("image_url", either("image")).where("image_url <> ''").select(
        "place", "position", "_date", "id", either("name").alias("name"), "set_id", F.coalesce(text_at(at(x, "set"), "name"), "_name", F.lit("")).alias("set_name"), either("localId").alias("local_id"), "image_url",
        F.lit(language).alias("language"), blank(text_at(at(x, "set", "cardCount"), "official")).alias("printed_total"), variant_from_flags(flag("firstEdition"), flag("reverse"), flag("holo")).alias("variant_class"),
        blank(text_at(x, "rarity")).alias("rarity"), blank(text_at(x, "regulationMark")).alias("regulation_mark"))
    if max_sets is not None:
        order = [F.desc("_date"), "place"] if latest_first else ["place"]
        first = cards.select("place", "_date").distinct().orderBy(*order).limit(max_sets)
        cards = cards.join(first.select("place"), "place", "left_semi")
    return cards.drop("_date")


def page_items(pages: DataFrame) -> DataFrame:
    """Items of result pages (``page``, ``json``) as they stand: ``page``, ``position``, ``card_id``, ``thumb``, ``alt_text``, ``view_text``, blank where missing."""
    every = pages.select("page", F.posexplode(records_of(at(F.try_parse_json("json"), "cardList"))).alias("position", "_i"))
    names = {"card_id": "cardID", "thumb": "cardThumbFile", "alt_text": "cardNameAltText", "view_text": "cardNameViewText"}
    return every.select("page", "position", *(F.coalesce(text_at(F.col("_i"), k), F.lit("")).alias(n) for n, k in names.items()))


def cards_from_pages(pages: DataFrame, images: DataFrame, site: str) -> DataFrame:
    """Cards of result pages whose image is there (``images``: ``card_id``): the first item of each id, by page and position, that has an
    image path. The set is the folder of the image's path."""
    items = page_items(pages).where("card_id <> '' and thumb <> ''")
    first = items.groupBy("card_id").agg(F.min_by(F.struct("thumb", F.coalesce(F.nullif("alt_text", F.lit("")), "view_text").alias("name")), F.struct("page", "position")).alias("i"))
    set_id = set_of_path(F.col("i.thumb"))
    return first.join(images.select("card_id").distinct(), "card_id", "left_semi").select(
        F.concat(F.lit("official-jp-"), "card_id").alias("id"), "i.name", set_id.alias("set_id"), F.col("card_id").alias("local_id"), F.concat(F.lit(site), F.when(~F.startswith("i.thumb", F.lit("/")), "/").otherwise(""), "i.thumb").alias("image_url"),
        F.concat(F.lit(f"{site}/card-search/details.php/card/"), "card_id", F.lit("/regu/all")).alias("marketplace_url"))


def clean_set_name(name: Column) -> Column:
    """A set's name without the code before a colon and the gallery behind it."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^[A-Z0-9]+:\s*", ""), r"(?i)\s+Trainer Gallery$", ""))


def search_rows(records: DataFrame, key: str, kind: str, json: str) -> DataFrame:
    """Cards of three kinds of records as rows for searching: ``key``, ``id``, ``name``, ``set_name``, ``local_id``, ``image_url``, ``language``, ``source``, ``set_id``.

    Kinds: ``tcgdex`` (a card's detail; its number with the official total, or the other, where one is not zero), ``tcgtracking`` (a product
    with its ``set``) and ``pokemontcg`` (an English card). Missing texts are blank; other records and kinds give no rows."""
    rows = records.select(key, F.col(kind).alias("source"), first_record(F.try_parse_json(json)).alias("_v")).where(F.col("_v").isNotNull() & F.col("source").isin("tcgdex", "tcgtracking", "pokemontcg"))
    v, kind_of = F.col("_v"), F.col("source")
    text = lambda *path: F.coalesce(text_at(at(v, *path[:-1]) if len(path) > 1 else v, path[-1]), F.lit(""))
    total = F.coalesce(*(F.nullif(F.nullif(text("set", "cardCount", k), F.lit("")), F.lit("0")) for k in ("official", "total")))
    by = lambda a, b, c: F.when(kind_of == "tcgdex", a).when(kind_of == "tcgtracking", b).otherwise(c)
    image = F.when(text("image") != "", F.concat(text("image"), F.lit("/low.webp"))).otherwise("")
    return rows.select(
        key, by(text("id"), F.concat(F.lit("tcgtracking-"), text("id")), F.concat(F.lit("pokemontcg-"), text("id"))).alias("id"), by(text("name"), F.coalesce(F.nullif(text("clean_name"), F.lit("")), text("name")), text("name")).alias("name"),
        by(text("set", "name"), clean_set_name(text("set", "name")), text("set", "name")).alias("set_name"),
        by(F.concat_ws("/", text("localId"), total), text("number"), F.concat_ws("/", text("number"), F.coalesce(*(F.nullif(F.nullif(text("set", k), F.lit("")), F.lit("0")) for k in ("printedTotal", "total"))))).alias("local_id"),
        by(image, text("image_url"), text("images", "small")).alias("image_url"), by(F.coalesce(F.nullif(text("language"), F.lit("")), F.lit("en")), F.lit("en"), F.lit("en")).alias("language"), "source", text("set", "id").alias("set_id"))
