"""Requests and addresses of market and price pages for cards, and answers of the market as references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as a
from ..functions.money import is_positive
from ..functions.search import in_bucket
from ..functions.values import CODES, LABELS
from .links import slug_number
from .references import EUR


def _condition_number(condition: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, CODES)), condition), F.lit(0))


def market_requests(cards: DataFrame, site: str, api: str) -> DataFrame:
    """What the market is asked for each card: ``id``, ``query``, ``own_set``, ``language_number``, ``condition_number``, ``search_url``
    and ``articles_url`` (null for a card without a product).

    ``cards``: ``id``, ``card_id``, ``name``, ``set_id``, ``set_name``, ``local_id``, ``product_id``, and what is asked for, ``wanted_language``
    and ``least_condition``; any may be null. Unknown languages and conditions ask for nothing at the site; to the interface a
    condition goes as it is."""
    c = F.col
    base = cards.withColumns({
        "query": a.market_query(c("name"), c("set_id"), c("set_name"), c("card_id"), c("local_id"), c("wanted_language")),
        "own_set": a.own_set(c("set_id"), c("card_id")), "language_number": a.language_number(c("wanted_language")),
        "condition_number": _condition_number(c("least_condition"))})
    text = lambda key, v: F.concat(F.lit(f"&{key}="), F.nullif(v.cast("string"), F.lit("")))
    blank = F.lit("")
    search = F.concat(F.lit(f"{site}/Products/Search?searchString="), a.encode_part(c("query")), F.coalesce(text("language", c("language_number")), blank), F.coalesce(text("minCondition", c("condition_number")), blank))
    articles = F.concat(
        F.lit(f"{api}/articles/"), c("product_id").cast("string"), F.lit("?maxResults=10&start=0"),
        F.coalesce(text("idLanguage", c("language_number")), blank), F.coalesce(text("minCondition", F.url_encode("least_condition")), blank))
    return base.select("id", "query", "own_set", "language_number", "condition_number", search.alias("search_url"), articles.alias("articles_url"))


def price_pages(cards: DataFrame, site: str) -> DataFrame:
    """Addresses at which a price page of each card may be: ``id``, ``pages`` (the likeliest first; none without a name and number) and ``search_url``.

    ``cards``: ``id``, ``name``, ``set_id``, ``set_name``, ``local_id``, ``language``, and what is asked for, ``wanted_language`` and ``bucket``. In Asian
    languages there is one page, for known sets and names in Latin letters; asking for Asian cards in another language gives none."""
    c = F.col
    language = F.coalesce("wanted_language", a.known_language(c("language")))
    asian, named = in_bucket(language, "asian"), F.coalesce(a.has_name(c("name")), F.lit(False))
    slug = F.concat_ws("-", F.nullif(a.address_slug(c("name")), F.lit("")), F.nullif(slug_number(c("local_id")), F.lit("")))
    local = a.asian_set_name(c("set_id"), language)
    none = F.array().cast("array<string>")
    sets = F.when(asian, F.when(named & local.isNotNull(), F.array(local)).otherwise(none)).when(c("bucket") == "asian", none).otherwise(a.english_set_names(c("set_id"), c("set_name")))
    rows = cards.select("id", sets.alias("_sets"), slug.alias("_slug"), a.words_joined(a.set_key(c("set_id")), F.when(named, c("name")), slug_number(c("local_id"))).alias("_query"))
    # in the set's part of an address an ampersand is a word of its own
    page = lambda s: F.concat(F.lit(f"{site}/game/pokemon-"), a.address_slug(F.replace(s, F.lit("&"), F.lit(" & ")), "&"), F.lit("/"), F.col("_slug"))
    return rows.select(
        "id", F.when(F.col("_slug") == "", none).otherwise(F.transform("_sets", page)).alias("pages"),
        F.concat(F.lit(f"{site}/search-products?q="), a.encode_part(F.col("_query")), F.lit("&type=prices")).alias("search_url"))


def live_references(answers: DataFrame) -> DataFrame:
    """The reference row of each live answer of the market: ``id``, ``raw`` in whole DKK, ``raw_source``, ``status``, ``note``, ``url``; all null but the id
    for an answer that is not ``ok`` or has no price above zero.

    ``answers``: ``id``, ``ok``, ``raw_eur``, ``product_url``, ``search_url``, ``fallback_url``, ``condition``, ``wanted_condition`` (asked for here),
    ``requested_condition`` (asked for as the answer says), ``listing_count``, ``exact_count``. The note says how many listings there are, how many
    of just the condition, and, if the listing is of another one than asked for, that its price is an upper bound."""
    code = lambda x: F.when(F.upper(x).isin(*CODES), F.upper(x))
    own, asked = code(F.col("condition")), code(F.coalesce("wanted_condition", "requested_condition"))
    titles = {v: k.title() for k, v in LABELS}
    label = F.element_at(F.create_map(*(F.lit(x) for kv in titles.items() for x in kv)), own)
    count = F.when(F.col("listing_count") > 1, F.concat(F.col("listing_count").cast("string"), F.lit(" matching listings"))).otherwise("1 matching listing")
    exact = F.coalesce(F.concat(F.col("exact_count").cast("string"), F.lit(" exact-condition listings; ")), F.lit(""))
    note = (
        F.when(own.isNull() | asked.isNull(), F.concat(F.lit("Lowest live Cardmarket listing ("), count, F.lit(").")))
        .when(own == asked, F.concat(F.lit("Lowest live Cardmarket "), label, F.lit(" listing. ("), exact, count, F.lit(").")))
        .otherwise(F.concat(F.lit("Condition mismatch: cheapest live listing is "), label, F.lit(", not "), F.element_at(F.create_map(*(F.lit(x) for kv in titles.items() for x in kv)), asked), F.lit(
            ". Cardmarket filters by minimum condition, so treat this as an upper-bound reference."))))
    there = F.coalesce(F.col("ok"), F.lit(False)) & is_positive(F.col("raw_eur"))
    return answers.select(
        "id", F.when(there, F.floor(F.col("raw_eur") * EUR + 0.5).cast("double")).alias("raw"), F.when(there, "cardmarket").alias("raw_source"), F.when(there, "live_filtered").alias("status"),
        F.when(there, note).alias("note"), F.when(there, F.coalesce("product_url", "search_url", "fallback_url")).alias("url"))
