"""Scores of links on result pages for a card, and rules for hits and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import in_bucket, search_token
from .search import best_link

#: What a page's address holds for a language, and the points of an address for a card.
LANGUAGE_PARTS = {"ja": "pokemon-japanese-", "ko": "pokemon-korean-", "zh-tw": "pokemon-chinese-", "zh-cn": "pokemon-chinese-"}
SEARCH_POINTS = {"language": 100, "other_language": -80, "number": 50, "token": 10}
SEARCH_LEAST = 130
PRODUCT_POINTS = {"query": 5, "name": 2, "number": 8, "set": 8}


def slug_number(number: Column) -> Column:
    """A collector number as addresses have it: the part before the slash, lower-case letters and digits, without zeros in front."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.split(F.coalesce(number, F.lit("")), "/")[0], "[^A-Za-z0-9]", ""), r"^0+(?=\d)", ""))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(search_token(text), "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def _points(tokens: Column, text: Column, each: int) -> Column:
    return each * F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def search_link_score(link: Column, name: Column, number: Column, language: Column) -> Column:
    """Points of a price page's address: the card's language in it, or another one's; its number at the end; each part of its name of two letters."""
    p, low = SEARCH_POINTS, F.lower(link)
    last = F.element_at(F.split(low, "/"), -1)
    own = F.coalesce(*(F.when(language == k, v) for k, v in LANGUAGE_PARTS.items()))
    others = [F.contains(low, F.lit(v)) for v in sorted(set(LANGUAGE_PARTS.values()))]
    spoken = F.when(own.isNotNull() & F.contains(low, own), p["language"]).when(others[0] | others[1] | others[2], p["other_language"]).otherwise(0)
    n = slug_number(number)
    numbered = F.when((n != "") & ((last == n) | F.endswith(last, F.concat(F.lit("-"), n))), p["number"]).otherwise(0)
    return spoken + numbered + _points(F.filter(_tokens(name), lambda t: F.length(t) > 1), last, p["token"])


def product_link_score(link: Column, query: Column, name: Column, number: Column, set_id: Column) -> Column:
    """Points of a product's address: each word of the query and of the name, the number before its slash, and the set."""
    p, plain = PRODUCT_POINTS, lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]+", " "))
    text = plain(link)
    word = lambda x: F.filter(F.split(plain(x), " "), lambda t: t != "")
    head, sets = F.trim(plain(F.split(number, "/")[0])), F.trim(plain(set_id))
    one = lambda x, each: F.when((x != "") & F.contains(text, x), each).otherwise(0)
    return _points(word(query), text, p["query"]) + _points(word(name), text, p["name"]) + one(head, p["number"]) + one(sets, p["set"])


def best_search_links(links: DataFrame) -> DataFrame:
    """Per ``page_id`` the price page of most points for its card, from ``SEARCH_LEAST``; of equal ones the earlier ``place``.
    ``links``: page_id, place, link, name, local_id, language; addresses without ``/game/`` do not count."""
    return best_link(links.where(F.contains("link", F.lit("/game/"))), search_link_score(F.col("link"), F.col("name"), F.col("local_id"), F.col("language")), SEARCH_LEAST)


def best_product_links(links: DataFrame) -> DataFrame:
    """Per ``page_id`` the single's address of most points, of equal ones the earlier ``place``. ``links``: page_id, place, link, query, name, local_id, set_id."""
    singles = links.where(F.contains("link", F.lit("/Products/Singles/")))
    return best_link(singles, product_link_score(F.col("link"), F.col("query"), F.col("name"), F.col("local_id"), F.col("set_id")))


def hit_matches(kind: Column, slug: Column, subtitle: Column, hit_number: Column, hit_name: Column, number: Column, name: Column) -> Column:
    """Whether a search hit is a card's: a card with an address and a subtitle, of the same number where both have one, whose name
    holds any word of the card's of two letters; a name missing on either side does not speak against it."""
    there = (F.coalesce(kind, F.lit("")) == "card") & (F.coalesce(slug, F.lit("")) != "") & (F.coalesce(subtitle, F.lit("")) != "")
    a, b = slug_number(number), slug_number(hit_number)
    word = lambda x: F.trim(F.regexp_replace(search_token(x), "[^A-Z0-9]+", " "))
    own, other = word(name), word(hit_name)
    any_word = F.exists(F.filter(F.split(own, " "), lambda t: F.length(t) > 1), lambda t: F.contains(other, t))
    return there & ~((a != "") & (b != "") & (a != b)) & ((own == "") | (other == "") | any_word)


def source_is_used(language: Column, wanted: Column, bucket: Column) -> Column:
    """Whether the source of English prices is asked for a card: not for Asian cards, languages asked for, or kinds."""
    asian = lambda x: in_bucket(x, "asian")
    return ~((F.coalesce(bucket, F.lit("")) == "asian") | asian(wanted) | asian(language))
