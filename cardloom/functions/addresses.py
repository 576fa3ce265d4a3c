"""Encoding of addresses and their parameters, and what addresses of market and price pages say of a card."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .search import ASIAN, WESTERN, _plain_letters

#: The market's codes of sets, by set id.
SET_CODES = {
    "ex9": "EM", "fut2020": "FUT20", "sv02": "PAL", "sv03": "OBF", "sv03.5": "MEW", "sv04": "PAR", "sv04.5": "PAF", "sv05": "TEF", "sv06": "TWM", "sv07": "SCR", "sv08": "SSP", "sv08.5": "PRE",
    "sv2a": "SV2a", "sv4a": "SV4a", "sv8a": "SV8a", "swsh7": "EVS", "swsh8": "FST", "swsh9": "BRS", "swsh9tg": "BRS", "swsh10": "ASR", "swsh10tg": "ASR", "swsh11": "LOR", "swsh11tg": "LOR",
    "swsh12": "SIT", "swsh12tg": "SIT", "swsh12.5": "CRZ"}
#: The market's numbers of languages, and the price pages' words for them.
LANGUAGE_NUMBERS = {"en": 1, "fr": 2, "de": 3, "es": 4, "it": 5, "zh-cn": 6, "ja": 7, "pt": 8, "ko": 10, "zh-tw": 11}
LANGUAGE_WORDS = {"ja": "Japanese", "ko": "Korean", "zh-tw": "Chinese", "zh-cn": "Chinese"}
#: Sets by the names that price pages have for them, in English by set id, and in Asian languages.
ENGLISH_NAMES = {
    "Scarlet & Violet 151": ("sv03.5", "sv3pt5", "sv2a"), "Prismatic Evolutions": ("sv08.5", "sv8pt5", "sv8a"), "Paldean Fates": ("sv04.5", "sv4pt5", "sv4a")}
ASIAN_NAMES = {"Scarlet & Violet 151": ("sv03.5", "sv2a"), "Shiny Treasure ex": ("sv04.5", "sv4a"), "Terastal Festival ex": ("sv08.5", "sv8a")}
#: The same name where Japanese differs, names of sets that mean one of the above, and sets that English has by another id.
JAPANESE_NAMES = {"Terastal Festival ex": "Terastal Festival"}
NAMES_OF_SETS = {"151": "Scarlet & Violet 151", "POKEMON CARD 151": "Scarlet & Violet 151"}
ENGLISH_SETS = {"sv2a": "sv03.5", "sv4a": "sv04.5", "sv8a": "sv08.5"}
#: Words that alone are no name.
SUFFIXES = ("ex", "v", "vmax", "vstar", "gx")


def _mapped(key: Column, values: dict) -> Column:
    """The value of a key in a small fixed table; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _by_set(set_id: Column, names: dict[str, tuple]) -> Column:
    return _mapped(set_id, {s: name for name, sets in names.items() for s in sets})


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def words_joined(*parts: Column) -> Column:
    """The parts that are not blank, a space between them."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def encode_part(x: Column) -> Column:
    """A text as a part of an address: UTF-8 bytes in percents but for letters, digits and ``-_.!~*'()``."""
    kept = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), kept.items(), F.url_encode(x))


def encode_form(x: Column) -> Column:
    """A text as a key or value of a query: a space is a plus sign; letters, digits and ``-_.~`` stay."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(query: Column) -> Column:
    """The parameters of a query in order, an array of ``key`` and ``value``; a part without an equals sign has a blank
    value, empty parts none, and what cannot be decoded stays as it is."""
    read = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))

    def parameter(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        return F.struct(read(key).alias("key"), read(F.substring(part, F.length(key) + 2, F.length(part))).alias("value"))

    return F.transform(F.filter(F.split(_blank(query), "&"), lambda p: p != ""), parameter)


def with_parameters(address: Column, given: dict[str, Column]) -> Column:
    """An address with these parameters in place of its own of the same names, and without its fragment; those that are
    null change nothing. A name counts once, with its last value, where it stood first."""
    plain = F.substring_index(address, "#", 1)
    path = F.substring_index(plain, "?", 1)
    new = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in given.items()))
    every = F.concat(parameters(F.substring(plain, F.length(path) + 2, F.length(plain))), F.filter(new, lambda p: p["value"].isNotNull()))
    last = F.transform(F.array_distinct(F.transform(every, lambda p: p["key"])), lambda k: F.element_at(F.filter(every, lambda p: p["key"] == k), -1))
    query = F.array_join(F.transform(last, lambda p: F.concat(encode_form(p["key"]), F.lit("="), encode_form(p["value"]))), "&")
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def address_slug(x: Column, more: str = "") -> Column:
    """Lower-case letters without marks, and digits; apostrophes vanish, runs of others are one dash, none at the ends."""
    plain = F.regexp_replace(F.translate(_blank(x), *_plain_letters()), "[\\u0300-\\u036f’'`]", "")
    return F.lower(F.btrim(F.regexp_replace(plain, f"[^A-Za-z0-9{more}]+", "-"), F.lit("-")))


def plain_number(number: Column) -> Column:
    """Letters and digits of a collector number before its slash, without zeros in front."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(_blank(number), "/", 1), "[^A-Za-z0-9]", ""), r"^0+(?=\d)", "")


def own_set(set_id: Column, card_id: Column) -> Column:
    """The set's id, or, where it is null, what stands before the last dash of the card's."""
    return F.coalesce(set_id, F.regexp_extract(_blank(card_id), "^(.+)-[^-]+$", 1))


def set_key(set_id: Column) -> Column:
    return F.lower(F.btrim(_blank(set_id)))


def set_code(set_id: Column, card_id: Column) -> Column:
    return F.coalesce(_mapped(set_key(own_set(set_id, card_id)), SET_CODES), set_id, F.lit(""))


def language_number(language: Column) -> Column:
    return _mapped(language, LANGUAGE_NUMBERS)


def market_query(name: Column, set_id: Column, set_name: Column, card_id: Column, number: Column, language: Column) -> Column:
    """What a card is searched for by: its name in Latin letters, its set's code or else name, and its number; by the last two
    alone in an Asian language where the set's id is letters, digits and a letter or none."""
    coded = F.coalesce(language.isin(*ASIAN) & set_key(own_set(set_id, card_id)).rlike(r"^[a-z]+\d+[a-z]?$"), F.lit(False))
    latin = name.rlike("[A-Za-z]") & ~name.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]")
    code = set_code(set_id, card_id)
    return words_joined(F.when(latin & ~coded, name), F.when(code != "", code).otherwise(set_name), plain_number(F.coalesce(number, card_id)))


def known_language(x: Column) -> Column:
    """A language code in lower case if it is one of those known."""
    return F.when(F.lower(x).isin(*ASIAN, *WESTERN), F.lower(x))


def has_name(name: Column) -> Column:
    """Whether a name has a word in Latin letters or digits that is no mere suffix."""
    return F.exists(F.split(address_slug(name), "-"), lambda t: (t != "") & ~t.isin(*SUFFIXES))


def english_set(set_id: Column) -> Column:
    """The id of the set that English has in place of a Japanese one; null for none."""
    return _mapped(F.lower(set_id), ENGLISH_SETS)


def english_set_names(set_id: Column, set_name: Column) -> Column:
    """Names under which a price page may have a set, the likeliest first, each once."""
    plain = F.btrim(F.regexp_replace(address_slug(set_name), "-", " "))
    known = F.coalesce(_by_set(F.lower(_blank(set_id)), ENGLISH_NAMES), _mapped(F.upper(plain), NAMES_OF_SETS))
    bare = reduce(lambda acc, p: F.regexp_replace(acc, p, ""), (r"(?i)^[A-Z0-9]+:\s*", r"(?i)\s+Trainer Gallery$", "(?i)^Pokemon "), _blank(set_name))
    return F.array_distinct(F.filter(F.array(known, set_name, F.btrim(bare)), lambda n: F.coalesce(n != "", F.lit(False))))


def asian_set_name(set_id: Column, language: Column) -> Column:
    """A set's name in an Asian language, after the word for it; null for sets and languages that have none."""
    own = _by_set(set_key(set_id), ASIAN_NAMES)
    named = F.when(language == "ja", F.coalesce(_mapped(own, JAPANESE_NAMES), own)).otherwise(own)
    return F.concat(_mapped(language, LANGUAGE_WORDS), F.lit(" "), named)
