"""Keys of names, sets and collector numbers for searching, and the parts of a score."""

from __future__ import annotations

import unicodedata
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages of each bucket.
ASIAN, WESTERN = ("ja", "ko", "zh-tw", "zh-cn"), ("en", "fr", "de", "es", "it", "pt")
#: Series by their prefix in a set id, and the recency of the series.
SERIES = (("sv", 300), ("swsh", 200), ("sm", 100), ("ex", 0))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the same without."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250)]
    marked = [(a, b) for a, b in pairs if a != b and len([c for c in unicodedata.normalize("NFKD", a) if not unicodedata.combining(c)]) == 1]
    return "".join(a for a, _ in marked), "".join(b for _, b in marked)


def search_token(x: Column) -> Column:
    """Upper-case Latin letters without marks, digits and ``/#.``; runs of others are one space."""
    plain = F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), *_plain_letters()), "[\\u0300-\\u036f’'`]", "")
    return F.upper(F.trim(F.regexp_replace(plain, "[^A-Za-z0-9/#.]+", " ")))


def collector_id(x: Column) -> Column:
    """The part before the slash, letters and digits alone, without zeros before the digits."""
    compact = F.upper(F.regexp_replace(F.split(F.coalesce(x, F.lit("")), "/")[0], "[^A-Za-z0-9]", ""))
    return F.regexp_replace(compact, r"^([A-Z]*?)0*(\d+)$", "$1$2")


def first_digits(x: Column) -> Column:
    """The first one to four digits, without zeros in front; empty for none."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d{1,4})", 1)
    return F.when(found == "", "").otherwise(found.cast("int").cast("string"))


def in_bucket(language: Column, bucket: str) -> Column:
    return F.coalesce(language.isin(*(ASIAN if bucket == "asian" else WESTERN)), F.lit(False))


def slug(x: Column) -> Column:
    """Lower case, runs of other than letters and digits as one dash, none at the ends."""
    plain = F.translate(F.coalesce(x, F.lit("")), *_plain_letters())
    return F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def recency(*ids: Column) -> Column:
    """A set's place in time by its series and number; 0 for none."""
    text = F.lower(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in ids)))

    def number(prefix: str) -> Column:
        return F.regexp_extract(text, rf"(?<![a-z0-9_]){prefix}0?(\d{{1,2}})", 1).try_cast("int")

    return F.coalesce(*(number(p) + n for p, n in SERIES), F.lit(0))


def direct_ids(set_id: Column, number: Column) -> Column:
    """Card ids that a set and a number may stand for: the number as it is and padded to two and three digits."""
    key = collector_id(number)
    every = F.when(key.rlike(r"^\d+$"), F.array(key, F.lpad(key, F.greatest(F.length(key), F.lit(2)), F.lit("0")), F.lpad(key, F.greatest(F.length(key), F.lit(3)), F.lit("0")))).otherwise(F.array(key))
    return F.transform(F.filter(F.array_distinct(every), lambda x: x != ""), lambda x: F.concat(set_id, F.lit("-"), x))


def collector_score(left: Column, right: Column) -> Column:
    """1 for equal numbers, 0.78 for equal parts before the slash, 0 otherwise or where one is missing."""
    head = lambda x: F.split(x, "/")[0]
    there = (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "")
    return F.when(~there, 0.0).when(left == right, 1.0).when(head(left) == head(right), 0.78).otherwise(0.0)


def language_score(left: Column, right: Column) -> Column:
    main = lambda x: F.split(F.lower(x), "-")[0]
    return F.when(F.coalesce(left, F.lit("")) == "", 0.0).when(main(left) == main(right), 1.0).otherwise(0.0)


def any_token(text: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(text, t))


def parse_query(x: Column) -> Column:
    """What a search text asks for: ``number`` (with a total, with a prefix, or the last that is no year) and ``tokens``."""
    from .text import NUMBER_PREFIXES

    text = search_token(x)
    one = f"(?:(?:{NUMBER_PREFIXES})\\s*)?0*\\d{{1,4}}"
    edge, end = "(?<![A-Z0-9_])", "(?![A-Z0-9_])"
    slash = F.regexp_extract(text, f"{edge}({one}\\s*/\\s*(?:(?:{NUMBER_PREFIXES})\\s*)?\\d{{1,4}}){end}", 1)
    prefixed = F.regexp_extract(text, f"{edge}((?:{NUMBER_PREFIXES})\\s*0*\\d{{1,4}}){end}", 1)
    numbers = F.filter(F.regexp_extract_all(text, F.lit(f"{edge}(\\d{{1,4}}){end}"), 1), lambda n: ~n.cast("int").between(1900, 2099))
    raw = F.coalesce(F.nullif(slash, F.lit("")), F.nullif(prefixed, F.lit("")), F.try_element_at(numbers, F.lit(-1)), F.lit(""))
    at = F.when(raw != "", F.instr(text, raw)).otherwise(0)
    rest = F.when(raw == "", text).otherwise(F.concat_ws(" ", F.substr(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(text, at + F.length(raw))))
    words = F.filter(F.split(rest, "\\s+"), lambda t: t.rlike("[A-Z]") & ~t.isin("NO", "CARD", "NUMBER", "NUM"))
    return F.struct(collector_id(raw).alias("number"), words.alias("tokens"))


def name_score(name: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda s, t: s + F.when(F.contains(name, t), 38).otherwise(-22))


def without_terms(text: Column, terms: Column) -> Column:
    """A text of words without the first place of each term, in turn, where it stands as whole words."""
    def cut(left: Column, term: Column) -> Column:
        wanted = F.concat(F.lit(" "), term, F.lit(" "))
        at = F.instr(left, wanted)
        return F.when(at == 0, left).otherwise(F.concat(F.substring(left, F.lit(1), at), F.substring(left, at + F.length(wanted), F.length(left))))

    return F.btrim(F.aggregate(F.coalesce(terms, F.array().cast("array<string>")), F.concat(F.lit(" "), text, F.lit(" ")), cut))


def dynamic_terms(text: Column) -> Column:
    """Codes of sets like SV8A or MSV8A in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Z]?SV[0-9]{1,2}[A-Z]\b"), 0)
