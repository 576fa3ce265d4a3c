"""Queries over addresses: cards with sets, names and languages of many forms, and links with parameters, from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as a
from ..functions import text, values
from ..operators import pages
from ..sources import fixtures as fx
from .base import _query

SITE, API, PRICES = "https://m.example/en", "https://m.example/ws", "https://p.example"


def _pick(k, *xs):
    return F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))


def _sql_list(xs):
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"


_SETS = (*a.SET_CODES, "SV2a", "SV4a", "sv8a", "Sv03.5", "sm1", "s12a", "sv8pt5", None, "", "base-1", " SV8a ")
_NAMES = ("", " EX", " & Co. (x)!", "'s ~ é+", "リザードン", "ex", "V", None)
_ASKED = ("ja", "en", "ko", None, "zh-cn", "fr", "zh-tw", "xx")
_SET_NAMES = ("Pokemon Card 151", "151", "SV: Evolving Skies", "Brilliant Stars Trainer Gallery", "Pokemon GO", "Champion's Path", "Scarlet & Violet", "Sér ie", "", None)
_LEAST = ("NM", None, "MT", "zz", "PO")


def market_cards(spark, d):
    k = F.col("id")
    name = F.when(k % 8 == 7, None).when(k % 8 == 4, "リザードン").when(k % 8 == 5, "ブラッキーex").when(k % 8 == 6, "V").otherwise(F.concat("name", _pick(k, *(x or "" for x in _NAMES))))
    return fx.catalogue(spark, d).select(
        "id", F.when(k % 3 == 0, F.concat(F.lit("SV2a-"), k.cast("string"))).when(k % 3 == 1, "plain").alias("card_id"), name.alias("name"), _pick(k, *_SETS).alias("set_id"), _pick(F.floor(k / 3), *_SET_NAMES).alias("set_name"),
        F.when(k % 13 != 0, F.col("local_id")).alias("local_id"), F.when(k % 4 != 0, k + 1000).alias("product_id"), F.when(k % 5 == 0, F.upper("language")).otherwise(F.col("language")).alias("language"),
        _pick(F.floor(k / 2), *_ASKED).alias("wanted_language"), _pick(F.floor(k / 7), *_LEAST).alias("least_condition"), F.when(k % 6 == 0, "asian").alias("bucket"))


_CARDS = f"""b AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 4 WHEN 1 THEN ' EX' WHEN 2 THEN ' V' ELSE '' END AS n0,
  CASE WHEN p_partkey % 7 = 0 THEN 'TG' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') WHEN p_partkey % 7 = 1 THEN 'GG' || (p_partkey % 70) ELSE lpad(CAST(p_partkey % 250 AS VARCHAR), 3, '0') || '/200' END AS l0,
  CASE p_partkey % 5 WHEN 1 THEN 'ja' WHEN 2 THEN 'ko' WHEN 3 THEN 'fr' ELSE 'EN' END AS lg FROM part),
mc AS (SELECT k AS id, CASE k % 3 WHEN 0 THEN 'SV2a-' || k WHEN 1 THEN 'plain' END AS card_id,
  CASE k % 8 WHEN 7 THEN NULL WHEN 4 THEN 'リザードン' WHEN 5 THEN 'ブラッキーex' WHEN 6 THEN 'V' ELSE n0 || {_sql_list([x or '' for x in _NAMES])}[1 + k % {len(_NAMES)}] END AS name,
  {_sql_list(_SETS)}[1 + k % {len(_SETS)}] AS set_id, {_sql_list(_SET_NAMES)}[1 + k // 3 % {len(_SET_NAMES)}] AS set_name, CASE WHEN k % 13 <> 0 THEN l0 END AS local_id, CASE WHEN k % 4 <> 0 THEN k + 1000 END AS product_id,
  CASE WHEN k % 5 = 4 THEN 'en' ELSE lg END AS language, {_sql_list(_ASKED)}[1 + k // 2 % {len(_ASKED)}] AS wanted_language, {_sql_list(_LEAST)}[1 + k // 7 % {len(_LEAST)}] AS least_condition, CASE WHEN k % 6 = 0 THEN 'asian' END AS bucket FROM b)"""
_CODES = ", ".join(f"('{k}', '{v}')" for k, v in a.SET_CODES.items())
_ENCODED = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_PLAIN = "regexp_replace(regexp_replace(split_part({0}, '/', 1), '[^A-Za-z0-9]', '', 'g'), '^0+([0-9])', '\\1')"
_LANGUAGES = ", ".join(f"('{k}', {v})" for k, v in a.LANGUAGE_NUMBERS.items())


@_query("p15_market_requests", f"""WITH {_CARDS}, o AS (SELECT *, coalesce(set_id, regexp_extract(coalesce(card_id, ''), '^(.+)-[^-]+$', 1)) AS own_set FROM mc),
c AS (SELECT o.*, coalesce(t.code, set_id, '') AS code, ln.n AS language_number, CAST(nullif(list_position(['MT','NM','EX','GD','LP','PL','PO'], least_condition), 0) AS BIGINT) AS condition_number FROM o
  LEFT JOIN (VALUES {_CODES}) t(s, code) ON t.s = lower(trim(own_set)) LEFT JOIN (VALUES {_LANGUAGES}) ln(l, n) ON ln.l = wanted_language),
q AS (SELECT *, array_to_string(list_filter([
    CASE WHEN regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') AND NOT (coalesce(wanted_language IN ('ja','ko','zh-tw','zh-cn'), false) AND regexp_matches(lower(trim(own_set)), '^[a-z]+[0-9]+[a-z]?$')) THEN name END,
    CASE WHEN code <> '' THEN code ELSE set_name END, {_PLAIN.format("coalesce(local_id, card_id, '')")}], lambda x: x IS NOT NULL AND x <> ''), ' ') AS query FROM c)
SELECT id, query, own_set, language_number, condition_number,
  '{SITE}/Products/Search?searchString=' || {_ENCODED.format('query')} || coalesce('&language=' || language_number, '') || coalesce('&minCondition=' || condition_number, '') AS search_url,
  '{API}/articles/' || product_id || '?maxResults=10&start=0' || coalesce('&idLanguage=' || language_number, '') || coalesce('&minCondition=' || least_condition, '') AS articles_url FROM q""")
def p15(spark, d):
    return pages.market_requests(market_cards(spark, d), SITE, API)


_SLUG = "lower(trim(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '[’''`]', '', 'g'), '[^A-Za-z0-9{1}]+', '-', 'g'), '-'))"
_ASIAN = "['ja','ko','zh-tw','zh-cn']"


@_query("p16_price_pages", f"""WITH {_CARDS}, l AS (SELECT *, coalesce(wanted_language, CASE WHEN lower(language) IN ('en','fr','de','es','it','pt','ja','ko','zh-tw','zh-cn') THEN lower(language) END) AS lang,
  {_SLUG.format('name', '')} AS ns, lower({_PLAIN.format("coalesce(local_id, '')")}) AS num, lower(coalesce(set_id, '')) AS s, lower(trim(coalesce(set_id, ''))) AS st FROM mc),
n AS (SELECT *, len(list_filter(string_split(ns, '-'), lambda t: t NOT IN ('', 'ex', 'v', 'vmax', 'vstar', 'gx'))) > 0 AS named, array_to_string(list_filter([ns, num], lambda x: x <> ''), '-') AS slug,
  CASE WHEN s IN ('sv03.5','sv3pt5','sv2a') THEN 'Scarlet & Violet 151' WHEN s IN ('sv08.5','sv8pt5','sv8a') THEN 'Prismatic Evolutions' WHEN s IN ('sv04.5','sv4pt5','sv4a') THEN 'Paldean Fates'
   WHEN upper(replace({_SLUG.format('set_name', '')}, '-', ' ')) IN ('151', 'POKEMON CARD 151') THEN 'Scarlet & Violet 151' END AS known,
  trim(regexp_replace(regexp_replace(regexp_replace(set_name, '^[A-Za-z0-9]+:\\s*', ''), '\\s+Trainer Gallery$', '', 'i'), '^Pokemon ', '', 'i')) AS bare,
  CASE WHEN st IN ('sv03.5','sv2a') THEN 'Scarlet & Violet 151' WHEN st IN ('sv04.5','sv4a') THEN 'Shiny Treasure ex' WHEN st IN ('sv08.5','sv8a') THEN CASE WHEN lang = 'ja' THEN 'Terastal Festival' ELSE 'Terastal Festival ex' END END AS base FROM l),
c AS (SELECT *, CASE WHEN lang IN ('ja','ko','zh-tw','zh-cn') THEN CASE WHEN named AND base IS NOT NULL THEN [CASE lang WHEN 'ja' THEN 'Japanese ' WHEN 'ko' THEN 'Korean ' ELSE 'Chinese ' END || base] ELSE [] END
   WHEN bucket = 'asian' THEN [] ELSE list_filter([known, CASE WHEN set_name IS DISTINCT FROM known THEN set_name END, CASE WHEN bare IS DISTINCT FROM known AND bare IS DISTINCT FROM set_name THEN bare END], lambda x: x IS NOT NULL AND x <> '') END AS names FROM n)
SELECT id, CASE WHEN slug = '' THEN '' ELSE array_to_string(list_transform(names, lambda x: '{PRICES}/game/pokemon-' || {_SLUG.format("replace(x, '&', ' & ')", '&')} || '/' || slug), ' ') END AS pages,
  '{PRICES}/search-products?q=' || {_ENCODED.format("array_to_string(list_filter([st, CASE WHEN named THEN name END, num], lambda x: x IS NOT NULL AND x <> ''), ' ')")} || '&type=prices' AS search_url FROM c""")
def p16(spark, d):
    return pages.price_pages(market_cards(spark, d), PRICES).withColumn("pages", F.array_join("pages", " "))


@_query("x32_equivalent_sets", f"WITH {_CARDS} SELECT set_id, CASE lower(set_id) WHEN 'sv2a' THEN 'sv03.5' WHEN 'sv4a' THEN 'sv04.5' WHEN 'sv8a' THEN 'sv08.5' END AS english, count(*) AS n FROM mc GROUP BY 1, 2")
def x32(spark, d):
    return market_cards(spark, d).groupBy("set_id", a.english_set(F.col("set_id")).alias("english")).agg(F.count(F.lit(1)).alias("n"))


# Links of a listing's order, whose parameters the filters replace

def _linked(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    link = F.concat(
        F.lit("https://m.example/s/"), k.cast("string"), F.when(n % 7 == 0, "").otherwise("?"), F.when(n % 2 == 0, F.concat(F.lit("language="), (k % 9).cast("string"), F.lit("&"))).otherwise(""),
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("q=a+b%2A~"), (k % 5).cast("string"))), F.when(n % 3 == 0, "&empty=&&language=77&flag").otherwise(""), F.when(n == 5, "#part?x=1").otherwise(""))
    return fx.table(spark, d, "lineitem").select(k.alias("order_id"), n.alias("line"), link.alias("link"), F.when(k % 3 != 0, k % 11).alias("language"), F.when(n % 4 != 1, n).alias("least"))


@_query("x20_filtered_links", """WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS line, 'https://m.example/s/' || l_orderkey AS path, l_linenumber % 7 <> 0 AS asked, l_linenumber % 2 = 0 AS before, l_linenumber % 3 = 0 AS after,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey % 11 END AS language, CASE WHEN l_linenumber % 4 <> 1 THEN l_linenumber END AS least, l_orderkey % 9 AS k9, l_orderkey % 5 AS k5 FROM lineitem),
v AS (SELECT *, CAST(coalesce(language, CASE WHEN after AND asked THEN 77 WHEN before AND asked THEN k9 END) AS VARCHAR) AS lv FROM l),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN before AND asked THEN 'language=' || lv END, CASE WHEN asked THEN 'q=a+b%2A~' || k5 END, CASE WHEN after AND asked THEN 'empty=' END, CASE WHEN NOT (before AND asked) AND lv IS NOT NULL THEN 'language=' || lv END,
  CASE WHEN after AND asked THEN 'flag=' END, 'minCondition=' || least], lambda x: x IS NOT NULL), '&') AS query FROM v)
SELECT order_id, line, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS link FROM q""")
def x20(spark, d):
    return _linked(spark, d).select("order_id", "line", a.with_parameters(F.col("link"), {"language": F.col("language"), "minCondition": F.col("least")}).alias("link"))


# The market's live answers, one for each listing

def _answers(spark, d):
    k, n, c = F.col("l_orderkey"), F.col("l_linenumber"), fx.CONDITIONS
    address = lambda kind: F.concat(F.lit(f"https://m.example/{kind}/"), k.cast("string"))
    return fx.table(spark, d, "lineitem").select(
        F.concat_ws("-", k, n).alias("id"), F.when(k % 10 != 0, k % 7 != 0).alias("ok"), F.when(k % 9 == 0, 0.0).when(k % 9 != 1, F.col("l_extendedprice") / 100).alias("raw_eur"),
        F.when(k % 2 == 0, address("p")).alias("product_url"), F.when(k % 3 == 0, address("s")).alias("search_url"), address("f").alias("fallback_url"),
        F.when(n % 4 == 0, F.lower(_pick(k, *c))).when(n % 4 != 1, _pick(k, *c)).alias("condition"), F.when(k % 4 == 0, _pick(k, *c)).when(k % 4 == 1, "nm?").alias("wanted_condition"),
        _pick(n, *c).alias("requested_condition"), F.when(n > 2, n - 2).alias("listing_count"), F.when(n % 2 == 0, n - 2).alias("exact_count"))


_TITLE = "map {'MT': 'Mint', 'NM': 'Near Mint', 'EX': 'Excellent', 'GD': 'Good', 'LP': 'Light Played', 'PL': 'Played', 'PO': 'Poor'}"


@_query("p13_live_references", f"""WITH a AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS k, l_linenumber AS n, {_sql_list(fx.CONDITIONS)} AS c, l_extendedprice / 100 AS eur FROM lineitem),
v AS (SELECT *, k % 10 <> 0 AND k % 7 <> 0 AND k % 9 > 1 AND eur > 0 AS there, CASE WHEN n % 4 <> 1 THEN c[1 + k % 7] END AS own, CASE k % 4 WHEN 0 THEN c[1 + k % 7] WHEN 1 THEN NULL ELSE c[1 + n % 7] END AS asked,
  CASE WHEN n > 3 THEN (n - 2) || ' matching listings' ELSE '1 matching listing' END AS many, CASE WHEN n % 2 = 0 THEN (n - 2) || ' exact-condition listings; ' ELSE '' END AS exact FROM a)
SELECT id, CASE WHEN there THEN CAST(floor(eur * 7.46::DOUBLE + 0.5::DOUBLE) AS DOUBLE) END AS raw, CASE WHEN there THEN 'cardmarket' END AS raw_source, CASE WHEN there THEN 'live_filtered' END AS status,
  CASE WHEN there THEN CASE WHEN own IS NULL OR asked IS NULL THEN 'Lowest live Cardmarket listing (' || many || ').' WHEN own = asked THEN 'Lowest live Cardmarket ' || {_TITLE}[own] || ' listing. (' || exact || many || ').'
    ELSE 'Condition mismatch: cheapest live listing is ' || {_TITLE}[own] || ', not ' || {_TITLE}[asked] || '. Cardmarket filters by minimum condition, so treat this as an upper-bound reference.' END END AS note,
  CASE WHEN there THEN 'https://m.example/' || CASE WHEN k % 2 = 0 THEN 'p/' WHEN k % 3 = 0 THEN 's/' ELSE 'f/' END || k END AS url FROM v""")
def p13(spark, d):
    return pages.live_references(_answers(spark, d))


# Prices within the markup of pages, and numbers of read fields

@_query("t9_embedded_prices", """WITH p AS (SELECT p_partkey AS id, p_partkey % 900 AS v, p_partkey % 6 AS f FROM part)
SELECT id, CAST(CASE f WHEN 0 THEN CASE WHEN v > 0 THEN v / 100.0::DOUBLE END WHEN 1 THEN 1000 + v + 0.5::DOUBLE WHEN 2 THEN nullif(v, 0) WHEN 3 THEN CASE WHEN v > 0 THEN v / 100.0::DOUBLE ELSE 7 END WHEN 4 THEN NULL ELSE nullif(v, 0) END AS DOUBLE) AS raw,
  CAST(CASE f WHEN 1 THEN nullif(v, 0) WHEN 2 THEN v + 0.25::DOUBLE WHEN 0 THEN 12.5::DOUBLE END AS DOUBLE) AS psa9, CAST(CASE f WHEN 1 THEN 55 WHEN 0 THEN 3.01::DOUBLE WHEN 4 THEN NULL WHEN 5 THEN 9 END AS DOUBLE) AS psa10 FROM p""")
def t9(spark, d):
    k = F.col("id")
    v = (k % 900).cast("string")
    page = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    html = (
        F.when(k % 6 == 0, page('<b>{\\"raw_usd\\":', v, ',\\"psa9_usd\\" : 1250,\\"PSA10_usd\\":301}</b>'))
        .when(k % 6 == 1, page("a Raw Price of $1,", F.lpad(v, 3, "0"), ".5 and <i>psa 9 $", v, "</i>, PSA10\\u002455"))
        .when(k % 6 == 2, page("$", v, " raw, then $", v, ".25 PSA 9 (PSA 95 $x)"))
        .when(k % 6 == 3, page("{&quot;raw_usd&quot;: ", v, "} raw price of $7, $8 rawest, PSA 9 $., PSA 10 $1.2.3"))
        .when(k % 6 == 4, page("$", v, " Rawest and $5 PSA 101, raw_usd: 6"))
        .otherwise(page('"raw_usd" null, "psa9_usd":0 and $', v, "Raw $9 PSA10")))
    return fx.cards(spark, d).select("id", values.embedded_prices(html).alias("p")).select("id", "p.*")


@_query("t16_number_fields", """WITH p AS (SELECT p_partkey AS id, p_partkey % 250 AS n, p_partkey % 6 AS f FROM part)
SELECT id, CASE f WHEN 0 THEN 'TG0' || n || '/30' WHEN 1 THEN n || 'A/200' WHEN 2 THEN '' WHEN 3 THEN 'ill egible' WHEN 4 THEN '000' || n ELSE 'N0' END AS number FROM p WHERE f <> 3 UNION ALL SELECT id, 'illegible' FROM p WHERE f = 3""")
def t16(spark, d):
    k = F.col("id")
    n = (k % 250).cast("string")
    field = F.when(k % 6 == 0, F.concat(F.lit("tgo"), n, F.lit("/3o x"))).when(k % 6 == 1, F.concat(F.lit(" #"), n, F.lit("a/2OO."))).when(k % 6 == 2, "").when(k % 6 == 3, "ill egible").when(
        k % 6 == 4, F.concat(F.lit("OoO"), n)).otherwise("no. x")
    return fx.cards(spark, d).select("id", text.number_field(field).alias("number"))
