"""Queries over landed payloads that hold the given tables' values, in the shapes of their providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query


def _j(*xs):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))


def _s(x):
    return x.cast("string")


# Payloads of the second provider, one for each card: prices in euros and of two variants, some missing, zero or texts

_API = """pl AS (SELECT id, CASE WHEN id % 17 = 0 THEN '{"x"' WHEN id % 17 = 1 THEN '[]' ELSE '{"id":"c' || id || '","cardmarket":{"prices":{"trendPrice":' || CASE id % 3 WHEN 0 THEN '0' WHEN 1 THEN '"9"' ELSE CAST(id % 50 + 0.25 AS VARCHAR) END || CASE WHEN id % 4 = 0 THEN '' ELSE ',"avg30":' || (id % 40) END
  || ',"avg1":' || (id % 5) || '}},"tcgplayer":{"url":"u' || id || '","prices":{"reverse":{"low":0,"mid":null},"normal":{"market":' || (id % 30) || ',"low":' || (id % 7) || ',"mid":' || (id % 11) || '},"holofoil":{"market":5}}}}' END AS json FROM cards)"""


def _api(spark, d):
    k = F.col("id")
    trend = F.when(k % 3 == 0, "0").when(k % 3 == 1, '"9"').otherwise(F.concat(_s(k % 50), F.lit(".25")))
    body = _j('{"id":"c', _s(k), '","cardmarket":{"prices":{"trendPrice":', trend, F.when(k % 4 == 0, "").otherwise(_j(',"avg30":', _s(k % 40))), ',"avg1":', _s(k % 5), '}},"tcgplayer":{"url":"u', _s(k),
              '","prices":{"reverse":{"low":0,"mid":null},"normal":{"market":', _s(k % 30), ',"low":', _s(k % 7), ',"mid":', _s(k % 11), '},"holofoil":{"market":5}}}}')
    return fx.cards(spark, d).select("id", F.when(k % 17 == 0, '{"x"').when(k % 17 == 1, "[]").otherwise(body).alias("json"))


_API_SQL = f""", {_API}, v AS (SELECT id, CASE WHEN json_valid(json) THEN CASE WHEN json_type(json) = 'OBJECT' THEN CAST(json AS JSON) END END AS j FROM pl),
e AS (SELECT id, j, list_filter(list_transform(['trendPrice','avg7','avg30','averageSellPrice','avg1'], lambda m: CASE WHEN json_type(j, '$.cardmarket.prices.' || m) IN ('UBIGINT','BIGINT','DOUBLE') THEN CAST(json_extract_string(j, '$.cardmarket.prices.' || m) AS DOUBLE) END), lambda x: x > 0)[1] AS eur,
  list_transform(json_keys(j, '$.tcgplayer.prices'), lambda k: list_sort(list_filter(list_transform(['market','mid','low','directLow'], lambda m: TRY_CAST(json_extract_string(j, '$.tcgplayer.prices.' || k || '.' || m) AS DOUBLE)), lambda x: x > 0))) AS vs FROM v),
u AS (SELECT id, j, eur, list_filter(list_transform(vs, lambda l: l[1 + len(l) // 2]), lambda x: x IS NOT NULL)[1] AS usd FROM e)"""


@_query("c9_api_reference", with_views(f"""{_API_SQL} SELECT id, coalesce(floor(eur * 7.46::DOUBLE + 0.5::DOUBLE), floor(usd * 7.0::DOUBLE + 0.5::DOUBLE)) AS raw, CASE WHEN eur IS NOT NULL THEN 'cardmarket' WHEN usd IS NOT NULL THEN 'tcgplayer' END AS raw_source,
 array_to_string(list_filter([CASE WHEN eur IS NOT NULL THEN 'cardmarket' END, CASE WHEN usd IS NOT NULL THEN 'tcgplayer' END], lambda x: x IS NOT NULL), ',') AS sources, CASE WHEN usd IS NOT NULL THEN json_extract_string(j, '$.tcgplayer.url') END AS url FROM u""", "cards"))
def c9(spark, d):
    return payloads.api_reference(_api(spark, d), "id", "json").drop("status", "note").withColumn("sources", F.array_join("sources", ","))


@_query("c9_api_reference_filtered", with_views(f"""{_API_SQL} SELECT id, CAST(NULL AS DOUBLE) AS raw, 'filtered_unavailable' AS status, CASE WHEN eur IS NOT NULL THEN 'Filtered price unavailable; the aggregate is ' || CAST(floor(eur * 7.46::DOUBLE + 0.5::DOUBLE) AS BIGINT) || ' DKK.' END AS note FROM u""", "cards"))
def c9_filtered(spark, d):
    return payloads.api_reference(_api(spark, d), "id", "json", filtered=True).select("id", "raw", "status", "note")


# Payloads of all four kinds, and some that cannot be read

def _mixed(spark, d):
    k = F.col("id")
    kind = F.when(k % 6 == 0, "tcgdex").when(k % 6 == 1, "pokemontcg").when(k % 6 == 2, "tcgtracking").when(k % 6 == 3, "pokeprices").when(k % 6 == 4, "other").otherwise("tcgdex")
    p = _s(F.round("price", 2))
    body = F.when(k % 6 == 0, _j('{"pricing":{"cardmarket":{"unit":"EUR","idProduct":', _s(k), ',"avg":', p, ',"trend-holo":1.5},"tcgplayer":{"unit":"USD","normal":{"lowPrice":', p, ',"marketPrice":null},"holo":{"midPrice":3}}}}')).when(
        k % 6 == 2, _j('{"tcg":{"Normal":{"low":', p, ',"market":2},"Foil":{"mkt":"7"}},"cardtrader":{"en":{"low":0.5}}}')).when(k % 6 == 3, _j('{"raw_usd":', _s(k * 10), ',"psa9_usd":null,"psa10_usd":', p, "}")).when(k % 6 == 4, "{}").otherwise("[1]")
    api = _api(spark, d).withColumnRenamed("json", "_api")
    return fx.cards(spark, d).join(api, "id").select("id", kind.alias("kind"), F.when(k % 6 == 1, F.col("_api")).otherwise(body).alias("json"))


@_query("s13_provider_prices")
def s13(spark, d):
    return payloads.read_provider_prices(_mixed(spark, d), "id", "kind", "json")


# Set documents with their cards, and a detail for most of them

def _sets(spark, d):
    c = fx.cards(spark, d)
    k = F.col("id")
    brief = _j('{"id":', F.when(k % 19 == 0, '""').otherwise(_j('"c', _s(k), '"')), ',"name":"', F.col("name"), '","localId":"', F.col("local_id"), '"', F.when(k % 3 == 0, _j(',"image":"i', _s(k), '"')).otherwise(""), "}")
    cards = c.select("set_id", "id", brief.alias("b")).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("bs"))  # a set's document holds all its cards
    head = _j('{"id":"', F.col("set_id"), '","name":"Set ', F.col("set_id"), '","releaseDate":"', F.md5("set_id"), '","cards":[')
    sets = cards.select(F.crc32("set_id").alias("place"), _j(head, F.array_join(F.transform("bs", lambda x: x["b"]), ","), "]}").alias("json"))
    detail = F.when(k % 7 == 0, "{").otherwise(_j('{"localId":"d', _s(k), '","set":{"cardCount":{"official":', _s(k % 200), '}},"variants":{"holo":', F.when(k % 2 == 0, "true").otherwise("false"), ',"reverse":', F.when(k % 6 == 0, "true").otherwise("null"), '}', F.when(k % 5 == 0, ',"image":""').otherwise(_j(',"image":"d', _s(k), '"')), "}"))
    return sets, c.where(k % 11 != 0).select(_j("c", _s(k)).alias("card_id"), detail.alias("json"))


_SETS = """x AS (SELECT set_id, id, md5(set_id) AS date, row_number() OVER (PARTITION BY set_id ORDER BY id) - 1 AS position, name, id % 5 <> 0 AS own FROM cards),
y AS (SELECT * FROM x WHERE id % 19 <> 0 AND id % 11 <> 0 AND id % 7 <> 0 AND (own OR id % 3 = 0)), z AS (SELECT set_id FROM (SELECT DISTINCT set_id, date FROM y) ORDER BY date DESC LIMIT 5)
SELECT 'c' || id AS id, CAST(position AS INT) AS position, name, set_id, 'Set ' || set_id AS set_name, 'd' || id AS local_id, CASE WHEN own THEN 'd' ELSE 'i' END || id AS image_url, 'ja' AS language, CAST(id % 200 AS VARCHAR) AS printed_total,
  CASE WHEN id % 6 = 0 THEN 'reverse' WHEN id % 2 = 0 THEN 'holo' ELSE 'standard' END AS variant_class FROM y WHERE set_id IN (SELECT set_id FROM z)"""


@_query("s1_cards_from_sets", with_views(f", {_SETS}", "cards"))
def s1(spark, d):
    return payloads.cards_from_sets(*_sets(spark, d), "ja", max_sets=5, latest_first=True).drop("place", "rarity", "regulation_mark")


# Result pages: items of the given pages' ids, ten a page, some repeated on the next

def _result_pages(spark, d):
    p = fx.table(spark, d, "pages").select(F.col("page_id").alias("k"))
    k = F.col("k")
    rows = p.select(F.inline(F.array(F.struct(F.floor(k / 10).alias("page"), (k % 10).alias("o"), k.alias("k")), F.struct(F.floor(k / 10 + 1).alias("page"), (k % 10 + 20).alias("o"), k.alias("k")))))
    item = _j('{"cardID":" ', F.when(k % 9 == 0, "").otherwise(_s(k)), ' ","cardThumbFile":"', F.when(k % 8 == 0, "").when(k % 5 == 0, "/x/y.jpg").otherwise(_j("/assets/large/S ", _s(k % 4), "!/", _s(k), ".jpg")), '","cardNameAltText":"', F.when(k % 2 == 0, "").otherwise(_j("alt", _s(k))), '","cardNameViewText":"view', _s(k), '"}')
    return rows.select("page", "o", item.alias("i")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o", "i"))).alias("x")).select("page", _j('{"cardList":[7,', F.array_join(F.transform("x", lambda e: e["i"]), ","), "]}").alias("json"))


@_query("s3_page_items", """WITH r AS (SELECT page_id AS k, page_id // 10 AS page, page_id % 10 AS o FROM pages UNION ALL SELECT page_id, page_id // 10 + 1, page_id % 10 + 20 FROM pages)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY o) - 1 AS INT) AS position, CASE WHEN k % 9 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS card_id, CASE WHEN k % 8 = 0 THEN '' WHEN k % 5 = 0 THEN '/x/y.jpg' ELSE '/assets/large/S ' || (k % 4) || '!/' || k || '.jpg' END AS thumb,
 CASE WHEN k % 2 = 0 THEN '' ELSE 'alt' || k END AS alt_text, 'view' || k AS view_text FROM r""")
def s3(spark, d):
    return payloads.page_items(_result_pages(spark, d))


@_query("s2_cards_from_pages", """SELECT 'official-jp-' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'view' ELSE 'alt' END || page_id AS name, CASE WHEN page_id % 5 = 0 THEN 'official' ELSE 'S_' || (page_id % 4) END AS set_id, CAST(page_id AS VARCHAR) AS local_id
FROM pages WHERE page_id % 9 <> 0 AND page_id % 8 <> 0 AND page_id % 7 <> 0""")
def s2(spark, d):
    images = fx.table(spark, d, "pages").where("page_id % 7 <> 0").select(F.col("page_id").cast("string").alias("card_id"))
    return payloads.cards_from_pages(_result_pages(spark, d), images, "https://cards.example").select("id", "name", "set_id", "local_id")


# Records of three sources as rows for searching

@_query("p3_search_rows", with_views(""" SELECT id AS k, CASE id % 3 WHEN 0 THEN 'tcgdex' WHEN 1 THEN 'tcgtracking' ELSE 'pokemontcg' END AS source, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'tcgtracking-' ELSE 'pokemontcg-' END || id AS id, name, 'S ' || (id % 9) AS set_name,
 local_id[1:3] || CASE id % 3 WHEN 1 THEN '' ELSE CASE WHEN id % 4 <> 0 THEN '/' || (id % 4) ELSE '/99' END END AS local_id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN '' WHEN id % 3 = 0 THEN 'm/low.webp' ELSE 'm' END AS image_url, CASE WHEN id % 3 = 0 THEN language ELSE 'en' END AS language, CAST(id % 9 AS VARCHAR) AS set_id FROM cards""", "cards"))
def p3(spark, d):
    k = F.col("id")
    number = F.substring("local_id", 1, 3)
    s = _j('"set":{"id":', _s(k % 9), ',"name":"', F.when(k % 3 == 1, _j("SV1: S ", _s(k % 9), " Trainer Gallery")).otherwise(_j("S ", _s(k % 9))), '"')
    text = F.when(k % 3 == 0, _j('{"id":"', _s(k), '","name":"', F.col("name"), '","localId":"', number, '","language":"', F.col("language"), '",', s, ',"cardCount":{"official":', _s(k % 4), ',"total":99}}', F.when(k % 2 == 0, "").otherwise(',"image":"m"'), "}")).when(
        k % 3 == 1, _j('{"id":', _s(k), ',"name":"other","clean_name":"', F.col("name"), '","number":"', number, '","image_url":"m",', s, "}}")).otherwise(
        _j('{"id":"', _s(k), '","name":"', F.col("name"), '","number":"', number, '","images":{"small":"m"},', s, ',"printedTotal":', _s(k % 4), ',"total":99}}'))
    kind = F.when(k % 3 == 0, "tcgdex").when(k % 3 == 1, "tcgtracking").otherwise("pokemontcg")
    return payloads.search_rows(fx.cards(spark, d).select(k.alias("k"), kind.alias("kind"), text.alias("json")), "k", "kind", "json")
