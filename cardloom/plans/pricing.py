"""Queries over reference values, values in texts, and deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import deals, references
from ..operators.references import PRIORITY
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query

_KEYS = list(PRIORITY)


def _rows(spark, d):
    """Rows of four providers per card, with lists of sources and addresses."""
    k, p = F.col("card_id"), F.col("p")
    none = F.lit(None).cast("double")
    s = F.array().cast("array<string>")
    name = lambda x: F.lit(x)

    def row(i, raw, source, status, sources, url, psa7=none, psa8=none, psa9=none, psa95=none, psa10=none):
        values = [x.alias(n) for n, x in zip(_KEYS, (raw, psa7, psa8, psa9, psa95, psa10), strict=True)]
        urls = F.map_from_arrays(sources, F.transform(sources, lambda x: F.concat(x, F.lit(f"/{url}/"), k.cast("string"))))
        return F.struct(F.lit(i).alias("ord"), *values, source.alias("raw_source"), status.alias("status"), F.concat(F.lit(f"{url} "), status).alias("note"), sources.alias("sources"), urls.alias("urls"))

    text = F.lit(None).cast("string")
    rows = [
        row(0, F.when((k % 3 != 0) & (k % 6 != 2), F.round(p)), F.lit("cardmarket"), F.when(k % 6 == 1, "live_filtered").when(k % 6 == 2, "filtered_unavailable"), F.when(k % 3 != 0, F.array(name("cardmarket"))).otherwise(s), "live"),
        row(1, F.when(k % 4 != 0, F.round(p * 0.9)), F.when(k % 5 == 0, "tcgplayer").otherwise("cardmarket"), F.when(k % 4 != 0, "aggregate"), F.when(k % 4 != 0, F.array(name("cardmarket"), name("tcgplayer"))).otherwise(s), "sets"),
        row(2, F.when(k % 2 == 1, F.round(p * 1.05)), F.lit("tcgplayer"), text, F.when(k % 2 == 1, F.array(name("tcgplayer"))).otherwise(s), "api"),
        row(3, F.when(k % 7 != 0, F.round(p * 1.1)), F.lit("pokeprices"), text, F.when(k % 7 != 0, F.array(name("pokeprices"))).otherwise(s), "guide",
            F.when(k % 5 == 0, F.round(p * 1.4)), F.when(k % 5 == 0, F.round(p * 1.9)), F.when(k % 2 == 1, F.round(p * 3)), none, F.when(k % 7 != 0, F.round(p * 6))),
    ]
    late = row(4, F.round(p * 1.2), F.lit("pricecharting"), text, F.array(name("pricecharting")), "late", F.when(k % 11 != 0, F.round(p * 1.5)), F.round(p * 2), F.round(p * 2.5), F.when(k % 13 != 0, F.round(p * 3.5)), F.round(p * 5))
    base = fx.table(spark, d, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_retailprice").alias("p"))
    return base.select("card_id", F.inline(F.array(*rows))), base.select("card_id", F.inline(F.array(late)))


def _sql_row(i, raw, source, status, sources, url, psa7="NULL", psa8="NULL", psa9="NULL", psa95="NULL", psa10="NULL"):
    cast = lambda x: f"CAST({x} AS DOUBLE)"
    values = ", ".join(f"{cast(x)} AS {n}" for n, x in zip(_KEYS, (raw, psa7, psa8, psa9, psa95, psa10), strict=True))
    return f"SELECT k AS card_id, {i} AS ord, {values}, {source} AS raw_source, CAST({status} AS VARCHAR) AS status, '{url} ' || CAST({status} AS VARCHAR) AS note, CAST({sources} AS VARCHAR[]) AS sources, '{url}' AS url FROM b"


_ROWS = "b AS (SELECT p_partkey AS k, p_retailprice AS p FROM part), rows_ AS (" + " UNION ALL ".join([
    _sql_row(0, "CASE WHEN k % 3 <> 0 AND k % 6 <> 2 THEN round(p) END", "'cardmarket'", "CASE k % 6 WHEN 1 THEN 'live_filtered' WHEN 2 THEN 'filtered_unavailable' END", "CASE WHEN k % 3 <> 0 THEN ['cardmarket'] ELSE [] END", "live"),
    _sql_row(1, "CASE WHEN k % 4 <> 0 THEN round(p * 0.9::DOUBLE) END", "CASE WHEN k % 5 = 0 THEN 'tcgplayer' ELSE 'cardmarket' END", "CASE WHEN k % 4 <> 0 THEN 'aggregate' END", "CASE WHEN k % 4 <> 0 THEN ['cardmarket','tcgplayer'] ELSE [] END", "sets"),
    _sql_row(2, "CASE WHEN k % 2 = 1 THEN round(p * 1.05::DOUBLE) END", "'tcgplayer'", "NULL", "CASE WHEN k % 2 = 1 THEN ['tcgplayer'] ELSE [] END", "api"),
    _sql_row(3, "CASE WHEN k % 7 <> 0 THEN round(p * 1.1::DOUBLE) END", "'pokeprices'", "NULL", "CASE WHEN k % 7 <> 0 THEN ['pokeprices'] ELSE [] END", "guide",
             "CASE WHEN k % 5 = 0 THEN round(p * 1.4::DOUBLE) END", "CASE WHEN k % 5 = 0 THEN round(p * 1.9::DOUBLE) END", "CASE WHEN k % 2 = 1 THEN round(p * 3) END", "NULL", "CASE WHEN k % 7 <> 0 THEN round(p * 6) END"),
]) + "), late AS (" + _sql_row(4, "round(p * 1.2::DOUBLE)", "'pricecharting'", "NULL", "['pricecharting']", "late", "CASE WHEN k % 11 <> 0 THEN round(p * 1.5::DOUBLE) END", "round(p * 2)", "round(p * 2.5::DOUBLE)", "CASE WHEN k % 13 <> 0 THEN round(p * 3.5::DOUBLE) END", "round(p * 5)") + ")"


def _merge_sql(name: str, rows: str, filtered: bool = False) -> str:
    def picked(k: str) -> str:
        names = "[" + ", ".join(f"'{s}'" for s in PRIORITY[k]) + "]"
        n = len(PRIORITY[k])
        place = f"coalesce(list_min(list_filter(list_transform(sources, lambda s: list_position({names}, s)), lambda x: x > 0)), {n + 1})"
        return f"arg_min({k}, {place} * 100 + ord) FILTER ({k} <> 0) AS {k}, {names}[min({place} * 100 + ord) FILTER ({k} <> 0) // 100] AS {k}_source"

    raw = picked("raw") if not filtered else (
        "arg_min(raw, ord) FILTER (status IN ('live_filtered','filtered') AND raw <> 0) AS raw, coalesce(arg_min(coalesce(raw_source, 'cardmarket'), ord) FILTER (status IN ('live_filtered','filtered') AND raw <> 0),"
        " max('cardmarket') FILTER (status = 'filtered_unavailable' AND list_contains(sources, 'cardmarket'))) AS raw_source")
    return f"""{name}_v AS (SELECT card_id, {raw}, {', '.join(picked(k) for k in _KEYS[1:])} FROM {rows} GROUP BY card_id),
{name}_m AS (SELECT r.card_id, arg_min({{'status': r.status, 'note': r.note}}, r.ord) FILTER (r.raw IS NOT DISTINCT FROM v.raw AND (v.raw_source IS NULL OR r.raw_source = v.raw_source OR list_contains(r.sources, v.raw_source))) AS a,
   arg_min({{'status': r.status, 'note': r.note}}, r.ord) FILTER (r.status IS NOT NULL) AS b FROM {rows} r JOIN {name}_v v USING (card_id) GROUP BY r.card_id),
{name}_s AS (SELECT card_id, string_agg(s, ',' ORDER BY o) AS sources, string_agg(u, ',' ORDER BY o) AS urls FROM (
   SELECT card_id, s, min(ord * 10 + i) AS o, arg_min(s || '/' || url || '/' || card_id, ord * 10 + i) AS u FROM (SELECT card_id, ord, url, unnest(sources) AS s, generate_subscripts(sources, 1) AS i FROM {rows}) GROUP BY card_id, s) GROUP BY card_id),
{name} AS (SELECT v.*, coalesce(a, b).status AS status, coalesce(a, b).note AS note, coalesce(sources, '') AS sources, coalesce(urls, '') AS urls FROM {name}_v v JOIN {name}_m USING (card_id) LEFT JOIN {name}_s USING (card_id))"""


def _flat(merged):
    return merged.withColumns({"sources": F.array_join("sources", ","), "urls": F.array_join(F.transform("sources", lambda s: F.try_element_at("urls", s)), ",")})


@_query("a11_reference_values", f"WITH {_ROWS}, {_merge_sql('m', 'rows_')} SELECT * FROM m")
def a11_whole(spark, d):
    return _flat(references.merge_references(_rows(spark, d)[0]))


@_query("a12_filtered_reference_values", f"WITH {_ROWS}, {_merge_sql('m', 'rows_', True)} SELECT * FROM m")
def a12(spark, d):
    return _flat(references.merge_references(_rows(spark, d)[0], require_filtered=True))


_LATE = f"""WITH {_ROWS}, {_merge_sql('m', 'rows_')}, w AS (SELECT * FROM m WHERE psa7 <> 0 AND psa8 <> 0 AND psa9 <> 0 AND psa10 <> 0),
r2 AS (SELECT * FROM (SELECT * FROM rows_ UNION ALL SELECT * FROM late) WHERE card_id NOT IN (SELECT card_id FROM w)), {_merge_sql('n', 'r2')}"""


@_query("c12_reference_with_late_source", _LATE + " SELECT * FROM w UNION ALL SELECT * FROM n")
def c12(spark, d):
    return _flat(references.reference_with_late(*_rows(spark, d)))


@_query("p12_grade_rows", _LATE + ", x AS (SELECT * FROM w UNION ALL SELECT * FROM n), y AS (" + " UNION ALL ".join(f"SELECT card_id, '{k}' AS grade, {k} AS value, {k}_source AS source FROM x" for k in _KEYS) + ") SELECT * FROM y WHERE value IS NOT NULL")
def p12(spark, d):
    return references.grade_rows(references.reference_with_late(*_rows(spark, d)))


@_query("p10_manual_overlay", f"WITH {_ROWS}, {_merge_sql('m', 'rows_')}, o AS (SELECT o_orderkey AS card_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS raw, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE 0 END AS psa10 FROM orders) "
        "SELECT m.card_id, coalesce(o.raw, m.raw) AS raw, CASE WHEN o.raw > 0 THEN 'manual' ELSE m.raw_source END AS raw_source, m.psa9, coalesce(nullif(o.psa10, 0), m.psa10) AS psa10, CASE WHEN o.psa10 > 0 THEN 'manual' ELSE m.psa10_source END AS psa10_source, "
        "(o.raw > 0 OR o.psa10 > 0) IS TRUE AS is_manual, CASE WHEN (o.raw > 0 OR o.psa10 > 0) IS TRUE THEN CASE WHEN sources = '' THEN 'manual' ELSE sources || ',manual' END ELSE sources END AS sources FROM m LEFT JOIN o USING (card_id)")
def p10(spark, d):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("double")
    manual = fx.table(spark, d, "orders").select(k.alias("card_id"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("raw"), F.when(k % 3 == 0, F.col("o_totalprice") * 2).otherwise(0.0).alias("psa10"), *(none.alias(n) for n in ("psa7", "psa8", "psa9", "psa95")))
    out = _flat(references.overlay_manual(references.merge_references(_rows(spark, d)[0]), manual))
    return out.select("card_id", "raw", "raw_source", "psa9", "psa10", "psa10_source", "is_manual", "sources")


def _fields(spark, d):
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    when = lambda m, x: F.when(k % m != 0, x)
    return fx.table(spark, d, "part").select(
        k.alias("card_id"), F.concat(F.lit("SV"), (k % 9).cast("string"), F.lit("a")).alias("set_id"), (k % 250).cast("string").alias("local_id"), F.lit(100).alias("official"),
        F.concat("p_name", F.when(k % 2 == 0, " ex").otherwise("")).alias("name"),
        F.array(when(3, p / 500), when(2, p / 400), F.lit(0.0)).alias("primary"), F.array(F.lit(None).cast("double"), F.when(k % 5 == 0, p / 50)).alias("alternate"),
        F.array(when(4, p / 7), F.lit(0.0), when(6, p / 9)).alias("holo"), F.array(p / 8, p / 6).alias("normal"), F.array(p).alias("reverse"),
        F.when(k % 10 == 0, p / 300).alias("filtered_eur"), F.when(k % 12 == 0, k).alias("product"))


_FIELDS = """WITH f AS (SELECT p_partkey AS k, 'SV' || (p_partkey % 9) || 'a' AS set_id, p_partkey % 250 AS local_id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ex' ELSE p_name END AS name, p_retailprice AS p FROM part),
g AS (SELECT *, CASE WHEN k % 3 <> 0 THEN p / 500 WHEN k % 2 <> 0 THEN p / 400 END AS one, CASE WHEN k % 5 = 0 THEN p / 50 END AS two, CASE WHEN k % 10 = 0 THEN p / 300 END AS filtered_eur,
  coalesce((list_sort(list_filter([CASE WHEN k % 4 <> 0 THEN p / 7 END, CASE WHEN k % 6 <> 0 THEN p / 9 END], lambda x: x > 0)))[1 + len(list_filter([CASE WHEN k % 4 <> 0 THEN p / 7 END, CASE WHEN k % 6 <> 0 THEN p / 9 END], lambda x: x > 0)) // 2], p / 6) AS usd FROM f),
h AS (SELECT *, CASE WHEN one IS NULL THEN two WHEN two >= 1 AND two >= one * 3 THEN two ELSE one END AS selected FROM g),
e AS (SELECT *, CASE WHEN local_id > 100 AND regexp_matches(name, '\\bex\\b') AND two IS NULL AND selected < 5 AND selected = one THEN round(selected * 100) ELSE selected END AS eur FROM h)"""


@_query("c8_provider_reference", _FIELDS + """ SELECT k AS card_id, round(coalesce(eur * 7.46::DOUBLE, usd * 7)) AS raw, CASE WHEN eur IS NOT NULL THEN 'cardmarket' ELSE 'tcgplayer' END AS raw_source, CASE WHEN eur IS NOT NULL THEN 'aggregate' END AS status,
 CASE WHEN eur IS NOT NULL THEN 'Aggregate price; language and condition apply at the market only.' END AS note, CASE WHEN eur IS NOT NULL OR k % 12 = 0 THEN 'cardmarket,tcgplayer' ELSE 'tcgplayer' END AS sources FROM e""")
def c8(spark, d):
    return references.provider_reference(_fields(spark, d)).withColumn("sources", F.array_join("sources", ","))


@_query("c8_filtered_reference", _FIELDS + """, x AS (SELECT *, coalesce(filtered_eur, eur) AS v FROM e) SELECT k AS card_id, round(v * 7.46::DOUBLE) AS raw, CASE WHEN v IS NOT NULL THEN 'cardmarket' ELSE 'tcgplayer' END AS raw_source,
 CASE WHEN filtered_eur IS NOT NULL THEN 'filtered' WHEN v IS NOT NULL THEN 'aggregate' ELSE 'filtered_unavailable' END AS status,
 CASE WHEN filtered_eur IS NOT NULL THEN NULL WHEN v IS NOT NULL THEN 'Aggregate price; language and condition apply at the market only.' ELSE 'Filtered price unavailable.' END AS note, CASE WHEN v IS NOT NULL OR k % 12 = 0 THEN 'cardmarket,tcgplayer' ELSE 'tcgplayer' END AS sources FROM x""")
def c8_filtered(spark, d):
    return references.provider_reference(_fields(spark, d), filtered=True).withColumn("sources", F.array_join("sources", ","))


@_query("a9_best_variant", _FIELDS + " SELECT k AS card_id, usd FROM e")
def a9(spark, d):
    return _fields(spark, d).select("card_id", references.best_variant(F.col("holo"), F.col("normal"), F.col("reverse")).alias("usd"))


@_query("c10_guide_reference", "SELECT p_partkey AS card_id, CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice / 100 * 7) END AS raw, CASE WHEN p_partkey % 4 <> 0 THEN round(p_retailprice / 50 * 7) END AS psa9, round(p_retailprice / 10 * 7) AS psa10 FROM part")
def c10(spark, d):
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    rows = fx.table(spark, d, "part").select(k.alias("card_id"), F.when(k % 3 != 0, p / 100).otherwise(0.0).alias("raw_usd"), F.when(k % 4 != 0, p / 50).alias("psa9_usd"), (p / 10).alias("psa10_usd"))
    return references.guide_reference(rows)


@_query("c11_product_raw", "SELECT p_partkey AS card_id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 3 END, p_retailprice * 4) AS usd FROM part")
def c11(spark, d):
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    none = F.lit(None).cast("double")
    one = F.struct(F.when(k % 2 == 0, p).alias("market"), F.when(k % 3 == 0, p * 2).alias("mkt"), none.alias("low"))
    two = F.struct(none.alias("market"), F.when(k % 5 == 0, p * 3).alias("mkt"), (p * 4).alias("low"))
    return fx.table(spark, d, "part").select(k.alias("card_id"), references.market_or_low(one, two).alias("usd"))


@_query("u2_union_sources", with_views(" SELECT card_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM provider_prices WHERE coalesce(raw, psa9, psa10) IS NOT NULL GROUP BY card_id", "provider_prices"))
def u2(spark, d):
    has = lambda c: F.collect_set(F.when(F.col(c).isNotNull(), F.col("source")))
    g = fx.provider_prices(spark, d).groupBy("card_id").agg(has("raw").alias("a"), has("psa9").alias("b"), has("psa10").alias("c"))
    return g.select("card_id", F.array_join(F.array_sort(F.array_union(F.array_union("a", "b"), "c")), ",").alias("sources"))


# Values in texts

_TEXTS = "WITH t AS (SELECT o_orderkey AS k, o_orderkey % 900 + 100 AS a, lpad(CAST(o_orderkey * 7 % 1000 AS VARCHAR), 3, '0') AS b FROM orders), s AS (SELECT k, CASE k % 8 WHEN 0 THEN '¥' || a || ',' || b WHEN 1 THEN a || '.' || b || '円' WHEN 2 THEN a || ',' || b || '.50' WHEN 3 THEN a || '.' || b || ',50 €' WHEN 4 THEN a || ',5' WHEN 5 THEN '$ ' || a WHEN 6 THEN 'none' ELSE a || '.25' END AS s FROM t)"


def _texts(spark, d):
    k = F.col("k")
    t = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumns({"a": (k % 900 + 100).cast("string"), "b": F.lpad((k * 7 % 1000).cast("string"), 3, "0")})
    forms = [("¥", "a", ",", "b", ""), ("", "a", ".", "b", "円"), ("", "a", ",", "b", ".50"), ("", "a", ".", "b", ",50 €"), ("", "a", ",5"), ("$ ", "a"), ("none",), ("", "a", ".25")]
    made = [F.concat(*(F.col(x) if x in ("a", "b") else F.lit(x) for x in f)) for f in forms]
    return t.select("k", F.element_at(F.array(*made), (k % 8 + 1).cast("int")).alias("s"))


@_query("x12_clean_number", _TEXTS + """, c AS (SELECT k, regexp_replace(s, '[^0-9.,-]', '', 'g') AS c FROM s)
SELECT k, coalesce(TRY_CAST(CASE WHEN contains(c, ',') AND contains(c, '.') THEN CASE WHEN len(c) - instr(reverse(c), '.') > len(c) - instr(reverse(c), ',') THEN replace(c, ',', '') ELSE replace(replace(c, '.', ''), ',', '.') END
  WHEN contains(c, ',') THEN CASE WHEN regexp_matches(c, '^[0-9]{1,3}(,[0-9]{3})+$') THEN replace(c, ',', '') ELSE replace(c, ',', '.') END
  WHEN regexp_matches(c, '^[0-9]{1,3}([.][0-9]{3})+$') THEN replace(c, '.', '') ELSE c END AS DOUBLE), 0) AS value FROM c""")
def x12(spark, d):
    return _texts(spark, d).select("k", v.clean_number(F.col("s")).alias("value"))


@_query("x13_parse_price", _TEXTS + """, c AS (SELECT k, regexp_replace(s, '[€$£ ]', '', 'g') AS c FROM s), n AS (SELECT k, TRY_CAST(CASE WHEN regexp_matches(c, '[0-9]{1,3}[.][0-9]{3},[0-9]{2}') THEN replace(replace(c, '.', ''), ',', '.')
  WHEN contains(c, ',') AND NOT contains(c, '.') THEN replace(c, ',', '.') WHEN contains(c, ',') THEN replace(c, ',', '') ELSE c END AS DOUBLE) AS n FROM c) SELECT k, CASE WHEN n > 0 THEN n END AS price FROM n""")
def x13(spark, d):
    return _texts(spark, d).select("k", v.parse_price(F.col("s")).alias("price"))


@_query("x14_parse_condition", """WITH t AS (SELECT ['Mint!', 'near mint', 'Excellent', 'is GOOD', 'Light Played', 'played', 'poor'][l_linenumber] || ' ' || l_returnflag AS text, ['mt','NM card','ex','gd','lp','PL','none'][l_linenumber] AS code FROM lineitem)
SELECT text, code, CASE WHEN contains(lower(text), 'near mint') THEN 'NM' WHEN contains(lower(text), 'light played') THEN 'LP' WHEN contains(lower(text), 'excellent') THEN 'EX' WHEN contains(lower(text), 'played') THEN 'PL' WHEN contains(lower(text), 'mint') THEN 'MT' WHEN contains(lower(text), 'good') THEN 'GD' ELSE 'PO' END AS condition,
 CASE code WHEN 'none' THEN NULL ELSE upper(code[1:2]) END AS from_code, count(*) AS n FROM t GROUP BY ALL""")
def x14(spark, d):
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("l_linenumber"))
    t = fx.table(spark, d, "lineitem").select(F.concat_ws(" ", at(("Mint!", "near mint", "Excellent", "is GOOD", "Light Played", "played", "poor")), "l_returnflag").alias("text"), at(("mt", "NM card", "ex", "gd", "lp", "PL", "none")).alias("code"))
    return t.groupBy("text", "code", v.parse_condition(F.col("text")).alias("condition"), v.parse_condition(F.col("code")).alias("from_code")).agg(F.count(F.lit(1)).alias("n"))


@_query("x15_raw_condition", "SELECT ['damaged','heavy_play','light_play',' mt ','near_mint','po','?'][l_linenumber] AS said, ['PO','PO','LP','MT','NM','PO','NM'][l_linenumber] AS condition, count(*) AS n FROM lineitem GROUP BY ALL")
def x15(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("damaged", "heavy_play", "light_play", " mt ", "near_mint", "po", "?"))), F.col("l_linenumber"))
    return fx.table(spark, d, "lineitem").groupBy(said.alias("said"), v.raw_condition(said).alias("condition")).agg(F.count(F.lit(1)).alias("n"))


@_query("x16_deal_status", "SELECT CASE o_orderstatus WHEN 'F' THEN 'bought' WHEN 'P' THEN 'skipped' ELSE 'seen' END AS status, count(*) AS n FROM orders GROUP BY 1")
def x16(spark, d):
    s = F.col("o_orderstatus")
    said = F.when(s == "F", "Bought").when(s == "P", "skipped").otherwise("SEEN")
    return fx.table(spark, d, "orders").groupBy(v.deal_status(said).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("x17_cert_numbers", """WITH c AS (SELECT o_orderkey AS k, CAST(10000000 + o_orderkey AS VARCHAR) AS n FROM orders) SELECT k, CASE k % 4 WHEN 3 THEN '12' || k % 100 ELSE n END AS cert,
 'https://www.psacard.com/cert/' || CASE k % 4 WHEN 3 THEN '12' || k % 100 ELSE n END || '/psa' AS url FROM c""")
def x17(spark, d):
    k = F.col("o_orderkey")
    n = (k + 10_000_000).cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("https://www.psacard.com/cert/"), n, F.lit("/psa"))).when(k % 4 == 1, F.concat(F.lit("psacard.com%2Fcert%2F"), n)).when(
        k % 4 == 2, F.concat(F.lit("PSA 9, cert "), n)).otherwise(F.concat(F.lit("no. 12-"), (k % 100).cast("string")))
    return fx.table(spark, d, "orders").select(k.alias("k"), v.cert_number(said).alias("cert")).withColumn("url", v.cert_url(F.col("cert")))


@_query("x19_money_texts", """WITH t AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) - 200000 AS x FROM orders) SELECT k, CASE WHEN x > 0 THEN '+' ELSE '' END || replace(format('{:,}', x), ',', '.') || ' DKK' AS money,
 CASE WHEN x > 0 THEN '+' ELSE '' END || replace(format('{:,}', x), ',', '.') || ',0%' AS percent, '¥' || format('{:,}', x) AS yen FROM t""")
def x19(spark, d):
    x = F.round("o_totalprice").cast("bigint") - 200_000
    t = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), x.cast("double").alias("x"))
    return t.select("k", v.money_text(F.col("x"), signed=True).alias("money"), v.percent_text(F.col("x")).alias("percent"), v.yen_text(F.col("x")).alias("yen"))


@_query("x21_decode_entities", "SELECT page_id, length(replace(replace(replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS chars, md5(replace(replace(replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&#39;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS digest FROM pages")
def x21(spark, d):
    plain = v.decode_entities(F.col("html"))
    return fx.table(spark, d, "pages").select("page_id", F.char_length(plain).cast("bigint").alias("chars"), F.md5(plain.cast("binary")).alias("digest"))


# Deals

@_query("s14_history_edits", with_views(", c AS (SELECT CASE WHEN id % 7 = 1 THEN 'bought' ELSE status END AS status, shop_price_yen, id FROM deals WHERE id % 5 <> 2), n AS (SELECT 'seen' AS status, shop_price_yen * 2 AS shop_price_yen, -1 - id AS id FROM deals WHERE id % 3 = 0) SELECT status, count(*) AS n, round(sum(shop_price_yen), 2) AS yen, min(id) AS lo, max(id) AS hi FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY status", "deals"))
def s14(spark, d):
    h = fx.deals(spark, d)
    changed = deals.set_status(h, h.where("id % 7 = 1").select("id", F.lit("bought").alias("status")))
    kept = deals.delete_deals(changed, h.where("id % 5 = 2"))
    new = h.where("id % 3 = 0").withColumns({"id": -1 - F.col("id"), "status": F.lit("seen"), "shop_price_yen": F.col("shop_price_yen") * 2})
    return deals.append_deals(kept, new).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shop_price_yen"), 2).alias("yen"), F.min("id").alias("lo"), F.max("id").alias("hi"))
