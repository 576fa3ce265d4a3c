"""Queries over evidence in texts, catalogue checks, pages, full decisions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import catalog, deals, extract
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query

# Texts as they are read from scanned cards, one per card

_SCANS = r"""sc AS (SELECT id AS doc_id, name || ' ex' || chr(10) || lpad(CAST(id % 250 AS VARCHAR), 3, '0') || '/172 ' || CASE id % 4 WHEN 0 THEN '税込 ¥' || (id % 900 + 100) || ',800' WHEN 1 THEN '¥' || (id % 900 + 1000) WHEN 2 THEN (id % 90 + 10) || ',500円' ELSE 'HP ' || (id % 300) END
  || chr(10) || 'MSV' || (id % 9) || 'a TG 0' || (id % 30) || chr(10) || 'PSA 9 cert: ' || (10000000 + id) AS text FROM cards)"""
_PREFIX = "TG|GG|SWSH|SM|XY|BW|DP|HGSS|SVP|SV"


def _scans(spark, d):
    k = F.col("id")
    t = lambda x: x.cast("string")
    price = F.when(k % 4 == 0, F.concat(F.lit("税込 ¥"), t(k % 900 + 100), F.lit(",800"))).when(k % 4 == 1, F.concat(F.lit("¥"), t(k % 900 + 1000))).when(
        k % 4 == 2, F.concat(t(k % 90 + 10), F.lit(",500円"))).otherwise(F.concat(F.lit("HP "), t(k % 300)))
    return fx.cards(spark, d).select(k.alias("doc_id"), F.concat(
        F.col("name"), F.lit(" ex\n"), F.lpad(t(k % 250), 3, "0"), F.lit("/172 "), price, F.lit("\nMSV"), t(k % 9), F.lit("a TG 0"), t(k % 30), F.lit("\nPSA 9 cert: "), t(10_000_000 + k)).alias("text"))


def _joined(name):
    return lambda df: df.withColumn(name, F.array_join(name, ","))


@_query("t1_scan_numbers", with_views(f""", {_SCANS}, n AS (SELECT doc_id, list_concat(regexp_extract_all(text, '(?i)\\b((?:(?:{_PREFIX})\\s*)?0*[0-9]{{1,4}})\\s*/\\s*[0-9]{{1,4}}\\b', 1), regexp_extract_all(text, '(?i)\\b((?:{_PREFIX})\\s*0*[0-9]{{1,4}})\\b', 1)) AS xs FROM sc)
SELECT doc_id, array_to_string(list_transform(xs, lambda x: regexp_replace(upper(regexp_replace(x, '\\s+', '', 'g')), '^([A-Z]*?)0*([0-9]+)$', '\\1\\2')), ',') AS numbers FROM n""", "cards"))
def t1(spark, d):
    return _joined("numbers")(extract.evidence(_scans(spark, d)).select("doc_id", "numbers"))


@_query("t2_scan_set_codes", with_views(" SELECT id AS doc_id, 'SV' || (id % 9) || 'a' AS codes FROM cards", "cards"))
def t2(spark, d):
    return _joined("codes")(extract.evidence(_scans(spark, d)).select("doc_id", "codes"))


@_query("t3_scan_certs", with_views(" SELECT id AS doc_id, CAST(10000000 + id AS VARCHAR) AS certs FROM cards", "cards"))
def t3(spark, d):
    return _joined("certs")(extract.evidence(_scans(spark, d)).select("doc_id", "certs"))


@_query("t4_scan_names", with_views(" SELECT id AS doc_id, name || ' ex,MSV' || (id % 9) || 'a' AS names FROM cards", "cards"))
def t4(spark, d):
    return _joined("names")(extract.evidence(_scans(spark, d)).select("doc_id", "names"))


@_query("t6_scan_queries", with_views(f""", {_SCANS}, n AS (SELECT doc_id, list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)\\b((?:(?:{_PREFIX})\\s*)?0*[0-9]{{1,4}})\\s*/\\s*[0-9]{{1,4}}\\b', 1), regexp_extract_all(text, '(?i)\\b((?:{_PREFIX})\\s*0*[0-9]{{1,4}})\\b', 1)), lambda x: regexp_replace(upper(regexp_replace(x, '\\s+', '', 'g')), '^([A-Z]*?)0*([0-9]+)$', '\\1\\2'))) AS xs FROM sc)
SELECT doc_id, 'SV' || (doc_id % 9) || 'a ' || x AS query FROM (SELECT doc_id, unnest(xs) AS x FROM n)""", "cards"))
def t6(spark, d):
    queries = extract.evidence(_scans(spark, d)).select("doc_id", F.explode("queries").alias("query"))
    return queries.where("query rlike '^SV[0-9]a '")


@_query("t5_yen_prices", with_views(" SELECT id AS doc_id, CASE id % 4 WHEN 0 THEN (id % 900 + 100) * 1000 + 800 WHEN 1 THEN id % 900 + 1000 WHEN 2 THEN (id % 90 + 10) * 1000 + 500 END AS price FROM cards WHERE id % 4 <> 3", "cards"))
def t5(spark, d):
    return extract.evidence(_scans(spark, d)).select("doc_id", "price").where("doc_id % 4 <> 3")


@_query("c16_scan_evidence")
def c16(spark, d):
    both = _scans(spark, d).unionByName(fx.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return extract.evidence(both)


@_query("a16_best_per_value", "WITH p AS (SELECT o_custkey AS doc_id, o_orderkey % 7 AS value, o_orderkey % 3 * 10 AS score, o_orderkey AS place FROM orders) SELECT doc_id, value, max(score) AS score, arg_max(place, (score, -place)) AS \"at\" FROM p GROUP BY ALL")
def a16(spark, d):
    k = F.col("o_orderkey")
    return extract.best_per_value(fx.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 7).alias("value"), (k % 3 * 10).alias("score"), k.alias("at")))


@_query("a21_best_field", "WITH r AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN ' ' ELSE role END AS text, length(text) % 5 / 4.0::DOUBLE AS confidence FROM conversations) SELECT conv_id, arg_min(text, (-confidence, text)) AS text, max(confidence) AS confidence FROM r WHERE trim(text) <> '' GROUP BY conv_id")
def a21(spark, d):
    c = fx.table(spark, d, "conversations")
    read = c.select("conv_id", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("role")).alias("text"), (F.char_length("text") % 5 / 4.0).alias("confidence"))
    return extract.best_field(read, "conv_id")


# Catalogue

@_query("f14_find_text", with_views(" SELECT id, name FROM cards WHERE contains(lower(name || ' ' || variant), 'red') AND variant = 'SMALL'", "cards"))
def f14(spark, d):
    return catalog.highlight(fx.cards(spark, d), "RED", "SMALL").select("id", "name")


@_query("j10_cards_with_listing", with_views(" SELECT id FROM cards WHERE id IN (SELECT product_id FROM listings WHERE price < 3000)", "cards", "listings"))
def j10(spark, d):
    return catalog.with_image(fx.cards(spark, d), fx.listings(spark, d).where("price < 3000").select(F.col("product_id").alias("id"))).select("id")


@_query("j11_cards_without_listing", with_views(" SELECT id FROM cards WHERE id NOT IN (SELECT product_id FROM listings WHERE price < 3000)", "cards", "listings"))
def j11(spark, d):
    return catalog.unseen(fx.cards(spark, d), fx.listings(spark, d).where("price < 3000").select(F.col("product_id").alias("id")), "id").select("id")


@_query("s4_labels", "SELECT vec_id // 4 AS card_id, label, count(*) AS vectors FROM embeddings WHERE label IS NOT NULL GROUP BY ALL")
def s4(spark, d):
    rows = fx.table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("card_id"), "label")
    return catalog.complete(rows, "card_id", "label").groupBy("card_id", "label").agg(F.count(F.lit(1)).alias("vectors"))


@_query("s11_training_manifest", "SELECT label, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS crops FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def s11(spark, d):
    made = catalog.manifest(fx.table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return made.select("label", "n", F.array_join(F.transform("crops", lambda x: x.cast("string")), ",").alias("crops"))


@_query("s12_provenance", with_views(", k AS (SELECT 'variant' AS \"by\", variant AS value, count(*) AS n FROM cards GROUP BY variant UNION ALL SELECT 'language', language, count(*) FROM cards GROUP BY language) SELECT \"by\", value, n FROM k", "cards"))
def s12(spark, d):
    return catalog.provenance(fx.cards(spark, d), "variant", "language")


@_query("c22_classified_pages", """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)', 1)) AS heading, generate_subscripts(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)', 1), 1) AS place FROM pages),
k AS (SELECT page_id, arg_min(CASE WHEN contains(heading, 'the') THEN 'english' ELSE 'marked' END, place) AS kind FROM h WHERE contains(heading, 'the') OR contains(heading, 'é') GROUP BY page_id) SELECT page_id, url, coalesce(kind, 'unknown') AS kind FROM pages LEFT JOIN k USING (page_id)""")
def c22(spark, d):
    pages = fx.table(spark, d, "pages")
    return extract.classify_points(pages.select("page_id", "url"), pages, {"the": "english", "é": "marked"})


@_query("t17_variant_from_flags", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'first-edition' WHEN p_partkey % 3 = 0 THEN 'reverse' WHEN p_partkey % 2 = 0 THEN 'holo' ELSE 'standard' END AS variant FROM part")
def t17(spark, d):
    k = F.col("p_partkey")
    return fx.table(spark, d, "part").select(k.alias("id"), text.variant_from_flags(k % 7 == 0, k % 3 == 0, F.when(k % 2 == 0, True)).alias("variant"))


@_query("t13_first_text", "SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k')) AS text FROM events")
def t13(spark, d):
    return fx.table(spark, d, "events").select("event_id", text.first_json_text(F.col("props"), "$.text", "$.k").alias("text"))


# Boxes and confidences

@_query("x30_boxes", """WITH b AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_partkey % 100 AS INT) AS l, CAST(l_suppkey % 80 AS INT) AS t, CAST(l_partkey % 100 + l_linenumber * 40 AS INT) AS r, CAST(l_suppkey % 80 + l_orderkey % 70 AS INT) AS b,
  CAST(l_suppkey % 200 AS INT) AS l2, CAST(l_partkey % 60 AS INT) AS t2, CAST(l_suppkey % 200 + 50 AS INT) AS r2, CAST(l_partkey % 60 + 40 AS INT) AS b2 FROM lineitem),
p AS (SELECT *, least(r, r2) - greatest(l, l2) AS w, least(b, b2) - greatest(t, t2) AS h, least((r - l) * (b - t), 2000) AS area, greatest(8, CAST(floor((r - l) * 0.08::DOUBLE) AS INT)) AS x, greatest(8, CAST(floor((b - t) * 0.16::DOUBLE) AS INT)) AS y FROM b)
SELECT id, line, round(CASE WHEN w > 0 AND h > 0 AND area <> 0 THEN w * h / area::DOUBLE ELSE 0 END, 9) AS overlap, greatest(0, l - x) AS "left", greatest(0, t - y) AS top, least(300, r + x) AS "right", least(120, b + y) AS bottom FROM p""")
def x30(spark, d):
    i = lambda x: F.expr(x).cast("int")
    one = boxes.box(i("l_partkey % 100"), i("l_suppkey % 80"), i("l_partkey % 100 + l_linenumber * 40"), i("l_suppkey % 80 + l_orderkey % 70"))
    two = boxes.box(i("l_suppkey % 200"), i("l_partkey % 60"), i("l_suppkey % 200 + 50"), i("l_partkey % 60 + 40"))
    wider = boxes.expand_box(F.col("one"), F.lit(300), F.lit(120))
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), one.alias("one"), two.alias("two"))
    return rows.select("id", "line", F.round(boxes.overlap_ratio(F.col("one"), F.col("two")), 9).alias("overlap"), wider.alias("w")).select("id", "line", "overlap", "w.*")


@_query("x27_confidence", """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS v, event_id % 400 AS score, event_id % 3 = 0 AS trusted FROM events), f AS (SELECT *, CASE WHEN v IS NOT NULL THEN least(greatest(CASE WHEN v > 1 THEN v / 100 ELSE v END, 0), 1) END AS fraction FROM e)
SELECT event_id, round(fraction, 9) AS fraction, round(CASE WHEN trusted AND score >= 180 THEN least(greatest(coalesce(fraction, 0), 0.8::DOUBLE), 0.99::DOUBLE)
  ELSE least(greatest(coalesce(fraction, 0) * 0.55::DOUBLE + least(greatest(score / 420::DOUBLE, 0.1::DOUBLE), 0.85::DOUBLE) * 0.45::DOUBLE, 0.1::DOUBLE), 0.99::DOUBLE) END, 9) AS confidence FROM f""")
def x27(spark, d):
    k = F.col("event_id")
    e = fx.table(spark, d, "events").select("event_id", boxes.fraction(F.when(k % 5 > 0, F.col("value"))).alias("fraction"))
    own = boxes.candidate_confidence(F.coalesce("fraction", F.lit(0.0)), k % 400, F.when(k % 3 == 0, "gibltcg").otherwise("tcgdex"))
    return e.select("event_id", F.round("fraction", 9).alias("fraction"), F.round(own, 9).alias("confidence"))


# Full decisions

def _all_values(spark, d):
    p = fx.provider_prices(spark, d)
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    g = p.groupBy("card_id").agg(of("cardmarket", "raw").alias("raw"), of("pokeprices", "psa9").alias("psa9"), of("pokeprices", "psa10").alias("psa10"), of("pricecharting", "raw").alias("g"))
    return g.select("card_id", "raw", "psa9", "psa10", (F.col("g") * 1.5).alias("psa7"), (F.col("g") * 2).alias("psa8"), F.when(F.col("card_id") % 2 == 0, F.col("g") * 3.5).alias("psa95"), (F.col("card_id") % 3 == 0).alias("is_manual"))


def _register_decisions():
    from .registry import _DECIDED

    margin = "CASE WHEN {0} <> 0 AND cost <> 0 THEN ({0} * (1 - 0.05::DOUBLE) - cost) / cost * 100 END"

    @_query("c14_decide_fully", _DECIDED + f""", gg AS (SELECT card_id, max(raw) FILTER (source = 'pricecharting') AS g FROM provider_prices GROUP BY card_id)
SELECT x.id, x.cost, route, net, profit, margin, decision, state, coalesce(warning, CASE WHEN d.card_id % 3 = 0 AND gg.card_id IS NOT NULL THEN 'MANUAL_VALUES' END) AS warning,
 {margin.format('(g * 1.5::DOUBLE)')} AS psa7_margin, {margin.format('(g * 2)')} AS psa8_margin, {margin.format('(CASE WHEN d.card_id % 2 = 0 THEN g * 3.5::DOUBLE END)')} AS psa95_margin FROM decided x JOIN deals d ON d.id = x.id LEFT JOIN gg ON gg.card_id = d.card_id""")
    def c14(spark, d):
        return deals.decide_fully(fx.deals(spark, d), _all_values(spark, d))

    @_query("p11_saved_deals", _DECIDED + " SELECT d.id, d.card_id, d.condition, d.shop_price_yen, d.status, d.created_at, route, net, profit, margin, decision, warning FROM decided x JOIN deals d ON d.id = x.id")
    def p11(spark, d):
        offers = fx.deals(spark, d)
        return deals.saved_deals(offers, deals.decide(offers, _all_values(spark, d)))


_register_decisions()
