"""The registered queries of the engine, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import catalog, deals, prices, ranks, similarity
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..streaming.latest import fresh, latest
from .base import _query, oracle_sql, queries  # noqa: F401

# Deals

_VALUES = "v AS (SELECT card_id, max(raw) FILTER (source = 'cardmarket') AS raw, max(psa9) FILTER (source = 'pokeprices') AS psa9, max(psa10) FILTER (source = 'pokeprices') AS psa10 FROM provider_prices GROUP BY card_id)"
_ROUTES = with_views(f""", {_VALUES},
j AS (SELECT d.*, raw, psa9, psa10, CASE WHEN shop_price_yen > 0 THEN shop_price_yen / 25::DOUBLE ELSE 0 END AS cost FROM deals d LEFT JOIN v USING (card_id)),
r AS (SELECT j.id, t.ord, t.route, cost + CASE WHEN graded AND cost > 0 THEN 220 ELSE 0 END AS route_cost, buy, maybe,
    CASE t.val WHEN 'raw' THEN raw WHEN 'psa9' THEN psa9 ELSE psa10 END AS value, cost
  FROM j JOIN (VALUES (0,'raw','raw_flip','raw',false,30,20),(1,'raw','grade_psa9','psa9',true,45,35),(2,'raw','grade_psa10','psa10',true,45,35),
    (3,'psa9','psa9_slab','psa9',false,20,10),(4,'psa10','psa10_slab','psa10',false,20,10)) t(ord, cond, route, val, graded, buy, maybe) ON t.cond = j.condition),
m AS (SELECT *, CASE WHEN value <> 0 AND route_cost <> 0 THEN value * (1 - 0.05::DOUBLE) END AS net FROM r),
g AS (SELECT *, net - route_cost AS profit, (net - route_cost) / route_cost * 100 AS margin FROM m),
f AS (SELECT *, CASE WHEN margin >= buy THEN 'BUY' WHEN margin >= maybe THEN 'MAYBE' ELSE 'SKIP' END AS free FROM g),
routes AS (SELECT id, ord, route, route_cost, net, profit, margin, CASE WHEN route_cost > 3250 AND free = 'BUY' THEN 'MAYBE' ELSE free END AS decision,
  coalesce(route_cost > 3250 AND free = 'BUY', false) AS capped, CASE WHEN route_cost <= 0 THEN 'idle' WHEN margin IS NULL THEN 'missing' ELSE 'ready' END AS state, cost FROM f)""", "deals", "provider_prices")


def _values(spark, d):
    p = fx.provider_prices(spark, d)
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    return p.groupBy("card_id").agg(of("cardmarket", "raw").alias("raw"), of("pokeprices", "psa9").alias("psa9"), of("pokeprices", "psa10").alias("psa10"))


@_query("c13_deal_routes", _ROUTES + " SELECT * EXCLUDE (cost) FROM routes")
def c13(spark, d):
    return deals.deal_routes(fx.deals(spark, d), _values(spark, d))


_DECIDED = _ROUTES + """, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE decision WHEN 'BUY' THEN 2 WHEN 'MAYBE' THEN 1 ELSE 0 END DESC, margin DESC, ord) AS k FROM routes WHERE state = 'ready'),
a AS (SELECT id, any_value(cost) AS cost, max(CASE WHEN ord = 0 THEN margin END) AS m0, max(CASE WHEN ord = 1 THEN margin END) AS m1, max(CASE WHEN ord = 2 THEN margin END) AS m2, count(*) AS n FROM routes GROUP BY id),
decided AS (SELECT a.id, a.cost, b.route, b.net, b.profit, b.margin, coalesce(b.decision, 'SKIP') AS decision,
  CASE WHEN a.cost <= 0 THEN 'idle' WHEN b.id IS NULL THEN 'missing' ELSE 'ready' END AS state,
  CASE WHEN n = 3 AND coalesce(m0 < 20, true) AND coalesce(m1 < 35, true) AND coalesce(m2 >= 45, false) THEN 'PSA_10_TRAP'
    WHEN a.cost > 0 AND b.id IS NULL THEN 'VALUES_MISSING' WHEN b.capped THEN 'HIGH_END_RISK' END AS warning
  FROM a LEFT JOIN b ON a.id = b.id AND b.k = 1)"""


@_query("c14_decide", _DECIDED + " SELECT * FROM decided")
def c14(spark, d):
    return deals.decide(fx.deals(spark, d), _values(spark, d))


@_query("c14_decision_report", _DECIDED + " SELECT decision, state, coalesce(warning, 'none') AS warning, count(*) AS n, round(coalesce(sum(profit), 0), 2) AS profit FROM decided GROUP BY ALL")
def c14_report(spark, d):
    return c14(spark, d).groupBy("decision", "state", F.coalesce("warning", F.lit("none")).alias("warning")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("profit"), F.lit(0.0)), 2).alias("profit"))


@_query("c15_margin_decision", with_views(f""", {_VALUES}, j AS (SELECT id, raw, CASE WHEN shop_price_yen > 0 THEN shop_price_yen / 25::DOUBLE ELSE 0 END AS cost FROM deals LEFT JOIN v USING (card_id)),
m AS (SELECT id, CASE WHEN raw <> 0 AND cost <> 0 THEN (raw * (1 - 0.05::DOUBLE) - cost) / cost * 100 END AS margin FROM j)
SELECT id, margin, CASE WHEN margin >= 30 THEN 'BUY' WHEN margin >= 15 THEN 'MAYBE' ELSE 'SKIP' END AS decision FROM m""", "deals", "provider_prices"))
def c15(spark, d):
    j = fx.deals(spark, d).join(_values(spark, d), "card_id", "left")
    s = money.Settings()
    m = j.select("id", money.margin_of(F.col("raw"), money.cost_of(F.col("shop_price_yen")), s).alias("margin"))
    return m.withColumn("decision", money.decide_margin(F.col("margin"), s.buy, s.maybe))


@_query("a18_bought_totals", with_views(" SELECT count(*) AS n, round(coalesce(sum(shop_price_yen), 0), 2) AS yen, round(coalesce(sum(CASE WHEN shop_price_yen > 0 THEN shop_price_yen / 25::DOUBLE ELSE 0 END), 0), 2) AS dkk FROM deals WHERE status = 'bought'", "deals"))
def a18(spark, d):
    return deals.bought_totals(fx.deals(spark, d))


@_query("k9_newest_deals", with_views(", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY card_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM deals) SELECT id, card_id, place FROM r WHERE place <= 3", "deals"))
def k9(spark, d):
    return deals.newest_first(fx.deals(spark, d), 3).select("id", "card_id", "place")


@_query("k9_deal_history", with_views(" SELECT id, card_id, CAST(row_number() OVER (PARTITION BY card_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM deals", "deals"))
def k9_history(spark, d):
    return deals.newest_first(fx.deals(spark, d)).select("id", "card_id", "place")


@_query("c23_history", with_views(" SELECT status, condition, count(*) AS n, round(sum(shop_price_yen), 2) AS yen, max(id) AS last_id FROM deals GROUP BY ALL", "deals"))
def c23(spark, d):
    return fx.deals(spark, d).groupBy("status", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shop_price_yen"), 2).alias("yen"), F.max("id").alias("last_id"))


# Listings and reference prices

_RANK = "list_position(['MT','NM','EX','GD','LP','PL','PO'], condition)"


@_query("f1_condition_at_least", with_views(f" SELECT condition, count(*) AS n, round(sum(price), 2) AS total FROM listings WHERE {_RANK} <= 4 GROUP BY condition", "listings"))
def f1(spark, d):
    return prices.condition_at_least(fx.listings(spark, d), "GD").groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@_query("a5_lowest_price", with_views(" SELECT product_id, min(price) FILTER (price > 0 AND isfinite(price)) AS lowest FROM listings GROUP BY product_id", "listings"))
def a5(spark, d):
    return prices.lowest_price(fx.listings(spark, d))


@_query("a6_upper_median", with_views(", l AS (SELECT product_id, list_sort(list(price) FILTER (price > 0 AND isfinite(price))) AS xs FROM listings GROUP BY product_id) SELECT product_id, xs[1 + len(xs) // 2] AS median FROM l", "listings"))
def a6(spark, d):
    return ranks.group_upper_median(fx.listings(spark, d), ["product_id"], "price")


@_query("a8_variant_price", with_views(""", p AS (SELECT card_id, max(raw) FILTER (source_order = 0) AS a, max(raw) FILTER (source_order = 1) * (1 + card_id % 5) AS b FROM provider_prices GROUP BY card_id)
SELECT card_id, CASE WHEN a IS NULL THEN b WHEN b >= 1 AND b >= a * 3 THEN b ELSE a END AS price, coalesce(a, b) AS first FROM p""", "provider_prices"))
def a8(spark, d):
    p = fx.provider_prices(spark, d).groupBy("card_id").agg(*(F.max(F.when(F.col("source_order") == i, F.col("raw"))).alias(c) for i, c in enumerate("ab")))
    a, b = F.col("a"), F.col("b") * (1 + F.col("card_id") % 5)
    return p.select("card_id", money.variant_price(a, b).alias("price"), money.first_positive(a, b).alias("first"))


@_query("c18_reference_listing", with_views(f""", x AS (SELECT DISTINCT ON (article_id) * FROM listings ORDER BY article_id, product_id, seller, price, condition),
o AS (SELECT *, condition = 'GD' AS exact FROM x WHERE price > 0 AND {_RANK} <= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY NOT exact, price, article_id) AS k,
  count(*) FILTER (exact) OVER (PARTITION BY product_id) AS exact_count, count(*) OVER (PARTITION BY product_id) AS listing_count FROM o)
SELECT product_id, price, article_id, condition, seller, exact_count, listing_count FROM k WHERE k = 1""", "listings"))
def c18(spark, d):
    return prices.reference_listing(prices.distinct_listings(fx.listings(spark, d)), "GD")


@_query("a17_distinct_listings", with_views(" SELECT count(*) AS n, round(sum(price), 2) AS total FROM (SELECT DISTINCT ON (article_id) * FROM listings ORDER BY article_id, product_id, seller, price, condition)", "listings"))
def a17(spark, d):
    return prices.distinct_listings(fx.listings(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


def _first_sql(v: str, priority: str) -> str:
    key = f"CASE WHEN list_position({priority}, source) > 0 THEN list_position({priority}, source) ELSE len({priority}) + 1 + source_order END"
    return f"arg_min({v}, {key}) FILTER ({v} > 0) AS {v}, arg_min(CASE WHEN list_position({priority}, source) > 0 THEN source ELSE '' END, {key}) FILTER ({v} > 0) AS {v}_source"


@_query("a11_merge_references", with_views(f""" SELECT card_id, {_first_sql('raw', "['cardmarket','tcgplayer','pokeprices','pricecharting']")},
 {_first_sql('psa9', "['pokeprices','pricecharting']")}, {_first_sql('psa10', "['pokeprices','pricecharting']")},
 string_agg(source, ',' ORDER BY source_order) FILTER (coalesce(raw, psa9, psa10) IS NOT NULL) AS sources FROM provider_prices GROUP BY card_id""", "provider_prices"))
def a11(spark, d):
    return prices.merge_references(fx.provider_prices(spark, d))


@_query("a4_lowest_listing", with_views(f""", o AS (SELECT *, condition = 'EX' AS exact FROM listings WHERE price > 0 AND {_RANK} <= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY NOT exact, price, article_id, condition, seller) AS k,
  count(*) FILTER (exact) OVER (PARTITION BY product_id) AS exact_count, count(*) OVER (PARTITION BY product_id) AS listing_count FROM o)
SELECT product_id, price, article_id, condition, seller, exact_count, listing_count FROM k WHERE k = 1""", "listings"))
def a4(spark, d):
    return prices.reference_listing(fx.listings(spark, d), "EX")


@_query("f2_positive_price", with_views(" SELECT condition, count(*) AS n, min(price) AS lowest FROM listings WHERE price > 0 AND isfinite(price) GROUP BY condition", "listings"))
def f2(spark, d):
    return prices.positive_prices(fx.listings(spark, d)).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lowest"))


@_query("j6_attach_prices", with_views(" SELECT c.id, count(p.source) AS n, min(p.raw) AS lowest FROM cards c LEFT JOIN provider_prices p ON p.card_id = c.id AND p.raw IS NOT NULL GROUP BY c.id", "cards", "provider_prices"))
def j6(spark, d):
    found = prices.attach_prices(fx.cards(spark, d), fx.provider_prices(spark, d).where("raw is not null"))
    return found.select("id", F.size("prices").cast("long").alias("n"), F.array_min(F.transform("prices", lambda p: p["raw"])).alias("lowest"))


# Vectors

_TOP = """, q AS (SELECT vec_id AS query_id, vector, label, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS v FROM vectors WHERE vec_id % 20 = 0),
r AS (SELECT * FROM vectors),
s AS (SELECT query_id, card_id, max(round(list_inner_product(q.v, r.vector), 6)) AS score FROM q JOIN r ON r.vec_id <> q.query_id GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS INT) AS rank FROM s),
top AS (SELECT * FROM k WHERE rank <= 20)"""


def _sides(spark, d):
    v = fx.vectors(spark, d)
    return v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v


def _prints(spark, d):
    return fx.vectors(spark, d).select("vec_id", "card_id", "label", "vector", F.transform("vector", F.abs).alias("histogram"), similarity.sign_hash(F.col("vector")).alias("hash"))


def _top(spark, d):
    q, r = _sides(spark, d)
    return similarity.vector_topk(q.select("query_id", "vector"), r, 20)


@_query("k1_vector_topk", with_views(_TOP + " SELECT query_id, card_id, score, rank FROM top", "vectors"))
def k1(spark, d):
    return _top(spark, d)


@_query("a1_max_similarity", with_views(_TOP + " SELECT query_id, card_id, round(least(greatest((score + 1) / 2, 0), 1), 7) AS similarity FROM s", "vectors"))
def a1(spark, d):
    q, r = _sides(spark, d)
    best = similarity.max_similarity(q.select("query_id", "vector"), r)
    return best.select("query_id", "card_id", F.round(similarity.rescaled(F.col("score")), 7).alias("similarity"))


@_query("a3_retrieval_metrics", with_views(_TOP + """, e AS (SELECT q.query_id, min(top.rank) AS rank FROM q LEFT JOIN (SELECT DISTINCT label, card_id FROM r) l ON l.label = q.label
  LEFT JOIN top ON top.query_id = q.query_id AND top.card_id = l.card_id GROUP BY q.query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS topn,
 round(avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top20, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM e""", "vectors"))
def a3(spark, d):
    q, r = _sides(spark, d)
    labels = q.select("query_id", "label").join(r.select("label", "card_id").distinct(), "label").select("query_id", "card_id")
    return similarity.retrieval_metrics(similarity.expected_rank(_top(spark, d), labels), 5)


@_query("f4_auto_select", with_views(_TOP + " SELECT query_id, arg_min(card_id, rank) AS card_id, min(rank) AS rank FROM top WHERE score >= 0.2 GROUP BY query_id", "vectors"))
def f4(spark, d):
    return similarity.auto_select(_top(spark, d), 0.2)


@_query("f5_needs_review", with_views(_TOP + " SELECT query_id, max(score) AS best, max(score) < 0.72 AS review FROM top GROUP BY query_id", "vectors"))
def f5(spark, d):
    best = _top(spark, d).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("review", similarity.needs_review(F.col("best")))


@_query("w2_expected_rank", with_views(_TOP + """ SELECT q.query_id, min(top.rank) AS rank FROM q JOIN (SELECT DISTINCT label, card_id FROM r) l ON l.label = q.label
  LEFT JOIN top ON top.query_id = q.query_id AND top.card_id = l.card_id GROUP BY q.query_id""", "vectors"))
def w2(spark, d):
    q, r = _sides(spark, d)
    labels = q.select("query_id", "label").join(r.select("label", "card_id").distinct(), "label").select("query_id", "card_id")
    return similarity.expected_rank(_top(spark, d), labels)


@_query("k5_candidate_topk", with_views(_TOP + " SELECT query_id, card_id, score, rank FROM top WHERE rank <= 8", "vectors"))
def k5(spark, d):
    return similarity.rank_candidates(_top(spark, d).drop("rank"), 8)


@_query("a15_best_per_card", with_views(_TOP + " SELECT card_id, max(score) AS score, arg_max(query_id, (score, -query_id)) AS query_id FROM top GROUP BY card_id", "vectors"))
def a15(spark, d):
    return similarity.best_per_card(_top(spark, d))


def _hist(v: str) -> str:
    return f"list_transform({v}, lambda x: abs(x))"


def _centered(v: str) -> str:
    return f"list_transform({v}, lambda x: x - list_sum({v}) / len({v}))"


@_query("a2_best_coarse", with_views(f""", h AS (SELECT vec_id, card_id, {_hist('vector')} AS h, list_reduce(list_transform(vector, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS bits FROM vectors),
c AS (SELECT *, {_centered('h')} AS c FROM h),
s AS (SELECT q.vec_id AS query_id, r.card_id, r.vec_id, round(0.72::DOUBLE * greatest(0, 1 - bit_count(xor(q.bits, r.bits)) / 64.0::DOUBLE)
    + (1 - 0.72::DOUBLE) * least(greatest((list_inner_product(q.c, r.c) / sqrt(list_inner_product(q.c, q.c) * list_inner_product(r.c, r.c)) + 1) / 2, 0), 1), 6) AS score
  FROM c q JOIN c r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, card_id ORDER BY score DESC, vec_id) AS k FROM s) SELECT query_id, card_id, score, vec_id FROM k WHERE k = 1""", "vectors"))
def a2(spark, d):
    h = _prints(spark, d)
    return similarity.best_coarse(h.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), h)


# Catalogue

_VARIANT = """CASE WHEN t IN ('normal','regular','none') THEN 'standard' WHEN t IN ('reverse_holo','reversefoil','reverse') THEN 'reverse' WHEN t IN ('holofoil','holo_foil','holo-foil') THEN 'holo'
  WHEN t IN ('first_edition','1st_edition','firstedition') THEN 'first-edition' WHEN t = '' THEN 'standard' ELSE t END"""


def _token(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z0-9/._-]+', '-', 'g'), '-+', '-', 'g'), '-')"


@_query("p1_print_uid", with_views(f", n AS (SELECT *, {_token('variant')} AS t FROM cards) SELECT id, {_token('language')} || ':' || {_token('set_id')} || ':' || regexp_replace(local_id, '\\s+', '', 'g') || ':' || {_VARIANT} AS uid FROM n", "cards"))
def p1(spark, d):
    return catalog.with_uid(fx.cards(spark, d)).select("id", "uid")


@_query("p2_market_queries", with_views(f""", n AS (SELECT *, {_token('variant')} AS t FROM cards)
SELECT id, concat_ws(' ', name, set_id, local_id, CASE WHEN {_VARIANT} <> 'standard' THEN variant END) AS query_us, concat_ws(' ', name, local_id, set_id) AS query_eu FROM n""", "cards"))
def p2(spark, d):
    return catalog.market_queries(fx.cards(spark, d))


@_query("s7_upsert", with_views(""", b AS (SELECT id % 500 AS id, name, price * 2 AS price, id AS o FROM cards WHERE id % 3 = 0),
u AS (SELECT id, arg_max(name, o) AS name, arg_max(price, o) AS price FROM b GROUP BY id)
SELECT id, name, price FROM cards WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT id, name, price FROM u""", "cards"))
def s7(spark, d):
    c = fx.cards(spark, d).select("id", "name", "price")
    batch = c.where("id % 3 = 0").select((F.col("id") % 500).alias("id"), "name", (F.col("price") * 2).alias("price"), F.col("id").alias("o"))
    return catalog.upsert(c, batch, "id", "o")


@_query("w4_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def w4(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return catalog.first_seen(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@_query("a13_dedupe_results", with_views(""", x AS (SELECT name, set_id, local_id, id AS place, CASE WHEN id % 2 = 0 THEN id END AS p1, CASE WHEN id % 5 = 0 THEN id END AS p2 FROM cards)
SELECT name, set_id, local_id, min(place) AS place, min(p1) AS p1, min(p2) AS p2 FROM x GROUP BY ALL""", "cards"))
def a13(spark, d):
    k = F.col("id")
    x = fx.cards(spark, d).select("name", "set_id", "local_id", k.alias("place"), F.when(k % 2 == 0, k).alias("p1"), F.when(k % 5 == 0, k).alias("p2"))
    return catalog.dedupe_results(x, "place", ["p1", "p2"])


@_query("u1_concat_sources", with_views(" SELECT source_order, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 0 AS source_order, id FROM cards WHERE language = 'en' UNION ALL SELECT 1, id FROM cards WHERE language = 'ja') GROUP BY 1", "cards"))
def u1(spark, d):
    c = fx.cards(spark, d)
    both = catalog.concat_sources(c.where("language = 'en'").select("id", "name"), c.where("language = 'ja'").select("id"))
    return both.groupBy("source_order").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@_query("a19_category_counts", with_views(" SELECT set_id, variant, count(*) AS n FROM cards GROUP BY ALL", "cards"))
def a19(spark, d):
    return catalog.category_counts(fx.cards(spark, d), "set_id", "variant")


@_query("f3_language_bucket", with_views(" SELECT CASE WHEN language IN ('ja','ko') THEN 'asian' ELSE 'western' END AS bucket, count(*) AS n FROM cards GROUP BY 1", "cards"))
def f3(spark, d):
    bucket = F.when(F.col("language").isin("ja", "ko"), "asian").otherwise("western")
    return fx.cards(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query("f14_text_search", with_views(" SELECT id, name FROM cards WHERE contains(lower(name || ' ' || variant), 'er')", "cards"))
def f14(spark, d):
    return catalog.highlight(fx.cards(spark, d), "ER").select("id", "name")


@_query("j10_with_image", with_views(" SELECT id FROM cards WHERE id IN (SELECT product_id FROM listings WHERE price > 50000)", "cards", "listings"))
def j10(spark, d):
    return catalog.with_image(fx.cards(spark, d), fx.listings(spark, d).where("price > 50000").select(F.col("product_id").alias("id"))).select("id")


@_query("j11_unseen", with_views(" SELECT id FROM cards WHERE id NOT IN (SELECT product_id FROM listings WHERE price > 50000)", "cards", "listings"))
def j11(spark, d):
    return catalog.unseen(fx.cards(spark, d), fx.listings(spark, d).where("price > 50000").select(F.col("product_id").alias("id")), "id").select("id")


@_query("a14_dedupe_candidates", with_views(" SELECT lower(set_id) AS set_key, lower(name) AS name_key, min(id) AS id, arg_min(local_id, id) AS local_id FROM cards GROUP BY ALL", "cards"))
def a14(spark, d):
    c = fx.cards(spark, d).select(F.lower("set_id").alias("set_key"), F.lower("name").alias("name_key"), "id", "local_id")
    return catalog.first_seen(c, ["set_key", "name_key"], "id")


@_query("u3_union_candidates", with_views(""", u AS (SELECT 0 AS source_order, * FROM cards WHERE language = 'en' UNION ALL SELECT 1, * FROM cards WHERE language = 'ja'),
f AS (SELECT variant, min((source_order, id)) AS f FROM u GROUP BY variant, lower(set_id), lower(name)),
k AS (SELECT variant, f[1] AS source_order, f[2] AS id, CAST(row_number() OVER (PARTITION BY variant ORDER BY f) AS INT) AS place FROM f) SELECT * FROM k WHERE place <= 10""", "cards"))
def u3(spark, d):
    c = fx.cards(spark, d)
    return catalog.union_candidates(catalog.concat_sources(c.where("language = 'en'"), c.where("language = 'ja'")), "variant", 10)


def _axes(spark, d):
    return fx.vectors(spark, d).select("vec_id", *(F.get("vector", i).alias(a) for i, a in enumerate("xyz")))


_XYZ = ", p AS (SELECT vec_id, vector[1] AS x, vector[2] AS y, vector[3] AS z FROM vectors)"


@_query("a20_axis_bounds", with_views(_XYZ + " SELECT " + ", ".join(f"round(quantile_cont({a}, {q}), 6) AS {a}_{n}" for a in "xyz" for n, q in (("lo", 0.005), ("hi", 0.995))) + " FROM p", "vectors"))
def a20(spark, d):
    return catalog.axis_bounds(_axes(spark, d), "xyz")


@_query("f7_focus", with_views(_XYZ + ", b AS (SELECT " + ", ".join(f"quantile_cont({a}, {q}) AS {a}_{n}" for a in "xyz" for n, q in (("lo", 0.005), ("hi", 0.995))) + " FROM p) SELECT vec_id FROM p, b WHERE " + " AND ".join(f"{a} BETWEEN {a}_lo AND {a}_hi" for a in "xyz"), "vectors"))
def f7(spark, d):
    return catalog.focus(_axes(spark, d), "xyz").select("vec_id")


@_query("s15_page_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS place FROM pages),
c AS (SELECT page_id, regexp_replace(raw, '[?#].*$', '') AS link, place FROM l) SELECT page_id, link, CAST(min(place) AS INT) AS place FROM c WHERE link <> '' GROUP BY page_id, link""")
def s15(spark, d):
    return catalog.page_links(fx.table(spark, d, "pages"))


# Texts

def _numbers(out: Column, name: str):
    return lambda spark, d: fx.table(spark, d, "documents").select("doc_id", out.alias(name)).where(F.size(name) > 0)


@_query("t1_card_numbers")
def t1(spark, d):
    return _numbers(text.card_numbers(F.col("text")), "numbers")(spark, d)


@_query("t2_set_codes")
def t2(spark, d):
    return _numbers(text.set_codes(F.col("text")), "codes")(spark, d)


@_query("t3_cert_numbers")
def t3(spark, d):
    return _numbers(text.cert_numbers(F.col("text")), "certs")(spark, d)


@_query("t4_name_lines")
def t4(spark, d):
    return _numbers(text.name_lines(F.col("text")), "names")(spark, d)


@_query("x11_infer_language", "SELECT CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]') THEN 'ja' WHEN trim(text) <> '' THEN 'en' END AS language, count(*) AS n FROM documents GROUP BY 1")
def x11(spark, d):
    return fx.table(spark, d, "documents").groupBy(text.infer_language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# Observations

@_query("st1_latest", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS observed_at FROM events GROUP BY user_id, event_type")
def st1(spark, d):
    return latest(fx.table(spark, d, "events"), ["user_id", "event_type"])


@_query("st1_fresh", "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS observed_at FROM events GROUP BY user_id, event_type) SELECT * FROM l WHERE observed_at + INTERVAL 12 HOUR > TIMESTAMP '2024-01-29 00:00:00'")
def st1_fresh(spark, d):
    return fresh(latest(fx.table(spark, d, "events"), ["user_id", "event_type"]), F.lit("2024-01-29 00:00:00").cast("timestamp"))


from . import addresses, links, markup, more, payloads, pricing, scanning, searching  # noqa: E402, F401  each registers its queries
