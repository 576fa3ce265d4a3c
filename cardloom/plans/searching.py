"""Queries over searching, matching and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as s
from ..operators import rerank, search, similarity
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.scratch import kept
from .base import _query

# Keys

_TOKEN = "upper(trim(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '[’''`]', '', 'g'), '[^A-Za-z0-9/#.]+', ' ', 'g')))"
_ID = "regexp_replace(upper(regexp_replace(split_part(coalesce({0}, ''), '/', 1), '[^A-Za-z0-9]', '', 'g')), '^([A-Z]*?)0*([0-9]+)$', '\\1\\2')"
_DIGITS = "coalesce(CAST(TRY_CAST(regexp_extract({0}, '[0-9]{{1,4}}') AS INT) AS VARCHAR), '')"


@_query("x5_search_tokens", f"SELECT conv_id, turn, {_TOKEN.format('text')} AS token FROM conversations")
def x5(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", s.search_token(F.col("text")).alias("token"))


_NUMBERS = "p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'TG 0' || p_partkey % 90 || '/100' WHEN 1 THEN '00' || p_partkey % 99 || '/165' WHEN 2 THEN 'PROMO-' || p_partkey WHEN 3 THEN ' 84' ELSE 'ex' END AS n FROM part)"


def _numbers(spark, d):
    k = F.col("p_partkey")
    t = lambda x: x.cast("string")
    n = F.when(k % 5 == 0, F.concat(F.lit("TG 0"), t(k % 90), F.lit("/100"))).when(k % 5 == 1, F.concat(F.lit("00"), t(k % 99), F.lit("/165"))).when(k % 5 == 2, F.concat(F.lit("PROMO-"), t(k))).when(k % 5 == 3, " 84").otherwise("ex")
    return fx.table(spark, d, "part").select(k.alias("id"), n.alias("n"))


@_query("x6_collector_keys", f"WITH {_NUMBERS} SELECT id, {_ID.format('n')} AS number, {_DIGITS.format('n')} AS digits FROM p")
def x6(spark, d):
    return _numbers(spark, d).select("id", s.collector_id(F.col("n")).alias("number"), s.first_digits(F.col("n")).alias("digits"))


@_query("x7_slugs", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand || ' ' || p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def x7(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.slug(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))).alias("slug"))


@_query("p14_set_recency", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 300 + p_partkey % 12 WHEN 1 THEN 200 + p_partkey % 12 WHEN 2 THEN 100 + p_partkey % 12 WHEN 3 THEN p_partkey % 12 ELSE 0 END AS recency FROM part")
def p14(spark, d):
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, ("SV0", "swsh", "sm", "ex", "base"))), (k % 5 + 1).cast("int"))
    return fx.table(spark, d, "part").select(k.alias("id"), s.recency(F.lit(""), F.concat(prefix, (k % 12).cast("string"))).cast("bigint").alias("recency"))


@_query("f3_language_buckets", with_views(" SELECT language, language IN ('ja','ko','zh-tw','zh-cn') AS asian, language IN ('en','fr','de','es','it','pt') AS western, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 'zh-tw' WHEN id % 9 = 1 THEN 'ru' ELSE language END AS language FROM cards) GROUP BY ALL", "cards"))
def f3(spark, d):
    k = F.col("id")
    c = fx.cards(spark, d).select(F.when(k % 9 == 0, "zh-tw").when(k % 9 == 1, "ru").otherwise(F.col("language")).alias("language"))
    return c.groupBy("language", s.in_bucket(F.col("language"), "asian").alias("asian"), s.in_bucket(F.col("language"), "western").alias("western")).agg(F.count(F.lit(1)).alias("n"))


# Search: texts made of the cards whose id is divisible by 20, against all cards

_PREFIXES = "TG|GG|SWSH|SM|XY|BW|DP|HGSS|SVP|SV"


def parsed_sql(queries: str) -> str:
    """What texts of a view (query_id, query) ask for, stage by stage: pq holds one row per text."""
    number = f"((?:(?:{_PREFIXES})\\s*)?0*[0-9]{{1,4}}\\s*/\\s*(?:(?:{_PREFIXES})\\s*)?[0-9]{{1,4}})"
    return f"""tk AS (SELECT *, {_TOKEN.format('query')} AS text FROM {queries}),
tm AS (SELECT DISTINCT {_TOKEN.format('term')} AS term, grp FROM set_aliases),
h0 AS (SELECT query_id, grp, term, instr(' ' || text || ' ', ' ' || term || ' ') AS ord FROM tk JOIN tm ON contains(' ' || text || ' ', ' ' || term || ' ')),
h1 AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY len(term) DESC, ord, term) = 1),
hi AS (SELECT query_id, grp, term, row_number() OVER (PARTITION BY query_id ORDER BY len(term) DESC, ord, grp) AS place FROM h1),
ks AS (SELECT query_id, language, set_id, label, row_number() OVER (PARTITION BY query_id ORDER BY place, pos, language, set_id) AS ord FROM (
  SELECT query_id, language, set_id, label, place, pos FROM hi JOIN set_aliases USING (grp) QUALIFY row_number() OVER (PARTITION BY query_id, language, set_id ORDER BY place, pos) = 1)),
te AS (SELECT query_id, list(term ORDER BY place) AS terms FROM hi GROUP BY query_id),
rm AS (SELECT tk.*, coalesce(terms[1], '') AS set_token, trim(list_reduce(list_prepend(' ' || text || ' ', coalesce(terms, [])), lambda x, t: CASE WHEN instr(x, ' ' || t || ' ') = 0 THEN x
  ELSE x[1:instr(x, ' ' || t || ' ')] || x[instr(x, ' ' || t || ' ') + len(t) + 2:] END)) AS left_text FROM tk LEFT JOIN te USING (query_id)),
nu AS (SELECT *, coalesce(nullif(regexp_extract(left_text, '\\b{number}\\b', 1), ''), nullif(regexp_extract(left_text, '\\b((?:{_PREFIXES})\\s*0*[0-9]{{1,4}})\\b', 1), ''),
  (list_filter(regexp_extract_all(left_text, '\\b([0-9]{{1,4}})\\b', 1), lambda n: CAST(n AS INT) NOT BETWEEN 1900 AND 2099))[-1], '') AS raw FROM rm),
re AS (SELECT *, CASE WHEN raw = '' THEN left_text ELSE concat_ws(' ', left_text[1:instr(left_text, raw) - 1], left_text[instr(left_text, raw) + len(raw):]) END AS rest FROM nu),
p0 AS (SELECT query_id, query, text, set_token, {_ID.format('raw')} AS number, list_filter(string_split_regex(rest, '\\s+'), lambda t: regexp_matches(t, '[A-Z]') AND t NOT IN ('NO','CARD','NUMBER','NUM')) AS tokens FROM re),
pq AS (SELECT *, {_DIGITS.format('number')} AS digits, array_to_string(tokens, ' ') AS cleaned, coalesce((SELECT arg_min(set_id, ord) FROM ks WHERE ks.query_id = p0.query_id AND ends_with(set_token, {_TOKEN.format('set_id')})), '') AS preferred_set,
  coalesce((SELECT count(*) FROM ks WHERE ks.query_id = p0.query_id), 0) AS n_sets FROM p0),
kc AS (SELECT *, {_TOKEN.format('name')} AS name_key, {_TOKEN.format('set_name')} AS set_key, {_ID.format('local_id')} AS number_key, {_DIGITS.format('local_id')} AS digits_key FROM catalogue)"""


_SAME = "(number = number_key OR (digits <> '' AND digits = digits_key))"
_ANY = "len(list_filter(tokens, lambda t: contains(name_key, t))) > 0"


def wanted_sql(preferred: str | None = None) -> str:
    """Sets in which a number is looked up; the preferred language, if any, is an Asian one here."""
    more = f"UNION ALL SELECT query_id, '{preferred}', set_id, ord + 1000000 FROM ks WHERE language IN ('ja','ko','zh-tw','zh-cn') AND language <> '{preferred}'" if preferred else ""
    value = f"CASE WHEN language = '{preferred}' THEN 3 WHEN language IN ('ja','ko','zh-tw','zh-cn') THEN 2 WHEN language = 'en' THEN 1 ELSE 0 END" if preferred else "CASE WHEN language = 'en' THEN 1 ELSE 0 END"
    return f"""w0 AS (SELECT query_id, language, set_id, min(ord) AS ord FROM (SELECT query_id, language, set_id, ord FROM ks {more}) GROUP BY ALL),
ws AS (SELECT query_id, number, digits, tokens, language, set_id, row_number() OVER (PARTITION BY query_id ORDER BY {value} DESC, ord) AS ord FROM w0 JOIN pq USING (query_id) WHERE number <> ''),
d0 AS (SELECT query_id, ws.ord, c.id, len(tokens) AS n FROM ws JOIN kc c USING (set_id, language) WHERE split_part(local_id, '/', 1) IN (number, CASE WHEN regexp_full_match(number, '[0-9]+') THEN lpad(number, CAST(greatest(2, len(number)) AS INT), '0') END, CASE WHEN regexp_full_match(number, '[0-9]+') THEN lpad(number, CAST(greatest(3, len(number)) AS INT), '0') END)),
di AS (SELECT DISTINCT query_id, id FROM d0 WHERE n > 0 OR ord = (SELECT min(ord) FROM d0 x WHERE x.query_id = d0.query_id)),
es AS (SELECT DISTINCT query_id, id FROM ws JOIN kc USING (set_id, language) WHERE {_SAME})"""


def search_sql(queries: str, top: int, preferred: str | None = None) -> str:
    """All texts against all cards by the rules; ``rk`` holds the best of each text."""
    language = f"CASE WHEN language = '{preferred}' THEN 46 WHEN language IN ('ja','ko','zh-tw','zh-cn') THEN 24 WHEN language = 'en' AND preferred_set = '' THEN 6 ELSE 0 END" if preferred else "CASE WHEN language = 'en' AND preferred_set = '' THEN 6 ELSE 0 END"
    return f"""{parsed_sql(f'(SELECT * FROM {queries} WHERE len(trim(query)) >= 2)')}, {wanted_sql(preferred)},
s0 AS (SELECT query_id, id, 0 AS stage FROM di JOIN pq USING (query_id) WHERE len(tokens) = 0 OR regexp_matches(number, '[A-Z]')),
s1 AS (SELECT query_id, id, 1 AS stage FROM (SELECT * FROM di UNION SELECT * FROM es) WHERE query_id NOT IN (SELECT query_id FROM s0)),
nr AS (SELECT * FROM (SELECT query_id, id, stage, name_key, set_key, number_key FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) JOIN kc USING (id)) QUALIFY row_number() OVER (PARTITION BY query_id, name_key, set_key, number_key ORDER BY id) = 1),
oc AS (SELECT * FROM kc QUALIFY row_number() OVER (PARTITION BY name_key, set_key, number_key ORDER BY id) = 1),
s3 AS (SELECT query_id, id, 3 AS stage FROM pq JOIN oc ON (number <> '' AND {_SAME}) OR contains(name_key, CASE WHEN len(coalesce(tokens[1], '')) >= 2 THEN tokens[1] WHEN len(cleaned) >= 2 THEN cleaned ELSE text END) WHERE query_id NOT IN (SELECT query_id FROM nr)),
st AS (SELECT query_id, id, stage FROM nr UNION ALL SELECT * FROM s3),
sc AS (SELECT st.query_id, st.id, stage, CASE WHEN number = '' THEN 0 WHEN number = number_key THEN 180 WHEN digits = digits_key THEN 80 ELSE 0 END
   + CASE WHEN EXISTS (SELECT 1 FROM ks WHERE ks.query_id = st.query_id AND (ks.set_id = kc.set_id OR contains(set_key, {_TOKEN.format('ks.label')}))) THEN 140 ELSE 0 END + CASE WHEN preferred_set <> '' AND preferred_set = kc.set_id THEN 28 ELSE 0 END
   + coalesce(list_sum(list_transform(tokens, lambda t: CASE WHEN contains(name_key, t) THEN 38 ELSE -22 END)), 0) + CASE WHEN len(tokens) > 0 AND contains(name_key, cleaned) THEN 45 ELSE 0 END
   + {language} + CASE source WHEN 'tcgtracking' THEN 4 WHEN 'pokemontcg' THEN 10 ELSE 0 END AS score
 FROM st JOIN pq USING (query_id) JOIN kc USING (id)),
rk AS (SELECT query_id, id, stage, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM sc QUALIFY rank <= {top})"""


_VIEWS = ("catalogue", "searches", "set_aliases")
_PARSED = f", {parsed_sql('searches')}"


def _parsed(spark, d):
    return search.parsed_queries(fx.searches(spark, d), fx.set_aliases(spark, d))


def _keyed(spark, d):
    return search.keyed_cards(fx.catalogue(spark, d)).withColumn("card_key", F.concat_ws("-", "set_id", F.split("local_id", "/")[0]))


@_query("c5_parsed_queries", with_views(_PARSED + " SELECT query_id, query, number, cleaned, set_token, preferred_set, n_sets FROM pq", *_VIEWS))
def c5(spark, d):
    return _parsed(spark, d).select("query_id", "query", "number", "cleaned", "set_token", "preferred_set", F.size("sets").cast("bigint").alias("n_sets"))


@_query("j12_alias_hits", with_views(_PARSED + " SELECT query_id, term, grp, CAST(place AS INT) AS place FROM hi", *_VIEWS))
def j12(spark, d):
    return search.set_hits(fx.searches(spark, d), fx.set_aliases(spark, d))


@_query("x22_wanted_sets", with_views(f"{_PARSED}, {wanted_sql('ja')} SELECT query_id, language, set_id, CAST(ord AS INT) AS place FROM ws", *_VIEWS))
def x22(spark, d):
    return search.wanted_sets(_parsed(spark, d), "ja", "asian").select("query_id", "language", "set_id", F.col("at").alias("place"))


@_query("j4_exact_set", with_views(f"{_PARSED}, {wanted_sql()} SELECT * FROM es", *_VIEWS))
def j4(spark, d):
    return search.exact_set(search.wanted_sets(_parsed(spark, d)), _keyed(spark, d))


@_query("j5_direct_ids", with_views(f"{_PARSED}, {wanted_sql()} SELECT * FROM di", *_VIEWS))
def j5(spark, d):
    return search.direct_cards(search.wanted_sets(_parsed(spark, d)), _keyed(spark, d))


@_query("f11_collector_only", with_views(_PARSED + " SELECT query_id, number FROM pq WHERE number <> '' AND len(tokens) = 0 AND n_sets = 0", *_VIEWS))
def f11(spark, d):
    return search.is_number_only(_parsed(spark, d)).select("query_id", "number")


@_query("f8_product_matches", with_views(f"{_PARSED} SELECT query_id, id FROM pq JOIN kc ON CASE WHEN number = '' THEN {_ANY} ELSE {_SAME} AND (len(tokens) = 0 OR {_ANY}) END", *_VIEWS))
def f8(spark, d):
    return search.product_matches(_parsed(spark, d), _keyed(spark, d))


@_query("j9_in_known_set", with_views(f"{_PARSED} SELECT query_id, id, set_id FROM pq JOIN kc ON number <> '' AND {_SAME} WHERE EXISTS (SELECT 1 FROM ks WHERE ks.query_id = pq.query_id AND (ks.set_id = kc.set_id OR contains(set_key, {_TOKEN.format('ks.label')})))", *_VIEWS))
def j9(spark, d):
    pairs = search.same_number_pairs(_parsed(spark, d), _keyed(spark, d))
    return pairs.where(search.in_known_set(F.col("sets"), F.col("set_id"), F.col("set_key"))).select("query_id", "id", "set_id")


def _search(spark, d, top=20):
    return search.search(fx.searches(spark, d), _keyed(spark, d).select("id", "name", "set_id", "set_name", "local_id", "language", "source", "card_key"), fx.set_aliases(spark, d), top, preferred="ja", bucket="asian")


@_query("c7_search", with_views(f", {search_sql('searches', 20, 'ja')} SELECT * FROM rk", *_VIEWS))
def c7(spark, d):
    return _search(spark, d)


@_query("w3_position_penalty", with_views(f", {search_sql('searches', 5, 'ja')} SELECT query_id, id, rank, CAST(score - 4 * (rank - 1) AS DOUBLE) AS score FROM rk", *_VIEWS))
def w3(spark, d):
    return rerank.position_penalty(_search(spark, d, 5)).select("query_id", "id", "rank", F.col("score").cast("double").alias("score"))


@_query("a13_dedupe_by_key", with_views(f""", x AS (SELECT id, upper(name) || CASE WHEN id % 2 = 0 THEN '!' ELSE '' END AS name, set_id, CASE WHEN id % 3 = 0 THEN '0' || local_id ELSE local_id END AS local_id, CASE WHEN id % 2 = 0 THEN id END AS p1, CASE WHEN id % 5 = 0 THEN id END AS p2,
  CASE WHEN id % 7 = 0 THEN id END AS p3, CASE WHEN id % 11 = 0 THEN id END AS p4, CASE WHEN id % 13 = 0 THEN id END AS p5 FROM cards)
SELECT min(id) AS id, arg_min(name, id) AS name, arg_min(set_id, id) AS set_id, arg_min(local_id, id) AS local_id, min(p1) AS p1, min(p2) AS p2, min(p3) AS p3, min(p4) AS p4, min(p5) AS p5 FROM x GROUP BY {_TOKEN.format('name')}, {_TOKEN.format('set_id')}, {_ID.format('local_id')}""", "cards"))
def a13(spark, d):
    k = F.col("id")
    ids = {f"p{i + 1}": m for i, m in enumerate((2, 5, 7, 11, 13))}
    x = fx.cards(spark, d).select(
        "id", F.concat(F.upper("name"), F.when(k % 2 == 0, "!").otherwise("")).alias("name"), "set_id",
        F.when(k % 3 == 0, F.concat(F.lit("0"), F.col("local_id"))).otherwise(F.col("local_id")).alias("local_id"), *(F.when(k % m == 0, k).alias(c) for c, m in ids.items()))
    return search.dedupe_results(x, "id", list(ids))


# Cards in another language: Japanese cards of a set against the English ones of the set that follows it by name

_DETAILS = """br AS (SELECT p_brand AS set_id, lead(p_brand) OVER (ORDER BY p_brand) AS other_set FROM (SELECT DISTINCT p_brand FROM part)),
de AS (SELECT id, set_id, local_id, language, CASE WHEN id % 13 <> 0 THEN {'illustrator': CASE WHEN id % 5 <> 1 OR id % 3 = 0 THEN 'a' || (id % 3) ELSE '' END, 'hp': id % 4 * 10, 'stage': 's' || (id % 2), 'types': CASE id % 3 WHEN 0 THEN ['x'] WHEN 1 THEN ['x', 'y'] ELSE [] END, 'sig': CASE WHEN id % 4 = 0 THEN '' ELSE 'cc' || (id % 4) || ':' || (id % 5) || '|:' END} END AS detail FROM catalogue),
kd AS (SELECT *, regexp_replace(upper(regexp_replace(split_part(local_id, '/', 1), '[^A-Za-z0-9]', '', 'g')), '^([A-Z]*?)0*([0-9]+)$', '\\1\\2') AS key FROM de),
np AS (SELECT a.id, b.id AS other_id, a.key = b.key AS same, coalesce(abs(TRY_CAST(a.key AS INT) - TRY_CAST(b.key AS INT)), 0) AS distance, coalesce(2 * abs(TRY_CAST(a.key AS INT) - TRY_CAST(b.key AS INT)) + CASE WHEN TRY_CAST(b.key AS INT) > TRY_CAST(a.key AS INT) THEN 1 ELSE 0 END, 0) AS place, a.detail AS d, b.detail AS o
  FROM kd a JOIN br USING (set_id) JOIN kd b ON b.set_id = br.other_set AND a.language = 'ja' AND b.language = 'en' AND (CASE WHEN TRY_CAST(a.key AS INT) IS NULL THEN a.key = b.key ELSE TRY_CAST(b.key AS INT) > 0 AND abs(TRY_CAST(a.key AS INT) - TRY_CAST(b.key AS INT)) <= 10 END))"""


def _details(spark, d):
    k = F.col("id")
    t = lambda x: x.cast("string")
    attack = lambda cost, damage: F.struct(cost.alias("cost"), damage.alias("damage"))
    none = F.lit(None).cast("string")
    attacks = F.when(k % 4 == 0, F.array().cast("array<struct<cost:array<string>,damage:string>>")).otherwise(F.array(attack(F.array(F.lit("c"), F.concat(F.lit("c"), t(k % 4))), t(k % 5)), attack(F.array().cast("array<string>"), none)))
    detail = F.struct(
        F.when((k % 5 != 1) | (k % 3 == 0), F.concat(F.lit("a"), t(k % 3))).otherwise("").alias("illustrator"), (k % 4 * 10).alias("hp"), F.concat(F.lit("s"), t(k % 2)).alias("stage"),
        F.when(k % 3 == 0, F.array(F.lit("x"))).when(k % 3 == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("types"), attacks.alias("attacks"))
    return fx.catalogue(spark, d).select("id", "set_id", "local_id", "language", F.when(k % 13 != 0, detail).alias("detail"))


def _language_pairs(spark, d):
    from pyspark.sql import Window

    c = _details(spark, d)
    brands = fx.table(spark, d, "part").select(F.col("p_brand").alias("set_id")).distinct()  # as many rows as there are sets
    sets = brands.withColumn("other_set", F.lead("set_id").over(Window.orderBy("set_id"))).where("other_set is not null")
    return c.where("language = 'ja'").drop("language"), c.where("language = 'en'").drop("language"), sets


@_query("j7_band_equivalents", with_views(f", {_DETAILS} SELECT id AS source_id, other_id, CAST(distance AS INT) AS distance, CAST(place AS INT) AS place FROM np", "catalogue"))
def j7(spark, d):
    return search.near_numbers(*_language_pairs(spark, d)).select(F.col("id").alias("source_id"), "other_id", "distance", "place")


@_query("c19_equivalents", with_views(f"""{", "}{_DETAILS}, sc AS (SELECT *, CASE WHEN d IS NOT NULL THEN CASE WHEN same THEN 8 ELSE 0 END + CASE WHEN d.illustrator <> '' AND d.illustrator = o.illustrator THEN 70 ELSE 0 END + CASE WHEN d.hp <> 0 AND d.hp = o.hp THEN 20 ELSE 0 END
  + CASE WHEN d.stage = o.stage THEN 12 ELSE 0 END + CASE WHEN len(d.types) > 0 AND d.types = o.types THEN 18 ELSE 0 END + CASE WHEN d.sig <> '' AND d.sig = o.sig THEN 30 ELSE 0 END END AS score FROM np),
f AS (SELECT * FROM sc WHERE score >= 70 OR (score IS NULL AND same) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, place, other_id) = 1) SELECT id AS source_id, other_id, score FROM f""", "catalogue"))
def c19(spark, d):
    return search.equivalents(*_language_pairs(spark, d))


@_query("j13_resolve_external", with_views(""", m AS (SELECT count(*) AS n FROM cards), h AS (SELECT o_orderkey AS ask, CAST(o_orderkey * 7 % n AS VARCHAR) AS external, place, (o_orderkey * f + place) % n AS id FROM orders, m, (VALUES (0, 3), (1, 7), (2, 13)) t(place, f)),
k AS (SELECT *, CAST(external IN (CAST(id * 2 AS VARCHAR), CAST(id AS VARCHAR), CAST(id - 1 AS VARCHAR)) AS BOOLEAN) AS exact FROM h)
SELECT ask, id, place, exact FROM k QUALIFY row_number() OVER (PARTITION BY ask ORDER BY exact DESC, place) = 1""", "cards"))
def j13(spark, d):
    n = fx.cards(spark, d).count()
    hits = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("ask"), (F.col("o_orderkey") * 7 % n).cast("string").alias("external"), F.inline(F.array(*(
        F.struct(F.lit(i).alias("place"), ((F.col("o_orderkey") * f + i) % n).alias("id")) for i, f in enumerate((3, 7, 13))))))
    keyed = hits.withColumns({"a": F.col("id") * 2, "b": F.col("id"), "c": F.col("id") - 1})
    return search.first_exact(keyed, "ask", "external", ["a", "b", "c"], "place").select("ask", "id", "place", "exact")


_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS place FROM pages),
c AS (SELECT page_id, regexp_replace(raw, '[?#].*$', '') AS link, min(place) AS place FROM l GROUP BY ALL)"""


@_query("k7_best_links", f"""WITH {_LINKS}, x AS (SELECT *, 5 * CAST(contains(upper(link), 'TH') AS INT) + 2 * CAST(contains(upper(link), 'A') AS INT) + 8 * CAST(contains(upper(link), 'RE') AS INT) AS score FROM c WHERE link <> '')
SELECT page_id, arg_max(link, (score, -place)) AS link, max(score) AS score FROM x WHERE score >= 2 GROUP BY page_id""")
def k7(spark, d):
    from ..operators.catalog import page_links

    has = lambda t, n: F.when(F.contains(F.upper("link"), F.lit(t)), n).otherwise(0)
    return search.best_link(page_links(fx.table(spark, d, "pages")), has("TH", 5) + has("A", 2) + has("RE", 8), 2)


# Matching: vectors whose id is divisible by 20 against all others, as in K1

def _hash_views():
    from .registry import _TOP, _centered, _hist

    return _TOP + f""", h AS (SELECT vec_id, card_id, {_hist('vector')} AS h, list_reduce(list_transform(vector, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS bits FROM vectors),
cc AS (SELECT *, {_centered('h')} AS c FROM h),
co AS (SELECT q.vec_id AS query_id, r.card_id, max(round(0.72::DOUBLE * greatest(0, 1 - bit_count(xor(q.bits, r.bits)) / 64.0::DOUBLE)
    + (1 - 0.72::DOUBLE) * least(greatest((list_inner_product(q.c, r.c) / sqrt(list_inner_product(q.c, q.c) * list_inner_product(r.c, r.c)) + 1) / 2, 0), 1), 6)) AS score
  FROM cc q JOIN cc r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id GROUP BY ALL),
si AS (SELECT query_id, card_id, round(least(greatest((score + 1) / 2, 0), 1), 7) AS similarity FROM s),
mi AS (SELECT co.query_id, co.card_id, similarity, round(co.score * (1 - 0.52::DOUBLE) + similarity * 0.52::DOUBLE, 6) AS coarse, round((co.score * (1 - 0.52::DOUBLE) + similarity * 0.52::DOUBLE), 17) AS c0 FROM co JOIN si USING (query_id, card_id)),
fi AS (SELECT *, round(coarse * 0.62::DOUBLE * (1 - 0.52::DOUBLE) + similarity * 0.52::DOUBLE, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, card_id) AS k FROM mi),
vm AS (SELECT query_id, card_id, coarse, similarity, final AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, card_id) AS INT) AS rank FROM fi WHERE k <= 80)"""


def _visual(spark, d, top=10):
    from .registry import _prints

    h = _prints(spark, d)
    return rerank.visual_match(similarity.visual_candidates(h.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), h), top=top)


def _register_matching():
    views = _hash_views()

    @_query("c1_visual_match", with_views(views + " SELECT * FROM vm WHERE rank <= 10", "vectors"))
    def c1(spark, d):
        return _visual(spark, d)

    @_query("k2_coarse_to_fine", with_views(views + " SELECT query_id, card_id, score AS fine, rank FROM vm WHERE rank <= 5", "vectors"))
    def k2(spark, d):
        return _visual(spark, d, 5).select("query_id", "card_id", F.col("score").alias("fine"), "rank")

    @_query("k2_coarse_to_fine_whole", with_views(views + " SELECT query_id, card_id, score AS fine, rank FROM vm WHERE rank <= 10", "vectors"))
    def k2_whole(spark, d):
        return _visual(spark, d, 10).select("query_id", "card_id", F.col("score").alias("fine"), "rank")

    @_query("j3_attach_cards", with_views(views + " SELECT query_id, card_id, rank, name, set_id FROM vm JOIN cards ON cards.id = card_id WHERE rank <= 10", "vectors", "cards"))
    def j3(spark, d):
        return rerank.attach_cards(_visual(spark, d), fx.cards(spark, d)).select("query_id", "card_id", "rank", "name", "set_id")

    @_query("c4_evaluation", with_views(views + """, e AS (SELECT q.query_id, min(t.rank) AS rank FROM q LEFT JOIN (SELECT DISTINCT label, card_id FROM r) l ON l.label = q.label
      LEFT JOIN vm t ON t.query_id = q.query_id AND t.card_id = l.card_id AND t.rank <= 20 GROUP BY q.query_id)
    SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS topn,
     round(avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top20, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM e""", "vectors"))
    def c4(spark, d):
        from .registry import _sides

        q, r = _sides(spark, d)
        labels = q.select("query_id", "label").join(r.select("label", "card_id").distinct(), "label").select("query_id", "card_id")
        return similarity.retrieval_metrics(similarity.expected_rank(_visual(spark, d, 20), labels), 5)

    reads = """, ev AS (SELECT DISTINCT vm.query_id, CASE vm.query_id % 4 WHEN 0 THEN '' WHEN 1 THEN c.name WHEN 2 THEN 'rare ' || upper(c.name) ELSE NULL END AS read_name, CASE vm.query_id % 3 WHEN 0 THEN c.local_id WHEN 1 THEN '' ELSE c.local_id[1:3] || '/999' END AS read_number,
      0.7::DOUBLE + (vm.query_id % 4) / 10.0::DOUBLE AS number_confidence, CASE WHEN vm.query_id % 5 = 0 THEN '' ELSE c.language || '-XX' END AS read_language FROM vm JOIN cards c ON c.id = card_id WHERE rank = 1),
    tx AS (SELECT vm.*, name, local_id, language, coalesce(read_name, '') AS rn, coalesce(read_number, '') AS rd, coalesce(read_language, '') AS rl, number_confidence FROM vm JOIN cards ON cards.id = card_id LEFT JOIN ev USING (query_id) WHERE rank <= 10),
    sc AS (SELECT *, round(least(greatest(CASE WHEN similarity <> 0 THEN similarity ELSE score END, 0), 1), 5) AS v, CASE WHEN rn = '' THEN 0 WHEN lower(rn) = lower(name) THEN 1 WHEN contains(lower(rn), lower(name)) OR contains(lower(name), lower(rn)) THEN 0.88::DOUBLE END AS n,
      CASE WHEN rd = '' THEN 0 WHEN rd = local_id THEN 1 WHEN split_part(rd, '/', 1) = split_part(local_id, '/', 1) THEN 0.78::DOUBLE ELSE 0 END AS c, CASE WHEN rl <> '' AND split_part(lower(rl), '-', 1) = lower(language) THEN 1 ELSE 0 END AS l FROM tx)"""

    @_query("x9_number_and_language_scores", with_views(views + reads + " SELECT query_id, card_id, CAST(c AS DOUBLE) AS number_score, CAST(l AS DOUBLE) AS language_score FROM sc", "vectors", "cards"))
    def x9(spark, d):
        return rerank.shown(_reranked(spark, d, 10)).select("query_id", "card_id", "number_score", "language_score")

    @_query("c2_text_rerank")
    def c2(spark, d):
        return rerank.shown(_reranked(spark, d)).select("query_id", "card_id", "visual_score", "name_score", "number_score", "language_score", "confidence", "rank")

    @_query("p7_recognized_fields", with_views(views + reads + """ SELECT query_id, coalesce(nullif(read_name, ''), name) AS name, coalesce(nullif(read_number, ''), local_id) AS collector_number, set_id, set_id || ' Series' AS set_name,
      lower(variant) AS variant_class, coalesce(nullif(read_language, ''), language) AS language FROM vm JOIN cards ON cards.id = card_id LEFT JOIN ev USING (query_id) WHERE rank = 1""", "vectors", "cards"))
    def p7(spark, d):
        return rerank.recognized_fields(_best_read(spark, d, kept(_visual(spark, d), "matches")).withColumn("set_name", F.concat("set_id", F.lit(" Series"))))

    @_query("p6_recognition_candidates")
    def p6(spark, d):
        return rerank.recognition_candidates(_reranked(spark, d), fx.cards(spark, d))

    @_query("c3_recognition")
    def c3(spark, d):
        return rerank.recognition(_reranked(spark, d))


def _best_read(spark, d, seen):
    """The best visual match of each query with its card and what was read."""
    best = seen.where("rank = 1").join(fx.cards(spark, d).withColumnRenamed("id", "card_id"), "card_id")
    k = F.col("query_id")
    return best.withColumns({
        "read_name": F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("name")).when(k % 4 == 2, F.concat(F.lit("rare "), F.upper("name"))),
        "read_number": F.when(k % 3 == 0, F.col("local_id")).when(k % 3 == 1, "").otherwise(F.concat(F.substring("local_id", 1, 3), F.lit("/999"))),
        "number_confidence": 0.7 + (k % 4) / 10.0, "read_attack": F.lit(""), "read_language": F.when(k % 5 == 0, "").otherwise(F.concat("language", F.lit("-XX")))})


def _reranked(spark, d, top=8):
    seen = kept(_visual(spark, d), "matches")
    matches = seen.drop("rank").join(fx.cards(spark, d).select(F.col("id").alias("card_id"), "name", "local_id", "language"), "card_id")
    evidence = _best_read(spark, d, seen).select("query_id", "read_name", "read_number", "number_confidence", "read_attack", "read_language")
    return rerank.rerank(matches, evidence, top)


_register_matching()
