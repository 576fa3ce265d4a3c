"""Queries over evidence of scans: records of unlike shape, detections, matcher outputs, and candidates of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import scan
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query
from .searching import search_sql

# Records of several shapes as JSON, one for each card

_RECORDS = """rec AS (SELECT id, CASE id % 6
  WHEN 0 THEN '{"number":"' || local_id || '","name":"' || name || '","setCode":"' || set_id || '","language":"Japanese","score":' || (id % 90) || '}'
  WHEN 1 THEN '{"cardNumber":' || (id % 250) || ',"total":"200","cardName":" ' || name || ' ","set_id":"' || set_id || '","lang":"EN-us","score":"' || (id % 90) || ' %"}'
  WHEN 2 THEN '{"number":" ","collectorNumber":"' || local_id || '","printedTotal":99.50,"title":"' || name || '","expansion":"' || set_name || '","locale":"fr","score":true}'
  WHEN 3 THEN '{"number":null,"localId":"7","name":"  ","title":{"x":1},"set":["' || set_id || '"],"setName":"' || set_name || '","a":"1.5e1x","b":"x1","c":-2}'
  WHEN 4 THEN '[' || id || ']' ELSE '{"number":"1"' END AS json FROM catalogue)"""


def _records(spark, d):
    k, t = F.col("id"), F.col("id") % 6
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    s = lambda x: x.cast("string")
    n, st, sn, num = F.col("name"), F.col("set_id"), F.col("set_name"), F.col("local_id")
    text = F.when(t == 0, j('{"number":"', num, '","name":"', n, '","setCode":"', st, '","language":"Japanese","score":', s(k % 90), "}")).when(
        t == 1, j('{"cardNumber":', s(k % 250), ',"total":"200","cardName":" ', n, ' ","set_id":"', st, '","lang":"EN-us","score":"', s(k % 90), ' %"}')).when(
        t == 2, j('{"number":" ","collectorNumber":"', num, '","printedTotal":99.50,"title":"', n, '","expansion":"', sn, '","locale":"fr","score":true}')).when(
        t == 3, j('{"number":null,"localId":"7","name":"  ","title":{"x":1},"set":["', st, '"],"setName":"', sn, '","a":"1.5e1x","b":"x1","c":-2}')).when(t == 4, j("[", s(k), "]")).otherwise('{"number":"1"')
    return fx.catalogue(spark, d).select("id", text.alias("json"))


def _text_sql(j: str, *keys: str) -> str:
    """The first key with a text that is not blank, or a number."""
    one = "CASE json_type({j}, '$.{k}') WHEN 'VARCHAR' THEN nullif(trim(json_extract_string({j}, '$.{k}')), '') WHEN 'BIGINT' THEN json_extract_string({j}, '$.{k}') WHEN 'UBIGINT' THEN json_extract_string({j}, '$.{k}') WHEN 'DOUBLE' THEN CAST(CAST(json_extract_string({j}, '$.{k}') AS DOUBLE) AS VARCHAR) END"
    return "coalesce(" + ", ".join(one.format(j=j, k=k) for k in keys) + ")"


def _evidence_sql(j: str) -> str:
    number, total = _text_sql(j, "number", "cardNumber", "collectorNumber", "localId"), _text_sql(j, "printedTotal", "total")
    lang = f"lower({_text_sql(j, 'language', 'lang', 'locale')})"
    return f"""{_text_sql(j, 'name', 'cardName', 'title')} AS name, {_text_sql(j, 'setCode', 'set_id', 'setId')} AS set_code, {_text_sql(j, 'setName', 'set', 'expansion')} AS set_name,
 CASE WHEN {number} IS NOT NULL AND {total} IS NOT NULL THEN {number} || '/' || {total} ELSE {number} END AS card_number,
 CASE WHEN {lang} LIKE 'ja%' OR contains({lang}, 'japan') THEN 'ja' WHEN {lang} LIKE 'en%' THEN 'en' END AS language"""


_VALID = "v AS (SELECT id, CASE WHEN json_valid(json) THEN CASE WHEN json_type(json) = 'OBJECT' THEN CAST(json AS JSON) END END AS j FROM rec)"


@_query("p9_evidence", with_views(f", {_RECORDS}, {_VALID} SELECT id, {_evidence_sql('j')} FROM v", "catalogue"))
def p9(spark, d):
    return scan.read_evidence(_records(spark, d), "id", "json")


@_query("x29_numeric_entries", with_views(f""", {_RECORDS}, {_VALID}, k AS (SELECT id, j, unnest(json_keys(j)) AS key FROM v WHERE j IS NOT NULL), t AS (SELECT id, key, json_extract(j, '$.' || key) AS x FROM k),
n AS (SELECT id, key, CASE WHEN json_type(x) IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(CAST(x AS VARCHAR) AS DOUBLE) WHEN json_type(x) = 'VARCHAR' THEN TRY_CAST(regexp_extract(json_extract_string(x, '$'), '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE) END AS value FROM t)
SELECT * FROM n WHERE value IS NOT NULL""", "catalogue"))
def x29(spark, d):
    rows = _records(spark, d).select("id", records.numeric_record(F.try_parse_json("json")).alias("m"))
    return rows.select("id", F.explode("m").alias("key", "value"))


# Answers of a detector: lists and single items, cards in several places, identities as lists

def _answers(spark, d):
    k = F.col("id")
    json = F.col("json")
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    s = lambda x: x.cast("string")
    shape = k % 7
    text = F.when(shape == 0, j('{"items":[{"card":', json, '},{"match":', json, ',"confidence":', s(k % 100), "}]}")).when(
        shape == 1, j('[{"result":{"card":', json, '},"confidence":0.5},3,{"identity":[{"id":"a"},{"label":" "},{"label":"b","confidence":"70"},{"id":"c"}]}]')).when(
        shape == 2, j('{"identity":{"best":{"confidence":250,"match":', json, '},"card_identity":"i', s(k), '"}}')).when(
        shape == 3, j('{"data":{"card":', json, '},"match":{"name":"m","confidence":0.25}}')).when(shape == 4, j('{"items":[],"number":"', s(k), '"}')).when(shape == 5, "{}").otherwise("{")
    return _records(spark, d).where(k % 6 < 4).select("id", text.alias("json"))


_ANSWERS = """ans AS (SELECT id, CASE id % 7 WHEN 0 THEN '{"items":[{"card":' || json || '},{"match":' || json || ',"confidence":' || (id % 100) || '}]}'
  WHEN 1 THEN '[{"result":{"card":' || json || '},"confidence":0.5},3,{"identity":[{"id":"a"},{"label":" "},{"label":"b","confidence":"70"},{"id":"c"}]}]'
  WHEN 2 THEN '{"identity":{"best":{"confidence":250,"match":' || json || '},"card_identity":"i' || id || '"}}'
  WHEN 3 THEN '{"data":{"card":' || json || '},"match":{"name":"m","confidence":0.25}}' WHEN 4 THEN '{"items":[],"number":"' || id || '"}' WHEN 5 THEN '{}' ELSE '{' END AS a FROM rec WHERE id % 6 < 4)"""
_OBJECT = "CASE WHEN json_type({0}) = 'OBJECT' THEN {0} END"


def _first_sql(*paths: tuple[str, str]) -> str:
    return "coalesce(" + ", ".join(_OBJECT.format(f"json_extract({v}, '$.{p}')") for v, p in paths) + ")"


def _number_sql(j: str, key: str) -> str:
    x = f"json_extract({j}, '$.{key}')"
    return f"CASE WHEN json_type({x}) IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(CAST({x} AS VARCHAR) AS DOUBLE) WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST(regexp_extract(json_extract_string({x}, '$'), '^\\s*([+-]?[0-9]+[.]?[0-9]*)', 1) AS DOUBLE) END"


def _fraction_sql(x: str) -> str:
    return f"(SELECT CASE WHEN c IS NOT NULL THEN least(greatest(CASE WHEN c > 1 THEN c / 100 ELSE c END, 0), 1) END FROM (SELECT {x} AS c))"


@_query("t14_detections", with_views(f""", {_RECORDS}, {_ANSWERS}, ok AS (SELECT id, CASE WHEN json_valid(a) THEN CAST(a AS JSON) END AS a FROM ans),
it AS (SELECT id, unnest(CASE WHEN json_type(a, '$.items') = 'ARRAY' AND json_array_length(a, '$.items') > 0 THEN CAST(json_extract(a, '$.items') AS JSON[]) WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) ELSE [a] END) AS i,
  generate_subscripts(CASE WHEN json_type(a, '$.items') = 'ARRAY' AND json_array_length(a, '$.items') > 0 THEN CAST(json_extract(a, '$.items') AS JSON[]) WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) ELSE [a] END, 1) AS place FROM ok WHERE a IS NOT NULL),
ob AS (SELECT * FROM it WHERE json_type(i) = 'OBJECT'),
ro AS (SELECT *, coalesce({_first_sql(('i', 'card'), ('i', 'result.card'), ('i', 'data.card'))}, i) AS r FROM ob),
be AS (SELECT *, {_first_sql(('r', 'identity.best'), ('i', 'identity.best'), ('r', 'card.identity.best'))} AS b FROM ro),
ma AS (SELECT *, {_first_sql(('b', 'match'), ('r', 'match'), ('i', 'match'))} AS m FROM be),
co AS (SELECT *, coalesce({_fraction_sql('coalesce(' + _number_sql('b', 'confidence') + ', ' + _number_sql('m', 'confidence') + ', ' + _number_sql('r', 'confidence') + ')')}, 0.85::DOUBLE) AS c, coalesce(m, r) AS e FROM ma),
ev AS (SELECT id, place, 0 AS j, c AS confidence, {_evidence_sql('e')}, NULL::VARCHAR AS identity FROM co),
li AS (SELECT id, place, c, unnest(l[1:3]) AS x, generate_subscripts(l[1:3], 1) AS j FROM (SELECT *, list_filter(CASE json_type(i, '$.identity') WHEN 'ARRAY' THEN CAST(json_extract(i, '$.identity') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(i, '$.identity')] ELSE [] END, lambda y: json_type(y) = 'OBJECT') AS l FROM co)),
al AS (SELECT * FROM ev WHERE coalesce(name, set_code, set_name, card_number) IS NOT NULL UNION ALL
  SELECT id, place, j, coalesce({_fraction_sql('coalesce(' + _number_sql('x', 'card_identity_confidence') + ', ' + _number_sql('x', 'confidence') + ')')}, c), NULL, NULL, NULL, NULL, NULL, {_text_sql('x', 'card_identity', 'cardIdentity', 'id', 'label')} AS identity FROM li WHERE {_text_sql('x', 'card_identity', 'cardIdentity', 'id', 'label')} IS NOT NULL)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place, j) AS INT) AS place, confidence, name, set_code, set_name, card_number, language, identity FROM al""", "catalogue"))
def t14(spark, d):
    return scan.detections(_answers(spark, d), "id", "json").drop("source", "queries")


@_query("p8_matcher_candidates")
def p8(spark, d):
    k = F.col("id")
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    s = lambda x: x.cast("string")
    card = j('{"id":"c', s(k), '","name":"', F.col("name"), '","set_id":"', F.col("set_id"), '","local_id":"', F.col("local_id"), '"}')
    text = F.when(k % 2 == 0, j("log line\n[", '{"score":', s((k % 130) / 100), ',"card":', card, "},", '{"score":"0.5"}]')).otherwise(
        j('{"match_confidence":0.7,"recognized_fields":{"name":"', F.col("name"), '"},"candidates":[{"card":{"set_id":"', F.col("set_id"), '"},"evidence":{"a":1,"b":"2.5"}}]}'))
    return scan.matcher_candidates(fx.catalogue(spark, d).select("id", text.alias("output")).withColumnRenamed("id", "match_id"), "match_id", "output").withColumn("evidence", F.to_json("evidence"))


# Candidates for evidence: what is read of the cards whose id is divisible by 20, against all cards

def _extractions(spark, d):
    k, n = F.col("id"), F.floor(F.col("id") / 20)
    text = lambda m, x: F.when(n % m != 0, x)
    rows = fx.catalogue(spark, d).where(k % 20 == 0).select(
        k.alias("extraction_id"), F.when(n % 2 == 0, "gibltcg").otherwise("google-ocr").alias("source"), (0.5 + (n % 5) / 10.0).alias("confidence"), F.floor(n / 3).alias("scan_id"),
        text(3, F.col("name")).alias("name"), text(4, F.col("set_id")).alias("set_code"), F.when(n % 5 == 0, F.col("set_name")).alias("set_name"), text(2, F.split("local_id", "/")[0]).alias("number"))
    return rows.withColumn("queries", scan.evidence_queries(F.col("name"), F.col("set_code"), F.col("set_name"), F.col("number")))


_EXTRACTIONS = """ex AS (SELECT id AS extraction_id, id // 20 AS n, CASE WHEN id // 20 % 2 = 0 THEN 'gibltcg' ELSE 'google-ocr' END AS source, 0.5::DOUBLE + (id // 20 % 5) / 10.0::DOUBLE AS confidence, id // 20 // 3 AS scan_id,
  CASE WHEN id // 20 % 3 <> 0 THEN name END AS nm, CASE WHEN id // 20 % 4 <> 0 THEN set_id END AS sc, CASE WHEN id // 20 % 5 = 0 THEN set_name END AS sn, CASE WHEN id // 20 % 2 <> 0 THEN split_part(local_id, '/', 1) END AS nu FROM catalogue WHERE id % 20 = 0),
eq AS (SELECT *, list_filter([sc || ' ' || nu, nm || ' ' || sc || ' ' || nu, nm || ' ' || nu, nm, nu, nm || ' ' || sn || ' ' || nu, nm || ' ' || sn], lambda q: q IS NOT NULL AND len(trim(q)) >= 2) AS queries FROM ex),
qx AS (SELECT extraction_id, scan_id, source, confidence, unnest(queries) AS query, generate_subscripts(queries, 1) - 1 AS place FROM eq),
qs AS (SELECT DISTINCT query AS query_id, query FROM qx)"""
_RESOLVED = f""", {_EXTRACTIONS}, {search_sql('qs', 5)},
jn AS (SELECT qx.*, rk.id, rk.rank, rk.score AS search_score, confidence * 100 + rk.score - 4 * (rk.rank - 1) AS total,
  CASE WHEN source = 'gibltcg' AND rk.score >= 180 THEN least(greatest(confidence, 0.8::DOUBLE), 0.99::DOUBLE) ELSE least(greatest(confidence * 0.55::DOUBLE + least(greatest(rk.score / 420.0::DOUBLE, 0.1::DOUBLE), 0.85::DOUBLE) * 0.45::DOUBLE, 0.1::DOUBLE), 0.99::DOUBLE) END AS cc
  FROM qx JOIN rk ON rk.query_id = qx.query)"""


@_query("j8_search_candidates", with_views(f"{_RESOLVED} SELECT extraction_id, CAST(place AS INT) AS place, query, id, rank, search_score, total AS score, round(cc, 9) AS candidate_confidence FROM jn", "catalogue", "set_aliases"))
def j8(spark, d):
    found = scan.search_candidates(_extractions(spark, d), fx.catalogue(spark, d), fx.set_aliases(spark, d))
    return found.withColumn("candidate_confidence", F.round("candidate_confidence", 9))


@_query("c17_resolved", with_views(f"""{_RESOLVED}, b AS (SELECT * FROM jn QUALIFY row_number() OVER (PARTITION BY scan_id, id ORDER BY total DESC, place, rank, cc DESC, query DESC) = 1)
SELECT scan_id, id, total AS score, round(cc, 9) AS confidence, query, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY total DESC, id) AS INT) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY total DESC, id) <= 8""", "catalogue", "set_aliases"))
def c17(spark, d):
    found = scan.resolve(_extractions(spark, d), fx.catalogue(spark, d), fx.set_aliases(spark, d), by="scan_id")
    return found.withColumn("confidence", F.round("confidence", 9))
