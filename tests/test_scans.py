"""Records, detections and matcher outputs of odd shapes, and candidates for evidence."""

import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions import records
from cardloom.operators import scan


def read(spark, texts, f, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, j string")
    return f(df, "k", "j").select("k", *columns).collect()


def test_lenient_json(spark):
    texts = ['{"a":1}', 'note {"a":1} end', "x [1,2] {", "log } {", None, "", '[{"a":1}', 'a {"b":[1]} ] tail']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(records.lenient_json(F.col("t"))).alias("x"))
    assert [r.x for r in df.collect()] == ['{"a":1}', '{"a":1}', "[1,2]", None, None, None, None, '{"b":[1]}']


def test_evidence_of_odd_records(spark):
    texts = ['{"name":" ","cardName":5,"number":0,"total":1.5,"set":{"a":1},"expansion":"E","lang":"Japan"}', "[1]", "null", "{", None, '{"language":"fr"}', '{"total":"9"}', '{"name":true,"title":"T","number":"007"}']
    got = [tuple(r)[1:] for r in read(spark, texts, scan.read_evidence, "name", "set_code", "set_name", "card_number", "language")]
    none = (None,) * 5
    assert got == [("5", None, "E", "0/1.5", "ja"), none, none, none, none, none, none, ("T", None, None, "007", None)]


def test_numeric_entries(spark):
    df = spark.createDataFrame([('{"a":1,"b":"2.5x","c":"x","d":true,"e":null,"f":[1],"g":"-.5e1","h k":" 7"}',), (None,), ("[1]",)], "j string")
    got = [r.m for r in df.select(records.numeric_record(F.try_parse_json("j")).alias("m")).collect()]
    assert got == [{"a": 1.0, "b": 2.5, "g": -5.0, "h k": 7.0}, {}, {}]


def test_detections(spark):
    card = {"name": "Mew", "number": "5", "setCode": "SIT"}
    texts = [
        json.dumps({"items": [{"card": card | {"confidence": 88}, "confidence": 1}, {"identity": [{"id": "a", "confidence": 0.5}, {"x": 1}, {"label": "b"}, {"id": "c"}]}]}),
        json.dumps({"identity": {"best": {"match": card, "confidence": "0.4"}, "id": "z"}, "card": {"name": "other"}}), json.dumps([1, "x", None]), "{", None, "{}", json.dumps({"card": {"number": 7}}),
    ]
    got = [tuple(r) for r in read(spark, texts, scan.detections, "place", "confidence", "name", "card_number", "queries", "identity")]
    queries = ["SIT 5", "Mew SIT 5", "Mew 5", "Mew"]
    assert got == [
        (0, 1, 0.88, "Mew", "5", queries, None), (0, 2, 0.5, None, None, [], "a"), (0, 3, 0.85, None, None, [], "b"),
        (1, 1, 0.4, "Mew", "5", queries, None), (1, 2, 0.4, None, None, [], "z"), (6, 1, 0.85, None, "7", [], None)]


def test_queries_of_evidence(spark):
    rows = [("Mew", "SIT", "Silver SV8a", "5/10"), (None, None, None, None), (" ", "", "x", "7"), ("N", None, "Set", None)]
    df = spark.createDataFrame(rows, "n string, c string, s string, k string")
    got = [r.q for r in df.select(scan.evidence_queries(*map(F.col, "ncsk")).alias("q")).collect()]
    assert got == [["SIT 5/10", "SV8a 5/10", "Mew SIT 5/10", "Mew SV8a 5/10", "Mew 5/10", "Mew", "5/10", "Mew Silver SV8a 5/10"], [], [], ["N Set"]]


def test_matcher_outputs(spark):
    v1 = [{"card": {"id": "a", "name": "Mew", "set_id": "s", "local_id": "1", "language": "en"}, "score": 1.5}, {"card": None, "score": "x"}, 7]
    v2 = {"canonical_print_uid": "u", "match_confidence": 0.6, "recognized_fields": {"collector_number": "9", "set_name": "S"}, "candidates": [{"card": {"tcgDexSetId": "t"}, "evidence": {"v": 0.5, "w": "1x", "z": []}}, {"score": 0.3, "canonical_print_uid": "p"}]}
    texts = ["info\n" + json.dumps(v1) + "\n", json.dumps(v2), "nothing", None, "5", '{"candidates": 3}']
    got = [tuple(r) for r in read(spark, texts, scan.matcher_candidates, "place", "id", "name", "set_id", "set_name", "local_id", "language", "confidence", "query", "print_uid", "evidence")]
    assert got == [
        (0, 0, "a", "Mew", "s", "", "1", "en", 0.99, "s 1 Mew", "a", {}), (0, 1, "-", "", "", "", "", "ja", 0.1, "", None, {}),
        (1, 0, "u", "", "t", "S", "9", "ja", 0.6, "t 9", "u", {"v": 0.5, "w": 1.0}), (1, 1, "p", "", "", "S", "9", "ja", 0.3, "9", "p", {})]


def test_candidates_of_several_texts(spark):
    cards = spark.createDataFrame([(1, "Mew", "sit", "5/10", "en"), (2, "Mewtwo", "sit", "6/10", "en"), (3, "Abra", "sv1", "5/10", "ja")], "id long, name string, set_id string, local_id string, language string")
    aliases = spark.createDataFrame([("sit", "SIT", 0, "en", "sit", "SIT")], "grp string, term string, pos int, language string, set_id string, label string")
    rows = [(1, "gibltcg", 0.5, ["SIT 5", "Mew"], 7), (2, "other", 0.9, ["Mew 5", "Mew 5"], 7), (3, "other", 0.9, [], 8), (4, "other", 0.9, None, 9)]
    ex = spark.createDataFrame(rows, "extraction_id int, source string, confidence double, queries array<string>, scan int")
    got = [tuple(r) for r in scan.resolve(ex, cards, aliases, by="scan").orderBy("rank").select("scan", "id", "score", "query", "rank").collect()]
    # SIT 5: 180 + 140, and the language's 6 only where no set is preferred; Mew 5: 180 + 38 + 45 + 6
    assert got == [(7, 1, 50 + 180 + 140 + 28, "SIT 5", 1), (7, 3, 90 + 180 - 22 - 4, "Mew 5", 2), (7, 2, 90 + 38 + 45 + 6 - 8, "Mew 5", 3)]
    assert scan.resolve(ex.limit(0), cards, aliases).count() == 0


def test_first_of_each(spark):
    rows = [(1, 0, "a", "s", "q"), (1, 1, "a", "s", "r"), (1, 2, None, "s", "q"), (1, 3, None, "s", "q"), (1, 4, None, "t", "q"), (2, 0, "a", "s", "q")]
    df = spark.createDataFrame(rows, "k int, place int, id string, source string, query string")
    assert sorted((r.k, r.place) for r in scan.first_of_each(df, "k", ["place"]).collect()) == [(1, 0), (1, 2), (1, 4), (2, 0)]


@pytest.mark.parametrize("name", ["p8_matcher_candidates"])
def test_rows_without_sql(spark, name):
    from oracle import SMALL

    from cardloom.plans import registry

    n = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert registry.queries()[name](spark, SMALL).count() == n + n // 2  # two candidates of every other card, one of the others
