"""Payloads of unlike shape against readings in Python, and odd documents."""

import json

from oracle import SMALL
from pyspark.sql import functions as F

from cardloom.functions import text
from cardloom.operators import payloads
from cardloom.plans import payloads as plans
from cardloom.plans import registry


def prices(kind, v):
    def own(record, market, unit, variant=""):
        return [(market, unit, variant, k, float(x)) for k, x in record.items() if k in payloads.MEASURES and isinstance(x, (int, float)) and not isinstance(x, bool)] if isinstance(record, dict) else []

    out = []
    for path, market, unit in payloads.PRICES[kind]:
        node = v
        for k in path:
            if k != "*":
                node = node.get(k, {}) if isinstance(node, dict) else {}
        out += [p for k, r in node.items() for p in own(r, market, unit, k)] if "*" in path else own(node, market, unit)
    return sorted(out)


def test_prices_of_every_kind(spark):
    got = {}
    for r in registry.queries()["s13_provider_prices"](spark, SMALL).collect():
        got.setdefault(r.id, []).append(r.error or (r.market, r.unit, r.variant, r.measure, r.value))
    for r in plans._mixed(spark, SMALL).collect():
        try:
            v = json.loads(r.json)
        except ValueError:
            v = None
        want = ["unknown kind"] if r.kind == "other" else ["malformed JSON"] if v is None else ["not a record"] if not isinstance(v, dict) else prices(r.kind, v)
        assert sorted(got.get(r.id, [])) == want, r


def test_odd_payloads(spark):
    rows = [(1, "tcgdex", None), (2, None, "{}"), (3, "pokeprices", '{"raw_usd":true,"psa9_usd":"5","psa10_usd":1e2,"x":4}'), (4, "tcgtracking", '{"tcg":[1],"cardtrader":{"a":3,"b":{"low":1}}}'), (5, "tcgdex", "{}")]
    df = spark.createDataFrame(rows, "id int, kind string, j string")
    got = sorted((r.id, r.error, r.measure, r.value, r.variant) for r in payloads.read_provider_prices(df, "id", "kind", "j").collect())
    assert got == [(1, "malformed JSON", None, None, None), (2, "unknown kind", None, None, None), (3, None, "psa10_usd", 100.0, ""), (4, None, "low", 1.0, "b")]
    assert payloads.read_provider_prices(df.limit(0), "id", "kind", "j").count() == 0


def test_reference_of_the_first_variant_in_order(spark):
    texts = [
        '{"tcgplayer":{"prices":{"z":{"market":0},"b":{"market":4,"low":2},"a":{"market":9}}}}', '{"cardmarket":{"prices":{"avg1":2,"avg7":1.5}},"tcgplayer":{"prices":{"a":{"mid":9}},"url":"u"}}', "{}", "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")
    got = [tuple(r) for r in payloads.api_reference(df, "id", "j").orderBy("id").select("raw", "raw_source", "sources", "url").collect()]
    assert got == [(28.0, "tcgplayer", ["tcgplayer"], None), (11.0, "cardmarket", ["cardmarket", "tcgplayer"], "u"), *[(None, None, [], None)] * 3]
    filtered = payloads.api_reference(df, "id", "j", filtered=True).orderBy("id").collect()
    assert [(r.raw, r.raw_source, r.status) for r in filtered[:3]] == [(None, "tcgplayer", "filtered_unavailable"), (None, "cardmarket", "filtered_unavailable"), (None, None, "filtered_unavailable")]
    assert [r.note for r in filtered[:2]] == [None, "Filtered price unavailable; the aggregate is 11 DKK."]


def test_a_limit_counts_sets_with_cards(spark):
    card = lambda i, **k: {"id": i, "image": "x"} | k
    sets = [(0, {"id": "a", "cards": [card("1"), {"id": "2"}]}), (1, {"id": "b", "cards": [card("9")]}), (2, {"id": "c", "releaseDate": "2024", "cards": {"id": "3", "image": "y", "name": "brief"}}), (3, {"cards": [card("1")]}), (4, [1])]
    s = spark.createDataFrame([(p, json.dumps(v)) for p, v in sets] + [(5, "{"), (6, None)], "place int, json string")
    details = spark.createDataFrame([("1", "5"), ("2", "{}"), ("3", '{"name":"N","variants":{"firstEdition":true,"holo":true},"set":{"name":"S"}}'), ("9", "[]")], "card_id string, json string")
    got = lambda **k: [(r.id, r.name, r.set_name, r.variant_class) for r in payloads.cards_from_sets(s, details, "ja", **k).orderBy("place", "position").collect()]
    assert got() == got(max_sets=1) == got(max_sets=2, latest_first=True) == got(set_ids=["c"]) == [("3", "N", "S", "first-edition")]
    assert got(set_ids=["a", "b"]) == got(max_sets=0) == []


def test_names_and_paths(spark):
    rows = [("/a/large/S V1!/x.jpg", "S_V1"), ("/a/small/x.jpg", "official"), ("/large/___/x", "official"), (None, "official")]
    df = spark.createDataFrame(rows, "p string, w string")
    assert all(r.g == r.w for r in df.select("w", text.set_of_path(F.col("p")).alias("g")).collect())
    assert spark.range(1).select(text.safe_name(F.lit("a b/ç.x-1_")).alias("x")).first().x == "a_b_.x-1_"
    assert spark.range(1).select(payloads.clean_set_name(F.lit("SWSH12: Silver Tempest Trainer Gallery")).alias("x")).first().x == "Silver Tempest"
