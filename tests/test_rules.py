"""Known inputs and outputs of the rules."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions import money, text
from cardloom.operators import catalog, deals, prices, similarity
from cardloom.streaming.latest import latest, start_latest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("condition, yen, raw, psa9, psa10, want", [
    ("raw", 10000.0, 600.0, None, None, ("raw_flip", 400.0, "BUY", "ready", None, 42.5)),
    ("psa9", 20000.0, None, 1000.0, None, ("psa9_slab", 800.0, "MAYBE", "ready", None, 18.75)),
    ("raw", 10000.0, 430.0, 390.0, 1200.0, ("grade_psa10", 400.0, "BUY", "ready", "PSA_10_TRAP", None)),
    ("psa10", 100000.0, None, None, 8000.0, ("psa10_slab", 4000.0, "MAYBE", "ready", "HIGH_END_RISK", 90.0)),
    ("raw", 10000.0, None, None, None, (None, 400.0, "SKIP", "missing", "VALUES_MISSING", None)),
])
def test_decisions(spark, condition, yen, raw, psa9, psa10, want):
    d = spark.createDataFrame([(1, 7, condition, yen)], "id long, card_id long, condition string, shop_price_yen double")
    v = spark.createDataFrame([(7, raw, psa9, psa10)], "card_id long, raw double, psa9 double, psa10 double")
    r = deals.decide(d, v).first()
    assert (r.route, r.cost, r.decision, r.state, r.warning) == want[:5]
    assert want[5] is None or r.margin == pytest.approx(want[5])


def test_medians_and_variants(spark):
    xs = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    assert one(spark, money.upper_median(xs(0.07, 0.07, 0.05, 0.06, 1.24))) == 0.07
    assert one(spark, money.upper_median(xs(1, 2, 3, 4))) == 3
    assert one(spark, money.upper_median(xs(0, -1, float("nan"), None))) is None
    assert one(spark, money.variant_price(F.lit(0.07), F.lit(12.68))) == 12.68
    assert one(spark, money.variant_price(F.lit(5.0), F.lit(12.68))) == 5.0


def test_reference_listing(spark):
    cols = "product_id long, article_id string, seller long, price double, condition string"
    r = [(1, "a", 1, 900.0, "NM"), (1, "b", 1, 700.0, "GD"), (1, "c", 1, 500.0, "GD"), (1, "d", 1, 450.0, "PL"), (2, "e", 1, 900.0, "NM"), (2, "f", 1, 700.0, "EX")]
    got = {x.product_id: (x.condition, x.price, x.exact_count) for x in prices.reference_listing(spark.createDataFrame(r, cols), "GD").collect()}
    assert got == {1: ("GD", 500.0, 2), 2: ("EX", 700.0, 0)}


def test_identity(spark):
    assert one(spark, text.canonical_uid(F.lit("JA"), F.lit("SV2a"), F.lit(" 084 / 165 "), F.lit("Holo Foil"))) == "ja:sv2a:084/165:holo"
    assert one(spark, text.card_numbers(F.lit("Pikachu ex 205/172 and TG 05"))) == ["205", "TG5"]
    assert one(spark, text.set_codes(F.lit("MSV2a, sit and SITE"))) == ["SV2a", "SIT"]
    assert one(spark, text.cert_numbers(F.lit("PSA 10 cert: 12345678"))) == ["12345678"]
    assert one(spark, text.name_lines(F.lit("Pikachu ex\n¥500\nHP 60\nPikachu ex\nRaichu"))) == ["Pikachu ex", "Raichu"]


def test_upsert_last_of_batch_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 2)], "id long, v string, o long")
    assert sorted(map(tuple, catalog.upsert(old, batch, "id", "o").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_hash_score_counts_sign_bit(spark):
    assert one(spark, similarity.hash_score(F.lit(-1), F.lit(0))) == 0.0
    assert one(spark, similarity.hash_score(F.lit(5), F.lit(4))) == 1 - 1 / 64


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = start_latest(stream, ["user_id", "event_type"], "latest_events", str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got, want = spark.table("latest_events"), latest(events, ["user_id", "event_type"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
