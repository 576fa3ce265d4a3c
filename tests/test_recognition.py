"""Fields and candidates of a recognition against known rows."""

from cardloom.operators import rerank


def test_read_fields_come_before_the_card(spark):
    ddl = "query_id int, card_id int, read_name string, read_number string, read_language string, name string, local_id string, set_id string, set_name string, variant string, language string"
    rows = [(1, 7, "Mew", "", None, "Mewtwo", "5/9", "s", "Set", "holofoil", "en"), (2, 7, None, "6", "ja", "Mewtwo", "5/9", "s", "Set", None, "en"), (3, None, "Mew", "6", "ja", None, None, None, None, None, None)]
    got = [tuple(r) for r in rerank.recognized_fields(spark.createDataFrame(rows, ddl)).orderBy("query_id").collect()]
    assert got == [(1, "Mew", "5/9", "s", "Set", "holo", "en"), (2, "Mewtwo", "6", "s", "Set", "standard", "ja"), (3, None, None, None, None, None, None)]


def test_candidates_have_identity_evidence_and_searches(spark):
    scored = spark.createDataFrame([(1, r, r, 1 / (r + 2), 0.1234567, 0.0, 0.0, 1.0) for r in range(1, 11)], "query_id int, rank int, card_id int, confidence double, visual_score double, name_score double, number_score double, language_score double")
    cards = spark.createDataFrame([(i, "Mew", "S1", f" {i}", "reverse", "EN") for i in range(1, 8)], "id int, name string, set_id string, local_id string, variant string, language string")
    got = rerank.recognition_candidates(scored, cards).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert (got[0].uid, got[0].score, got[0].visual_score, got[0].query_us, got[0].query_eu) == ("en:s1:1:reverse", 0.33333, 0.12346, "Mew S1 1 reverse", "Mew 1 S1")
    assert rerank.recognition_candidates(scored, cards.limit(0)).count() == 0
