"""Known inputs and outputs of search, price and evidence rules, and a stream of decisions."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cardloom.functions import boxes, values
from cardloom.functions import search as keys
from cardloom.operators import deals, extract, references, rerank, search
from cardloom.streaming.latest import start_decisions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, number", [("¥12,800", 12800.0), ("12800円", 12800.0), ("税込 9.800", 9800.0), ("42,5", 42.5), ("", 0.0), ("1.234,56", 1234.56), ("1,234.56", 1234.56)])
def test_numbers(spark, text, number):
    assert one(spark, values.clean_number(F.lit(text))) == number


@pytest.mark.parametrize("text, prices", [
    ("税込 12,800 / ¥9,800 / 9800", [12800, 9800]), ("¥500080", [5000]), ("税込 980030", [9800]), ("PRICE 1280080", [12800]), ("HP 330 attack 80", []), ("¥1OO0", [1000]),
])
def test_yen_prices(text, prices):
    assert extract.prices_of(text)[: max(1, len(prices))] == prices


def test_evidence(spark):
    rows = [(1, "Pikachu ex 205/172 税込 ¥12,800"), (2, None), (3, ""), (4, "Pikachu ex\nＳＶ2a 1o5/165")]
    got = {r.doc_id: r for r in extract.evidence(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].numbers == ["205"] and got[1].price == 12800
    assert got[4].names == ["Pikachu ex", "SV2a"] and got[4].codes == ["SV2a"] and got[4].numbers[0] == "105"
    assert got[4].queries[:3] == ["SV2a 105", "Pikachu ex SV2a 105", "Pikachu ex 105"]
    assert got[3].numbers == [] and got[3].price is None


def test_boxes(spark):
    n = lambda *xs: [F.lit(x) for x in xs]
    assert one(spark, boxes.overlap_ratio(boxes.box(*n(0, 0, 10, 10)), boxes.box(*n(5, 5, 9, 25)))) == 20 / 80
    assert one(spark, boxes.overlap_ratio(boxes.box(*n(0, 0, 10, 10)), boxes.box(*n(10, 0, 20, 10)))) == 0
    assert tuple(one(spark, boxes.expand_box(boxes.box(*n(4, 20, 204, 120)), F.lit(210), F.lit(400)))) == (0, 4, 210, 136)
    assert tuple(one(spark, boxes.absolute_box(*n(100, 200, 0.1, 0.25, 0.5, 2.0)))) == (10, 50, 60, 200)
    assert tuple(one(spark, boxes.absolute_box(*n(100, 200, 1.5, 0.0, 0.0, 0.0)))) == (99, 0, 100, 1)
    assert [one(spark, boxes.fraction(F.lit(x).cast("double"))) for x in (None, 0.4, 87.0, 250.0, -1.0)] == [None, 0.4, 0.87, 1.0, 0.0]
    assert one(spark, boxes.candidate_confidence(F.lit(0.5), F.lit(200), F.lit("gibltcg"))) == 0.8


def test_search_keys(spark):
    assert one(spark, keys.search_token(F.lit("Flabébé’s  (holo) #12"))) == "FLABEBES HOLO #12"
    assert one(spark, keys.collector_id(F.lit("TG 015/030"))) == "TG15"
    assert one(spark, keys.first_digits(F.lit("TG015"))) == "15"
    assert one(spark, keys.direct_ids(F.lit("sv1"), F.lit("7/165"))) == ["sv1-7", "sv1-07", "sv1-007"]
    assert one(spark, keys.direct_ids(F.lit("sv1"), F.lit("1234"))) == ["sv1-1234"]
    p = one(spark, keys.parse_query(F.lit("Blaziken SIT 15")))
    assert (p.number, p.tokens) == ("15", ["BLAZIKEN", "SIT"])
    p = one(spark, keys.parse_query(F.lit("charizard 2016 GG 044/070")))
    assert (p.number, p.tokens) == ("GG44", ["CHARIZARD"])
    assert one(spark, keys.recency(F.lit("sv08.5"))) == 308 and one(spark, keys.recency(F.lit("base1"))) == 0


ALIASES = [
    ("em", "EM", 0, "en", "ex9", "Emerald"), ("em", "Emerald", 0, "en", "ex9", "Emerald"), ("sit", "SIT", 0, "en", "swsh12", "Silver Tempest"), ("sit", "Silver Tempest", 0, "en", "swsh12", "Silver Tempest"),
    ("sit tg", "Silver Tempest TG", 0, "en", "swsh12", "Silver Tempest"), ("fut", "FUT20", 0, "en", "fut2020", "Futsal 2020"), ("fut", "Futsal", 0, "en", "fut2020", "Futsal 2020"), ("fut", "FUTSAL 2020", 0, "en", "fut2020", "Futsal 2020"),
    ("mew", "151", 0, "en", "sv03.5", "151"), ("mew", "151", 1, "ja", "SV2a", "Card 151"), ("hif", "HIF", 0, "en", "sm115", "Hidden Fates"), ("hif", "HIF", 1, "en", "sma", "Shiny Vault"), ("sv8", "SV8", 0, "en", "sv08", "Sparks"),
]
CODES = [("SV2A", 0, "en", "sv03.5", "151"), ("SV2A", 1, "ja", "SV2a", "Card 151")]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(ALIASES, "grp string, term string, pos int, language string, set_id string, label string")


def test_texts_are_parsed(spark, aliases):
    """Set names leave the text before its number and name are read."""
    codes = spark.createDataFrame(CODES, "code string, pos int, language string, set_id string, label string")
    want = {
        "Blaziken SIT 15": ("15", ["BLAZIKEN"], ["swsh12"]), "Blaziken VMAX Silver Tempest TG15": ("TG15", ["BLAZIKEN", "VMAX"], ["swsh12"]), "Blaziken TG15": ("TG15", ["BLAZIKEN"], []),
        "Pikachu on the Ball Futsal 2020 1": ("1", ["PIKACHU", "ON", "THE", "BALL"], ["fut2020"]), "Blaziken EM 1": ("1", ["BLAZIKEN"], ["ex9"]), "151 175": ("175", [], ["sv03.5", "SV2a"]),
        "msv2a 177": ("177", [], ["sv03.5", "SV2a"]), "175 SV2a": ("175", [], ["sv03.5", "SV2a"]), "SV9b 12": ("12", [], ["SV9b"]), "Charizard GX HIF SV49": ("SV49", ["CHARIZARD", "GX"], ["sm115", "sma"]),
        "Mewtwo VSTAR GG44": ("GG44", ["MEWTWO", "VSTAR"], []), "Card No 1999": ("", [], []), "": ("", [], []), "Silver Tempest TG silver tempest 3": ("3", [], ["swsh12"]),
    }
    queries = spark.createDataFrame([(i, q) for i, q in enumerate([*want, None])], "query_id long, query string")
    got = {r.query: r for r in search.parsed_queries(queries, aliases, codes).collect()}
    assert {q: (r.number, r.tokens, [s.set_id for s in r.sets]) for q, r in got.items() if q is not None} == want
    assert got[None].tokens == [] and got["175 SV2a"].preferred_set == "SV2a" and got["Blaziken SIT 15"].preferred_set == ""


def test_search_finds_parts_digits_and_sets(spark, aliases):
    rows = [
        (1, "Blaziken VMAX", "swsh12", "TG15/195", "en"), (2, "Chesnaught V", "swsh12", "015/195", "en"), (3, "Blaziken", "ex9", "1/106", "en"), (4, "Charizard", "sv1", "5/165", "ja"),
        (5, "Mewtwo", "sv1", "TG5/30", "en"), (6, "Charizard", "sv1", "5/165", "en"), (7, "Torchic", "swsh12", "14/195", "en"), (8, "Mew", "sv1", "6/165", "ja"), (9, None, None, None, None),
    ]
    cards = spark.createDataFrame([(*r, r[2]) for r in rows], "id long, name string, set_id string, local_id string, language string, set_name string")
    texts = ["Blaziken SIT 15", "chariz", "mew 5", "SIT TG15", "torchic", "x", None, "silver tempest 14", "zzz"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    found = {}
    for r in search.search(queries, cards, aliases).orderBy("query_id", "rank").collect():
        found.setdefault(texts[r.query_id], []).append((r.id, r.stage))
    assert found["Blaziken SIT 15"] == [(1, 1), (2, 1)]  # the name outweighs the number of its digits alone
    assert found["chariz"] == [(4, 3)]  # a part of a name; the same card once
    assert found["mew 5"][0] == (5, 3) and {i for i, _ in found["mew 5"]} == {4, 5, 8}  # digits of TG5
    assert found["SIT TG15"] == [(1, 0)] and found["torchic"] == [(7, 3)] and found["silver tempest 14"] == [(7, 0)]
    assert not {"x", None, "zzz"} & set(found)
    assert search.search(queries.limit(0), cards, aliases).count() == search.search(queries, cards.limit(0), aliases).count() == 0


def test_contained_by_rarest_run(spark):
    words = ["ring", "string", "rin", "", None, "a", "ab", "ringring"] + ["thing"] * 50
    hay = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")
    needles = spark.createDataFrame([("ring",), ("a",), ("hin",), ("",), ("gri",), ("zz",), ("ring",)], "needle string").withColumn("n", F.monotonically_increasing_id())
    got = search.contained(needles, hay, "text", block=7)
    want = [(n, i) for n in ["ring", "a", "hin", "gri", "zz", "ring"] for i, w in enumerate(words) if w and n in w]
    assert got.count() == len(want)


def test_merge_goes_by_listed_sources(spark):
    cols = "card_id long, ord int, raw double, psa7 double, psa8 double, psa9 double, psa95 double, psa10 double, raw_source string, status string, note string, sources array<string>, urls map<string,string>"
    none = (None,) * 5
    rows = [
        (1, 0, 19.0, *none, "cardmarket", None, None, ["cardmarket"], {"cardmarket": "a"}), (1, 1, 2908.0, *none, "pokeprices", None, None, ["pokeprices"], {"cardmarket": "b", "pokeprices": "c"}),
        (2, 0, None, *none, None, None, None, [], {}), (2, 1, 50.0, *none, "tcgplayer", "aggregate", "n", ["cardmarket", "tcgplayer"], {}),
        (3, 0, None, *none, None, None, None, [], {}), (3, 1, None, *none, None, "aggregate", "n", ["cardmarket"], {}),
        (4, 0, 7.0, *none, "other", None, None, ["other"], {}),
    ]
    got = {r.card_id: r for r in references.merge_references(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1].raw, got[1].raw_source, got[1].urls) == (19.0, "cardmarket", {"cardmarket": "a", "pokeprices": "c"})
    assert (got[2].raw, got[2].raw_source, got[2].status) == (50.0, "cardmarket", "aggregate")
    assert (got[3].raw, got[3].status) == (None, None)  # the first row without a value is the chosen one
    assert (got[4].raw, got[4].raw_source) == (7.0, None)


def test_rerank_by_number(spark):
    matches = spark.createDataFrame([(1, 25, 0.9, 0.9, "Pikachu", "025/165", "en"), (1, 84, 0.72, 0.72, "Pikachu", "084/165", "en")], "query_id long, card_id long, score double, similarity double, name string, local_id string, language string")
    evidence = spark.createDataFrame([(1, "Pikachu", "084/165", 0.9, "", "en")], "query_id long, read_name string, read_number string, number_confidence double, read_attack string, read_language string")
    got = rerank.rerank(matches, evidence).orderBy("rank").collect()
    assert [r.card_id for r in got] == [84, 25] and got[0].confidence == pytest.approx(0.72 * 0.34 + 0.15 + 0.34 + 0.05)
    alone = rerank.rerank(matches, evidence.limit(0)).orderBy("rank").collect()
    assert [(r.card_id, r.confidence) for r in alone] == [(25, 0.9), (84, 0.72)]
    best = rerank.recognition(rerank.rerank(matches, evidence)).first()
    assert (best.card_id, best.needs_review, best.number, best.candidates) == (84, False, "084/165", [84, 25])
    close = spark.createDataFrame([(1, 2, 0.720000, 0.720000, "x", "1", "en"), (1, 3, 0.720004, 0.720004, "x", "1", "en"), (2, 4, 0.719996, 0.719996, "x", "1", "en")], matches.schema)
    ranked = rerank.rerank(close, evidence.limit(0))
    assert [r.card_id for r in ranked.where("query_id = 1").orderBy("rank").collect()] == [3, 2]  # by what is not rounded
    assert [(r.query_id, r.confidence, r.needs_review) for r in rerank.recognition(ranked).orderBy("query_id").collect()] == [(1, 0.72, False), (2, 0.72, True)]
    assert rerank.similarity("Charzard", "charizard") == SequenceMatcher(None, "charzard", "charizard").ratio()
    assert (rerank.similarity("Pikachu", "PIKACHU ex"), rerank.similarity("", "x"), rerank.similarity("Ａb", "ab")) == (0.88, 0.0, 1.0)


def test_equivalents(spark):
    none = (None,) * 5
    detail = "struct<illustrator:string,hp:int,stage:string,types:array<string>,attacks:array<struct<cost:array<string>,damage:string>>>"
    full = ("Ann", 60, "Basic", ["Fire"], [(["F", "C"], "20"), ([], None)])
    source = [
        (1, "SV2a", "025/165", full), (2, "SV2a", "30", None), (3, "SV2a", "TG5", full), (4, "other", "25", full), (5, "SV2a", "100", none), (6, "SV2a", "5", ("", 0, "Basic", [], None))]
    other = [
        (11, "sv03.5", "025", none), (12, "sv03.5", "035", full), (13, "sv03.5", "36", full), (14, "sv03.5", "15", full), (15, "sv03.5", "30", None), (16, "sv03.5", "TG05", ("Ann", 0, "", None, None)),
        (17, "sv03.5", "100", none), (18, "sv03.5", "5", ("", 0, "Basic", [], None)), (19, "sv03.5", "0", full)]
    cols = f"id long, set_id string, local_id string, detail {detail}"
    sets = spark.createDataFrame([("sv2a", "sv03.5"), ("sv4a", "sv04.5")], "set_id string, other_set string")
    got = search.equivalents(spark.createDataFrame(source, cols), spark.createDataFrame(other, cols), sets).orderBy("source_id").collect()
    # 1: 70 + 20 + 12 + 18 + 30, of two as near the lower; 2: no detail, so the same number; 3: the same illustrator and number; 5 and 6: too few points
    assert [tuple(r) for r in got] == [(1, 14, 150), (2, 15, None), (3, 16, 78)]
    assert one(spark, search.attack_signature(F.lit(None).cast("array<struct<cost:array<string>,damage:string>>"))) == ""


def test_first_exact(spark):
    rows = [("a", 0, "x", None, 5), ("a", 1, "y", "a", 6), ("a", 2, "a", "a", 7), ("b", 1, "x", "y", 8), ("b", 0, "p", None, 9), ("5", 0, "x", None, 1), ("5", 1, "x", "q", 5)]
    df = spark.createDataFrame([(r[0], *r) for r in rows], "ask string, wanted string, place int, k1 string, k2 string, k3 int")
    got = {r.ask: (r.place, r.exact) for r in search.first_exact(df, "ask", "wanted", ["k1", "k2", "k3"], "place").collect()}
    assert got == {"a": (1, True), "b": (0, False), "5": (1, True)}


def test_stream_of_decisions_equals_batch(spark, tmp_path):
    from cardloom.plans import registry
    from cardloom.sources import fixtures as fx

    small = "/root/testdata/sf0.001"
    offers, priced = fx.deals(spark, small), registry._values(spark, small)
    offers.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(offers.schema).parquet(str(tmp_path / "in"))
    q = start_decisions(stream, priced, "decisions", str(tmp_path / "state"))
    assert q.awaitTermination(180)
    got, want = spark.table("decisions"), deals.decide(offers, priced)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
