"""Addresses, encodings and live answers against known rows and against the standard library."""

from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from cardloom.functions import addresses as a
from cardloom.functions import text, values
from cardloom.operators import pages

CARDS = "id long, card_id string, name string, set_id string, set_name string, local_id string, product_id long, language string, wanted_language string, least_condition string, bucket string"


def cards(spark, *rows):
    names = [c.split()[0] for c in CARDS.split(", ")]
    return spark.createDataFrame([tuple({"id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], CARDS)


def test_market_requests_of_known_cards(spark):
    rows = (
        {"name": "Blaziken", "set_id": "ex9", "local_id": "1/106"}, {"name": "Pikachu on the Ball", "set_id": "fut2020", "local_id": "1/5"},
        {"card_id": "SV2a-201", "name": "リザードンex", "set_id": "SV2a", "local_id": "201/165"}, {"name": "Blaziken VMAX", "set_id": "swsh12tg", "local_id": "TG15/195", "wanted_language": "en", "least_condition": "NM"},
        {"name": "Psyduck", "set_id": "SV2a", "local_id": "175/165", "wanted_language": "ja", "least_condition": "MT", "product_id": 7}, {"card_id": "swsh7-4"}, {})
    got = pages.market_requests(cards(spark, *rows), "s", "api").orderBy("id").collect()
    assert [r.query for r in got] == ["Blaziken EM 1", "Pikachu on the Ball FUT20 1", "SV2a 201", "Blaziken VMAX SIT TG15", "SV2a 175", "EVS swsh74", ""]
    assert got[3].search_url == "s/Products/Search?searchString=Blaziken%20VMAX%20SIT%20TG15&language=1&minCondition=2"
    assert got[4].search_url == "s/Products/Search?searchString=SV2a%20175&language=7&minCondition=1"
    assert got[4].articles_url == "api/articles/7?maxResults=10&start=0&idLanguage=7&minCondition=MT"
    assert got[6].search_url == "s/Products/Search?searchString=" and got[6].articles_url is None
    assert pages.market_requests(cards(spark).limit(0), "s", "api").count() == 0


def test_price_pages_of_known_cards(spark):
    duck = {"name": "Psyduck", "set_id": "sv2a", "set_name": "Pokemon Card 151", "local_id": "175/165", "language": "ja"}
    rows = (
        duck, {**duck, "wanted_language": "ko"}, {**duck, "name": "コダック"}, {**duck, "name": "ブラッキーex", "set_id": "SV8a", "local_id": "217/187"},
        {"name": "Umbreon VMAX", "set_id": "swsh7", "set_name": "Evolving Skies", "local_id": "215/203", "language": "en"}, {**duck, "language": "en", "bucket": "asian"},
        {"name": "Farfetch'd", "set_name": "SWSH9: Brilliant Stars Trainer Gallery", "local_id": "TG01"}, {})
    got = pages.price_pages(cards(spark, *rows), "s").orderBy("id").collect()
    assert [r.pages for r in got] == [
        ["s/game/pokemon-japanese-scarlet-&-violet-151/psyduck-175"], ["s/game/pokemon-korean-scarlet-&-violet-151/psyduck-175"], [], [], ["s/game/pokemon-evolving-skies/umbreon-vmax-215"], [],
        ["s/game/pokemon-swsh9-brilliant-stars-trainer-gallery/farfetchd-tg01", "s/game/pokemon-brilliant-stars/farfetchd-tg01"], []]
    assert [got[i].search_url for i in (2, 3, 7)] == ["s/search-products?q=sv2a%20175&type=prices", "s/search-products?q=sv8a%20217&type=prices", "s/search-products?q=&type=prices"]


def _merged(link, given):
    """What the standard library makes of it."""
    parts = urlsplit(link)
    kept = dict(parse_qsl(parts.query, keep_blank_values=True)) | given
    return urlunsplit(parts._replace(query=urlencode(kept), fragment=""))


def test_parameters_as_the_standard_library(spark):
    links = ["https://x/y", "https://x/y?", "https://x/y?a=1&a=2&b", "https://x/y?b=%E3%83%AA+c%2Bd&language=9&=v#f?q=1", "https://x/y?q=a*b~c!()'%20&&minCondition=", "https://x/y?a=b=c&x=%zz", "https://x/y#only"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, link string")
    for given in ({}, {"language": "7"}, {"language": "7", "minCondition": "a b&c"}):
        wanted = {k: F.lit(given.get(k)).cast("string") for k in ("language", "minCondition")}
        got = [r[0] for r in rows.orderBy("i").select(a.with_parameters(F.col("link"), wanted)).collect()]
        assert got == [_merged(x, given) for x in links]


def test_encodings_come_back(spark):
    texts = ["a b", "é&+/?#=%", "リ😀", "~*'()!-_.", "", "\n\t\"\\"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", a.encode_part(F.col("x")), a.encode_form(F.col("x"))).collect()
    for x, part, form in got:
        assert part == quote(x, safe="-_.!~*'()") and form == urlencode({"": x})[1:]


@pytest.mark.parametrize("change, want", [
    ({}, (95.0, "Lowest live Cardmarket Near Mint listing. (2 exact-condition listings; 3 matching listings).", "p")),
    ({"exact_count": None, "listing_count": 1, "product_url": None}, (95.0, "Lowest live Cardmarket Near Mint listing. (1 matching listing).", "s")),
    ({"wanted_condition": "ex"}, (95.0, "Condition mismatch: cheapest live listing is Near Mint, not Excellent. Cardmarket filters by minimum condition, so treat this as an upper-bound reference.", "p")),
    ({"wanted_condition": None, "requested_condition": "?"}, (95.0, "Lowest live Cardmarket listing (3 matching listings).", "p")),
    ({"ok": None}, (None, None, None)), ({"raw_eur": 0.0}, (None, None, None)), ({"raw_eur": float("nan")}, (None, None, None)), ({"raw_eur": None}, (None, None, None))])
def test_live_references(spark, change, want):
    row = {"id": 1, "ok": True, "raw_eur": 12.68, "product_url": "p", "search_url": "s", "fallback_url": "f", "condition": "nm", "wanted_condition": "NM", "requested_condition": "PO", "listing_count": 3, "exact_count": 2} | change
    schema = "id int, ok boolean, raw_eur double, product_url string, search_url string, fallback_url string, condition string, wanted_condition string, requested_condition string, listing_count int, exact_count int"
    got = pages.live_references(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert (got.raw, got.note, got.url) == want


def test_embedded_prices_and_number_fields(spark):
    def prices(html):
        return tuple(spark.createDataFrame([(html,)], "h string").select(values.embedded_prices(F.col("h")).alias("p")).first().p)

    assert prices('{"raw_usd":1234,"psa9_usd":0} PSA 9 $1,050.50 $2 PSA 10') == (12.34, 1050.5, 2.0)
    assert prices("") == prices(None) == (None, None, None)
    got = spark.createDataFrame([("o12/1O2",), ("x",), ("",), (None,), ("tg 15",)], "x string").select(text.number_field(F.col("x"))).collect()
    assert [r[0] for r in got] == ["012/102", "x", "", "", "15"]
