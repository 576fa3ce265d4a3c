"""Items of nested answers against a recursive reading, prices of cells, and listing rows of odd markup."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import markup, readings


def recursive(value, dx=0, dy=0):
    """Items (text, confidence, box) of a value, read depth first."""
    out = []

    def number(x):
        try:
            return None if x is None or isinstance(x, (list, dict, bool)) or math.isnan(float(x)) else float(x)
        except ValueError:
            return None

    def is_number(x):
        return isinstance(x, (int, float)) and not isinstance(x, bool)

    def box_of(b):
        if not isinstance(b, list):
            return None
        if len(b) != 4 or not all(map(is_number, b)):
            points = [p for p in b if isinstance(p, list) and len(p) >= 2 and is_number(p[0]) and is_number(p[1])]
            if not points:
                return None
            b = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]
        return tuple(round(x + d) for x, d in zip(b, (dx, dy, dx, dy), strict=True))

    def add(text, confidence=None, box=None):
        item = (text.strip(), number(confidence), box_of(box))
        if item[0] and (item[0], item[2]) not in [(t, b) for t, _, b in out]:
            out.append(item)

    def get(xs, i):
        return xs[i] if i < len(xs) else None

    def lists(node, keys):
        return next((node[k] for k in keys if isinstance(node.get(k), list)), [])

    def walk(node):
        if isinstance(node, str):
            add(node)
        elif isinstance(node, dict):
            texts, scores, boxes = (lists(node, k) for k in (readings.TEXTS, readings.SCORES, readings.BOXES))
            for i, t in enumerate(texts):
                if isinstance(t, str):
                    add(t, get(scores, i), get(boxes, i))
            if not texts:
                for k in readings.TEXT_KEYS:
                    if isinstance(node.get(k), str):
                        add(node[k], node.get("score") or node.get("confidence"))
                for child in node.values():
                    if isinstance(child, (dict, list)):
                        walk(child)
        elif isinstance(node, list):
            if len(node) == 2 and isinstance(node[1], list) and node[1] and isinstance(node[1][0], str):
                add(node[1][0], get(node[1], 1), node[0])
            else:
                for child in node:
                    walk(child)

    walk(value)
    return out


def made(rng, depth):
    kind = rng.randint(0, 9)
    word = lambda: rng.choice(["a", "b ", " 12,800円", "", "ok", "é"])
    box = rng.choice([[1, 2, 3.5, 4.5], [[0, 1], [5, 2.5], ["x", 1]], None, [1, 2], "box", [[1]]])
    if depth == 0 or kind == 0:
        return rng.choice([word(), 5, None, True, 1.5])
    if kind <= 2:
        return {"rec_texts": [word(), 3, word()], "rec_scores": [0.9, None, "0.5"], rng.choice(["dt_polys", "boxes"]): [box, None, box], "other": [word()]}
    if kind <= 4:
        return [box, [word(), rng.choice([0.8, "x", None])]]
    if kind <= 6:
        return {"z": made(rng, depth - 1), "text": word(), "a": made(rng, depth - 1), "score": rng.choice([0, 0.7, "0.25", None]), "confidence": 0.3}
    return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_items_of_any_depth(spark):
    rng = random.Random(7)
    values = [made(rng, 5) for _ in range(150)] + [[], {}, "alone", 3, None, {"texts": []}, {"texts": ["t"], "a": {"text": "no"}}, {"b": {"text": "2"}, "a": {"text": "1"}}]
    rows = [(i, json.dumps(v), "r", 10, -3) for i, v in enumerate(values)] + [(900, "{", "r", 0, 0), (901, None, "r", 0, 0), (902, "", "r", 0, 0)]
    df = spark.createDataFrame(rows, "id int, j string, region string, dx int, dy int")
    got = {}
    for r in readings.ocr_items(df, "id", "j", "region", "dx", "dy").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.text, r.confidence, None if r.left is None else (r.left, r.top, r.right, r.bottom)) if r.error is None else r.error)
    assert {i for i, v in got.items() if v == ["malformed JSON"]} == {900, 902}
    assert 901 not in got
    for i, v in enumerate(values):
        assert got.get(i, []) == recursive(v, 10, -3), (i, v)


def test_prices_of_items(spark):
    rows = [(1, 0, "¥12,800", 0.5, 0, 0, 60, 30, "white-tag 1"), (1, 1, "税込 12,800", None, None, None, None, None, "full"), (1, 2, "9800円", 1.0, None, None, None, None, None), (2, 0, None, None, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "id int, place int, text string, confidence double, left int, top int, right int, bottom int, region string")
    got = {(r.id, r.value): (r.score, r.place) for r in readings.item_prices(items, "id").collect()}
    assert got == {(1, 12800): (110 + 20 + 10 + 38 + 10 + 1, 0), (1, 9800): (105 + 20 + 20, 2)}


@pytest.mark.parametrize("html, want", [
    ('<td id="used_price"><span class="price js-price"> $1,234.50</span></td><td class="x graded_price y">\n<SPAN data-a="1" class="js-price">$9</span>', {"raw": 1234.5, "psa9": 9.0}),
    ('<td id="used_price"></td><td id="other"><span class="price">$5</span></td>', {}),  # a blank cell stays blank
    ('<td id="used_price"><td id="new_price"><span class="price">$5</span></td>', {"psa8": 5.0}),  # not closed
    ('<td class="complete_price"></td><td class="cib_price"><span class="price">$7.5</span></td>', {"psa7": 7.5}),
    ('<td class="my_graded_price_x"><span class="price">$7</span></td><td id="box_only_price"><b>$3</b></td><td id="manual_only_price"><span class="price">$0</span></td>', {}), ("", {}), (None, {}),
])
def test_price_cells(spark, html, want):
    row = markup.price_cells(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").first().asDict()
    assert {k: v for k, v in row.items() if v is not None and k != "id"} == want


def test_listing_rows(spark):
    page = """<div id=articleRow7 class='row'><span class="seller-name"> Ann <b>B</b></span><div title="Near Mint"></div><div class="price-container"><span class="font-weight-bold">1.234,50 €</span></div></div>
      <div data-article-id="8"><a href="/x/Users/Bo">Bo</a><span class="condition">LP</span><i data-price="3,50">x</i>
      <div data-article-id="8"><span class="price">9 €</span></div></div>
      <table><tr id="article-9"><td>EX <br>costs 99,00 € now <b>12,00 €</b><td><div title="nothing"><tr id="article-10"><td>no price</td></tr></table>
      <div class="article-row"><p data-id-article="11"></p><span class="price">free</span><p>from</p><p>2.75€</p></div><div class="article-row"><span class="price">5</span></div>
      <div class="no-gutters row" id="article-12"><img title="MT"><span class=price>$4</span>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div>")], "id int, h string")
    got = [tuple(r) for r in markup.listing_rows(df, "id", "h").orderBy("id", "place").collect()]
    assert got == [
        (1, 1, "7", 1234.5, "NM", "Ann B"), (1, 2, "8", 3.5, "LP", "Bo"), (1, 3, "9", 12.0, "EX", "unknown"), (1, 4, "11", 2.75, "EX", "unknown"), (1, 5, "12", 4.0, "MT", "unknown")]


def test_queries_read_what_was_written(spark):
    from oracle import SMALL

    from cardloom.plans import markup as pages
    from cardloom.plans import registry
    from cardloom.sources import fixtures as fx

    known = registry.queries()
    form = F.crc32("article_id") % 4
    listings = fx.listings(spark, SMALL).where(form != 2).select("product_id", "article_id", F.round("price", 2).alias("price"), F.when(form == 3, "EX").otherwise(F.col("condition")).alias("condition"),
                                                               F.when(form == 3, "unknown").otherwise(F.concat(F.lit("s"), "seller")).alias("seller"))
    # rows of form 1 are not closed, so those that follow stand within them and their seller and condition are the first found
    got = known["t10_listing_rows"](spark, SMALL).select("product_id", "article_id", F.round("price", 2).alias("price"), "condition", "seller")
    assert got.count() == listings.select("product_id", "article_id").distinct().count() and got.exceptAll(listings).count() == 0
    want = {r.answer_id: recursive(json.loads(r.json)) for r in pages._answers(spark, SMALL).collect() if not (r.json.startswith('[') and r.n % 6 == 5)}
    items = {}
    for r in known["t15_ocr_items"](spark, SMALL).where("error is null").orderBy("answer_id", "place").collect():
        items.setdefault(r.answer_id, []).append((r.text, r.confidence, None if r.left is None else (r.left, r.top, r.right, r.bottom)))
    assert items == {k: v for k, v in want.items() if v}
    assert known["t7_item_prices"](spark, SMALL).where("value = 12800").count() == sum(any(t == "¥12,800" for t, *_ in v) for v in items.values())
