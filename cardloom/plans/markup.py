"""Queries over pages of markup and JSON readings that hold the given tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup, readings
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query

# Price pages: one for each card, with cells that are blank, not closed, or named twice

_CELL = {"used_price": 3, "complete_price": 4, "cib_price": 2, "new_price": 5, "graded_price": 7, "box_only_price": 1, "manual_only_price": 6}


def _price_pages(spark, d):
    k = F.col("id")
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    parts = []
    for name, m in _CELL.items():
        tag = F.when(k % 2 == 0, j(f'<td id="{name}">')).otherwise(j(f'<TD class="a {name} b" data-n="1">'))
        value = F.when(k % (m + 2) == 0, "").otherwise(j('<span class="price js-price">\n $', F.format_number(k * m + 0.5, 2), "</span>"))
        parts.append(j(tag, value, F.when(k % 3 == 0, "").otherwise("</td>")))
    return fx.cards(spark, d).select("id", j("<table><tr><td>x</td>", *parts, "</table>").alias("html"))


_PRICE_PAGES = "pg AS (SELECT id, '<table><tr><td>x</td>' || " + " || ".join(
    f"""CASE WHEN id % 2 = 0 THEN '<td id="{name}">' ELSE '<TD class="a {name} b" data-n="1">' END || CASE WHEN id % {m + 2} = 0 THEN '' ELSE '<span class="price js-price">' || chr(10) || ' $' || format('{{:,.2f}}', id * {m} + 0.5::DOUBLE) || '</span>' END || CASE WHEN id % 3 = 0 THEN '' ELSE '</td>' END"""
    for name, m in _CELL.items()) + " || '</table>' AS html FROM cards)"


def _cell_sql(*names: str) -> str:
    one = "TRY_CAST(replace(regexp_extract(list_filter(c, lambda x: regexp_matches(x, '(?i)^[^>]*(id=\"{n}\"|class=\"[^\"]*\\b{n}\\b)'))[1], '(?is)^[^>]*>\\s*<span[^>]+class=\"[^\"]*price[^\"]*\">\\s*[$]([0-9,.]+)', 1), ',', '') AS DOUBLE)"
    return "coalesce(" + ", ".join(one.format(n=n) for n in names) + ")"


@_query("t8_price_cells", with_views(f", {_PRICE_PAGES}, ce AS (SELECT id, string_split_regex(html, '(?i)<td')[2:] AS c FROM pg) SELECT id, " + ", ".join(f"{_cell_sql(*names)} AS {k}" for k, names in markup.PRICE_CELLS.items()) + " FROM ce", "cards"))
def t8(spark, d):
    return markup.price_cells(_price_pages(spark, d), "id", "html")


# Listing pages: the listings of each product as rows of several forms

def _listing_pages(spark, d):
    s = fx.listings(spark, d)
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    n, key = F.crc32("article_id"), F.col("article_id")
    amount = F.replace(F.translate(F.format_number("price", 2), ",.", "_,"), F.lit("_"), F.lit("."))
    form = n % 4
    row = F.when(form == 0, j('<div id="articleRow', key, '" class="row"><span class="seller-name">s', F.col("seller").cast("string"), '</span><b title="', F.col("condition"), '"></b><div class="price-container"><span class="font-weight-bold">', amount, " €</span></div></div>")).when(
        form == 1, j('<div data-article-id="', key, '"><a href="/en/Users/s', F.col("seller").cast("string"), '">s', F.col("seller").cast("string"), '</a><br><i class="condition">', F.col("condition"), '</i><i data-price="', F.col("price").cast("string"), '">x</i>')).when(
        form == 2, j('<div class="article-row"><p data-id-article="', key, '">no price</p></div>')).otherwise(j("<tr id='article-", key, "'><td>unnamed<td><b>", amount, " €</b></tr>"))
    return s.select("product_id", "article_id", row.alias("r")).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "r"))).alias("rows")).select(
        "product_id", F.array_join(F.transform("rows", lambda x: x["r"]), "\n").alias("html"))


@_query("t10_listing_rows")
def t10(spark, d):
    return markup.listing_rows(_listing_pages(spark, d), "product_id", "html")


# Readings: the answers of a reader for each conversation turn, in several shapes and depths

def _answers(spark, d):
    c = fx.table(spark, d, "conversations").withColumn("n", F.crc32(F.concat_ws("-", "conv_id", "turn")))
    n, text = F.col("n"), F.to_json(F.struct("text"))
    quoted = F.substring(text, F.lit(9), F.length(text) - 9)  # the text as JSON
    q = F.when(F.col("text").isNull(), '""').otherwise(quoted)
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    shape = n % 6
    json = F.when(shape == 0, j('{"rec_texts":[', q, ',7,"¥12,800"],"rec_scores":[0.5],"dt_polys":[[[1,2],[9,5]]]}')).when(
        shape == 1, j("[[[[0,0],[5,8]],[", q, ",0.9]],[[1,2,3,4],[\"9800円\",\"0.5\"]]]")).when(
        shape == 2, j('{"z":{"pages":[{"text":', q, ',"score":0,"confidence":"0.25"}]},"a":[', q, ',[["deep"]]]}')).when(shape == 3, j('{"description":', q, "}")).when(shape == 4, q).otherwise(j("[", q))
    return c.select("n", F.concat_ws("-", "conv_id", "turn").alias("answer_id"), json.alias("json"))


@_query("t15_ocr_items")
def t15(spark, d):
    return readings.ocr_items(_answers(spark, d).drop("n"), "answer_id", "json")


@_query("t7_item_prices")
def t7(spark, d):
    region = F.when(F.col("n") % 5 == 0, "white-tag 1").otherwise("full")
    return readings.item_prices(readings.ocr_items(_answers(spark, d).withColumn("region", region).drop("n"), "answer_id", "json", "region"), "answer_id")
