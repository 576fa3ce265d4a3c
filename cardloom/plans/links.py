"""Queries over links and hits for cards: four addresses of each card, of which some are its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from .base import _query

_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_NUM = "lower(regexp_replace(regexp_replace(split_part({0}, '/', 1), '[^A-Za-z0-9]', '', 'g'), '^0+([0-9])', '\\1'))"
_CARDS = f"""cd AS (SELECT id, name, local_id, set_id, language, {_SLUG.format('name')} AS slug, {_NUM.format('local_id')} AS n FROM catalogue),
ln AS (SELECT cd.*, place, CASE place WHEN 0 THEN 'https://p.example/game/pokemon-' || CASE WHEN id % 3 = 0 THEN 'japanese-' ELSE '' END || 'x/' || slug || '-' || n WHEN 1 THEN 'https://p.example/game/pokemon-korean-x/' || slug || '-' || (id % 9)
   WHEN 2 THEN 'https://m.example/Products/Singles/' || set_id || '/' || slug || '-' || n ELSE 'https://m.example/Products/Singles/other/' || CASE WHEN id % 2 = 0 THEN slug ELSE 'none' END END AS link FROM cd, (VALUES (0), (1), (2), (3)) t(place))"""


def _links(spark, d):
    k = F.col("id")
    c = fx.catalogue(spark, d)
    slug, n = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-")), links.slug_number(F.col("local_id"))
    urls = (
        F.concat(F.lit("https://p.example/game/pokemon-"), F.when(k % 3 == 0, "japanese-").otherwise(""), F.lit("x/"), slug, F.lit("-"), n),
        F.concat(F.lit("https://p.example/game/pokemon-korean-x/"), slug, F.lit("-"), (k % 9).cast("string")),
        F.concat(F.lit("https://m.example/Products/Singles/"), F.col("set_id"), F.lit("/"), slug, F.lit("-"), n),
        F.concat(F.lit("https://m.example/Products/Singles/other/"), F.when(k % 2 == 0, slug).otherwise("none")))
    rows = [F.struct(F.lit(i).alias("place"), u.alias("link")) for i, u in enumerate(urls)]
    return c.select(k.alias("page_id"), "name", "local_id", "set_id", "language", F.concat_ws(" ", "name", "set_id").alias("query"), F.inline(F.array(*rows)))


@_query("t11_search_links", with_views(f""", {_CARDS}, sc AS (SELECT id, place, link, CASE WHEN (language = 'ja' AND contains(link, 'pokemon-japanese-')) OR (language = 'ko' AND contains(link, 'pokemon-korean-')) THEN 100 WHEN contains(link, 'pokemon-japanese-') OR contains(link, 'pokemon-korean-') THEN -80 ELSE 0 END
 + CASE WHEN n <> '' AND ends_with(lower(link), '-' || n) THEN 50 ELSE 0 END + 10 * len(list_filter(string_split(lower(name), ' '), lambda t: len(t) > 1 AND contains(string_split(lower(link), '/')[-1], t))) AS score FROM ln WHERE contains(link, '/game/'))
SELECT id AS page_id, arg_max(link, (score, -place)) AS link, CAST(max(score) AS INT) AS score FROM sc WHERE score >= 130 GROUP BY id""", "catalogue"))
def t11(spark, d):
    return links.best_search_links(_links(spark, d))


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


@_query("t12_product_links", with_views(f""", {_CARDS}, tx AS (SELECT *, regexp_replace(lower(link), '[^a-z0-9]+', ' ', 'g') AS t FROM ln WHERE contains(link, '/Products/Singles/')),
sc AS (SELECT id, place, link, 5 * len(list_filter({_WORDS.format("name || ' ' || set_id")}, lambda w: contains(t, w))) + 2 * len(list_filter({_WORDS.format('name')}, lambda w: contains(t, w))) + CASE WHEN contains(t, lower(split_part(local_id, '/', 1))) THEN 8 ELSE 0 END
 + CASE WHEN contains(t, trim(regexp_replace(lower(set_id), '[^a-z0-9]+', ' ', 'g'))) THEN 8 ELSE 0 END AS score FROM tx)
SELECT id AS page_id, arg_max(link, (score, -place)) AS link, CAST(max(score) AS INT) AS score FROM sc GROUP BY id""", "catalogue"))
def t12(spark, d):
    return links.best_product_links(_links(spark, d))


@_query("f9_search_hits", with_views(f""" SELECT a.id, b.id AS hit FROM catalogue a JOIN catalogue b ON b.id BETWEEN a.id - 3 AND a.id + 3 AND b.id % 5 <> 0 AND b.id % 7 <> 3
 AND (b.id % 4 = 0 OR {_NUM.format('a.local_id')} = {_NUM.format('b.local_id')}) AND (b.id % 6 = 0 OR len(list_filter(string_split(upper(a.name), ' '), lambda t: len(t) > 1 AND contains(upper(b.name), t))) > 0)""", "catalogue"))
def f9(spark, d):
    k = F.col("id")
    c = fx.catalogue(spark, d).select("id", "name", "local_id")
    hits = c.select(
        k.alias("hit"), F.when(k % 5 == 0, "set").otherwise("card").alias("kind"), F.when(k % 7 == 3, "").otherwise("s").alias("subtitle"),
        F.when(k % 4 == 0, None).otherwise(F.col("local_id")).alias("hit_number"), F.when(k % 6 == 0, " ").otherwise(F.col("name")).alias("hit_name"), F.explode(F.sequence(k - 3, k + 3)).alias("id"))
    same = links.hit_matches(F.col("kind"), F.lit("slug"), F.col("subtitle"), F.col("hit_number"), F.col("hit_name"), F.col("local_id"), F.col("name"))
    return c.join(hits, "id").where(same).select("id", "hit")


@_query("f10_source_policy", with_views(" SELECT id, NOT (id % 9 = 0 OR id % 4 = 1 OR language IN ('ja','ko')) AS used FROM catalogue", "catalogue"))
def f10(spark, d):
    k = F.col("id")
    return fx.catalogue(spark, d).select("id", links.source_is_used(F.col("language"), F.when(k % 4 == 1, "zh-cn").when(k % 4 == 2, "fr"), F.when(k % 9 == 0, "asian")).alias("used"))
