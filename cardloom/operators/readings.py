"""Readings of texts on images: items out of JSON answers of any depth, and prices among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import at, is_number, number_of
from ..sources.scratch import kept
from .extract import prices_scored

#: Keys of lists of texts with their scores and boxes, and keys of single texts.
TEXTS, SCORES = ("rec_texts", "texts"), ("rec_scores", "scores", "confidences")
BOXES = ("rec_polys", "dt_polys", "rec_boxes", "boxes", "det_polys")
TEXT_KEYS = ("text", "description", "transcription")
_ITEM = "array<struct<sub:int,text:string,confidence:double,box:struct<left:double,top:double,right:double,bottom:double>>>"


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _text(value: Column) -> Column:
    return F.when(_is_text(value), F.try_variant_get(value, "$", "string"))


def _float(value: Column) -> Column:
    whole = F.try_variant_get(value, "$", "string").try_cast("double")
    return F.when(is_number(value) | _is_text(value), F.when(F.isnan(whole), None).otherwise(whole))


def box_of(value: Column) -> Column:
    """The box of four numbers, or around points of two numbers or more; null for all else."""
    parts = _list(value)
    four = (F.size(parts) == 4) & F.forall(parts, is_number)
    points = F.filter(F.transform(parts, _list), lambda p: F.coalesce((F.size(p) >= 2) & is_number(F.get(p, 0)) & is_number(F.get(p, 1)), F.lit(False)))
    side = lambda f, i: f(F.transform(points, lambda p: number_of(F.get(p, i))))
    around = F.struct(side(F.array_min, 0).alias("left"), side(F.array_min, 1).alias("top"), side(F.array_max, 0).alias("right"), side(F.array_max, 1).alias("bottom"))
    plain = F.struct(*(number_of(F.get(parts, i)).alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))))
    return F.when(four, plain).when(F.size(points) > 0, around)


def _item(sub: Column, text: Column, confidence: Column, box: Column) -> Column:
    return F.struct(sub.cast("int").alias("sub"), text.alias("text"), confidence.cast("double").alias("confidence"), box.alias("box"))


def _first_list(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(_list(at(v, k)) for k in keys))


def _node(v: Column, own: Column) -> tuple[Column, Column]:
    """The items of a node itself, and whether what is in it is read no further. ``own``: the node's text, where it is one."""
    none = F.lit(None)
    texts, scores, boxes = (_first_list(v, k) for k in (TEXTS, SCORES, BOXES))
    many = F.transform(texts, lambda t, i: _item(i, _text(t), _float(F.get(scores, i)), box_of(F.get(boxes, i))))
    listed = F.size(texts) > 0
    score = _float(at(v, "score"))
    sure = F.when(F.coalesce(score, F.lit(0.0)) != 0, score).otherwise(_float(at(v, "confidence")))
    single = F.array(*(_item(F.lit(i), _text(at(v, k)), sure, none.cast("struct<left:double,top:double,right:double,bottom:double>")) for i, k in enumerate(TEXT_KEYS)))
    items = _list(v)
    second = _list(F.get(items, 1))
    pair = (F.size(items) == 2) & (F.size(second) > 0) & _is_text(F.get(second, 0))
    one = F.array(_item(F.lit(0), _text(F.get(second, 0)), _float(F.get(second, 1)), box_of(F.get(items, 0))))
    empty = F.array().cast(_ITEM)
    alone = F.array(_item(F.lit(0), own, none, none.cast("struct<left:double,top:double,right:double,bottom:double>")))
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    found = F.when(own.isNotNull(), alone).when(listed, many).when(is_object, single).when(F.coalesce(pair, F.lit(False)), one).otherwise(empty)
    return found.cast(_ITEM), own.isNotNull() | F.coalesce(listed, F.lit(False)) | F.coalesce(pair, F.lit(False))


def ocr_items(answers: DataFrame, key: str, json: str, region: str | None = None, left: str | None = None, top: str | None = None) -> DataFrame:
    """Texts of JSON answers in the order in which they stand: ``key``, ``place``, ``text``, ``confidence``, ``left``, ``top``, ``right``,
    ``bottom``, ``region`` and ``error``.

    Read are lists of texts with their scores and boxes, pairs of a box and a text with its score, records with a text,
    and texts in lists, at any depth. Boxes of points become the box around them, moved by the columns ``left`` and ``top``, if named. Blank
    texts are left out, equal ones of a box and region count once. An answer that is no JSON has one row with an ``error``.

    One level is read in each round, all answers at once, until none has more; so no task holds more than a level's
    nodes, and the rounds are as many as the deepest answer's levels."""
    offset = lambda c: F.lit(0) if c is None else F.coalesce(F.col(c), F.lit(0))
    label = F.lit(None).cast("string") if region is None else F.col(region)
    head = [F.col(key).alias("_key"), label.alias("region"), offset(left).alias("_dx"), offset(top).alias("_dy")]
    given = answers.where(F.col(json).isNotNull())
    bad = given.where(F.try_parse_json(json).isNull()).select(*head, F.lit("malformed JSON").alias("error"))
    front = given.where(F.try_parse_json(json).isNotNull()).select(*head, F.array().cast("array<int>").alias("path"), _text(F.try_parse_json(json)).alias("own"), F.col(json).alias("j"))
    levels = []
    v = F.col("_v")
    while not (front := kept(front, "front")).isEmpty():
        read = front.withColumn("_v", F.when(F.col("own").isNull(), F.try_parse_json("j")))
        items, closed = _node(v, F.col("own"))
        levels.append(read.select("_key", "region", "_dx", "_dy", "path", F.inline(items)))
        order = F.map_entries(F.from_json("j", "map<string,string>"))
        kinds = F.try_variant_get(v, "$", "map<string,variant>")
        is_nested = lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
        below = F.transform(F.filter(order, lambda e: is_nested(F.element_at(kinds, e["key"]))), lambda e: F.struct(F.lit(None).cast("string").alias("own"), e["value"].alias("j")))
        listed = F.transform(F.arrays_zip(F.from_json("j", "array<string>").alias("j"), _list(v).alias("v")), lambda e: F.struct(_text(e["v"]).alias("own"), e["j"].alias("j")))
        deeper = F.when(kinds.isNotNull(), below).otherwise(listed)
        front = read.where(~closed).select("_key", "region", "_dx", "_dy", "path", F.posexplode(deeper).alias("_i", "_n")).select(
            "_key", "region", "_dx", "_dy", F.concat("path", F.array("_i")).alias("path"), "_n.own", "_n.j").where("own is not null or substring(j, 1, 1) in ('[', '{')")
    moved = lambda c, d: F.bround(F.col(f"box.{c}") + F.col(d), 0).cast("int").alias(c)
    every = reduce(DataFrame.unionByName, levels, front.limit(0).select("_key", "region", "_dx", "_dy", "path", F.inline(F.array().cast(_ITEM))))
    clean = every.withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where("text <> ''").select(
        "_key", "region", "path", "sub", "text", "confidence", moved("left", "_dx"), moved("top", "_dy"), moved("right", "_dx"), moved("bottom", "_dy"))
    same = Window.partitionBy("_key", "region", "text", "left", "top", "right", "bottom").orderBy("path", "sub")
    once = clean.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    place = (F.row_number().over(Window.partitionBy("_key").orderBy("path", "sub")) - 1).alias("place")
    columns = ["text", "confidence", "left", "top", "right", "bottom", "region"]
    found = once.select(F.col("_key").alias(key), place, *columns, F.lit(None).cast("string").alias("error"))
    types = dict(found.dtypes)
    failed = bad.select(F.col("_key").alias(key), F.lit(None).cast("int").alias("place"), *(F.lit(None).cast(types[c]).alias(c) for c in columns[:-1]), "region", "error")
    return found.unionByName(failed)


def item_prices(items: DataFrame, key: str) -> DataFrame:
    """Prices in yen among the items of ``ocr_items``: ``key``, ``value``, ``score``, ``place`` (of the item), each value once with its best score,
    of equal ones the earlier. To the score of how a price is written come 20 times the confidence, 38 in regions called
    white-tag, and for large boxes up to 18 by their height and 10 by their width."""
    sized = lambda a, b, by, most: F.coalesce(F.least(F.lit(float(most)), F.greatest(F.lit(0), F.col(b) - F.col(a)) / by), F.lit(0.0))
    bonus = F.coalesce(F.col("confidence") * 20, F.lit(0.0)) + F.when(F.startswith(F.coalesce("region", F.lit("")), F.lit("white-tag")), 38.0).otherwise(0.0) + sized("top", "bottom", 3, 18) + sized("left", "right", 60, 10)
    found = items.where("text is not null").select(key, "place", bonus.alias("_b"), F.inline(prices_scored(F.col("text"))))
    best = found.groupBy(key, "value").agg(F.max(F.struct((F.col("points") + F.col("_b")).alias("score"), (-F.col("place")).alias("p"))).alias("m"))
    return best.select(key, "value", F.col("m.score").alias("score"), (-F.col("m.p")).alias("place"))
