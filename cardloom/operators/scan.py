"""Evidence of scanned cards: from records of unlike shape to search texts, and from these to candidates of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import candidate_confidence, fraction
from ..functions.records import at, first_number, first_record, first_text, lenient_json, number_of, numeric_record, records_of, text_at
from ..functions.text import set_codes
from .extract import scan_queries
from .search import search

#: Search texts of an extraction that are used.
MOST_QUERIES = 8
#: The trusted source of detections, and its confidence where it names none.
DETECTOR, DETECTOR_CONFIDENCE = "gibltcg", 0.85
#: Identities of a detection that are looked at.
MOST_IDENTITIES = 3


def language_of(record: Column) -> Column:
    """``ja`` or ``en`` by a record's language; null for others."""
    value = F.lower(first_text(record, "language", "lang", "locale"))
    return F.when(value.startswith("ja") | F.contains(value, F.lit("japan")), "ja").when(value.startswith("en"), "en")


def evidence_of(record: Column) -> Column:
    """What a record (VARIANT) says of a card, by the first key that says something: ``name``, ``set_code``, ``set_name``,
    ``card_number`` (with the total, if both are there) and ``language``."""
    number, total = first_text(record, "number", "cardNumber", "collectorNumber", "localId"), first_text(record, "printedTotal", "total")
    return F.struct(
        first_text(record, "name", "cardName", "title").alias("name"), first_text(record, "setCode", "set_id", "setId").alias("set_code"),
        first_text(record, "setName", "set", "expansion").alias("set_name"),
        F.when(number.isNotNull() & total.isNotNull(), F.concat_ws("/", number, total)).otherwise(number).alias("card_number"), language_of(record).alias("language"))


def read_evidence(records: DataFrame, key: str, json: str) -> DataFrame:
    """``key`` and the evidence of each record of JSON text; all null where it is no record."""
    v = first_record(F.try_parse_json(json))
    return records.select(key, v.alias("_v")).select(key, evidence_of(F.col("_v")).alias("_e")).select(key, "_e.*")


def evidence_queries(name: Column, set_code: Column, set_name: Column, card_number: Column) -> Column:
    """Search texts of a card's evidence, the most telling first, each once, at most ``MOST_QUERIES``."""
    def one(x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(F.array().cast("array<string>"))

    codes = F.concat(one(set_code), set_codes(F.coalesce(set_name, F.lit(""))))
    there = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    whole = F.when(there(name) & there(set_name), F.concat_ws(" ", F.trim(name), F.trim(set_name)))
    full = F.when(whole.isNotNull() & there(card_number), F.concat_ws(" ", whole, F.trim(card_number)))
    direct = F.array_compact(F.array(full, whole))
    return F.slice(F.array_distinct(F.concat(scan_queries(one(name), codes, one(card_number)), direct)), 1, MOST_QUERIES)


def detections(responses: DataFrame, key: str, json: str) -> DataFrame:
    """Extractions of a detector's answers, JSON of several shapes: ``key``, ``place``, ``source``, ``confidence``, the evidence, the
    search ``queries`` and ``identity``.

    An answer holds ``items``, or is one item or an array of them. An item's card may stand in ``card``, ``result.card`` or
    ``data.card``, and the best match in ``identity.best``; what it says comes first, then the card. An item with
    any evidence is an extraction. Of a list of identities (or one) the first ``MOST_IDENTITIES`` with a name are
    extractions without search texts. Malformed JSON and answers without items give no rows; nothing else is lost."""
    root = F.try_parse_json(json)
    named = records_of(at(root, "items"))
    items = F.when(F.size(named) > 0, named).otherwise(records_of(root))
    i = F.col("item")
    rows = responses.select(key, F.posexplode(items).alias("_i", "item"))
    rows = rows.withColumn("_root", F.coalesce(first_record(at(i, "card"), at(i, "result", "card"), at(i, "data", "card")), i))
    r = F.col("_root")
    rows = rows.withColumn("_best", first_record(at(r, "identity", "best"), at(i, "identity", "best"), at(r, "card", "identity", "best")))
    rows = rows.withColumn("_match", first_record(at(F.col("_best"), "match"), at(r, "match"), at(i, "match")))
    confidence = F.coalesce(fraction(first_number(at(F.col("_best"), "confidence"), at(F.col("_match"), "confidence"), at(r, "confidence"))), F.lit(DETECTOR_CONFIDENCE))
    rows = rows.withColumn("_c", confidence).withColumn("_e", evidence_of(F.coalesce("_match", "_root")))
    e = lambda c: F.col(f"_e.{c}")
    some = F.coalesce(e("name"), e("card_number"), e("set_code"), e("set_name")).isNotNull()
    own = F.struct(
        F.lit(-1).alias("_j"), F.col("_c").alias("confidence"), *(e(c).alias(c) for c in ("name", "set_code", "set_name", "card_number", "language")),
        evidence_queries(e("name"), e("set_code"), e("set_name"), e("card_number")).alias("queries"), F.lit(None).cast("string").alias("identity"))
    none = F.lit(None).cast("string")
    listed = F.transform(F.slice(records_of(at(i, "identity")), 1, MOST_IDENTITIES), lambda x, j: F.struct(
        j.alias("_j"), F.coalesce(fraction(first_number(at(x, "card_identity_confidence"), at(x, "confidence"))), F.col("_c")).alias("confidence"),
        *(none.alias(c) for c in ("name", "set_code", "set_name", "card_number", "language")), F.array().cast("array<string>").alias("queries"),
        first_text(x, "card_identity", "cardIdentity", "id", "label").alias("identity")))
    every = F.concat(F.when(some, F.array(own)).otherwise(F.array().cast(own_type())), F.filter(listed, lambda x: x["identity"].isNotNull()))
    out = rows.select(key, "_i", F.inline(every))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_i", "_j"))
    return out.select(key, place.alias("place"), F.lit(DETECTOR).alias("source"), "confidence", "name", "set_code", "set_name", "card_number", "language", "queries", "identity")


def own_type() -> str:
    texts = ",".join(f"{c}:string" for c in ("name", "set_code", "set_name", "card_number", "language"))
    return f"array<struct<_j:int,confidence:double,{texts},queries:array<string>,identity:string>>"


def matcher_candidates(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """Candidates of a matcher's outputs: ``key``, ``place``, ``id``, ``name``, ``set_id``, ``set_name``, ``local_id``, ``image_url``,
    ``language``, ``confidence`` (0.1 to 0.99), ``query``, ``print_uid`` and ``evidence`` (its numbers by name).

    The first form of output is an array of results with a ``card`` and a ``score``; the second a record of ``candidates`` whose
    cards may leave out what the record's ``recognized_fields`` say. Text around the JSON does not matter. Other
    output gives no rows. A card without an id is named by its print, or by set and number; without a language it is Japanese."""
    rows = outputs.select(key, lenient_json(F.trim(output)).alias("_root"))
    root = F.col("_root")
    first = F.try_variant_get(root, "$", "array<variant>").isNotNull()
    found = F.when(first, records_of(root)).otherwise(records_of(at(root, "candidates")))
    rows = rows.select(key, "_root", first.alias("_first"), F.posexplode(found).alias("place", "_r"))
    rows = rows.withColumn("_card", first_record(at(F.col("_r"), "card"))).withColumn("_read", first_record(at(root, "recognized_fields")))
    r, card, read, old = F.col("_r"), F.col("_card"), F.col("_read"), F.col("_first")

    def either(v1: Column, v2: Column) -> Column:
        return F.when(old, v1).otherwise(v2)

    text = lambda k: text_at(card, k)
    uid = F.coalesce(text_at(r, "canonical_print_uid"), text("canonical_print_uid"), text_at(root, "canonical_print_uid"))
    value = F.coalesce(either(number_of(at(r, "score")), first_number(at(r, "score"), at(root, "match_confidence"))), F.lit(0.0))
    rows = rows.select(
        key, "place", old.alias("_first"), text("id").alias("_id"), either(text("id"), uid).alias("print_uid"),
        either(text("name"), F.coalesce(text("name"), text_at(read, "name"))).alias("_name"),
        either(text("set_id"), F.coalesce(text("set_id"), text("tcgDexSetId"), text_at(read, "set_id"))).alias("_set"),
        either(text("set_name"), F.coalesce(text("set_name"), text("setName"), text_at(read, "set_name"))).alias("_set_name"),
        either(text("local_id"), F.coalesce(text("collector_number"), text("local_id"), text_at(read, "collector_number"))).alias("_number"),
        either(text("image_url"), F.coalesce(text("image_url"), text("imageUrl"))).alias("_image"),
        either(text("language"), F.coalesce(text("language"), text_at(read, "language"))).alias("_language"),
        F.least(F.greatest(value, F.lit(0.1)), F.lit(0.99)).alias("confidence"), F.when(~old, numeric_record(at(r, "evidence"))).alias("evidence"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        key, "place", F.coalesce("_id", F.when(~F.col("_first"), F.col("print_uid")), F.concat_ws("-", blank("_set"), blank("_number"))).alias("id"), blank("_name").alias("name"),
        blank("_set").alias("set_id"), blank("_set_name").alias("set_name"), blank("_number").alias("local_id"), blank("_image").alias("image_url"), F.coalesce("_language", F.lit("ja")).alias("language"),
        "confidence", F.concat_ws(" ", "_set", "_number", "_name").alias("query"), "print_uid", F.coalesce("evidence", F.expr("cast(map() as map<string,double>)")).alias("evidence"))


def search_candidates(extractions: DataFrame, cards: DataFrame, aliases: DataFrame, per_query: int = 5, step: int = 4, codes: DataFrame | None = None) -> DataFrame:
    """Candidates of each search text of each extraction (``extraction_id``, ``source``, ``confidence``, ``queries``): ``extraction_id``,
    ``place`` (of the text), ``query``, ``id``, ``rank``, ``search_score``, ``score`` and ``candidate_confidence``.

    Each different text is searched once, and its best ``per_query`` cards count ``confidence`` * 100 plus the search's score,
    less ``step`` for each place behind the first."""
    texts = extractions.select("extraction_id", "source", "confidence", F.posexplode(F.slice("queries", 1, MOST_QUERIES)).alias("place", "query"))
    once = texts.select("query").distinct().select(F.col("query").alias("query_id"), "query")
    found = search(once, cards, aliases, top=per_query, codes=codes).select(F.col("query_id").alias("query"), "id", "rank", F.col("score").alias("search_score"))
    joined = texts.join(found, "query")
    return joined.select(
        "extraction_id", "place", "query", "id", "rank", "search_score", (F.col("confidence") * 100 + F.col("search_score") - step * (F.col("rank") - 1)).alias("score"),
        candidate_confidence(F.col("confidence"), F.col("search_score"), F.col("source")).alias("candidate_confidence"))


def resolve(extractions: DataFrame, cards: DataFrame, aliases: DataFrame, by: str = "extraction_id", top: int = 8, codes: DataFrame | None = None) -> DataFrame:
    """The ``top`` cards of each value of ``by`` over all search texts of its extractions: ``by``, ``id``, ``score``, ``confidence``, ``query``
    (the text that found it so), ``rank``. A card counts by its best score; of equal ones the earlier extraction, text and rank
    stand, and of equal cards the smaller id comes first. Extractions without search texts find nothing."""
    keys = extractions.select("extraction_id", F.col(by).alias("_by")).distinct()
    found = search_candidates(extractions, cards, aliases, codes=codes).join(keys, "extraction_id")
    best = found.groupBy("_by", "id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), (-F.col("rank")).alias("r"), "candidate_confidence", "query")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("_by").orderBy(F.desc("b.score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select(
        F.col("_by").alias(by), "id", F.col("b.score").alias("score"), F.col("b.candidate_confidence").alias("confidence"), "b.query", "rank")


def first_of_each(candidates: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Candidates of several sources as one list: the first of each card, or of each source and text where no card is known."""
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("card:"), F.col("id"))).otherwise(F.concat_ws(":", F.lit("query"), "source", "query"))
    place = F.row_number().over(Window.partitionBy(by, key).orderBy(*order))
    return candidates.withColumn("_n", place).where("_n = 1").drop("_n")
