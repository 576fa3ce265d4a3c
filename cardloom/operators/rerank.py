"""Final scores of visual matches, reranking by text evidence, and the result per query."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import collector_score, language_score
from ..functions.text import normalize_number, variant_class
from .catalog import market_queries, with_uid
from .similarity import coarse_to_fine

#: Weights of the features, alone, and with a collector number read with this confidence.
WEIGHTS = {"visual": 0.45, "name": 0.15, "number": 0.20, "language": 0.05}
SURE, SURE_WEIGHTS = 0.82, {"visual": 0.34, "name": 0.15, "number": 0.34, "language": 0.05}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def search_text(x: str | None) -> str:
    plain = regex.sub(r"[^\w\s/.\-]", " ", unicodedata.normalize("NFKC", x or "").casefold())
    return " ".join(plain.split())


def similarity(left: str | None, right: str | None) -> float:
    """1 for equal texts, 0.88 where one holds the other, else the share of matching blocks; 0 for an empty one."""
    a, b = search_text(left), search_text(right)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.88 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


def blended(coarse: Column, embedding: Column, orb: Column, weight: float = 0.52) -> Column:
    """The final score of a match from its coarse score, which has the embedding in it already, and the embedding once more."""
    w = min(0.85, max(0.0, weight))
    return (coarse * 0.62 + orb * 0.38) * (1 - w) + F.coalesce(embedding, F.lit(0.0)) * w


def visual_match(candidates: DataFrame, weight: float = 0.52, keep: int = 80, top: int = 10) -> DataFrame:
    """Per query the ``top`` cards of highest final score among the ``keep`` of highest coarse score, ties to the smaller card.

    ``candidates``: query_id, card_id, score of hash and histogram, similarity of the embedding (and orb, if known). A card without an
    embedding keeps its score as its coarse one and counts 0 in the final blend."""
    w = min(0.85, max(0.0, weight))
    mixed = F.when(F.col("similarity").isNull(), F.col("score")).otherwise(F.col("score") * (1 - w) + F.col("similarity") * w)
    orb = F.coalesce("orb", F.lit(0.0)) if "orb" in candidates.columns else F.lit(0.0)
    scored = candidates.withColumns({"coarse": F.round(mixed, 6), "_orb": orb}).withColumn("fine", F.round(blended(F.col("coarse"), F.col("similarity"), F.col("_orb"), w), 6))
    best = coarse_to_fine(scored.withColumn("_s", F.col("score")).withColumn("score", F.col("coarse")), keep, top)
    return best.select("query_id", "card_id", "coarse", "similarity", F.col("fine").alias("score"), "rank")


def attach_cards(scores: DataFrame, cards: DataFrame) -> DataFrame:
    """Scores with the card's row; scores of unknown cards go."""
    return scores.join(cards.withColumnRenamed("id", "card_id"), "card_id")


def rerank(matches: DataFrame, evidence: DataFrame, top: int = 8) -> DataFrame:
    """Matches (query_id, card_id, score, similarity, name, local_id, language) by visual and text features.

    ``evidence``: query_id, read_name, read_number, number_confidence, read_attack, read_language. Without any
    text of a query the visual score counts alone; a similarity of 0 falls back to the score. Scores are not rounded: what is
    shown may be (see ``shown``), what decides is not."""
    joined = matches.join(evidence, "query_id", "left")
    read = lambda c: F.coalesce(c, F.lit("")) != ""
    any_text = read("read_name") | read("read_number") | read("read_attack") | read("read_language")
    sure = read("read_number") & (F.coalesce("number_confidence", F.lit(0.0)) >= SURE)
    visual = clamp(F.coalesce(F.when(F.col("similarity") != 0, F.col("similarity")), F.col("score")))
    featured = joined.withColumns({
        "visual_score": visual,
        "name_score": F.when(read("read_name"), text_similarity("read_name", "name")).otherwise(0.0),
        "number_score": collector_score(normalize_number(F.col("read_number")), normalize_number(F.col("local_id"))),
        "language_score": language_score(F.col("read_language"), F.col("language")),
    })
    weight = lambda k: F.when(~any_text, 1.0 if k == "visual" else 0.0).when(sure, SURE_WEIGHTS[k]).otherwise(WEIGHTS[k])
    score = sum((weight(k) * F.col(f"{k}_score") for k in WEIGHTS), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("score"), "card_id")
    return featured.withColumn("confidence", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def shown(scores: DataFrame) -> DataFrame:
    """Features and confidence to five places."""
    return scores.withColumns({c: F.round(c, 5) for c in scores.columns if c == "confidence" or c.endswith("_score")})


def recognition(reranked: DataFrame, cutoff: float = 0.72) -> DataFrame:
    """One row per query: the best card, its confidence, whether it needs review, the recognised fields (read texts
    first) and the candidates in order."""
    entry = F.struct("rank", "card_id", F.round("confidence", 5).alias("confidence"))
    best = F.min_by(F.struct("card_id", "confidence", "name", "local_id", "language", "read_name", "read_number", "read_language"), "rank").alias("b")
    rows = reranked.groupBy("query_id").agg(best, F.array_sort(F.collect_list(entry)).alias("c"))
    either = lambda read, own: F.coalesce(F.nullif(F.col(f"b.{read}"), F.lit("")), F.col(f"b.{own}"))
    return rows.select(
        "query_id", "b.card_id", F.round("b.confidence", 5).alias("confidence"), (F.col("b.confidence") < cutoff).alias("needs_review"),
        either("read_name", "name").alias("name"), either("read_number", "local_id").alias("number"), either("read_language", "language").alias("language"),
        F.transform("c", lambda x: x["card_id"]).alias("candidates"))


def recognized_fields(best: DataFrame) -> DataFrame:
    """Per query what is known of its card, what was read before what the card says: ``query_id``, ``name``, ``collector_number``, ``set_id``,
    ``set_name``, ``variant_class``, ``language``; all null but the id where there is no card.

    ``best``: query_id, card_id, read_name, read_number, read_language, name, local_id, set_id, set_name, variant, language. Blank and missing readings do not count."""
    there = F.col("card_id").isNotNull()
    either = lambda read, own: F.when(there, F.coalesce(F.nullif(F.col(read), F.lit("")), F.col(own)))
    return best.select(
        "query_id", either("read_name", "name").alias("name"), either("read_number", "local_id").alias("collector_number"), F.when(there, F.col("set_id")).alias("set_id"),
        F.when(there, F.col("set_name")).alias("set_name"), F.when(there, variant_class(F.col("variant"))).alias("variant_class"), either("read_language", "language").alias("language"))


def recognition_candidates(reranked: DataFrame, cards: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` candidates of each query, a row each: ``query_id``, ``rank``, ``card_id``, ``uid``, ``score`` and the features to five places, and the
    search texts of two markets, ``query_us`` and ``query_eu``. ``cards``: id, name, set_id, local_id, variant, language; candidates of unknown cards go."""
    first = shown(reranked.where(F.col("rank") <= limit)).select("query_id", "rank", "card_id", F.col("confidence").alias("score"), *(f"{k}_score" for k in WEIGHTS))
    known = with_uid(cards).select(F.col("id").alias("card_id"), "uid")
    searched = market_queries(cards).withColumnRenamed("id", "card_id")
    return first.join(known, "card_id").join(searched, "card_id")


def position_penalty(ranked: DataFrame, step: float = 4.0) -> DataFrame:
    return ranked.withColumn("score", F.col("score") - step * (F.col("rank") - 1))
