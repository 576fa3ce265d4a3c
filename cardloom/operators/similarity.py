"""Vector and fingerprint matching, ranking and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and references in one block; a task holds one of each.
BLOCK, REFS = 4_096, 16_384
#: Queries, and references, in one block where a block gives a row for each of its queries and cards: as many of either, as what is sent
#: grows with one over each, and what a task makes with their product.
FEW = 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def rescaled(score: Column) -> Column:
    """Cosine to 0..1."""
    return F.least(F.greatest((score + 1) / 2, F.lit(0.0)), F.lit(1.0))


def tiled(queries: DataFrame, refs: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], ddl: str, by: list[str] | None = None, size: int = BLOCK, refs_size: int | None = None) -> DataFrame:
    """``kernel`` over each pair of a block of ``queries`` (by query_id, of about ``size``) and a block of ``refs`` (by ``by``, or all their columns,
    of about ``refs_size``, or ``REFS``).

    The queries are a stated set. Blocks are bounded, and each side is sent once per block of the other."""
    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    n, m = blocks(queries, size), blocks(refs, refs_size or REFS)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # columns of both sides may come from one table
    left = own.withColumns({"_q": F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"), "_r": every(m)})
    right = refs.withColumns({"_r": F.pmod(F.xxhash64(*(by or refs.columns)), F.lit(m)).cast("int"), "_q": every(n)})

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return kernel(q, r) if len(q) and len(r) else pd.DataFrame({c.split()[0]: [] for c in ddl.split(", ")})

    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(run, ddl)


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_list()).astype(float)


#: Queries of a block that are scored at once.
TILE = 256


def _own(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    """Where a reference is the query's own row."""
    return q.query_id.to_numpy()[:, None] == r.vec_id.to_numpy()[None, :]


def _cosines(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    scores = np.round(_matrix(q.v) @ _matrix(r.vector).T, 6)
    scores[_own(q, r)] = -np.inf
    return scores


def _unit(arrays: pd.Series) -> np.ndarray:
    h = _matrix(arrays)
    h = h - h.mean(axis=1, keepdims=True)
    size = np.sqrt((h * h).sum(axis=1, keepdims=True))
    return np.divide(h, size, out=np.full_like(h, np.nan), where=size > 0)


def _prints(q: pd.DataFrame, r: pd.DataFrame, weight: float) -> np.ndarray:
    """Scores of prints by hash and histogram; a constant histogram is like none."""
    apart = np.bitwise_count(q["hash"].to_numpy().view(np.uint64)[:, None] ^ r["hash"].to_numpy().view(np.uint64))
    alike = np.clip((_unit(q.histogram) @ _unit(r.histogram).T + 1) / 2, 0, 1)
    scores = np.round(weight * np.maximum(0, 1 - apart / 64.0) + (1 - weight) * np.nan_to_num(alike), 6)
    scores[_own(q, r)] = -np.inf
    return scores


def _best(q: pd.DataFrame, cards: np.ndarray, order: np.ndarray, k: int, **columns: np.ndarray) -> pd.DataFrame:
    """The ``k`` first cards of each query by ``order`` (higher first, ties to the smaller card), with values of ``columns``."""
    top = np.argsort(-order, axis=1, kind="stable")[:, :k]
    out = {"query_id": np.repeat(q.query_id.to_numpy(), top.shape[1]), "card_id": cards[top].ravel()} | {n: np.take_along_axis(x, top, 1).ravel() for n, x in columns.items()}
    return pd.DataFrame(out)[np.isfinite(np.take_along_axis(order, top, 1).ravel())]


def _tiles(q: pd.DataFrame):
    return (q.iloc[i : i + TILE] for i in range(0, len(q), TILE))


def _every(q: pd.DataFrame, cards: np.ndarray, order: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """Every query and card that met (finite in ``order``), with values of ``columns``."""
    at, card = np.nonzero(np.isfinite(order))
    return pd.DataFrame({"query_id": q.query_id.to_numpy()[at], "card_id": cards[card]} | {n: x[at, card] for n, x in columns.items()})


def max_similarity(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Per query and card the highest cosine (rounded to 6 places) over the card's vectors but the query's own, as ``score``.

    ``queries``: query_id, vector; ``refs``: vec_id, card_id, vector (unit length). The result has a row for each pair, as asked;
    a card's rows, few by their nature, are in one block, so these rows are not shuffled."""
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("card_id")
        cards, starts = np.unique(r.card_id.to_numpy(), return_index=True)
        found = []
        for part in _tiles(q):
            scores = np.maximum.reduceat(_cosines(part, r), starts, axis=1)
            found.append(_every(part, cards, scores, score=scores))
        return pd.concat(found)

    left = queries.select("query_id", normalized(F.col("vector")).alias("v"))
    return tiled(left, refs.select("vec_id", "card_id", "vector"), best, "query_id bigint, card_id bigint, score double", by=["card_id"], size=FEW, refs_size=FEW)


def vector_topk(queries: DataFrame, refs: DataFrame, k: int = 20) -> DataFrame:
    """Per query the ``k`` cards of highest cosine over their vectors but the query's own (rounded to 6 places; ties to the smaller card).

    ``queries``: query_id, vector; ``refs``: vec_id, card_id, vector (unit length). Each pair of blocks keeps ``k`` cards a
    query. Maxima per card are taken before each cut, so the result is exact: a card of the final list is in
    the list of the block that holds its best vector.
    """
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("card_id")
        cards, starts = np.unique(r.card_id.to_numpy(), return_index=True)
        found = []
        for part in _tiles(q):
            scores = np.maximum.reduceat(_cosines(part, r), starts, axis=1)
            found.append(_best(part, cards, scores, k, score=scores))
        return pd.concat(found)

    found = tiled(queries.select("query_id", normalized(F.col("vector")).alias("v")), refs.select("vec_id", "card_id", "vector"), best, "query_id bigint, card_id bigint, score double")
    return rank_candidates(found.groupBy("query_id", "card_id").agg(F.max("score").alias("score")), k)


def best_coarse(queries: DataFrame, prints: DataFrame, weight: float = 0.72) -> DataFrame:
    """Per query and card the best of its prints by hash and histogram, of equal ones the smallest vector id.

    ``queries``: query_id, hash, histogram; ``prints``: card_id, vec_id, hash, histogram, of which the query's own does not
    count. The result has a row for each pair, as asked; a card's prints are in one block."""
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values(["card_id", "vec_id"])
        cards, starts, sizes = np.unique(r.card_id.to_numpy(), return_index=True, return_counts=True)
        found = []
        for part in _tiles(q):
            scores = _prints(part, r, weight)
            most = np.maximum.reduceat(scores, starts, axis=1)
            ids = np.where(scores == np.repeat(most, sizes, axis=1), r.vec_id.to_numpy(), np.iinfo(np.int64).max)
            found.append(_every(part, cards, most, score=most, vec_id=np.minimum.reduceat(ids, starts, axis=1)))
        return pd.concat(found)

    left, right = queries.select("query_id", "hash", "histogram"), prints.select("card_id", "vec_id", "hash", "histogram")
    return tiled(left, right, best, "query_id bigint, card_id bigint, score double, vec_id bigint", by=["card_id"], size=FEW, refs_size=FEW)


def visual_candidates(queries: DataFrame, refs: DataFrame, k: int = 80, weight: float = 0.52, hash_weight: float = 0.72) -> DataFrame:
    """Cards that may be among the ``k`` of highest coarse score of a query: ``query_id``, ``card_id``, ``score`` (best print) and
    ``similarity`` (highest cosine, from 0 to 1). Both sides: vector, hash, histogram, with query_id, or vec_id and card_id.

    The coarse score blends both, each the best over a card's rows but the query's own; so a card's rows, few by their nature, are
    in one block, and each pair of blocks keeps ``k`` cards a query."""
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("card_id")
        cards, starts = np.unique(r.card_id.to_numpy(), return_index=True)
        found = []
        for part in _tiles(q):
            prints = np.maximum.reduceat(_prints(part, r, hash_weight), starts, axis=1)
            alike = np.round(np.clip((np.maximum.reduceat(_cosines(part, r), starts, axis=1) + 1) / 2, 0, 1), 7)
            found.append(_best(part, cards, np.round(prints * (1 - weight) + alike * weight, 6), k, score=prints, similarity=alike))
        return pd.concat(found)

    left = queries.select("query_id", normalized(F.col("vector")).alias("v"), "hash", "histogram")
    return tiled(left, refs.select("card_id", "vec_id", "vector", "hash", "histogram"), best, "query_id bigint, card_id bigint, score double, similarity double", by=["card_id"])


def rank_candidates(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "card_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expected_rank(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """The best rank of an expected card of each query; null if outside."""
    hit = ranked.join(labels, ["query_id", "card_id"], "left_semi")
    return labels.select("query_id").distinct().join(hit.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def retrieval_metrics(ranks: DataFrame, n: int = 5) -> DataFrame:
    """Count, top-1/n/20 accuracy and mean reciprocal rank; all 0 for no query."""
    within = lambda k: F.round(F.coalesce(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), 6)
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6)
    return ranks.agg(F.count(F.lit(1)).alias("queries"), within(1).alias("top1"), within(n).alias("topn"), within(20).alias("top20"), mrr.alias("mrr"))


def hash_score(a: Column, b: Column) -> Column:
    """1 - d/64 for two 64-bit hashes, d the bits that differ."""
    return F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0)


def sign_hash(vector: Column) -> Column:
    """The signs of 64 components as a 64-bit integer."""
    bits = F.array_join(F.transform(F.slice(vector, 1, 64), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    half = lambda i: F.conv(F.substring(bits, i, 32), 2, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def auto_select(candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per query the first candidate of this confidence."""
    good = candidates.where(F.col("score") >= threshold)
    return good.groupBy("query_id").agg(F.min_by("card_id", "rank").alias("card_id"), F.min("rank").alias("rank"))


def needs_review(score: Column, cutoff: float = 0.72) -> Column:
    return F.coalesce(score, F.lit(0.0)) < cutoff


def coarse_to_fine(scores: DataFrame, coarse: int = 80, top: int = 10) -> DataFrame:
    """Per query the ``top`` of highest ``fine`` among the ``coarse`` of highest ``score``; ties to the smaller card."""
    kept = rank_candidates(scores, coarse).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("fine"), "card_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_per_card(scores: DataFrame) -> DataFrame:
    """Per card its highest score over all queries; of equal ones the smallest query."""
    best = scores.groupBy("card_id").agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("m"))
    return best.select("card_id", F.col("m.score").alias("score"), (-F.col("m.q")).alias("query_id"))
