"""Exact top-k search by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block of candidates and of queries; a task holds one of each.
CANDIDATES, QUERIES = 16_384, 4_096
#: Candidates of a block whose lists are read together, in ascending order of their ids.
PART = 2_048
#: Shares of the lists that are read before the bounds are looked at.
DEPTHS = (0.5, 0.7, 0.85)
#: The bar of a query that has fewer than k scores yet.
NONE = np.int64(-(2**63))


def most(values: np.ndarray) -> int:
    """The largest absolute value, exact for any integer."""
    return max(int(values.max()), -int(values.min()))


def fitting(bound: int) -> type:
    """Numbers that hold every integer of at most this absolute value exactly; floats where they do, for fast products."""
    if bound >= 2**63:
        raise ValueError("inner products of these components may not fit 64 bits")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Lists:
    """Candidates with one sorted list per component, for reading from either end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.sorted = np.sort(values, axis=0)

    def ends(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The last value read of each list, from its high and from its low end, at this share of its length."""
        n = len(self.ids)
        depth = min(n, max(1, int(np.ceil(share * n))))
        return self.sorted[n - depth], self.sorted[depth - 1]


class Best:
    """Per query the ``k`` best so far; of equal scores the first come, so come in order of the ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries
        self.bar = np.full(queries, NONE)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        all_scores, all_ids = np.append(self.scores[query], scores.astype(np.int64)), np.append(self.ids[query], ids)
        if len(all_scores) > 4 * self.k:  # no full sort of what cannot stay
            least = np.partition(all_scores, len(all_scores) - self.k)[len(all_scores) - self.k]
            keep = all_scores >= least
            all_scores, all_ids = all_scores[keep], all_ids[keep]
        first = np.argsort(-all_scores, kind="stable")[: self.k]
        self.scores[query], self.ids[query] = all_scores[first], all_ids[first]
        if len(first) == self.k:
            self.bar[query] = all_scores[first[-1]]


def read(lists: Lists, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Add to ``best`` what these candidates have to offer each query.

    The list of a component is read from its better end for the query: the high end for a positive
    component, the low end for a negative one. Of a candidate that a list has shown the product is
    known; what it has not shown is no better than the last value read and no worse than the list's
    worst value: that bounds each score from above and below. The bar of a query is its k-th best
    score so far, or k-th lower bound here if that is higher (one less, as equals count). Reading stops for a query when no upper
    bound is over its bar; the candidates left at the last look are read to the end of their lists.
    """
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    v, k = lists.values, best.k
    bar = best.bar.copy()
    rows = np.arange(len(queries))  # queries for which lists are still read
    alive = None
    for share in DEPTHS:
        if (bar[rows] == NONE).any():
            break  # all is read
        high, low = lists.ends(share)
        upper = plus[rows] @ np.maximum(v, high).T
        upper += minus[rows] @ np.minimum(v, low).T
        alive = upper > bar[rows, None]
        some = alive.any(axis=1)
        rows, alive = rows[some], alive[some]
        if not len(rows):
            return
        if alive.sum(axis=1).min() > k:  # only then can lower bounds here raise a bar; the query's own row may be one
            lower = plus[rows] @ np.where(v >= high, v, lists.sorted[0]).T
            lower += minus[rows] @ np.where(v <= low, v, lists.sorted[-1]).T
            place = lower.shape[1] - k - 1
            bar[rows] = np.maximum(bar[rows], np.partition(lower, place, axis=1)[:, place].astype(np.int64) - 1)
        if alive.sum() < len(rows) * 8:
            break
    if alive is None or alive.sum() * 8 > alive.size:
        scores = queries[rows] @ v.T
        for i, row in enumerate(rows):
            keep = lists.ids != own[row]
            if alive is not None:
                keep &= alive[i]
            best.add(row, lists.ids[keep], scores[i, keep])
        return
    for i, row in enumerate(rows):
        at = np.flatnonzero(alive[i])
        at = at[lists.ids[at] != own[row]]
        best.add(row, lists.ids[at], v[at] @ queries[row])


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, part: int = PART) -> pd.DataFrame:
    """Ids and scores of the ``k`` best candidates of each query but its own row, ties to the smaller id."""
    kind = fitting(sum(most(v) * most(q) for v, q in zip(values.T, queries.T, strict=True)))
    order = np.argsort(ids, kind="stable")
    ids, values, queries = ids[order], values[order].astype(kind), queries.astype(kind)
    best = Best(len(queries), k)
    for i in range(0, len(ids), part):
        read(Lists(ids[i : i + part], values[i : i + part]), queries, query_ids, best)
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, [len(x) for x in best.ids]),
        "vec_id": np.concatenate([*best.ids, np.zeros(0, np.int64)]),
        "score": np.concatenate([*best.scores, np.zeros(0, np.int64)]),
    })


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, candidates: int = CANDIDATES, block: int = QUERIES) -> DataFrame:
    """The ``k`` highest inner products of each query with ``vectors`` but its own row.

    Both hold ``vec_id`` and ``vector`` (array<int> or array<bigint>, no nulls, all of one length: others
    take no part). Products and sums are 64-bit where 32 bits might not hold them; components whose sums
    might not fit 64 bits are an error, never wrong scores.
    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``, ties to the smaller id; all, if fewer.
    A repeated ``vec_id`` is one candidate per row; a query's rows are taken once; a null id takes no
    part. Empty tables give an empty table.

    Blocks of candidates meet blocks of queries, each pair a group with lists of bounded length; a
    pair yields ``k`` rows a query, so what is ranked last grows with queries times blocks, and each
    vector is sent once per block of the other side. Equal vectors are dealt by their ids, so a
    vector that is very common is spread over blocks.
    """
    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        df = df.where("vec_id is not null and vector is not null").select("vec_id", "vector", F.size("vector").alias("dim"))
        blocks = max(1, -(-df.count() // size))
        return df.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks

    vectors, n_blocks = dealt(vectors, candidates)
    queries, n_groups = dealt(queries.dropDuplicates(["vec_id"]), block)
    left = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = vectors.withColumn("c", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stack = lambda df: np.stack(df.vector.to_list())
        return search_block(v.vec_id.to_numpy(), stack(v), q.vec_id.to_numpy(), stack(q), k)

    keys = ["dim", "b", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_top_k(embeddings: DataFrame, scale: int = 64, k: int = 20, every: int = 20) -> DataFrame:
    """Quantised embeddings, floor(scale * x): rows whose id is divisible by ``every`` against all rows."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    ready = written(embeddings.where(usable(F.col("embedding"))).select("vec_id", whole.alias("vector")), "vectors")
    return top_k(ready.where(F.col("vec_id") % every == 0), ready, k)
