"""Hard-negative mining: exact integer scores by float32 products of residues, then windows of scores.

A residue number system holds an integer by its remainders modulo several small primes. Products of
matrices of remainders are exact in float32, as no sum over ``CHUNK`` components reaches 2**24, and
are joined to exact signed scores by the Chinese remainder theorem.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk import usable

#: Components that are summed in float32 at once.
CHUNK = 64
#: Vectors of a block of candidates and of anchors; a task holds one of each.
CANDIDATES, ANCHORS = 8_192, 16_384
#: Anchors and candidates whose scores are held at once.
TILE_ROWS, TILE_COLUMNS = 256, 4_096
LEAST, MOST = -(2**63), 2**63 - 1


def small_primes(below: int = 1024) -> list[int]:
    """Odd primes in descending order whose halves, squared, sum up exactly ``CHUNK`` times in float32."""
    primes = [n for n in range(3, below, 2) if all(n % d for d in range(3, int(n**0.5) + 1, 2))]
    return [p for p in reversed(primes) if CHUNK * (p // 2) ** 2 < 1 << 24]


PRIMES = small_primes()


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Integers in float32, below 2**24, to about ±p/2, in place. Rounding may leave one a little beyond."""
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


def _remainders(values: np.ndarray, p: int) -> np.ndarray:
    r = values % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _largest(values: np.ndarray) -> list[int]:
    """The largest absolute value of each column, exact for 64-bit integers."""
    return [max(int(a), -int(b)) for a, b in zip(values.max(axis=0), values.min(axis=0), strict=True)]


class Residues:
    """Rows of 64-bit integers by their remainders modulo the first ``n`` primes."""

    def __init__(self, values: np.ndarray, n: int):
        self.parts = [_remainders(values, p) for p in PRIMES[:n]]

    def rows(self, part: slice) -> list[np.ndarray]:
        return [x[part] for x in self.parts]


def primes_for(bound: int) -> int:
    """How many primes hold every integer of at most this absolute value; twice their range, as remainders
    may lie a little beyond half their prime."""
    n, span = 0, 1
    while span <= 4 * bound + 1:
        span *= PRIMES[n]
        n += 1
    return max(n, 1)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The matrix product of remainders, modulo ``p``."""
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, a.shape[1], CHUNK):
        out += _reduced(a[:, i : i + CHUNK] @ b[:, i : i + CHUNK].T, p)
    return _reduced(out, p)


def residue_scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """All inner products of the rows of two matrices given by their remainders, as 64-bit integers.

    Mixed-radix digits: each is the remainder of what the digits before it leave, times the inverse of
    their primes. Digits lie around zero, so the joined score has its sign.
    """
    digits: list[np.ndarray] = []
    for i, p in enumerate(PRIMES[: len(a)]):
        rest = _product(a[i], b[i], p)
        for q, digit in zip(PRIMES, digits, strict=False):
            inverse = pow(q, -1, p)
            rest -= digit
            rest *= np.float32(inverse - p if inverse > p // 2 else inverse)
            _reduced(rest, p)
        digits.append(rest)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(reversed(PRIMES[: len(a) - 1]), reversed(digits[:-1]), strict=True):
        out *= p
        out += digit.astype(np.int64)
    return out


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products in integers of any size; what leaves 64 bits becomes the nearest 64-bit integer."""
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


class Scores:
    """Exact inner products of two blocks of rows, in tiles.

    Rows with components so large that a sum might leave 62 bits are scored in integers of any size,
    all others by residues, with as many primes as the columns' largest values ask for.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        limit = int((2**62 // max(1, a.shape[1])) ** 0.5)
        self.large_a, self.large_b = ((x > limit) | (x < -limit) for x in (a, b))
        self.large_a, self.large_b = self.large_a.any(axis=1), self.large_b.any(axis=1)
        a, b = np.where(self.large_a[:, None], 0, a), np.where(self.large_b[:, None], 0, b)
        n = primes_for(sum(x * y for x, y in zip(_largest(a), _largest(b), strict=True)))
        self.residues_a, self.residues_b = Residues(a, n), Residues(b, n)

    def tile(self, rows: slice, columns: slice) -> np.ndarray:
        out = residue_scores(self.residues_a.rows(rows), self.residues_b.rows(columns))
        far = self.large_a[rows]
        if far.any():
            out[far] = whole_scores(self.a[rows][far], self.b[columns])
        far = self.large_b[columns]
        if far.any():
            out[:, far] = whole_scores(self.a[rows], self.b[columns][far])
        return out

    def tiles(self):
        for i in range(0, len(self.a), TILE_ROWS):
            for j in range(0, len(self.b), TILE_COLUMNS):
                rows, columns = slice(i, min(i + TILE_ROWS, len(self.a))), slice(j, min(j + TILE_COLUMNS, len(self.b)))
                yield rows, columns, self.tile(rows, columns)


def first_of_rows(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each row: higher scores, then smaller ids."""
    order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises, without overflow
    rows = rows[order]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return order[place < k]


def share_of(percent: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floor and ceiling of ``percent`` hundredths of the scores, without overflow for 0 to 100."""
    q, r = score // 100, score % 100
    return percent * q + percent * r // 100, percent * q - (-percent * r // 100)


class Found:
    """The first ``k`` of each group of rows over tiles."""

    def __init__(self, k: int):
        self.k, self.rows, self.ids, self.scores = k, [], [], []

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = first_of_rows(rows, scores, ids, self.k)
        self.rows.append(rows[keep])
        self.ids.append(ids[keep])
        self.scores.append(scores[keep])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, ids, scores = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.rows, self.ids, self.scores))
        keep = first_of_rows(rows, scores, ids, self.k)
        return rows[keep], ids[keep], scores[keep]


def best_others(scores: Scores, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its ``k`` highest scores among candidates of another id."""
    found = Found(k)
    for rows, columns, s in scores.tiles():
        other = own[rows, None] != ids[None, columns]
        if s.shape[1] > k:
            place = s.shape[1] - k
            other &= s >= np.partition(np.where(other, s, LEAST), place, axis=1)[:, place, None]
        r, c = np.nonzero(other)
        found.add(r + rows.start, ids[columns][c], s[r, c])
    return found.all()


def best_in_windows(scores: Scores, labels: np.ndarray, their: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """Per anchor and window (columns of ``low`` and ``high``, both ends included; empty where low exceeds
    high) the ``k`` highest scores among candidates of another label. The row is anchor * windows + window."""
    n = low.shape[1]
    found = Found(k)
    empty = low > high
    bottom, top = np.where(empty, MOST, low).min(axis=1), np.where(empty, LEAST, high).max(axis=1)
    for rows, columns, s in scores.tiles():
        r, c = np.nonzero((s >= bottom[rows, None]) & (s <= top[rows, None]) & (labels[rows, None] != their[None, columns]))
        s = s[r, c]
        for j in range(n):
            keep = (s >= low[rows, j][r]) & (s <= high[rows, j][r])
            found.add((r[keep] + rows.start) * n + j, ids[columns][c[keep]], s[keep])
    return found.all()


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def _paired(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt in blocks: each block of anchors meets each block of rows of equal ``keys``.

    The number of blocks follows the rows of a key, so a common key is many pairs of blocks of bounded size."""
    sizes = anchors.groupBy(*keys).agg(_blocks(F.count(F.lit(1)), ANCHORS).alias("_as")).join(
        rows.groupBy(*keys).agg(_blocks(F.count(F.lit(1)), CANDIDATES).alias("_cs")), keys)
    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col(n)).cast("int")

    left = anchors.join(sizes, keys).withColumn("_a", own("_as")).withColumn("_c", every("_cs")).drop("_as", "_cs")
    right = rows.join(sizes, keys).withColumn("_c", own("_cs")).withColumn("_a", every("_as")).drop("_as", "_cs")
    return left, right


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Each anchor's ``k`` highest-scored rows of its label but its own id: ``anchor_id``, ``place`` from 1,
    ``positive_id``, ``positive_score``."""
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        own, ids = _numbers(left, "vec_id"), _numbers(right, "vec_id")
        at, found, score = best_others(Scores(_matrix(left, dim), _matrix(right, dim)), own, ids, k)
        return pa.table([own[at], found, score], schema=schema)

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    keys = ["dim", "label"]
    left, right = _paired(anchors, rows, keys)
    keys = [*keys, "_a", "_c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "anchor_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(anchors: DataFrame, rows: DataFrame, positive: int = 5, negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives: for each anchor and each of its ``positive`` best rows of the same label, the first
    ``negative`` rows of another label whose score is from ``low`` to ``high`` hundredths (0 to 100) of
    the positive's.

    Both tables hold ``vec_id``, ``label`` and ``vector`` (array<bigint>); other columns are left out. Rows
    with a null in any of them, or in a component, or an empty vector take no part, and vectors of unlike length
    do not meet. Scores are exact 64-bit integer inner products; one beyond 64 bits counts as the nearest
    64-bit integer. Higher scores come first, ties by the smaller id. A repeated id is one candidate a
    row, but an anchor once: the row of its smallest label, then vector. An anchor never meets its own
    id. Fewer rows than asked for: all. Empty tables give an empty table.

    Returns ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``, ``place`` (of the positive).

    Of equal vectors of one label only the smallest ids can be among the first, so as many as are asked for (and
    one, for the anchor's own) are kept before blocks are dealt; a limit in each task comes before
    that shuffle, so a vector that very many rows hold is no large group.
    """
    def ready(df: DataFrame) -> DataFrame:
        whole = F.forall("vector", lambda x: x.isNotNull())
        kept = df.where("vec_id is not null and label is not null and vector is not null and size(vector) > 0").where(whole)
        return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))

    most = max(positive, negative) + 1
    same = Window.partitionBy("_h", "label", "vector").orderBy("vec_id")
    rows = ready(rows).withColumn("_h", F.xxhash64("vector")).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_h", "_n")
    rows = written(rows.withColumn("dim", F.size("vector")), "candidates")
    first = ready(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_r"))
    anchors = written(first.select("vec_id", "_r.label", "_r.vector", F.size("_r.vector").alias("dim")), "anchors")
    best = written(positives(anchors, rows, positive), "positives")
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p")).select(
        F.col("anchor_id").alias("vec_id"), F.col("p.place").alias("places"), F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        counts = np.array([len(x) for x in left.column("scores").to_pylist()])
        score, ids = (np.zeros((len(left), positive), np.int64) for _ in range(2))
        there = np.arange(positive) < counts[:, None]
        score[there], ids[there] = (np.concatenate([*map(np.asarray, left.column(c).to_pylist())]) for c in ("scores", "positives"))
        bottom, top = share_of(low, score)[1], share_of(high, score)[0]
        bottom[~there], top[~there] = MOST, LEAST
        at, found, s = best_in_windows(
            Scores(_matrix(left, dim), _matrix(right, dim)), _numbers(left, "label"), _numbers(right, "label"), _numbers(right, "vec_id"), bottom, top, negative)
        row, j = at // positive, at % positive
        return pa.table([_numbers(left, "vec_id")[row], (j + 1).astype(np.int32), ids[row, j], found, score[row, j], s], schema=schema)

    schema = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), *((c, pa.int64()) for c in ("positive_id", "negative_id", "positive_score", "negative_score"))])
    left, right = _paired(anchors.join(lists, "vec_id"), rows, ["dim"])
    keys = ["dim", "_a", "_c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, "anchor_id bigint, place int, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negative).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place")


def mine_embeddings(embeddings: DataFrame, scale: int = 256, every: int = 100) -> DataFrame:
    """Hard negatives of embeddings (``vec_id``, ``label``, ``embedding``), each component floor(scale * x); one
    that leaves 64 bits counts as the nearest 64-bit integer. Anchors are rows whose id is divisible by
    ``every``; rows with a null label, a null vector or a null or non-finite component take no part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    ready = written(embeddings.where(usable(F.col("embedding"))).select("vec_id", "label", whole.alias("vector")), "vectors")
    return mine(ready.where(F.col("vec_id") % every == 0), ready)
