"""Hard negatives against brute force in whole numbers, on large components, repeats, ties, nulls and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>, score int"


def brute(rows, anchor, positive=5, negative=5, low=80, high=100):
    ready = [r[:3] for r in rows if None not in r[:3] and r[2] and None not in r[2]]
    firsts = {}
    for r in ready:
        if anchor(r[0]):
            firsts[r[0]] = min(firsts.get(r[0], r), r, key=lambda x: x[1:])
    out = []
    for a, label, v in firsts.values():
        s = [(-min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i, b) for i, b, w in ready if i != a and len(w) == len(v)]
        for place, (p, i, _) in enumerate(sorted(x for x in s if x[2] == label)[:positive], 1):
            hits = sorted(x for x in s if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:negative]
            out += [(a, i, r, n, -p, -q, place) for r, (q, n, _) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("most, dim", [(20, 3), (300, 70), (2**27, 5), (2**31, 200), (2**60, 4)])
def test_scores_are_exact(most, dim):
    rng = np.random.default_rng(most % 97)
    a, b = rng.integers(-most, most, (30, dim)), rng.integers(-most, most, (40, dim))
    a[3] //= most
    got = negatives.Scores(a, b).tile(slice(0, 30), slice(0, 40))
    for i in range(30):
        for j in range(40):
            assert got[i, j] == min(max(sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True)), -(2**63)), 2**63 - 1)


def test_primes_and_shares():
    assert all(negatives.CHUNK * (p // 2) ** 2 < 2**24 for p in negatives.PRIMES)
    for percent in (0, 7, 80, 100):
        for s in (-1001, -5, 0, 3, 7, 999):
            floor, ceiling = negatives.share_of(percent, np.array([s]))
            assert (floor[0], ceiling[0]) == (percent * s // 100, -(-percent * s // 100))


def test_mine(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [int(x) for x in rng.integers(-3, 9, 4)], 1) for i in range(400)]
    rows += [(1000 + i, i % 2, [5, 5, 5, 5], 1) for i in range(60)]  # equal vectors, ties
    rows += [(i, 1, [2**40, 1, 0, 3], 1) for i in (40, 40, 41)] + [(50, 0, [1, 1, 1, 1], 2), (60, None, [1, 1, 1, 1], 2), (None, 1, [1, 1, 1, 1], 2)]
    rows += [(70, 1, None, 2), (71, 1, [], 2), (72, 1, [1, None, 2, 3], 2), (80, 1, [1, 2], 1), (83, 1, [2, 2], 1), (84, 0, [2, 1], 1), (2000, 9, [-1, -1, -1, -1], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(negatives, "CANDIDATES", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "TILE_COLUMNS", 16)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place"]
    for low, high in ((80, 100), (0, 90)):
        got = negatives.mine(df.where(F.col("vec_id") % 10 == 0), df, low=low, high=high).select(*names)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, low=low, high=high)


def test_mine_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(100, 1, [1, 2], 0), (200, 2, [2, 2], 0)], SCHEMA)
    assert negatives.mine(empty, empty).count() == negatives.mine(some, empty).count() == negatives.mine(some, some).count() == 0
