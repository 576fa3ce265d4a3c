"""Inner products whose factors are large in different components."""

import numpy as np
import pytest

from cardloom.llm import topk


def test_large_values_in_different_components():
    values = np.array([[10**9, 1, 2], [3, 4, 0], [5, 1, 1], [0, 0, 7]])
    queries = np.array([[1, 10**12, 0], [0, -1, 10**6]])
    got = topk.search_block(np.arange(4), values, np.array([3, 0]), queries, 2)
    best = {q: got[got.query_id == i][["vec_id", "score"]].values.tolist() for q, i in ((0, 3), (1, 0))}
    assert best == {0: [[1, 4 * 10**12 + 3], [0, 10**12 + 10**9]], 1: [[3, 7 * 10**6], [2, 10**6 - 1]]}
    with pytest.raises(ValueError):
        topk.search_block(np.arange(1), np.array([[2**40]]), np.array([5]), np.array([[2**40]]), 2)
