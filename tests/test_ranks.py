"""Ranks within groups, and quantiles, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions.money import upper_median
from cardloom.operators import catalog
from cardloom.operators.ranks import group_upper_median, values_at_ranks


def test_ranks_of_groups_with_ties_nulls_and_one_that_is_large(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 900, 4000)] + [("b", 5.0)] * 50 + [(None, 2.0), (None, 1.0), ("c", None), ("d", -0.5)]
    got = values_at_ranks(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", lambda n: F.array(F.lit(1), F.floor(n / 3) + 1, n, n + 1)).collect()
    want = set()
    for g in {g for g, _ in rows}:
        xs = sorted(v for h, v in rows if h == g and v is not None)
        want |= {(g, len(xs), r, xs[r - 1]) for r in (1, len(xs) // 3 + 1, len(xs)) if xs}
    assert {(r.g, r.n, r["rank"], r.v) for r in got} == want and len(got) == len(want)


def test_upper_median_of_groups_as_of_arrays(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), None if x < -2 else round(float(x), 1)) for g, x in zip(rng.integers(0, 40, 3000), rng.normal(1, 2, 3000), strict=True)] + [(99, 0.0), (98, float("nan")), (97, float("inf")), (None, 3.0)]
    table = spark.createDataFrame(rows, "g int, v double")
    want = {tuple(r) for r in table.groupBy("g").agg(upper_median(F.collect_list("v"))).collect()}
    got = group_upper_median(table, ["g"], "v").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert group_upper_median(table.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_quantiles_as_numpy(spark, n):
    xs = np.round(np.random.default_rng(n).normal(size=(n, 2)), 2)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in xs] + [(None, None)], "x double, y double")
    got = {(r.axis, r.q): r.value for r in catalog.quantiles(points, "xy", (0.005, 0.5, 0.995)).collect()}
    want = {(a, q): np.quantile(xs[:, i], q) for i, a in enumerate("xy") for q in (0.005, 0.5, 0.995)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert catalog.quantiles(points.where("false"), "xy", (0.5,)).count() == 0
    assert catalog.axis_bounds(points.where("false"), "xy").first().x_lo is None
