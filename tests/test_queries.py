import pytest
from oracle import SMALL, assert_same

from cardloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], SMALL)


def test_history_is_whole(spark):
    got = registry.queries()["k9_deal_history"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert got.where("place > 3").count() > 0


def test_coarse_ranks_beyond_the_lists_reach_the_top(spark):
    got = registry.queries()["k2_coarse_to_fine_whole"](spark, SMALL)
    short = registry.queries()["k1_vector_topk"](spark, SMALL)
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0
    assert got.join(short, ["query_id", "card_id"], "left_anti").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
