"""Queries that give a row for each query and card, with no limit of a list."""

from oracle import SMALL

from cardloom.operators import similarity
from cardloom.plans import registry
from cardloom.sources import fixtures as fx


def pairs(spark):
    """Queries and cards that have a row besides the query's own."""
    v = fx.vectors(spark, SMALL).select("vec_id", "card_id")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id")
    return q.join(v, q.query_id != v.vec_id).select("query_id", "card_id").distinct()


def test_max_similarity_has_each_pair(spark):
    got, want = registry.queries()["a1_max_similarity"](spark, SMALL), pairs(spark)
    assert got.count() == want.count() and got.select("query_id", "card_id").exceptAll(want).count() == 0
    assert got.groupBy("query_id").count().where("count > 80").count() > 0


def test_max_similarity_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 4)
    monkeypatch.setattr(similarity, "REFS", 64)
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(0, 20)], "query_id long, vector array<double>")
    r = spark.createDataFrame([(i, i // 2, [0.6, 0.8] if i % 2 else [-1.0, 0.0]) for i in range(300)], "vec_id long, card_id long, vector array<double>")
    alone = spark.createDataFrame([(5, 999, [0.0, 1.0])], r.schema)  # a card whose one row is a query's own
    got = {(x.query_id, x.card_id): x.score for x in similarity.max_similarity(q, r.where("vec_id <> 5").unionByName(alone)).collect()}
    assert len(got) == 20 * 151 - 2 and (5, 999) not in got and (4, 2) not in got
    assert got[5, 2] == -1 and got[3, 1] == -1 and got[2, 1] == 0.6 and got[0, 999] == 0


def test_best_coarse_has_each_pair(spark):
    got, want = registry.queries()["a2_best_coarse"](spark, SMALL), pairs(spark)
    assert got.count() == want.count() and got.select("query_id", "card_id").exceptAll(want).count() == 0
    assert got.groupBy("query_id").count().where("count > 80").count() > 0


def test_best_coarse_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 2)
    monkeypatch.setattr(similarity, "REFS", 32)
    prints = spark.createDataFrame([(i, i // 3, i % 3, [1.0, 2.0, 4.0]) for i in range(300)], "vec_id long, card_id long, hash long, histogram array<double>")
    q = prints.where("vec_id < 6").selectExpr("vec_id AS query_id", "0L AS hash", "histogram")
    got = {(x.query_id, x.card_id): (x.score, x.vec_id) for x in similarity.best_coarse(q, prints).collect()}
    # hashes 1 and 2 differ from 0 in one bit, so the smaller vector id counts where the card's print of hash 0 is the query's own
    assert len(got) == 6 * 100 and got[1, 7] == (1, 21) and got[0, 0] == (round(0.72 * 63 / 64 + 0.28, 6), 1) and got[3, 0] == (1, 0)


def test_blocks_send_few_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", similarity.FEW // 64)
    monkeypatch.setattr(similarity, "REFS", similarity.REFS // 64)
    tiled = similarity.tiled
    monkeypatch.setattr(similarity, "tiled", lambda q, r, f, ddl, **kw: tiled(q, r, lambda a, b: a.iloc[:1].assign(n=len(a) + len(b))[["query_id", "n"]], "query_id bigint, n bigint", **kw))
    prints = spark.range(1024).selectExpr("id AS vec_id", "id AS card_id", "id AS hash", "array(1D) AS histogram")
    got = similarity.best_coarse(prints.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id"), prints)
    assert got.agg({"n": "sum"}).first()[0] < 40_000  # rows that are sent; blocks of few queries and many references sent 66,560
