"""What must not lie on disk at once, and what a task must not hold at once."""

import os

from cairn.operators import graph as G
from cairn.operators import models as M
from cairn.operators import similarity as SIM
from cairn.session import FREE_SHUFFLES, release, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stored_tables_free_their_shuffles_and_go(spark, monkeypatch):
    before = spark.conf.get(FREE_SHUFFLES, None)
    seen = []
    real = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: (seen.append(spark.conf.get(FREE_SHUFFLES)), real(self, path))[1])
    table = stored(spark.range(10).repartition(2, "id"), "test")
    assert seen == ["true"] and spark.conf.get(FREE_SHUFFLES, None) == before and table.count() == 10
    path = table.stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    release(table)
    assert not os.path.exists(path)


def baskets(spark):
    return spark.createDataFrame([(u, i) for u in range(30) for i in range(u % 7, 40, 1 + u % 5)], "user_id bigint, item_id bigint")


def test_pairs_are_dealt_in_rounds(spark, monkeypatch):
    want = rows(SIM.item_similarity(baskets(spark), limit=5, threshold=0.1)), rows(SIM.co_occurrence(baskets(spark)))
    names = []
    monkeypatch.setattr(SIM, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    monkeypatch.setattr(SIM, "ROUND", 1000)
    got = rows(SIM.item_similarity(baskets(spark), limit=5, threshold=0.1)), rows(SIM.co_occurrence(baskets(spark)))
    assert got == want and names.count("pairs") > 4


def test_triangles_are_dealt_narrow(spark, monkeypatch):
    pairs = [(a, b) for a in range(14) for b in range(a + 1, 14) if (a * b + a + b) % 3]
    kinds = {}
    monkeypatch.setattr(G, "stored", lambda df, name: (kinds.update({name: dict(df.dtypes)}), stored(df, name))[1])
    t = G.edge_triangles(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    assert kinds["outs"] == {"u": "smallint", "_out": "array<smallint>"}
    assert t.schema.simpleString() == "struct<src:bigint,dst:bigint,triangles:bigint>"
    kept, vs = G.cohesion_graph(spark.createDataFrame(pairs, "src bigint, dst bigint"), 1)
    assert rows(kept) == rows(t) and vs.count() == 14


def test_factorization_has_as_many_blocks_as_its_ratings_need(spark, monkeypatch):
    from pyspark.ml import recommendation

    made, real = [], recommendation.ALS.fit
    monkeypatch.setattr(recommendation.ALS, "fit", lambda self, data: (made.append((self.getNumUserBlocks(), self.getNumItemBlocks())), real(self, data))[1])
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(8) for i in range(u % 3, 9, 2)], "user_id bigint, item_id bigint, rating double")
    M.fit_mf(ratings, rank=2, iters=1)
    monkeypatch.setattr(M, "BLOCK_RATINGS", 2)
    M.fit_mf(ratings, rank=2, iters=1)
    assert made[0] == (10, 10) and made[1] == (-(-ratings.count() // 2),) * 2


def test_user_sums_are_not_dealt_by_item(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(6)], "id bigint, vec array<float>")
    given = spark.createDataFrame([(u, i) for u in range(4) for i in range(8)], "user_id bigint, item_id bigint")
    recent = given.filter("item_id < 2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.sort_by_vectors(given, vectors, recent, recent)
        exchanges = [x for x in plan(out).splitlines() if "hashpartitioning(item_id" in x]
        shown = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(x for x in shown.splitlines() if "Join Inner, (user_id" in x)
    assert exchanges and len(join) - len(join.lstrip(" :+-")) < min(len(x) - len(x.lstrip(" :+-")) for x in shown.splitlines() if "Join LeftOuter" in x)
