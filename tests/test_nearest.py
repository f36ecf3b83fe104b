"""Exact neighbours, largest products, fold-in and dense ids against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.ids import dense_index
from cairn.operators import models as MO
from cairn.operators import nearest as NE

SCHEMA = "id bigint, vec array<float>, v string, class string"


def units(m):
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest_by_hand(ids, m, k, queries=None):
    """All similarities, to 9 decimals, ties by id."""
    ids, u = np.array(ids), units(m)
    own = queries is None
    names, q = (ids, u) if own else (np.array(queries[0]), units(queries[1]))
    sims = np.round(q @ u.T, 9) + 0.0
    out = {}
    for i, name in enumerate(names):
        order = [j for j in np.lexsort((ids, -sims[i])) if not own or ids[j] != name][:k]
        out[int(name)] = [(int(ids[j]), float(sims[i, j])) for j in order]
    return out


def listed(df, key="id"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append((r["other"], r["sim"]))
    return out


def table(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v], "a", "b") for i, v in zip(ids, m)], SCHEMA).repartition(5)


def clustered(seed, n, dim, groups, spread):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(groups, dim))[rnd.integers(groups, size=n)] + rnd.normal(size=(n, dim)) * spread
    return m.astype(np.float32).astype(float)


@pytest.mark.parametrize("groups, spread", [(12, 0.05), (1, 1.0)])
def test_nearest_rows_of_every_row(spark, groups, spread):
    m = clustered(1, 900, 6, groups, spread)
    m[100:160] = m[3]                          # copies
    m[200:203] = 0                             # zero vectors
    ids = np.random.default_rng(2).permutation(5000)[:900]
    got = listed(NE.nearest(table(spark, ids, m), 7))
    want = nearest_by_hand(ids, m, 7)
    assert got.keys() == want.keys()
    for i in want:
        assert [x for x, _ in got[i]] == [x for x, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-9)


def test_blocks_are_pruned_and_nothing_is_lost():
    """The kernel alone: blocks out of reach are skipped, results stay those of all pairs."""
    m = units(clustered(3, 1200, 5, 8, 0.03))
    cells = (m @ units(clustered(3, 8, 5, 8, 0.0)).T).argmax(axis=1)
    blocks = []
    for c in np.unique(cells):
        own = np.flatnonzero(cells == c)
        for lo in range(0, len(own), 50):
            rows = own[lo:lo + 50]
            blocks.append(NE._block(int(c), len(blocks), rows.tolist(), [[int(i)] for i in rows], list(m[rows]), [-2.0] * len(rows), 4, True))
    visited = 0
    schema = NE._arrow(NE._FOUND)
    want = nearest_by_hand(range(1200), m, 3)
    for q in blocks[::5]:
        search = NE._Search(4)
        search.add(q)
        search.begin()
        for c in sorted(blocks, key=lambda b: -float(np.dot(b["centre"], q["centre"]))):
            before = search.sim.copy()
            search.visit(c)
            visited += (before != search.sim).any()
        for batch in search.found(schema):
            for r in batch.to_pylist():
                assert [x["id"] for x in r["near"] if x["id"] != r["class"]][:3] == [i for i, _ in want[r["class"]]]
    assert visited < 0.5 * len(blocks) * len(blocks[::5])
    assert all(b["floor"] > -1 for b in blocks if len(np.frombuffer(b["classes"], "<i8")) >= 4)


def test_nearest_of_separate_queries(spark):
    m, q = clustered(4, 400, 6, 5, 0.2), clustered(5, 60, 6, 5, 0.2)
    q[0] = 0
    q[1] = q[2]
    df = table(spark, range(400), m)
    asked = spark.createDataFrame([(i + 1000, [float(x) for x in v]) for i, v in enumerate(q)], "q bigint, w array<double>")
    got = listed(NE.nearest(df, 5, queries=asked, query_key="q", query_vec="w"), "query")
    want = nearest_by_hand(range(400), m, 5, (np.arange(60) + 1000, q))
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items()}


def test_nearest_of_few_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [0.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    assert listed(NE.nearest(df, 9)) == {1: [(7, 1.0), (6, 0.0), (8, -1.0)], 7: [(1, 1.0), (6, 0.0), (8, -1.0)],
                                         6: [(1, 0.0), (7, 0.0), (8, 0.0)], 8: [(6, 0.0), (1, -1.0), (7, -1.0)]}
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    assert NE.nearest(empty, 3).collect() == []
    assert NE.nearest(df, 3, queries=empty).collect() == []


def test_copies_of_a_third_of_the_rows(spark):
    m = clustered(6, 300, 4, 300, 1.0)
    m[:100] = m[0]
    got = listed(NE.nearest(table(spark, range(300), m), 4))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)] and got[99] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    assert {i: [x for x, _ in v] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in nearest_by_hand(range(300), m, 4).items()}


def test_top_unseen_asks_again_for_long_histories(spark):
    rnd = np.random.default_rng(7)
    m, q = rnd.normal(size=(300, 5)) * rnd.uniform(0, 3, (300, 1)), rnd.normal(size=(20, 5))
    q[0] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id bigint, vec array<double>")
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "user_id bigint, vec array<double>")
    scores = np.round(q @ m.T, 9) + 0.0
    best = [np.lexsort((np.arange(300), -s)) for s in scores]
    gone = {(u, int(i)) for u, long in ((1, 60), (2, 295), (3, 300), (4, 3)) for i in best[u][:long]}
    out = NE.top_unseen(items, users, spark.createDataFrame(sorted(gone), "user_id bigint, item_id bigint"), 6)
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    want = {u: [int(i) for i in best[u] if (u, int(i)) not in gone][:6] for u in range(20)}
    assert got == {u: w for u, w in want.items() if w}


def test_fold_in_is_the_pseudo_inverse(spark):
    m = np.random.default_rng(8).normal(size=(80, 6))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id bigint, features array<double>").repartition(4)
    recent = spark.createDataFrame([(1, 3), (1, 50), (2, 7), (2, 999), (3, 999)], "user_id bigint, item_id bigint")
    inverse = np.linalg.pinv(m).T
    want = {1: inverse[3] + inverse[50], 2: inverse[7]}
    got = {r.user_id: r.vec for r in MO.fold_in_users(recent, items).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[u], want[u], atol=1e-9) for u in want)
    top = MO.recommend_recent_mf(recent, items, 4, fold_in=True).orderBy("user_id", "rank").collect()
    for u, own in ((1, {3, 50}), (2, {7})):
        order = [int(i) for i in np.argsort(-(m @ want[u])) if i not in own][:4]
        assert [r.item_id for r in top if r.user_id == u] == order


def test_items_in_order_of_their_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id bigint, vec array<double>")
    recent = spark.createDataFrame([(9, 1), (8, 4)], "user_id bigint, item_id bigint")
    given = spark.createDataFrame([(u, i) for u in (9, 8, 7) for i in (1, 2, 3, 4, 5)], "user_id bigint, item_id bigint")
    out = MO.sort_by_vectors(given, vectors, recent, recent.limit(0)).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id, r.place) for r in out] == [(9, 3, 0), (9, 2, 0), (9, 1, 1), (9, 4, 2), (9, 5, 2)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_dense_ids_are_a_permutation(spark, reuse):
    """A payload column, many partitions, small advisory size: ids 1..n, in order, each once, when written and read back."""
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
                "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.exchange.reuse": reuse}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 1_500_000
        df = spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.xxhash64("id").cast("string"), 22, "0")).alias("key"),
                                   F.md5(F.col("id").cast("string")).alias("payload"), F.lit("x").alias("_place"))
        from cairn.session import stored
        out = stored(dense_index(df, ["key"]), "test-ids")
        row = out.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(row) == (n, n, 1, n) and out.columns == ["key", "payload", "_place", "id"]
        later = out.select(F.col("id") + 1, F.col("key").alias("before")).toDF("id", "before")
        assert out.join(later, "id").filter(F.col("before") >= F.col("key")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_tables(monkeypatch):
    found = {}
    def stored(df, name, real=NE.stored):
        found[name] = df.columns
        return real(df, name)
    monkeypatch.setattr(NE, "stored", stored)
    return found


@pytest.mark.parametrize("drop", [True, False])
def test_recent_vectors_with_near_twins(spark, monkeypatch, drop):
    """Only pairs that may be a perfect match have their vectors dealt; scores are those of all pairs."""
    tables = kept_tables(monkeypatch)
    m = clustered(9, 120, 6, 40, 0.4)
    m[50:55] = m[0] * 3                        # perfect matches of item 0
    m[60] = m[1] + 1e-3
    u = units(m)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    recents = {1: [0, 7, 9], 2: [1, 2], 3: [5], 4: [999]}
    recent = spark.createDataFrame([(x, i) for x, own in recents.items() for i in own], "user_id bigint, item_id bigint")
    out = MO.recommend_vectors(vectors, recent, recent, 5, drop).orderBy("user_id", "rank").collect()
    for x in (1, 2, 3):
        cos = u @ u[recents[x]].T
        score = np.round(np.where((np.round(cos, 9) == 1.0) & drop, 0.0, cos).sum(axis=1), 9)
        want = [i for i in np.lexsort((np.arange(120), -score)) if i not in recents[x]][:5]
        assert [r.item_id for r in out if r.user_id == x] == want
        assert np.allclose([r.score for r in out if r.user_id == x], score[want] / score[want[0]], atol=1e-8)
    assert tables["near"] == ["query", "id", "sim", "raw"] and ("scored" in tables) == drop


def test_search_multiplies_in_single_precision_first():
    search, m = NE._Search(3), units(clustered(10, 70, 9, 4, 1e-4))
    block = NE._block(0, 0, list(range(70)), [[i, i + 500] if i % 9 == 0 else [i] for i in range(70)], list(m), [-2.0] * 70, 3, True)
    search.add(block)
    search.begin()
    search.visit(block)
    assert search.single.dtype == np.float32 and len(search.lists) <= 8
    ids = [i for i in range(70)] + [i + 500 for i in range(0, 70, 9)]
    want = nearest_by_hand(ids, m[[i % 500 for i in ids]], 3, (np.arange(70), m))
    for batch in search.found(NE._arrow(NE._FOUND)):
        for r in batch.to_pylist():
            assert [x["id"] for x in r["near"]] == [i for i, _ in want[r["class"]]]


def test_fold_in_multiplies_outside_of_expressions(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 1.0]), (3, None)], "item_id bigint, features array<double>")
    recent = spark.createDataFrame([(1, 1), (1, 1), (2, 3)], "user_id bigint, item_id bigint")
    out = MO.fold_in_users(recent, items.filter("item_id < 3"))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert [r.user_id for r in got] == [1] and np.allclose(got[0].vec, np.linalg.pinv(np.array([[1.0, 2.0], [0.5, 1.0]]))[:, 0])
