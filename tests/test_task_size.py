"""Figures that must not grow faster than the input: memory of a task, what is dealt, what is worked out twice."""

import re

import pytest

from cairn.functions import features as FE
from cairn.operators import catalog as C
from cairn.operators import models as M
from cairn.operators import ranking as RK
from cairn.operators import recommend as RC
from cairn.operators import rules as RU
from cairn.operators import sessions as SS
from cairn.plans.registry import load_all
from cairn.session import size_tasks
from cairn.sources.pages import Attribute, matches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_items_from_actions_deals_no_types(spark):
    actions = spark.createDataFrame([(1, 1, 3, 5), (1, 1, 3, 7), (1, 2, 3, 6), (1, 3, 1, 9), (2, 1, None, 1)],
                                    "user_id bigint, item_id bigint, type int, t bigint")
    types = spark.createDataFrame([(1, "accept"), (3, "return"), (3, "return")], "type int, name string")
    out = C.items_from_actions(actions, types, "return", 1)
    assert "hashpartitioning(type" not in plan(out)
    assert rows(out.select("user_id", "item_id", "last_t", "rank")) == [(1, 1, 7, 1)]


def test_session_tags_are_gathered_as_lists(spark):
    actions = spark.createDataFrame([(1, i, t) for i, t in [(1, 0), (2, 5), (1, 6), (3, 500), (4, 501)]], "user_id bigint, item_id bigint, t bigint")
    tags = spark.createDataFrame([(1, "b,a"), (2, "c"), (2, "a"), (3, None), (4, "")], "item_id bigint, tags string")
    out = SS.session_tags(actions, tags, 100, 1, 100, 1)
    assert "explode" not in plan(out)
    assert rows(out) == [(1, 1, "a a a b b c")]


def test_history_finds_first_actions_on_narrow_rows(spark):
    actions = spark.createDataFrame([(u, i, t) for u in (1, None) for t, i in enumerate([9, 1, 2, None, 3, 1])], "user_id bigint, item_id bigint, t bigint")
    tags = spark.createDataFrame([(1, "a"), (2, "b,c"), (3, "d"), (None, "x")], "item_id bigint, tags string")
    out = SS.history_features(actions, tags, 1, 2)
    # the first group limit, lowest in the plan, holds actions without tags
    assert plan(out).count("WindowGroupLimit") == 4
    want = [(2, 1, "i_b i_c u_a"), (3, 2, "i_d u_a u_b u_c")]
    assert sorted((r.item_id, r.c, r.line) for r in out.filter("user_id = 1").collect()) == want
    assert sorted((r.item_id, r.c, r.line) for r in out.filter("user_id IS NULL").collect()) == want
    lines, idf = FE.history_tfidf_lines(out, ["user_id", "c"])
    assert lines.count() == 4 and idf.count() == 6


def test_tasks_are_sized_unless_the_session_says_otherwise(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    s = spark.newSession()
    size_tasks(s)
    assert int(s.conf.get(name)) >= 1000 and s.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16777216b"
    own = spark.newSession()
    own.conf.set(name, "7")
    size_tasks(own)
    assert own.conf.get(name) == "7"
    off = spark.newSession()
    off.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    size_tasks(off)
    assert off.conf.get(name, None) is None


def test_tag_affinity_sums_are_held_where_rows_are_dealt(spark):
    aff = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0)], "user_id bigint, tag string, affinity double")
    counts = spark.createDataFrame([("a", 1, 4), ("a", 2, 2), ("b", 2, 5), ("b", 3, 1)], "tag string, item_id bigint, count bigint")
    seen = spark.createDataFrame([(1, 1), (2, None)], "user_id bigint, item_id bigint")
    out = RC.recommend_tag_affinity(aff, counts, seen, 2, per_tag=2)
    assert "REPARTITION_BY_COL" in plan(out)
    assert [(u, i, round(s, 3)) for u, i, s in rows(out.select("user_id", "item_id", "score"))] == [(1, 2, 1.0), (1, 3, 0.16), (2, 2, 1.0), (2, 3, 0.2)]


def test_equal_baskets_are_scored_once(spark):
    rules = spark.createDataFrame([(["a"], "x", 0.5, 2.0), (["a", "b"], "y", 0.5, 1.0), (["b"], "x", 0.25, 2.0)],
                                  "antecedent array<string>, consequent string, confidence double, lift double")
    baskets = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b", "c"]), (3, ["a"]), (3, ["b"]), (None, ["a"]), (4, None), (5, [])],
                                    "user_id bigint, basket array<string>")
    out = RU.recommend_assoc(rules, baskets, max_basket=2)
    assert not re.search(r"hashpartitioning\(user_id#\d+L, consequent", plan(out))
    got = {(r.user_id, r.consequent): r.score for r in out.collect()}
    assert got == {(1, "x"): 1.0, (1, "y"): pytest.approx(2 / 3), (2, "x"): 1.0, (2, "y"): pytest.approx(2 / 3), (3, "x"): 1.0, (None, "x"): 1.0}


def test_itemsets_are_mined_once(spark):
    baskets = spark.createDataFrame([(b, i) for b in range(20) for i in "ab"[: 1 + b % 2]] + [(None, "a")], "basket_id bigint, item string")
    sets = RU.frequent_itemsets(baskets, 0.1)
    assert "ExistingRDD" not in plan(sets)
    assert {tuple(r["items"]): (r.freq, round(r.support, 4)) for r in sets.collect()} == {("a",): (21, 1.0), ("b",): (10, 0.4762), ("a", "b"): (10, 0.4762)}


def test_cluster_lists_are_not_dealt(spark):
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (None, 1), (4, None), (5, 0), (5, 1)], "user_id bigint, cluster bigint")
    lists = spark.createDataFrame([(0, 10, 3.0), (0, 11, 2.0), (0, 12, 2.0), (0, None, 1.0), (1, 10, 5.0), (1, 13, 4.0)],
                                  "cluster bigint, item_id bigint, score double")
    seen = spark.createDataFrame([(1, 10), (1, 11), (1, 99), (1, None), (3, 10), (3, 10), (None, 10)], "user_id bigint, item_id bigint")
    out = M.recommend_user_cluster(clusters, lists, seen, 2)
    assert "hashpartitioning(user_id" in plan(out) and ", item_id" not in "".join(x for x in plan(out).splitlines() if "hashpartitioning" in x)
    got = {(r.user_id, r.item_id, r["rank"]): r.score for r in out.collect()}
    assert got == {(1, 12, 1): 1.0, (1, None, 2): 0.5, (2, 10, 1): 1.0, (2, 11, 2): pytest.approx(2 / 3), (3, 13, 1): 1.0,
                   (None, 10, 1): 1.0, (None, 13, 2): 0.8, (5, 10, 1): 1.0, (5, 13, 2): 0.8}


def test_topics_of_lists_are_those_of_rows(spark):
    tags = [(u, t) for u in range(12) for t in ("abc" if u % 2 else "xyz")]
    single = spark.createDataFrame(tags, "user_id bigint, tag string")
    listed = spark.createDataFrame([(u, ts) for u in range(12) for ts in ((["a", "b"], ["c"]) if u % 2 else (["x"], ["y", "z"]))],
                                   "user_id bigint, tags array<string>")
    for given in (single, listed):
        users, terms = M.fit_topics(given, k=2, iters=3, seed=1)
        assert users.count() == 24 and {r.tag for r in terms.collect()} == set("abcxyz")
        assert "ObjectHashAggregate" not in plan(users)                  # the documents are read back


def test_unseen_items_of_lists(spark):
    picks = [(1, "p"), (1, "q"), (2, "q"), (2, "q"), (3, "r"), (None, "p"), (4, None)]
    lists = [("p", 1), ("p", 2), ("q", 2), ("q", 3), ("q", None), ("q", 3), ("r", 9), (None, 7)] + [("r", i) for i in range(100, 200)]
    seen = [(1, 2), (2, 3), (2, 3), (3, 150), (3, 1), (1, None), (None, 1)]
    p = spark.createDataFrame(picks, "user_id bigint, k string")
    ls = spark.createDataFrame(lists, "k string, item_id bigint")
    s = spark.createDataFrame(seen, "user_id bigint, item_id bigint")
    out = RK.exclude_seen(p, s, lists=ls)
    plain = RK.exclude_seen(p.join(ls, "k").select("user_id", "item_id").distinct(), s)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert out.columns == plain.columns and sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    assert plan(out).rstrip().splitlines()[2 if "AdaptiveSparkPlan" in plan(out) else 1].find("Exchange") < 0


def test_pages_come_in_short_batches(spark):
    pages = spark.createDataFrame([("<p>a <b>c</b></p>",), (None,), ("<p>x</p><p>y</p>",)], "html string")
    out = pages.select(matches(pages.html, [Attribute("p", "p")]).alias("m"))
    assert "ArrowEvalPython" not in plan(out)
    assert [r.m for r in out.collect()] == [[["a c"]], [[]], [["x", "y"]]]


def test_recent_items_of_sorted_lists_are_dealt_once(spark, tmp_path):
    for name, table in {
            "lineitem": spark.range(40).selectExpr("id AS l_orderkey", "id % 9 AS l_partkey", "1 AS l_linenumber", "1.0D AS l_quantity", "'A' AS l_returnflag"),
            "orders": spark.range(40).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey", "timestamp_seconds(id) AS o_orderdate"),
            "embeddings": spark.range(9).selectExpr("id AS vec_id", "array(1.0F, CAST(id AS FLOAT)) AS embedding", "0 AS label")}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    out = load_all()["m15_sort_by_vectors"][0](spark, str(tmp_path))
    assert "orders.parquet" not in plan(out) and "WindowGroupLimit" not in plan(out)
    assert sorted(r["rank"] for r in out.collect()) == sorted(2 * list(range(1, 10)))
