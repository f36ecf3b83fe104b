"""Small exact cases from FIXTURES.md (reference unit tests and own cases)."""

import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import features as FE
from cairn.functions import scalars as S
from cairn.operators import affinity as AF
from cairn.operators import catalog as C
from cairn.operators import graph as G
from cairn.operators import minhash as MH
from cairn.operators import popularity as POP
from cairn.operators import recommend as RC
from cairn.operators import rules as RU
from cairn.operators import sessions as SS
from cairn.operators import similarity as SIM


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# fixtures 1-2: URL path templates
@pytest.mark.parametrize("path,expected", [
    ("/users/22/recommendations", "/users/{userid}/recommendations"),
    ("/users/22/actions", "/users/{userid}/actions"),
    ("/items/7/actions", "/items/{itemid}/actions"),
    ("/users/22/actions/7", "/users/{userid}/actions/{itemid}"),
    ("/items/7/actions/22", "/items/{itemid}/actions/{userid}"),
    ("/actions/99", "/actions/{actionid}"),
    ("/items/7", "/items/{itemid}"),
    ("/js/users/1/recommendations", "/js/users/1/recommendations"),
])
def test_normalize_path(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(S.normalize_path("p").alias("t")).first()["t"] == expected


# fixtures 5-6: MinHash similarity of overlapping user sets
def test_minhash_jaccard(spark):
    ev = [(1, u, 0.0) for u in range(1, 100)] + [(2, u, 0.0) for u in range(51, 100)]
    df = spark.createDataFrame(ev, "item_id long, user_id long, t double")
    out = MH.minhash_similarity(df, 100, h=100, seed=1, min_activity=1).collect()
    assert len(out) == 1 and abs(out[0]["jaccard"] - 0.5) <= 0.15
    assert MH.minhash_similarity(df, 100, h=100, seed=1, min_activity=200).count() == 0


# fixtures 7-8: tag co-occurrence
def test_tag_similarity(spark):
    dt = spark.createDataFrame([(1, "football"), (1, "soccer"), (2, "money"), (2, "finance"), (3, "football"), (4, "money")],
                               "doc_id long, tag string")
    j = SIM.tag_similarity(dt, "jaccard").filter("tag = 'football'")
    assert rows(j, "other", "score") == [("soccer", 0.5)]
    assert SIM.tag_similarity(dt, "jaccard", max_share=0.1).filter("tag = 'football'").count() == 0
    a = SIM.tag_similarity(dt, "asym").filter("tag = 'football'")
    assert rows(a, "other", "score") == [("soccer", 1.0)]
    assert SIM.tag_similarity(dt, "asym", min_count=10).filter("tag = 'football'").count() == 0


def _sets(spark, data):
    return spark.createDataFrame(data, "user_id long, alg string, alg_order int, item_id long, score double")


# fixtures 9-10: rank-sum combiner
def test_rank_sum(spark):
    a = [(1, "A", 0, 2, 2.0), (1, "A", 0, 1, 1.0)]
    b = [(1, "B", 1, 3, 3.0), (1, "B", 1, 2, 2.0), (1, "B", 1, 1, 1.0)]
    out = RC.combine_rank_sum(_sets(spark, a + b), 2)
    assert rows(out, "item_id", "score") == [(1, 1.0), (2, 3.0), (3, 2.0)]
    strict = RC.combine_rank_sum(_sets(spark, [(1, "Z", 0, 1, 1.0)] + a), 2, strict=True)
    alone = RC.combine_rank_sum(_sets(spark, a), 2)
    assert rows(strict, "item_id", "score") == rows(alone, "item_id", "score")


# fixture 11: first-successful and score-order combiners
def test_first_and_score_combiners(spark):
    sets = [(1, "a", 0, 1, 1.0), (1, "b", 1, 2, 2.0), (1, "b", 1, 3, 1.0), (1, "c", 2, 4, 3.0), (1, "c", 2, 5, 2.0), (1, "c", 2, 2, 5.0)]
    df = _sets(spark, sets)
    assert rows(RC.combine_first(df, 2), "alg") == [("b",), ("b",)]
    assert rows(RC.combine_first(df, 4), "alg") == [("c",), ("c",), ("c",)]
    top = RC.combine_score(df, 1).first()
    assert (top["item_id"], top["score"]) == (2, 5.0)


# fixture 12: recent interactions
def test_recent_interactions(spark):
    a = spark.createDataFrame([(1, 2, 10, 0, 0), (1, 1, 20, 0, 0)], "user_id long, item_id long, t long, order_key long, line_no int")
    assert rows(SS.recent_interactions(a, 10, 2), "item_id", "score") == [(1, 1.0), (2, 0.5)]


# fixture 14: popular in session, depth 1
def test_popular_in_session(spark):
    recent = spark.createDataFrame([(1, 1, 1)], "user_id long, item_id long, recent_rank long")
    idim = spark.createDataFrame([(1, 1)], "item_id long, dim_id int")
    top = spark.createDataFrame([(1, 22, 10.0), (1, 21, 9.0), (1, 20, 8.0)], "dim_id int, item_id long, count double")
    seen = spark.createDataFrame([(1, 1)], "user_id long, item_id long")
    out = RC.recommend_popular_in_session(recent, idim, top, 2, seen)
    assert rows(out, "item_id") == [(21,), (22,)]


# fixture 17: binary feature
def test_binary_feature(spark):
    df = spark.createDataFrame([("something",), (None,), ("2",), ("0",), ("",)], "a string")
    assert [r["b"] for r in df.select(S.binary_feature("a").alias("b")).collect()] == [1, 0, 1, 0, 0]


# fixture 18: split feature over two columns, numbers ignored
def test_split_feature(spark):
    df = spark.createDataFrame([("a b", "c d"), ("word1", "word2"), ("x 12", None)], "a string, b string")
    out = [r["t"] for r in df.select(S.split_feature(["a", "b", "missing"], ignore_numbers=True, df_columns=df.columns).alias("t")).collect()]
    assert out == [["a", "b", "c", "d"], ["word1", "word2"], ["x"]]


# fixture 19: feature ids
def test_feature_id(spark):
    df = spark.createDataFrame([("type1",), ("type2",), ("type1",)], "v string")
    m = FE.FeatureId("v", "id", max_classes=1, exclude_missing=True).fit(df)
    out = m.transform(df).collect()
    assert len(out) == 2 and all(r["id"] == 1 for r in out)
    m2 = FE.FeatureId("v", "id", min_size=2, exclude_missing=True).fit(df)
    assert m2.transform(df).count() == 2


# fixture 20: svmlight
def test_svmlight(spark):
    df = spark.createDataFrame([(1, 1.2)], "k long, a double")
    line, _ = FE.svmlight_features(df, "k", ["a"])
    assert line.first()["svm"] == "1:1.200000"


# fixtures 21-25: automatic transforms
def test_auto_transform(spark):
    df = spark.createDataFrame([("true", "x", 9.0, "c"), ("false", "x", 12.0, "c")], "b string, const string, a double, dup string")
    at = FE.AutoTransform(drop_duplicates=True).fit(df)
    assert "const" in at.drop and "b" in at.bools
    out = at.transform(df).collect()
    assert sorted(r["b"] for r in out) == [0, 1]
    at2 = FE.AutoTransform(min_max_limit=True).fit(spark.createDataFrame([(9.0,), (12.0,)], "a double"))
    t = at2.transform(spark.createDataFrame([(1.0,), (15.0,)], "a double")).collect()
    assert [round(r["a"], 6) for r in t] == [-1.0, 1.0]
    miss = FE.AutoTransform().fit(spark.createDataFrame([("true",), ("false",), ("",)], "c string"))
    assert "c" in miss.cats
    assert sorted((r["c"] for r in miss.transform(spark.createDataFrame([("",)], "c string")).collect())) == ["UKN"]


def test_date_feature_hour_sine(spark):
    df = spark.createDataFrame([("30JAN14:15:11:00",)], "d string").select(F.to_timestamp("d", "ddMMMyy:HH:mm:ss").alias("ts"))
    r = df.select(*S.date_features("ts", "ts", ("h",))).first()
    assert abs(r["ts_h_sin"] - math.sin(2 * math.pi * 15 / 24)) < 1e-9 and abs(r["ts_h_sin"] + 0.7071) < 1e-3


# fixture 28: sessions split by gap
def test_session_items(spark):
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 5), (1, "c", 700)], "user_id long, item_id string, t long")
    for bw in (None, 100):
        out = SS.session_items(a, 600, bucket_width=bw)
        assert rows(out, "session_no", "items") == [(1, "a b"), (2, "c")]


# fixture 29: session seconds truncated per gap, min 1 s
def test_session_metrics(spark):
    imps = spark.createDataFrame([(1, 0, 0, "c", "baseline"), (1, 1_900_000, 1, "c", "baseline"), (1, 3_800_000, 2, "c", "baseline"),
                                  (2, 0, 3, "c", "normal")], "user_id long, t_us long, event_id long, consumer string, abkey string")
    m = SS.session_metrics(imps, 600_000_000, 50)
    assert rows(m, "user_id", "secs", "pv") == [(1, 2, 3), (2, 1, 1)]


# fixture 30: baskets
def test_baskets(spark):
    a = spark.createDataFrame([(1, "a", "add", 0, 0), (1, "b", "add", 10, 1), (1, "a", "rm", 20, 2), (1, "c", "add", 5000, 3)],
                              "user_id long, item_id string, event_type string, t_us long, event_id long")
    out = SS.baskets(a, "add", "rm", 1000)
    assert rows(out, "basket") == [("b",), ("c",)]
    # a gap before a removal does not split
    a2 = spark.createDataFrame([(1, "a", "add", 0, 0), (1, "b", "add", 10, 1), (1, "a", "rm", 9000, 2)],
                               "user_id long, item_id string, event_type string, t_us long, event_id long")
    assert rows(SS.baskets(a2, "add", "rm", 1000), "basket") == [("b",)]


# fixture 31: CTR without clicks
def test_ctr_zero(spark):
    imps = spark.createDataFrame([("c", "IMP", "2024-01-01 00:00:00")], "consumer string, click string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    from cairn.operators.analytics import ctr_daily
    assert ctr_daily(imps).count() == 0 and ctr_daily(imps, include_zero=True).count() == 1


# fixture 32: tag-affinity cap drops the user
def test_tag_affinity_cap(spark):
    acts = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 100 + i) for i in range(20)], "user_id long, item_id long")
    tags = spark.createDataFrame([(i, f"t{k}") for i in range(20) for k in range(6)] + [(100 + i, "other") for i in range(20)],
                                 "item_id long, tag string")
    full = AF.user_tag_affinity(acts, tags, 1, 4, 0.2, max_tags=None)
    assert full.filter("user_id = 1").count() == 6
    assert AF.user_tag_affinity(acts, tags, 1, 4, 0.2, max_tags=5).filter("user_id = 1").count() == 0


# fixture 33: decayed count closed form
def test_decayed_counts(spark):
    df = spark.createDataFrame([(1, 0), (1, 10)], "k long, t long")
    c = POP.decayed_counts(df, ["k"], 10.0, 20).first()["count"]
    assert abs(c - (math.exp(-2) + math.exp(-1))) < 1e-12


# fixture 35: item cosine
def test_item_cosine(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b")], "user_id long, item_id string")
    for chunk in (1, 2000):
        s = SIM.item_similarity(a, chunk=chunk).first()
        assert abs(s["sim"] - 2 / math.sqrt(6)) < 1e-12


# fixtures 36-37: association rules and one-item baskets
def test_assoc_rules(spark):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "basket_id long, item string")
    fi = RU.frequent_itemsets(b, 0.1)
    supp = {tuple(r["items"]): r["support"] for r in fi.collect()}
    assert abs(supp[("a", "b")] - 0.4) < 1e-12
    rules = RU.assoc_rules(b, 0.1, 0.0, -1.0)
    r = rules.filter("antecedent = array('a') and consequent = 'b'").first()
    assert abs(r["confidence"] - 2 / 3) < 1e-12 and abs(r["lift"] - (2 / 3) / 0.6) < 1e-12
    baskets = b.sparkSession.createDataFrame([(7, ["a"])], "user_id long, basket array<string>")
    assert RU.recommend_assoc(rules, baskets).filter("consequent = 'b'").count() == 1


# fixture 38: id resolution
def test_resolve_user_ids(spark):
    df = spark.createDataFrame([("c", "u1", 0), ("c", "u1", 5), ("c", "u2", 0)], "client string, client_userid string, userid long")
    assert rows(C.resolve_user_ids(df), "client_userid", "userid") == [("u1", 5), ("u1", 5)]


# fixture 39: ignored recommendations
def test_ignored_recs(spark):
    shown = spark.createDataFrame([(1, 1, "5:6:7")], "user_id long, list_id long, recommendations string")
    clicks = spark.createDataFrame([(1, 1, 7)], "user_id long, list_id long, clicked long")
    assert rows(RC.ignored_recs(shown, clicks), "item_id") == [(5,), (6,)]


# fixture 40: triangle cohesion
def test_cohesion(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    kept, vs = G.cohesion_graph(e, 1)
    assert rows(kept, "src", "dst", "triangles") == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


# fixture 41: bounded path expansion
def test_expand_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "src string, dst string, weight double")
    src = spark.createDataFrame([("a",)], "source string")
    out = {r["v"]: r["cost"] for r in G.expand_paths(e, src, 5, hops=2).collect()}
    assert abs(out["c"] - 0.2) < 1e-12 and abs(out["b"] - 0.1) < 1e-12
