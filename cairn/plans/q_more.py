"""Registered queries: n-gram recommender, vocabulary vectors, class ids,
cluster suggestion, tag-cluster exclusion, term search (M21, A21, A22, R9, R19, M32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import features as FE
from cairn.operators import affinity as AF
from cairn.operators import models as M
from cairn.operators import recommend as RC
from cairn.operators import sessions as SS
from cairn.plans import derived as D
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.q_sessions import DAY_US, NGRAM_SQL
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


@query("m21_recommend_ngram", NGRAM_SQL + """,
p2 AS (SELECT user_id, item_id, t_us, event_id, lag(item_id) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS pi FROM clicks),
dd AS (SELECT * FROM p2 WHERE pi IS NULL OR pi <> item_id),
l2 AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS q FROM dd),
sq AS (SELECT user_id, max(item_id) FILTER (WHERE q = 1) AS x1, max(item_id) FILTER (WHERE q = 2) AS x2, COUNT(*) FILTER (WHERE q <= 2) AS n FROM l2 GROUP BY user_id),
hs AS (SELECT user_id, CAST(x1 AS VARCHAR) AS hist, 2 AS n FROM sq UNION ALL
       SELECT user_id, CAST(x2 AS VARCHAR) || ' ' || CAST(x1 AS VARCHAR), 3 FROM sq WHERE n = 2),
cd AS (SELECT hs.user_id, CAST(string_split(model.gram, ' ')[-1] AS BIGINT) AS item_id, model.prob FROM hs JOIN model ON hs.n = model.n AND hs.hist = model.hist),
sc AS (SELECT user_id, item_id, SUM(prob) AS score FROM cd GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc)
SELECT user_id, item_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_m21(spark, d):
    c = V.clicks(spark, d)
    model = SS.ngram_model(c, 3, order=("t_us", "event_id"), bucket_width=DAY_US)
    out = SS.recommend_ngram(model, c, 5, order=("t_us", "event_id"), bucket_width=DAY_US)
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("m21_recommend_ngram_all", NGRAM_SQL + """,
p2 AS (SELECT user_id, item_id, t_us, event_id, lag(item_id) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS pi FROM clicks),
dd AS (SELECT * FROM p2 WHERE pi IS NULL OR pi <> item_id),
l5 AS (SELECT user_id, item_id, 6 - row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS q FROM dd QUALIFY q >= 1),
hs AS (SELECT user_id, CAST(item_id AS VARCHAR) AS hist, 2 AS n FROM l5 UNION ALL
       SELECT a.user_id, concat(a.item_id, ' ', b.item_id), 3 FROM l5 a JOIN l5 b ON b.user_id = a.user_id AND b.q = a.q + 1 UNION ALL
       SELECT a.user_id, concat(a.item_id, ' ', b.item_id, ' ', c.item_id), 4 FROM l5 a JOIN l5 b ON b.user_id = a.user_id AND b.q = a.q + 1
         JOIN l5 c ON c.user_id = a.user_id AND c.q = a.q + 2),
cd AS (SELECT hs.user_id, CAST(string_split(model.gram, ' ')[-1] AS BIGINT) AS item_id, model.prob FROM hs JOIN model ON hs.n = model.n AND hs.hist = model.hist),
sc AS (SELECT user_id, item_id, round(SUM(prob), 9) AS score FROM cd
       WHERE NOT EXISTS (SELECT 1 FROM l5 WHERE l5.user_id = cd.user_id AND l5.item_id = cd.item_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc)
SELECT user_id, item_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_m21_all(spark, d):
    c = V.clicks(spark, d)
    model = SS.ngram_model(c, 3, order=("t_us", "event_id"), bucket_width=DAY_US)
    out = SS.recommend_ngram_all(model, c, 5, order=("t_us", "event_id"), bucket_width=DAY_US)
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("a21_doc_vectors", """
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
v AS (SELECT term, CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_index FROM
      (SELECT term, COUNT(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 500))
SELECT t.doc_id, v.term_index, COUNT(*) AS count FROM t JOIN v ON t.term = v.term GROUP BY ALL""")
def q_a21(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.explode(FE.tokenize(F.col("text"))).alias("term"))
    return AF.doc_vectors(docs, 500)


@query("a22_class_ids", """
SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS class_id FROM (SELECT DISTINCT event_type FROM events)""")
def q_a22(spark, d):
    return AF.class_ids(V.table(spark, d, "events"), "event_type")


R9_SQL = W("actions", "item_tag", "item_dim") + """,
tc AS (SELECT t.tag, d.dim_id AS cluster_id, COUNT(*) AS c FROM item_tag t JOIN item_dim d ON t.item_id = d.item_id WHERE d.attr = 'type' GROUP BY ALL),
ts AS (SELECT tag, cluster_id, c / SUM(c) OVER (PARTITION BY tag) AS sim FROM tc),
ut AS (SELECT DISTINCT a.user_id, t.tag FROM actions a JOIN item_tag t ON a.item_id = t.item_id),
s AS (SELECT ut.user_id, ts.cluster_id, SUM(ts.sim) AS s FROM ut JOIN ts ON ut.tag = ts.tag WHERE ts.sim > 0.5 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, cluster_id) AS rank FROM s)"""


def _r9(spark, d):
    it = V.item_tag(spark, d)
    idim = V.item_dim(spark, d).filter("attr = 'type'")
    from pyspark.sql import Window
    tc = it.join(idim, "item_id").groupBy("tag", F.col("dim_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("c"))
    ts = tc.select("tag", "cluster_id", (F.col("c") / F.sum("c").over(Window.partitionBy("tag"))).alias("sim"))
    ut = V.actions(spark, d).select("user_id", "item_id").join(it, "item_id").select("user_id", "tag").distinct()
    return RC.suggest_clusters(ut, ts, top=3, min_sim=0.5)


@query("r9_suggest_clusters", R9_SQL + """
SELECT user_id, cluster_id, rank, round(0.5 * s / max(s) OVER (PARTITION BY user_id), 6) AS weight FROM rk WHERE rank <= 3""")
def q_r9(spark, d):
    return _r9(spark, d).select("user_id", "cluster_id", "rank", r("weight", "weight"))


@query("r19_exclude_by_tag_cluster", W("actions", "item_tag") + """,
uc AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS group_id, CAST(user_id % 3 AS INTEGER) AS cluster_id FROM (SELECT DISTINCT user_id FROM actions)),
ic AS (SELECT DISTINCT t.item_id, CASE WHEN length(t.tag) % 2 = 0 THEN 0 ELSE 1 END AS group_id, CAST(length(t.tag) % 3 AS INTEGER) AS ic FROM item_tag t),
cand AS (SELECT DISTINCT user_id, item_id FROM actions WHERE type = 1),
j AS (SELECT cand.user_id, cand.item_id, uc.cluster_id, ic.ic FROM cand JOIN uc ON cand.user_id = uc.user_id
      JOIN ic ON ic.item_id = cand.item_id AND ic.group_id = uc.group_id),
bad AS (SELECT DISTINCT user_id, item_id FROM j WHERE ic <> cluster_id
        EXCEPT SELECT DISTINCT user_id, item_id FROM j WHERE ic = cluster_id)
SELECT user_id, item_id FROM cand EXCEPT SELECT user_id, item_id FROM bad""")
def q_r19(spark, d):
    a = V.actions(spark, d)
    users = a.select("user_id").distinct()
    uc = users.select("user_id", F.when(F.col("user_id") % 2 == 0, 0).otherwise(1).alias("group_id"),
                      (F.col("user_id") % 3).cast("int").alias("cluster_id"))
    it = V.item_tag(spark, d)
    ic = it.select("item_id", F.when(F.length("tag") % 2 == 0, 0).otherwise(1).alias("group_id"),
                   (F.length("tag") % 3).cast("int").alias("cluster_id")).distinct()
    cands = a.filter("type = 1").select("user_id", "item_id").distinct()
    return RC.exclude_by_tag_cluster(cands, uc, ic)


@query("m32_search_terms")
def q_m32(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang", FE.tokenize(F.col("text")).alias("toks"))
    dv, tv = M.random_index_vectors(docs.select("doc_id", F.col("toks").alias("terms")), dim=64, dense=True)
    # one query per language: the sum of the vectors of its 10 most frequent terms
    freq = docs.select("lang", F.explode("toks").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    from cairn.operators.ranking import top_k
    qt = top_k(freq, ["lang"], [F.desc("n"), F.asc("term")], 10, rank_col=None)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    qv = qt.join(tv, "term").groupBy("lang").agg(F.collect_list("vec").alias("_v")) \
        .select("lang", F.aggregate("_v", F.array_repeat(F.lit(0.0), 64), plus).alias("vec"))
    out = M.search_vectors(dv.withColumnRenamed("doc_id", "id"), qv.withColumnRenamed("lang", "query"), 5)
    return out.select("query", "id", r("sim", "sim"), "rank")


@query("j1_join_items", W("actions", "item_tags") + """
SELECT a.user_id, a.item_id, a.order_key, a.line_no, t.tags FROM actions a JOIN item_tags t ON a.item_id = t.item_id WHERE a.type = 3""")
def q_j1(spark, d):
    from cairn.operators.catalog import join_items
    a = V.actions(spark, d).filter("type = 3").select("user_id", "item_id", "order_key", "line_no")
    return join_items(a, V.item_tags(spark, d))


@query("j2_broadcast_lookup", W("actions", "dimensions", "item_dim") + """
SELECT a.order_key, a.line_no, a.item_id, d.value AS brand FROM actions a JOIN item_dim i ON a.item_id = i.item_id
JOIN dimensions d ON d.dim_id = i.dim_id WHERE i.attr = 'brand'""")
def q_j2(spark, d):
    from cairn.operators.catalog import lookup
    idim = V.item_dim(spark, d).filter("attr = 'brand'").select("item_id", "dim_id")
    dims = V.dimensions(spark, d).select("dim_id", F.col("value").alias("brand"))
    a = V.actions(spark, d).select("order_key", "line_no", "item_id")
    return lookup(lookup(a, idim, "item_id"), dims, "dim_id").select("order_key", "line_no", "item_id", "brand")


@query("j4_j5_anti_semi", W("actions") + """
SELECT DISTINCT user_id, item_id, 'without' AS kind FROM actions a WHERE type = 1
  AND NOT EXISTS (SELECT 1 FROM actions b WHERE b.type = 3 AND b.user_id = a.user_id AND b.item_id = a.item_id)
UNION ALL SELECT DISTINCT user_id, item_id, 'only' FROM actions a WHERE type = 1
  AND EXISTS (SELECT 1 FROM actions b WHERE b.type = 3 AND b.user_id = a.user_id AND b.item_id = a.item_id)""")
def q_j45(spark, d):
    from cairn.operators.catalog import only, without
    a = V.actions(spark, d)
    t1 = a.filter("type = 1").select("user_id", "item_id").distinct()
    t3 = a.filter("type = 3").select("user_id", "item_id")
    return without(t1, t3, ["user_id", "item_id"]).withColumn("kind", F.lit("without")) \
        .unionByName(only(t1, t3, ["user_id", "item_id"]).withColumn("kind", F.lit("only")))


@query("j6_co_occurring_pairs", """
WITH p AS (SELECT DISTINCT o.o_custkey AS u, p.p_brand AS b FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           JOIN part p ON p.p_partkey = l.l_partkey)
SELECT a.b AS item1, b.b AS item2, COUNT(*) AS co FROM p a JOIN p b ON a.u = b.u AND a.b < b.b GROUP BY ALL""")
def q_j6(spark, d):
    from cairn.operators.similarity import co_occurrence
    a = V.actions(spark, d).select("user_id", "item_id")
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"))
    ub = a.join(p, "item_id").select("user_id", F.col("brand").alias("item_id")).distinct()
    return co_occurrence(ub, chunk=8)


@query("w8_top_k", """
WITH x AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT c_nationkey, c_custkey, c_acctbal, rank FROM x WHERE rank <= 3""")
def q_w8(spark, d):
    from cairn.operators.ranking import top_k
    c = V.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return top_k(c, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("r14_strategy_cascade", W("actions") + """,
pop AS (SELECT item_id, COUNT(*) AS score FROM actions GROUP BY item_id),
us AS (SELECT DISTINCT user_id FROM actions),
c1 AS (SELECT us.user_id, pop.item_id, pop.score FROM us, pop
       WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = us.user_id AND a.item_id = pop.item_id)),
r1 AS (SELECT user_id, item_id, score / max(score) OVER (PARTITION BY user_id) AS score FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c1) WHERE rank <= 5),
st AS (SELECT user_id, item_id, CAST(SUM(COALESCE(least(CASE type WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 END * n,
            CASE type WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 END), 0.0)) AS DOUBLE) AS score
       FROM (SELECT user_id, item_id, type, COUNT(*) AS n FROM actions GROUP BY ALL) GROUP BY user_id, item_id),
st2 AS (SELECT * FROM st WHERE score > 0 AND item_id % 3 = 0),
rs AS (SELECT user_id, 'static' AS alg, 0 AS alg_order, item_id, score FROM st2 UNION ALL
       SELECT user_id, 'popular', 1, item_id, score FROM r1),
sz AS (SELECT user_id, alg, alg_order, COUNT(*) AS k FROM rs GROUP BY ALL),
pk AS (SELECT user_id, alg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k >= 5 THEN 0 ELSE 1 END,
        CASE WHEN k >= 5 THEN alg_order ELSE -k END, alg_order) AS q FROM sz) WHERE q = 1),
ch AS (SELECT rs.* FROM rs JOIN pk ON rs.user_id = pk.user_id AND rs.alg = pk.alg),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ch)
SELECT user_id, alg, item_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_r14(spark, d):
    from cairn.operators import popularity as POP
    a = V.actions(spark, d)
    static = POP.action_ratings(a, {1: (1.0, 3.0), 2: (0.5, 1.0)}).withColumnRenamed("rating", "score") \
        .filter("score > 0 and item_id % 3 = 0")
    pop = RC.recommend_popular(a, a.select("user_id"), 5)
    out = RC.recommend([("static", static), ("popular", pop)], 5, "first")
    return out.select("user_id", "alg", "item_id", r("score", "score"), "rank")
