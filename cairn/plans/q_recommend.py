"""Registered queries: recommendation composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import popularity as POP
from cairn.operators import recommend as RC
from cairn.operators.similarity import recent_items
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


ORDER_DESC = "t DESC, order_key DESC, line_no DESC, item_id DESC"
LAST_ITEM = f"""
li AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC}) AS q
       FROM actions) WHERE q = 1)"""


@query("r1_recommend_popular", W("actions") + """,
pop AS (SELECT item_id, COUNT(*) AS score FROM actions GROUP BY item_id),
us AS (SELECT DISTINCT user_id FROM actions),
c AS (SELECT us.user_id, pop.item_id, pop.score FROM us, pop
      WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = us.user_id AND a.item_id = pop.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c)
SELECT user_id, item_id, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_r1(spark, d):
    a = V.actions(spark, d)
    out = RC.recommend_popular(a, a.select("user_id"), 5)
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("r1_recommend_popular_dims", W("actions", "item_dim") + """,
pop AS (SELECT item_id, COUNT(*) AS score FROM actions WHERE item_id IN (SELECT item_id FROM item_dim WHERE dim_id IN (3, 4)) GROUP BY item_id),
us AS (SELECT DISTINCT user_id FROM actions),
c AS (SELECT us.user_id, pop.item_id, pop.score FROM us, pop
      WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = us.user_id AND a.item_id = pop.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c)
SELECT user_id, item_id, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_r1d(spark, d):
    a = V.actions(spark, d)
    out = RC.recommend_popular(a, a.select("user_id"), 5, V.item_dim(spark, d), [3, 4])
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("r2_reorder_by_popularity", W("actions") + """,
recs AS (SELECT DISTINCT user_id, item_id FROM actions WHERE type = 3),
pop AS (SELECT item_id, COUNT(*) AS score FROM actions WHERE type = 1 AND value > 40 GROUP BY item_id)
SELECT recs.user_id, recs.item_id, COALESCE(CAST(pop.score AS DOUBLE), 0.0) AS score FROM recs LEFT JOIN pop ON recs.item_id = pop.item_id""")
def q_r2(spark, d):
    a = V.actions(spark, d)
    recs = a.filter("type = 3").select("user_id", "item_id").distinct().withColumn("score", F.lit(1.0))
    pop = a.filter("type = 1 and value > 40").groupBy("item_id").agg(F.count(F.lit(1)).alias("score"))
    return RC.reorder_by_popularity(recs, pop).select("user_id", "item_id", "score")


@query("r3_recommend_recent", W("actions") + """,
us AS (SELECT DISTINCT user_id FROM actions),
c AS (SELECT us.user_id, p.p_partkey AS item_id FROM us, part p
      WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = us.user_id AND a.item_id = p.p_partkey)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id DESC) AS rank FROM c)
SELECT user_id, item_id, round(1.0 - (rank - 1) * (1.0 / 5), 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_r3(spark, d):
    a = V.actions(spark, d)
    items = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    out = RC.recommend_recent(items, a.select("user_id"), a, 5)
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("r3_recommend_recent_category", W("actions") + "," + LAST_ITEM + """,
uc AS (SELECT li.user_id, p.p_type AS category FROM li JOIN part p ON p.p_partkey = li.item_id),
c AS (SELECT uc.user_id, p.p_partkey AS item_id FROM uc JOIN part p ON p.p_type = uc.category
      WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = uc.user_id AND a.item_id = p.p_partkey)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id DESC) AS rank FROM c)
SELECT user_id, item_id, round(1.0 - (rank - 1) * (1.0 / 5), 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_r3c(spark, d):
    a = V.actions(spark, d)
    part = V.table(spark, d, "part")
    items = part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"))
    last = recent_items(a, 1, order=("t", "order_key", "line_no"))
    users = last.join(items, "item_id").select("user_id", "category")
    out = RC.recommend_recent(items, users, a, 5, category="category")
    return out.select("user_id", "item_id", r("score", "score"), "rank")


@query("r4_popular_in_session", W("actions", "item_dim") + "," + LAST_ITEM + """,
agg AS (SELECT i.item_id, d.dim_id, i.cnt AS count FROM
          (SELECT item_id, SUM(value + 1) AS cnt FROM actions GROUP BY item_id) i
          JOIN item_dim d ON i.item_id = d.item_id WHERE i.cnt >= 40),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim_id ORDER BY count DESC, item_id) AS rn FROM agg) WHERE rn <= 10),
ds AS (SELECT dim_id, item_id, count / max(count) OVER (PARTITION BY dim_id) AS s FROM dt),
ud AS (SELECT li.user_id, d.dim_id FROM li JOIN item_dim d ON d.item_id = li.item_id),
j AS (SELECT ud.user_id, ds.item_id, max(ds.s) AS score FROM ud JOIN ds ON ud.dim_id = ds.dim_id GROUP BY ALL),
un AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = j.user_id AND a.item_id = j.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM un)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 5""")
def q_r4(spark, d):
    a = V.actions(spark, d)
    idim = V.item_dim(spark, d)
    dim_top = POP.most_popular_by_dim(a, idim, k=10, min_count=40)
    rec = recent_items(a, 1, order=("t", "order_key", "line_no"))
    out = RC.recommend_popular_in_session(rec, idim, dim_top, 5, a.select("user_id", "item_id"))
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("r4_popular_in_session_depth", W("actions", "item_dim") + """,
l AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k,
             t, order_key, line_no FROM actions),
rec AS (SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS d
        FROM l WHERE k = 1) WHERE d <= 3),
agg AS (SELECT i.item_id, d.dim_id, i.cnt AS count FROM
          (SELECT item_id, SUM(value + 1) AS cnt FROM actions GROUP BY item_id) i
          JOIN item_dim d ON i.item_id = d.item_id WHERE i.cnt >= 40),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim_id ORDER BY count DESC, item_id) AS rn FROM agg) WHERE rn <= 10),
slot AS (SELECT rec.user_id, rec.d, a.a, dim.dim_id, dim.dim_id IN (SELECT dim_id FROM dt) AS has
         FROM rec CROSS JOIN (VALUES (0, 'brand'), (1, 'type'), (2, 'size')) a(a, attr)
         LEFT JOIN item_dim dim ON dim.item_id = rec.item_id AND dim.attr = a.attr),
c AS (SELECT s.user_id, s.d, s.a, dt.item_id, dt.count, row_number() OVER (PARTITION BY s.user_id, s.d, s.a ORDER BY dt.count DESC, dt.item_id) AS pos
      FROM slot s JOIN dt ON dt.dim_id = s.dim_id
      WHERE NOT EXISTS (SELECT 1 FROM actions x WHERE x.user_id = s.user_id AND x.item_id = dt.item_id)),
ls AS (SELECT s.user_id, s.d, s.a, max(c.count) AS top, min(c.count) / max(c.count) AS f, coalesce(s.has, false) AND count(c.item_id) = 0 AS void
       FROM slot s LEFT JOIN c ON c.user_id = s.user_id AND c.d = s.d AND c.a = s.a GROUP BY s.user_id, s.d, s.a, s.has),
lv AS (SELECT *, coalesce(sum(CAST(void AS INTEGER)) OVER (PARTITION BY user_id, d ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM ls),
lw AS (SELECT *, coalesce(product(CASE WHEN void THEN 1.0 ELSE coalesce(f, 1.0) END)
         OVER (PARTITION BY user_id, d, v ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS lowest FROM lv),
o AS (SELECT c.*, c.count / lw.top * lw.lowest AS s, row_number() OVER (PARTITION BY c.user_id ORDER BY c.d, c.a, c.pos) AS nr
      FROM c JOIN lw ON lw.user_id = c.user_id AND lw.d = c.d AND lw.a = c.a),
fo AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY nr) = 1 AS INTEGER) AS first FROM o),
ds AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY nr) AS size FROM fo),
full_at AS (SELECT user_id, min(nr) AS nr, arg_min(d, nr) AS d FROM ds WHERE size >= 15 GROUP BY user_id),
kept AS (SELECT ds.* FROM ds LEFT JOIN full_at u ON u.user_id = ds.user_id
         WHERE u.nr IS NULL OR ds.nr <= u.nr OR (ds.d > u.d AND ds.a = 0 AND ds.pos = 1)),
sc AS (SELECT user_id, item_id, round(sum(s), 12) AS score FROM kept GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 15""")
def q_r4_depth(spark, d):
    """The last three items, brand, type and size in this order."""
    a = V.actions(spark, d)
    idim = V.item_dim(spark, d)
    dim_top = POP.most_popular_by_dim(a, idim, k=10, min_count=40)
    out = RC.recommend_session_depth(recent_items(a, 3), idim, dim_top, 15, a.select("user_id", "item_id"),
                                     ["brand", "type", "size"], 3)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("r5_recommend_static", W("actions", "item_dim") + """,
w(type, per_action, max_sum) AS (VALUES (1, 1.0, 3.0), (2, 0.5, 1.0)),
pt AS (SELECT user_id, item_id, type, COUNT(*) AS n FROM actions GROUP BY ALL),
rt AS (SELECT user_id, item_id, SUM(COALESCE(least(w.per_action * pt.n, w.max_sum), 0.0)) AS score
       FROM pt LEFT JOIN w ON pt.type = w.type GROUP BY user_id, item_id),
f AS (SELECT * FROM rt WHERE score > 0 AND item_id IN (SELECT item_id FROM item_dim WHERE dim_id IN (1, 2, 3, 4, 5))),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM f)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 3""")
def q_r5(spark, d):
    rt = POP.action_ratings(V.actions(spark, d), {1: (1.0, 3.0), 2: (0.5, 1.0)}).withColumnRenamed("rating", "score")
    out = RC.recommend_static(rt, 3, V.item_dim(spark, d), [1, 2, 3, 4, 5])
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("r10_referrer_clusters", W("clicks") + """,
vis AS (SELECT event_id, 'http://site' || CAST(user_id % 5 AS VARCHAR) || '.com/path/' || CAST(item_id AS VARCHAR) AS referrer FROM clicks),
rm AS (SELECT 'http://site' || CAST(n_nationkey % 5 AS VARCHAR) || '.com' AS prefix, n_nationkey AS cluster_id FROM nation
       UNION ALL SELECT 'http://site' || CAST(n_regionkey AS VARCHAR) || '.com/path/' || CAST(n_nationkey AS VARCHAR), 100 + n_nationkey FROM nation)
SELECT vis.event_id, vis.referrer, rm.cluster_id FROM vis JOIN rm ON starts_with(vis.referrer, rm.prefix)""")
def q_r10(spark, d):
    c = V.clicks(spark, d)
    vis = c.select("event_id", F.concat(F.lit("http://site"), (F.col("user_id") % 5).cast("string"), F.lit(".com/path/"),
                                        F.col("item_id").cast("string")).alias("referrer"))
    n = V.table(spark, d, "nation")
    rm = n.select(F.concat(F.lit("http://site"), (F.col("n_nationkey") % 5).cast("string"), F.lit(".com")).alias("prefix"),
                  F.col("n_nationkey").alias("cluster_id")) \
        .unionByName(n.select(F.concat(F.lit("http://site"), F.col("n_regionkey").cast("string"), F.lit(".com/path/"),
                                       F.col("n_nationkey").cast("string")).alias("prefix"),
                              (F.col("n_nationkey") + 100).alias("cluster_id")))
    return RC.referrer_clusters(vis, rm).select("event_id", "referrer", "cluster_id")


RS_SQL = W("actions") + """,
rs AS (SELECT user_id, CASE type WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS alg, type - 1 AS alg_order, item_id, MAX(value) AS score
       FROM actions GROUP BY ALL)"""


def _rs(spark, d):
    a = V.actions(spark, d)
    return a.groupBy("user_id", F.when(F.col("type") == 1, "a").when(F.col("type") == 2, "b").otherwise("c").alias("alg"),
                     (F.col("type") - 1).alias("alg_order"), "item_id").agg(F.max("value").alias("score"))


@query("r11_combine_first", RS_SQL + """,
sz AS (SELECT user_id, alg, alg_order, COUNT(*) AS k FROM rs GROUP BY ALL),
pk AS (SELECT user_id, alg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k >= 12 THEN 0 ELSE 1 END,
        CASE WHEN k >= 12 THEN alg_order ELSE -k END, alg_order) AS q FROM sz) WHERE q = 1),
ch AS (SELECT rs.* FROM rs JOIN pk ON rs.user_id = pk.user_id AND rs.alg = pk.alg),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ch)
SELECT user_id, alg, item_id, score, rank FROM rk WHERE rank <= 12""")
def q_r11(spark, d):
    return RC.combine_first(_rs(spark, d), 12).select("user_id", "alg", "item_id", "score", "rank")


@query("r12_combine_rank_sum", RS_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, alg ORDER BY score DESC, item_id) - 1 AS r FROM rs)
SELECT user_id, item_id, CAST(SUM(5 - r) AS DOUBLE) AS score FROM rk WHERE r < 5 GROUP BY ALL""")
def q_r12(spark, d):
    return RC.combine_rank_sum(_rs(spark, d), 5)


@query("r12_combine_rank_sum_strict", RS_SQL + """,
ok AS (SELECT user_id, alg FROM rs GROUP BY ALL HAVING COUNT(*) >= 12),
rk AS (SELECT rs.*, row_number() OVER (PARTITION BY rs.user_id, rs.alg ORDER BY score DESC, item_id) - 1 AS r FROM rs
       JOIN ok ON rs.user_id = ok.user_id AND rs.alg = ok.alg)
SELECT user_id, item_id, CAST(SUM(12 - r) AS DOUBLE) AS score FROM rk WHERE r < 12 GROUP BY ALL""")
def q_r12s(spark, d):
    return RC.combine_rank_sum(_rs(spark, d), 12, strict=True)


@query("r13_combine_score", RS_SQL + """,
m AS (SELECT user_id, item_id, MAX(score) AS score FROM rs GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM m)
SELECT user_id, item_id, score, rank FROM rk WHERE rank <= 5""")
def q_r13(spark, d):
    return RC.combine_score(_rs(spark, d), 5)


@query("r15_diversify", W("actions") + """,
w(type, per_action, max_sum) AS (VALUES (1, 1.0, 3.0), (2, 0.5, 1.0)),
pt AS (SELECT user_id, item_id, type, COUNT(*) AS n FROM actions GROUP BY ALL),
rt AS (SELECT user_id, item_id, SUM(COALESCE(least(w.per_action * pt.n, w.max_sum), 0.0)) + item_id / 1e5 AS score
       FROM pt LEFT JOIN w ON pt.type = w.type GROUP BY user_id, item_id),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS k FROM rt) WHERE k <= 15),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(user_id AS VARCHAR) || '|' || CAST(item_id AS VARCHAR) || '|3')) AS h FROM c) WHERE h <= 5)
SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM pk""")
def q_r15(spark, d):
    rt = POP.action_ratings(V.actions(spark, d), {1: (1.0, 3.0), 2: (0.5, 1.0)})
    rt = rt.select("user_id", "item_id", (F.col("rating") + F.col("item_id") / 1e5).alias("score"))
    out = RC.diversify(rt, 5, 3, round_id=3)
    return out.select("user_id", "item_id", r("score", "score"), F.col("rank").cast("bigint").alias("rank"))


@query("r16_assign_variation", """
WITH b AS (SELECT c_custkey AS user_id, CAST(('0x' || substr(md5('ab|' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 + 1 AS bucket FROM customer)
SELECT user_id, bucket, CASE WHEN bucket <= 50 THEN 'baseline' WHEN bucket <= 80 THEN 'normal' WHEN bucket <= 100 THEN 'test' ELSE 'test' END AS variation FROM b""")
def q_r16(spark, d):
    users = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return RC.assign_variation(users, [("baseline", 0.5), ("normal", 0.3), ("test", 0.2)])


@query("r17_route_by_rectag", W("impressions") + """
SELECT event_id, rectag, COALESCE(s.strategy, 'popular') AS strategy FROM impressions i
LEFT JOIN (VALUES ('rt1', 'similarity'), ('rt2', 'clusters')) s(rt, strategy) ON i.rectag = s.rt""")
def q_r17(spark, d):
    strategies = spark.createDataFrame([("rt1", "similarity"), ("rt2", "clusters")], "rectag string, strategy string")
    out = RC.route_by_rectag(V.impressions(spark, d), strategies, "popular")
    return out.select("event_id", "rectag", "strategy")


@query("r18_candidates_popular", W("actions") + """
SELECT item_id FROM (SELECT item_id, COUNT(*) AS n FROM actions GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20)""")
def q_r18(spark, d):
    return RC.candidates("popular", actions=V.actions(spark, d), n=20)


@query("r20_map_dimensions", W("actions", "item_dim") + "," + LAST_ITEM + """,
rq AS (SELECT li.user_id, d.dim_id FROM li JOIN item_dim d ON d.item_id = li.item_id WHERE d.attr = 'brand'),
mp AS (SELECT DISTINCT rq.user_id, rq.dim_id AS from_dim, d2.dim_id AS to_dim FROM rq JOIN item_dim d2 ON d2.attr = 'type'
       JOIN li ON li.user_id = rq.user_id AND li.item_id = d2.item_id WHERE rq.user_id % 4 = 0)
SELECT rq.user_id, rq.dim_id, COALESCE(mp.to_dim, rq.dim_id) AS mapped_dim FROM rq LEFT JOIN mp ON rq.user_id = mp.user_id AND rq.dim_id = mp.from_dim""")
def q_r20(spark, d):
    a = V.actions(spark, d)
    idim = V.item_dim(spark, d)
    li = recent_items(a, 1, order=("t", "order_key", "line_no")).select("user_id", "item_id")
    rq = li.join(idim.filter("attr = 'brand'"), "item_id").select("user_id", "dim_id")
    mp = rq.filter(F.col("user_id") % 4 == 0).join(li, "user_id").join(
        idim.filter("attr = 'type'").select("item_id", F.col("dim_id").alias("to_dim")), "item_id") \
        .select("user_id", F.col("dim_id").alias("from_dim"), "to_dim").distinct()
    return RC.map_dimensions(rq, mp).select("user_id", "dim_id", "mapped_dim")


@query("r21_ignored_recs", W("impressions") + """,
sh AS (SELECT user_id, event_id AS list_id, recommendations, item_id FROM impressions),
ck AS (SELECT user_id, list_id, CASE WHEN list_id % 5 = 0 THEN 999 WHEN list_id % 3 = 0 THEN item_id WHEN list_id % 3 = 1
         THEN (item_id + 1) % 100 ELSE (item_id + 7) % 100 END AS clicked FROM sh),
ex AS (SELECT user_id, list_id, CAST(x.v AS BIGINT) AS item_id, CAST(x.p - 1 AS INTEGER) AS pos FROM sh,
       LATERAL (SELECT unnest(string_split(recommendations, ':')) AS v, generate_subscripts(string_split(recommendations, ':'), 1) AS p) x),
cp AS (SELECT ex.user_id, ex.list_id, min(ex.pos) AS cpos FROM ex JOIN ck ON ex.user_id = ck.user_id AND ex.list_id = ck.list_id AND ex.item_id = ck.clicked GROUP BY ALL)
SELECT ex.user_id, ex.list_id, ex.item_id, ex.pos FROM ex JOIN cp ON ex.user_id = cp.user_id AND ex.list_id = cp.list_id WHERE ex.pos < cp.cpos""")
def q_r21(spark, d):
    imp = V.impressions(spark, d)
    shown = imp.select("user_id", F.col("event_id").alias("list_id"), "recommendations", "item_id")
    lid = F.col("list_id")
    clk = shown.select("user_id", "list_id", F.when(lid % 5 == 0, F.lit(999)).when(lid % 3 == 0, F.col("item_id"))
                       .when(lid % 3 == 1, (F.col("item_id") + 1) % 100).otherwise((F.col("item_id") + 7) % 100)
                       .cast("bigint").alias("clicked"))
    return RC.ignored_recs(shown, clk)


@query("r22_explain", W("actions") + """,
pop AS (SELECT item_id, COUNT(*) AS n FROM actions GROUP BY item_id),
recs AS (SELECT item_id, CASE WHEN n % 3 = 0 THEN 'popular:v1' WHEN n % 3 = 1 THEN 'recent:v2' ELSE 'other' END AS recommender FROM pop),
ex(alg, locale, text) AS (VALUES ('popular', 'en', 'Popular now'), ('popular', 'fr', 'Populaire'), ('recent', 'en', 'New for you'))
SELECT recs.item_id, recs.recommender, COALESCE(l.text, e.text) AS explanation FROM recs
LEFT JOIN ex l ON l.alg = split_part(recs.recommender, ':', 1) AND l.locale = 'fr'
LEFT JOIN ex e ON e.alg = split_part(recs.recommender, ':', 1) AND e.locale = 'en'""")
def q_r22(spark, d):
    pop = V.actions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    recs = pop.select("item_id", F.when(F.col("n") % 3 == 0, "popular:v1").when(F.col("n") % 3 == 1, "recent:v2")
                      .otherwise("other").alias("recommender"))
    ex = spark.createDataFrame([("popular", "en", "Popular now"), ("popular", "fr", "Populaire"), ("recent", "en", "New for you")],
                               "alg string, locale string, text string")
    return RC.explain(recs, ex, "fr").select("item_id", "recommender", "explanation")


@query("r23_recent_items_with_tags", W("item_tags") + """
SELECT item_id, tags FROM item_tags WHERE list_has_any(string_split(tags, ','), ['ring', 'bolt']) ORDER BY item_id DESC LIMIT 20""")
def q_r23(spark, d):
    return RC.recent_items_with_tags(V.item_tags(spark, d), ["ring", "bolt"], 20).select("item_id", "tags")
