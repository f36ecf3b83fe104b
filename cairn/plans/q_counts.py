"""Registered queries: decayed counts, cluster counts and their recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import affinity as AF
from cairn.operators import popularity as POP
from cairn.operators import recommend as RC
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query

NOW = 1706745600          # 2024-02-01 00:00:00 UTC, the read time of all decayed counts
ALPHA = 7 * 86400.0       # decay constant (s)


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def clicks_s(spark, d):
    return V.clicks(spark, d).withColumn("t", F.col("t_us") / 1e6)


def user_clusters(spark, d):
    dims = V.item_dim(spark, d).filter("attr = 'brand'")
    uc = AF.user_dim_clusters(V.clicks(spark, d), dims, 10, 0.05, 3)
    return uc.select("user_id", F.col("dim_id").alias("cluster_id"), "weight")


def cluster_counts(spark, d):
    return POP.cluster_counts(clicks_s(spark, d), user_clusters(spark, d), ALPHA, NOW)


BASE = W("clicks", "item_dim") + f""",
cs AS (SELECT *, t_us / 1e6 AS t FROM clicks),
ua AS (SELECT user_id, item_id FROM clicks WHERE user_id IN (SELECT user_id FROM clicks GROUP BY user_id HAVING count(*) >= 10)),
ud AS (SELECT ua.user_id, d.dim_id FROM ua JOIN item_dim d ON ua.item_id = d.item_id WHERE d.attr = 'brand'),
uc0 AS (SELECT user_id, dim_id, COUNT(*) AS c FROM ud GROUP BY ALL),
g AS (SELECT dim_id, SUM(c) / (SELECT SUM(c) FROM uc0) AS gs FROM uc0 GROUP BY dim_id),
sh AS (SELECT uc0.user_id, uc0.dim_id, uc0.c / SUM(uc0.c) OVER (PARTITION BY uc0.user_id) AS weight, g.gs FROM uc0 JOIN g ON uc0.dim_id = g.dim_id),
pa AS (SELECT user_id, dim_id, weight FROM sh WHERE weight > gs + 0.05),
uclus AS (SELECT user_id, dim_id AS cluster_id, weight FROM pa WHERE dim_id IN (SELECT dim_id FROM pa GROUP BY dim_id HAVING COUNT(*) >= 3)),
ui AS (SELECT user_id, item_id, SUM(exp(-greatest({NOW} - t, 0) / {ALPHA})) AS c, max(t) AS mt FROM cs GROUP BY ALL),
cc AS (SELECT COALESCE(u.cluster_id, -1) AS cluster_id, ui.item_id, SUM(ui.c * COALESCE(u.weight, 1.0)) AS count, max(ui.mt) AS t
       FROM ui LEFT JOIN uclus u ON ui.user_id = u.user_id GROUP BY ALL)"""


@query("a15_decayed_counts", W("clicks") + f"""
SELECT item_id, round(SUM(exp(-greatest({NOW} - t_us / 1e6, 0) / {ALPHA})), 6) AS count,
       CAST(floor(max(t_us / 1e6)) AS BIGINT) AS t FROM clicks GROUP BY item_id""")
def q_a15(spark, d):
    out = POP.decayed_counts(clicks_s(spark, d), ["item_id"], ALPHA, NOW)
    return out.select("item_id", r("count", "count"), F.floor("t").cast("bigint").alias("t"))


@query("a8_user_clusters_clicks", BASE + "\nSELECT user_id, cluster_id, round(weight, 6) AS weight FROM uclus")
def q_a8c(spark, d):
    return user_clusters(spark, d).select("user_id", "cluster_id", r("weight", "weight"))


@query("a16_cluster_counts", BASE + "\nSELECT cluster_id, item_id, round(count, 6) AS count, CAST(floor(t) AS BIGINT) AS t FROM cc")
def q_a16(spark, d):
    return cluster_counts(spark, d).select("cluster_id", "item_id", r("count", "count"),
                                           F.floor("t").cast("bigint").alias("t"))


@query("a17_top_counts_cluster", BASE + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, item_id) AS rank FROM cc)
SELECT cluster_id, item_id, round(count, 6) AS count, rank FROM rk WHERE rank <= 5""")
def q_a17c(spark, d):
    out = POP.top_counts(cluster_counts(spark, d), 5)
    return out.select("cluster_id", "item_id", r("count", "count"), "rank")


@query("a17_top_counts_global", BASE + """,
gl AS (SELECT item_id, SUM(count) AS count FROM cc GROUP BY item_id),
rk AS (SELECT *, row_number() OVER (ORDER BY count DESC, item_id) AS rank FROM gl)
SELECT item_id, round(count, 6) AS count, rank FROM rk WHERE rank <= 10""")
def q_a17g(spark, d):
    out = POP.top_counts(cluster_counts(spark, d), 10, by="global")
    return out.select("item_id", r("count", "count"), "rank")


@query("a17_top_counts_dims", BASE + """,
f AS (SELECT * FROM cc WHERE item_id IN (SELECT item_id FROM item_dim WHERE dim_id IN (76, 77))
        AND item_id IN (SELECT item_id FROM item_dim WHERE attr = 'size' AND dim_id < 50)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, item_id) AS rank FROM f)
SELECT cluster_id, item_id, round(count, 6) AS count, rank FROM rk WHERE rank <= 5""")
def q_a17d(spark, d):
    idim = V.item_dim(spark, d)
    cc = cluster_counts(spark, d).join(
        idim.filter("attr = 'size' and dim_id < 50").select("item_id").distinct(), "item_id", "left_semi")
    out = POP.top_counts(cc, 5, item_dim=idim, dims=[76, 77])
    return out.select("cluster_id", "item_id", r("count", "count"), "rank")


TAG = "red"
TAGGED = BASE.replace(W("clicks", "item_dim"), W("clicks", "item_dim", "item_tags")) + f""",
tg AS (SELECT item_id FROM item_tags WHERE regexp_matches(tags, '(^|,)[ ]*{TAG}[ ]*(,|$)'))"""


@query("a17_top_counts_tag", TAGGED + """,
gl AS (SELECT item_id, SUM(count) AS count FROM cc WHERE item_id IN (SELECT item_id FROM tg) GROUP BY item_id),
rk AS (SELECT *, row_number() OVER (ORDER BY count DESC, item_id) AS rank FROM gl)
SELECT item_id, round(count, 6) AS count, rank FROM rk WHERE rank <= 20""")
def q_a17t(spark, d):
    out = POP.top_counts(cluster_counts(spark, d), 20, by="global", item_tags=V.item_tags(spark, d), tag=TAG)
    return out.select("item_id", r("count", "count"), "rank")


@query("a17_top_counts_tag_two_dims", TAGGED + """,
f AS (SELECT cc.* FROM cc WHERE item_id IN (SELECT item_id FROM tg) AND item_id IN (SELECT item_id FROM item_dim WHERE dim_id BETWEEN 1 AND 25)
        AND item_id IN (SELECT item_id FROM item_dim WHERE dim_id = 76)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, item_id) AS rank FROM f)
SELECT cluster_id, item_id, round(count, 6) AS count, rank FROM rk WHERE rank <= 5""")
def q_a17td(spark, d):
    """A tag, one of many dimensions (the brands) and a second dimension."""
    out = POP.top_counts(cluster_counts(spark, d), 5, item_dim=V.item_dim(spark, d), dims=range(1, 26), dim2=76,
                         item_tags=V.item_tags(spark, d), tag=TAG)
    return out.select("cluster_id", "item_id", r("count", "count"), "rank")


SIG = BASE + f""",
it AS (SELECT item_id, SUM(count) AS s FROM cc GROUP BY item_id),
sl AS (SELECT cluster_id, SUM(exp(-greatest({NOW} - t, 0) / {ALPHA})) AS sl FROM cc GROUP BY cluster_id),
sg AS (SELECT SUM(count) AS sg FROM cc),
x AS (SELECT cc.cluster_id, cc.item_id, cc.count, cc.count / sl.sl AS a, it.s / sg.sg AS b
      FROM cc JOIN it ON cc.item_id = it.item_id JOIN sl ON cc.cluster_id = sl.cluster_id, sg),
sc AS (SELECT cluster_id, item_id, count, (a - b) / greatest(a, b) * count AS score FROM x),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, item_id) AS rank FROM sc)"""


@query("a18_significant_counts", SIG + """
SELECT cluster_id, item_id, round(count, 6) AS count, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def q_a18(spark, d):
    out = POP.significant_counts(cluster_counts(spark, d), ALPHA, NOW, 5)
    return out.select("cluster_id", "item_id", r("count", "count"), r("score", "score"), "rank")


@query("a19_update_popularity", W("clicks") + f""",
o AS (SELECT item_id, CAST(COUNT(*) AS DOUBLE) AS score, CAST(floor(max(t_us) / 1000000) AS BIGINT) AS t FROM clicks
      WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'view' GROUP BY item_id),
b AS (SELECT item_id, COUNT(*) AS count FROM clicks WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'click' GROUP BY item_id)
SELECT COALESCE(o.item_id, b.item_id) AS item_id,
  round(CASE WHEN b.count IS NULL THEN o.score WHEN o.score IS NULL THEN CAST(b.count AS DOUBLE)
       ELSE b.count + o.score * exp(-greatest({NOW} - o.t, 0) / 82400.0) END, 6) AS score,
  CASE WHEN b.count IS NULL THEN o.t ELSE CAST({NOW} AS BIGINT) END AS t
FROM o FULL OUTER JOIN b ON o.item_id = b.item_id""")
def q_a19(spark, d):
    c = V.clicks(spark, d)
    old = c.filter((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("event_type") == "view")) \
        .groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"),
                                F.floor(F.max("t_us") / 1_000_000).cast("bigint").alias("t"))
    batch = c.filter((F.col("ts") >= F.lit("2024-01-16").cast("timestamp")) & (F.col("event_type") == "click")) \
        .groupBy("item_id").agg(F.count(F.lit(1)).alias("count"))
    out = POP.update_popularity(old, batch, NOW)
    return out.select("item_id", r("score", "score"), "t")


R6_SQL = BASE + """,
top AS (SELECT * FROM (SELECT cluster_id, item_id, count AS c, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, item_id) AS k
        FROM cc) WHERE k <= 25),
tm AS (SELECT *, max(c) OVER (PARTITION BY cluster_id) AS m FROM top),
j AS (SELECT u.user_id, tm.item_id, tm.c / tm.m * u.weight * 1.0 AS s FROM uclus u JOIN tm ON u.cluster_id = tm.cluster_id WHERE tm.m > 0),
un AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = j.user_id AND c.item_id = j.item_id)),
agg AS (SELECT user_id, item_id, SUM(s) AS score FROM un GROUP BY ALL),
en AS (SELECT * FROM agg WHERE user_id IN (SELECT user_id FROM agg GROUP BY user_id HAVING COUNT(*) >= 3)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM en)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 5"""


@query("r6_cluster_count_recs", R6_SQL)
def q_r6(spark, d):
    seen = V.clicks(spark, d).select("user_id", "item_id")
    out = RC.recommend_cluster_counts(cluster_counts(spark, d), user_clusters(spark, d), seen, 5, min_items=3)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("r7_sort_by_clusters", BASE + """,
last AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY max(t_us) DESC, item_id DESC) AS q
         FROM clicks GROUP BY user_id, item_id) WHERE q <= 10),
j AS (SELECT l.user_id, l.item_id, SUM(cc.count * u.weight) AS score FROM last l JOIN uclus u ON l.user_id = u.user_id
      JOIN cc ON cc.cluster_id = u.cluster_id AND cc.item_id = l.item_id GROUP BY ALL HAVING SUM(cc.count * u.weight) > 0)
SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM j""")
def q_r7(spark, d):
    from cairn.operators.similarity import recent_items
    last = recent_items(V.clicks(spark, d), 10, order=("t_us",))
    out = RC.sort_by_clusters(last, cluster_counts(spark, d), user_clusters(spark, d))
    return out.select("user_id", "item_id", r("score", "score"), F.col("rank").cast("bigint").alias("rank"))


@query("r8_tag_affinity_recs", W("actions", "item_tag") + """,
a AS (SELECT user_id, item_id FROM actions WHERE user_id IN (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) >= 10)),
acts AS (SELECT a.* FROM a WHERE item_id IN (SELECT item_id FROM item_tag)),
tags AS (SELECT a.user_id, t.tag FROM a JOIN item_tag t ON a.item_id = t.item_id),
gl AS (SELECT tag, COUNT(*) / (SELECT COUNT(*) FROM acts) AS g FROM tags GROUP BY tag),
docs AS (SELECT user_id, COUNT(*) AS docs FROM acts GROUP BY user_id HAVING COUNT(*) >= 10),
tf AS (SELECT user_id, tag, COUNT(*) AS tf FROM tags GROUP BY ALL HAVING COUNT(*) > 4),
j AS (SELECT tf.user_id, tf.tag, (tf.tf / docs.docs - gl.g) / gl.g AS affinity FROM tf JOIN docs ON tf.user_id = docs.user_id JOIN gl ON tf.tag = gl.tag),
p AS (SELECT * FROM j WHERE affinity > 0.2),
aff AS (SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY user_id HAVING COUNT(*) <= 5)),
pop AS (SELECT item_id, COUNT(*) AS count FROM actions GROUP BY item_id),
tc AS (SELECT t.tag, t.item_id, pop.count FROM item_tag t JOIN pop ON t.item_id = pop.item_id),
top AS (SELECT *, max(count) OVER (PARTITION BY tag) AS m FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY count DESC, item_id) AS k FROM tc) WHERE k <= 50),
sc AS (SELECT aff.user_id, top.item_id, SUM(aff.affinity * top.count / top.m) AS score FROM aff JOIN top ON aff.tag = top.tag GROUP BY ALL),
un AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM actions x WHERE x.user_id = sc.user_id AND x.item_id = sc.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM un)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 5""")
def q_r8(spark, d):
    a = V.actions(spark, d)
    it = V.item_tag(spark, d)
    aff = AF.user_tag_affinity(a, it, 10, 4, 0.2, 5)
    pop = a.groupBy("item_id").agg(F.count(F.lit(1)).alias("count"))
    tc = it.join(pop, "item_id").select("tag", "item_id", "count")
    out = RC.recommend_tag_affinity(aff, tc, a.select("user_id", "item_id"), 5, per_tag=50)
    return out.select("user_id", "item_id", "rank", r("score", "score"))
