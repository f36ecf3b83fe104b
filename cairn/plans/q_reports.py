"""Registered queries: CTR / engagement reports, stats, affinity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import affinity as AF
from cairn.operators import analytics as AN
from cairn.plans import derived as D
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


CTR_SQL = """
SELECT {keys}, COUNT(*) FILTER (WHERE click = 'IMP') AS impressions, COUNT(*) FILTER (WHERE click = 'CTR') AS clicks,
       round(CASE WHEN COUNT(*) FILTER (WHERE click = 'IMP') > 0 THEN
         COUNT(*) FILTER (WHERE click = 'CTR') / COUNT(*) FILTER (WHERE click = 'IMP') * 100.0 END, 6) AS ctr
FROM (SELECT *, year(ts) AS y, month(ts) AS m, day(ts) AS d, COALESCE(rectag, 'default') AS rtag FROM impressions {where}) x
GROUP BY {keys} {having}"""


@query("a1_ctr_daily", W("impressions") + CTR_SQL.format(
    keys="consumer, y, m, d", where="", having="HAVING COUNT(*) FILTER (WHERE click = 'IMP') > 0 AND COUNT(*) FILTER (WHERE click = 'CTR') > 0"))
def q_a1(spark, d):
    out = AN.ctr_daily(V.impressions(spark, d))
    return out.select("consumer", "y", "m", "d", "impressions", "clicks", r("ctr", "ctr"))


@query("a1_ctr_daily_with_zero", W("impressions") + CTR_SQL.format(
    keys="consumer, y, m, d", where="WHERE user_id % 7 = 0 OR click = 'IMP'", having=""))
def q_a1z(spark, d):
    imp = V.impressions(spark, d).filter((F.col("user_id") % 7 == 0) | (F.col("click") == "IMP"))
    out = AN.ctr_daily(imp, include_zero=True)
    return out.select("consumer", "y", "m", "d", "impressions", "clicks", r("ctr", "ctr"))


@query("a2_ctr_by_rectag", W("impressions") + CTR_SQL.format(
    keys="consumer, abkey, rtag, y, m, d",
    where="WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')",
    having="HAVING COUNT(*) FILTER (WHERE click = 'IMP') > 0 AND COUNT(*) FILTER (WHERE click = 'CTR') > 0")
    .replace("SELECT consumer, abkey, rtag,", "SELECT consumer, abkey, rtag AS rectag,"))
def q_a2(spark, d):
    users = V.table(spark, d, "events").filter("event_type = 'signup'").select("user_id")
    out = AN.ctr_by_rectag(V.impressions(spark, d), users)
    return out.select("consumer", "abkey", "rectag", "y", "m", "d", "impressions", "clicks", r("ctr", "ctr"))


@query("a4_recency_percentiles", W("impressions", "actions") + """,
pub AS (SELECT item_id, min(ts) AS publish_ts FROM actions GROUP BY item_id),
ex AS (SELECT i.ts, CAST(unnest(string_split(i.recommendations, ':')) AS BIGINT) AS rec_item FROM impressions i WHERE click = 'IMP'),
j AS (SELECT year(ex.ts) AS y, month(ex.ts) AS m, day(ex.ts) AS d, hour(ex.ts) AS h,
             floor((epoch_us(ex.ts) - epoch_us(p.publish_ts)) / 1000000) AS recency
      FROM ex JOIN pub p ON ex.rec_item = p.item_id)
SELECT y, m, d, h, COUNT(*) AS n, round(quantile_cont(recency, 0.25), 6) AS p25, round(quantile_cont(recency, 0.5), 6) AS p50,
       round(quantile_cont(recency, 0.75), 6) AS p75, round(quantile_cont(recency, 0.9), 6) AS p90,
       round(quantile_cont(recency, 0.99), 6) AS p99
FROM j GROUP BY y, m, d, h""")
def q_a4(spark, d):
    pub = V.actions(spark, d).groupBy("item_id").agg(F.min("ts").alias("publish_ts"))
    out = AN.recency_percentiles(V.impressions(spark, d), pub)
    return out.select("y", "m", "d", "h", "n", *[r(c, c) for c in ("p25", "p50", "p75", "p90", "p99")])


@query("a5_unique_users", W("clicks") + """
SELECT user_id, COUNT(DISTINCT CAST(floor(epoch(ts) / 86400) AS BIGINT)) AS n_days, min('u' || CAST(user_id * 7 % 1000 AS VARCHAR)) AS client_userid
FROM clicks GROUP BY user_id HAVING COUNT(DISTINCT CAST(floor(epoch(ts) / 86400) AS BIGINT)) >= 28""")
def q_a5(spark, d):
    c = V.clicks(spark, d).withColumn("client_userid", F.concat(F.lit("u"), (F.col("user_id") * 7 % 1000).cast("string")))
    return AN.unique_users(c, 28)


@query("a14_impression_stats", W("impressions") + """
SELECT consumer, COALESCE(rectag, 'default') AS rectag, abkey, CAST(floor(t_us / 1000000) AS BIGINT) AS second,
       COUNT(*) FILTER (WHERE click = 'IMP') AS impressions, COUNT(*) FILTER (WHERE click = 'CTR') AS clicks
FROM impressions GROUP BY ALL""")
def q_a14i(spark, d):
    return AN.impression_stats(V.impressions(spark, d))


REQ_SQL = W("clicks") + """,
req AS (SELECT event_id, 'c' || CAST(user_id % 3 AS VARCHAR) AS consumer,
  CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS httpmethod,
  CASE event_type WHEN 'view' THEN '/users/' || CAST(user_id AS VARCHAR) || '/recommendations'
                  WHEN 'click' THEN '/items/' || CAST(item_id AS VARCHAR) || '/actions'
                  WHEN 'purchase' THEN '/users/' || CAST(user_id AS VARCHAR) || '/actions/' || CAST(item_id AS VARCHAR)
                  WHEN 'error' THEN '/js/' || CAST(item_id AS VARCHAR) || '/actions'
                  ELSE '/actions/' || CAST(event_id AS VARCHAR) END AS path,
  CAST(floor(value * 10) AS INTEGER) AS exectime, CAST(floor(t_us / 1000000) AS BIGINT) AS time FROM clicks),
tmpl AS (SELECT *, CASE WHEN starts_with(path, '/js') THEN path
       WHEN regexp_matches(path, '^(/users/)([^/]+)(/recommendations)$') THEN regexp_replace(path, '^(/users/)([^/]+)(/recommendations)$', '\\1{userid}\\3')
       WHEN regexp_matches(path, '^(/items/)([^/]+)(/actions)$') THEN regexp_replace(path, '^(/items/)([^/]+)(/actions)$', '\\1{itemid}\\3')
       WHEN regexp_matches(path, '^(/users/)([^/]+)(/actions/)([^/]+)$') THEN regexp_replace(path, '^(/users/)([^/]+)(/actions/)([^/]+)$', '\\1{userid}\\3{itemid}')
       WHEN regexp_matches(path, '^(/actions/)([^/]+)$') THEN regexp_replace(path, '^(/actions/)([^/]+)$', '\\1{actionid}')
       ELSE path END AS tpath FROM req)"""


@query("a14_request_stats", REQ_SQL + """
SELECT consumer, httpmethod, tpath AS path, time AS second, COUNT(*) AS count, round(avg(exectime), 6) AS exectime
FROM tmpl GROUP BY ALL""")
def q_a14r(spark, d):
    out = AN.request_stats(D.requests(spark, d))
    return out.select("consumer", "httpmethod", "path", "second", "count", r("exectime", "exectime"))


PRED_SQL = """
WITH p AS (SELECT vec_id, 'c' || CAST(vec_id % 3 AS VARCHAR) AS consumer, CASE WHEN label = 0 THEN 'v0' ELSE 'v1' END AS variation,
                  'm' || CAST(vec_id % 2 AS VARCHAR) AS model, CAST(vec_id * 10 AS BIGINT) AS time,
                  [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS s FROM embeddings),
x AS (SELECT p.*, u.i, u.v FROM p, LATERAL (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS i) u),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rn FROM x),
best AS (SELECT consumer, variation, model, time, CASE i WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS predicted_class, v AS score
         FROM b WHERE rn = 1)"""


@query("a14_prediction_stats", PRED_SQL + """
SELECT consumer, variation, model, predicted_class, time AS second, COUNT(*) AS count, round(avg(score), 6) AS score
FROM best GROUP BY ALL""")
def q_a14p(spark, d):
    out = AN.prediction_stats(D.predictions(spark, d))
    return out.select("consumer", "variation", "model", "predicted_class", "second", "count", r("score", "score"))


# ------------------------------------------------------------------ affinity

A8_SQL = W("actions", "item_dim") + """,
a AS (SELECT user_id, item_id FROM actions WHERE user_id IN (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) >= 10)),
ud AS (SELECT a.user_id, d.dim_id FROM a JOIN item_dim d ON a.item_id = d.item_id WHERE d.attr = 'brand'),
uc AS (SELECT user_id, dim_id, COUNT(*) AS c FROM ud GROUP BY ALL),
g AS (SELECT dim_id, SUM(c) / (SELECT SUM(c) FROM uc) AS gs FROM uc GROUP BY dim_id),
s AS (SELECT uc.user_id, uc.dim_id, uc.c / SUM(uc.c) OVER (PARTITION BY uc.user_id) AS weight, g.gs FROM uc JOIN g ON uc.dim_id = g.dim_id),
p AS (SELECT user_id, dim_id, weight FROM s WHERE weight > gs + 0.1)
SELECT user_id, dim_id, round(weight, 6) AS weight FROM p WHERE dim_id IN (SELECT dim_id FROM p GROUP BY dim_id HAVING COUNT(*) >= 5)"""


@query("a8_user_dim_clusters", A8_SQL)
def q_a8(spark, d):
    dims = V.item_dim(spark, d).filter("attr = 'brand'")
    out = AF.user_dim_clusters(V.actions(spark, d), dims, 10, 0.1, 5)
    return out.select("user_id", "dim_id", r("weight", "weight"))


def _aff_sql(cap: bool, analysis: bool, tag_filter: str = "") -> str:
    tf_filter = f"WHERE tag IN (SELECT tag FROM ({tag_filter}))" if tag_filter else ""
    body = W("actions", "item_tag") + f""",
a AS (SELECT user_id, item_id FROM actions WHERE user_id IN (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) >= 10)),
acts AS (SELECT a.* FROM a WHERE item_id IN (SELECT item_id FROM item_tag)),
tags AS (SELECT a.user_id, t.tag FROM a JOIN item_tag t ON a.item_id = t.item_id),
gl AS (SELECT tag, COUNT(*) / (SELECT COUNT(*) FROM acts) AS g FROM tags GROUP BY tag),
docs AS (SELECT user_id, COUNT(*) AS docs FROM acts GROUP BY user_id HAVING COUNT(*) >= 10),
tf AS (SELECT user_id, tag, COUNT(*) AS tf FROM tags {tf_filter} GROUP BY ALL HAVING COUNT(*) > 4),
j AS (SELECT tf.user_id, tf.tag, tf.tf, docs.docs, (tf.tf / docs.docs - gl.g) / gl.g AS affinity
      FROM tf JOIN docs ON tf.user_id = docs.user_id JOIN gl ON tf.tag = gl.tag),
p AS (SELECT * FROM j WHERE affinity > 0.2)"""
    if analysis:
        return body + "\nSELECT user_id, tag, round(affinity, 6) AS affinity, tf, docs FROM p"
    if cap:
        return body + "\nSELECT user_id, tag, round(affinity, 6) AS affinity FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY user_id HAVING COUNT(*) <= 5)"
    return body


@query("a9_user_tag_affinity", _aff_sql(True, False))
def q_a9(spark, d):
    out = AF.user_tag_affinity(V.actions(spark, d), V.item_tag(spark, d), 10, 4, 0.2, 5)
    return out.select("user_id", "tag", r("affinity", "affinity"))


@query("a10_tag_affinity_analysis", _aff_sql(False, True))
def q_a10(spark, d):
    out = AF.user_tag_affinity(V.actions(spark, d), V.item_tag(spark, d), 10, 4, 0.2, analysis=True)
    return out.select("user_id", "tag", r("affinity", "affinity"), "tf", "docs")


TAGDEF_SQL = """SELECT DISTINCT t.tag, CASE WHEN t.tag IN (SELECT lower(p_type) FROM part) THEN 'type' ELSE 'name' END AS "group",
    CASE WHEN t.tag IN (SELECT lower(p_type) FROM part) THEN 'type' ELSE 'name' END || '_' || substr(t.tag, 1, 1) AS cluster
    FROM item_tag t"""


@query("a11_user_tag_clusters", _aff_sql(False, False, TAGDEF_SQL) + f""",
defs AS ({TAGDEF_SQL}),
ids AS (SELECT tag, CAST(dense_rank() OVER (ORDER BY "group") - 1 AS INTEGER) AS group_id,
               CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS cluster_id FROM defs)
SELECT p.user_id, ids.group_id, ids.cluster_id, string_agg(p.tag, ',' ORDER BY p.tag) AS tags, COUNT(*) AS n_tags
FROM p JOIN ids ON p.tag = ids.tag GROUP BY ALL""")
def q_a11(spark, d):
    out, _ = AF.user_tag_clusters(V.actions(spark, d), V.item_tag(spark, d), D.tag_defs(spark, d), 10, 4, 0.2)
    return out.withColumn("group_id", F.col("group_id").cast("int")).withColumn("cluster_id", F.col("cluster_id").cast("int"))


@query("a12_user_tag_counts", W("actions", "item_tag") + """,
a AS (SELECT user_id, item_id FROM actions WHERE user_id IN (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) >= 30))
SELECT a.user_id, t.tag, COUNT(*) AS n FROM a JOIN item_tag t ON a.item_id = t.item_id GROUP BY ALL""")
def q_a12(spark, d):
    return AF.user_tag_counts(V.actions(spark, d), V.item_tag(spark, d), 30)
