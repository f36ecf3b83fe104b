"""Registered queries: catalogue / history lookups and id resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import catalog as C
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def items(spark, d):
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


@query("c1_recent_actions", W("actions") + """,
rk AS (SELECT user_id, item_id, type, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS rank
       FROM actions WHERE type = 2)
SELECT user_id, item_id, rank FROM rk WHERE rank <= 20""")
def q_c1(spark, d):
    return C.recent_actions(V.actions(spark, d), 20, type_=2).select("user_id", "item_id", "rank")


@query("c1_recent_actions_pair", W("actions") + """,
rk AS (SELECT user_id, item_id, order_key, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS rank
       FROM actions)
SELECT user_id, item_id, order_key, rank FROM rk WHERE rank <= 2""")
def q_c1p(spark, d):
    return C.recent_actions(V.actions(spark, d), 2, by=("user_id", "item_id")).select("user_id", "item_id", "order_key", "rank")


@query("c2_list_items_newest", "SELECT p_partkey AS item_id, p_name AS name, p_type AS type FROM part ORDER BY p_partkey DESC LIMIT 10 OFFSET 20")
def q_c2(spark, d):
    return C.list_items(items(spark, d), "newest", 20, 10)


@query("c2_list_items_alpha", "SELECT p_partkey AS item_id, p_name AS name, p_type AS type FROM part ORDER BY p_name, p_partkey DESC LIMIT 10 OFFSET 5")
def q_c2a(spark, d):
    return C.list_items(items(spark, d), "alpha", 5, 10)


@query("c2_list_items_of_dimension", W("dimensions") + """
SELECT p_partkey AS item_id, p_name AS name, p_type AS type FROM part
WHERE p_type IN (SELECT value FROM dimensions WHERE attr = 'type' AND dim_id = (SELECT max(dim_id) FROM dimensions))
ORDER BY p_name, p_partkey DESC LIMIT 10 OFFSET 5""")
def q_c2d(spark, d):
    """A page of the items of the last dimension's type."""
    dims = V.dimensions(spark, d).filter("attr = 'type'").select("dim_id", F.col("value").alias("item_type"))
    last = dims.agg(F.max("dim_id")).first()[0]
    return C.list_items_of_dimension(items(spark, d), dims, last, "alpha", 5, 10)


@query("c3_items_by_name", "SELECT p_partkey AS item_id, p_name AS name, p_type AS type FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_partkey DESC LIMIT 15")
def q_c3(spark, d):
    return C.items_by_name(items(spark, d), "RED", 15)


@query("c4_min_item_after", W("actions") + """,
lo AS (SELECT item_id, max(ts) AS last_op FROM actions GROUP BY item_id)
SELECT COALESCE((SELECT item_id FROM lo WHERE last_op >= TIMESTAMP '2001-01-01' ORDER BY last_op, item_id LIMIT 1), 0) AS item_id""")
def q_c4(spark, d):
    lo = V.actions(spark, d).groupBy("item_id").agg(F.max("ts").alias("last_op"))
    return C.min_item_after(lo, "last_op", F.lit("2001-01-01").cast("timestamp"))


@query("c5_items_from_actions", W("actions") + """,
a AS (SELECT user_id, item_id, max(t) AS last_t FROM actions WHERE type = 3 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_t DESC, item_id DESC) AS rank FROM a)
SELECT user_id, item_id, last_t, rank FROM rk WHERE rank <= 5""")
def q_c5(spark, d):
    types = spark.createDataFrame([(1, "accept"), (2, "none"), (3, "return")], "type int, name string")
    return C.items_from_actions(V.actions(spark, d), types, "return", 5).select("user_id", "item_id", "last_t", "rank")


@query("c6_item_dimension_names", W("item_dim", "dimensions") + """
SELECT i.item_id, i.dim_id, d.attr, d.value FROM item_dim i JOIN dimensions d ON i.dim_id = d.dim_id
WHERE d.dim_id IN (SELECT dim_id FROM dimensions WHERE lower(trim(attr)) = 'type' AND lower(trim(value)) = 'promo')
   OR i.item_id IN (SELECT item_id FROM item_dim WHERE dim_id = 1)""")
def q_c6(spark, d):
    dims = V.dimensions(spark, d)
    idim = V.item_dim(spark, d).drop("attr")
    names = C.item_dimension_names(idim, dims)
    promo = C.dimension_of(dims, " Type", "PROMO ")
    a = names.join(promo, "dim_id", "left_semi")
    b = names.join(idim.filter("dim_id = 1").select("item_id"), "item_id", "left_semi")
    return a.unionByName(b).distinct().select("item_id", "dim_id", "attr", "value")


def _user_attrs(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.lit("segment").alias("attr"), F.col("c_mktsegment").alias("value")) \
        .unionByName(c.select(F.col("c_custkey").alias("user_id"), F.lit("nation").alias("attr"), F.col("c_nationkey").cast("string").alias("value")))


@query("c7_users_with", """
WITH ua AS (SELECT c_custkey AS user_id, 'segment' AS attr, c_mktsegment AS value FROM customer
            UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT DISTINCT user_id FROM ua WHERE attr = 'segment' AND value = 'MACHINERY'""")
def q_c7(spark, d):
    return C.users_with(_user_attrs(spark, d), "segment", "MACHINERY")


@query("c7_user_demographics", """
WITH ua AS (SELECT c_custkey AS user_id, 'segment' AS attr, c_mktsegment AS value FROM customer
            UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer),
dm AS (SELECT attr, value, dense_rank() OVER (ORDER BY attr, value) AS demo_id FROM (SELECT DISTINCT attr, value FROM ua))
SELECT DISTINCT ua.user_id, dm.demo_id, dm.attr, dm.value FROM ua JOIN dm ON dm.attr = ua.attr AND dm.value = ua.value""")
def q_c7d(spark, d):
    ua = _user_attrs(spark, d)
    demos = C.demographics(ua)
    return C.user_demographics(ua, demos).join(demos, "demo_id")


@query("c8_wide_attributes", W("item_attributes") + """
SELECT item_id, first(value) FILTER (WHERE attr = 'brand') AS brand, first(value) FILTER (WHERE attr = 'size') AS size,
       first(value) FILTER (WHERE attr = 'type') AS type FROM item_attributes GROUP BY item_id""")
def q_c8(spark, d):
    return C.wide_attributes(V.item_attributes(spark, d), ["brand", "size", "type"])


@query("c9_rating_stats", W("actions") + """
SELECT item_id, round(avg(value), 6) AS avgrating, round(stddev_pop(value), 6) AS stddevrating, COUNT(*) AS n FROM actions GROUP BY item_id""")
def q_c9(spark, d):
    out = C.rating_stats(V.actions(spark, d))
    return out.select("item_id", r("avgrating", "avgrating"), r("stddevrating", "stddevrating"), "n")


@query("c10_attribute_clicks", W("impressions") + """,
u AS (SELECT user_id, t_us, event_id, event_id AS list_id, recommendations, rectag, abkey, NULL::BIGINT AS clicked FROM impressions WHERE click = 'IMP'
      UNION ALL SELECT user_id, t_us, event_id, NULL, NULL, NULL, NULL, item_id FROM impressions WHERE click = 'CTR'),
l AS (SELECT *, last(list_id IGNORE NULLS) OVER w AS l_id FROM u
      WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT l.user_id, l.event_id AS click_id, l.l_id AS list_id, l.clicked, s.recommendations, s.rectag, s.abkey
      FROM l JOIN impressions s ON s.event_id = l.l_id WHERE l.clicked IS NOT NULL AND l.l_id IS NOT NULL)
SELECT user_id, click_id, list_id, clicked,
       CAST(CASE WHEN list_position(string_split(recommendations, ':'), CAST(clicked AS VARCHAR)) > 0
            THEN list_position(string_split(recommendations, ':'), CAST(clicked AS VARCHAR)) - 1 END AS INTEGER) AS position,
       rectag AS algorithm, abkey AS variation FROM k""")
def q_c10(spark, d):
    imp = V.impressions(spark, d)
    shown = imp.filter("click = 'IMP'")
    clicks = imp.filter("click = 'CTR'")
    return C.attribute_clicks(shown, clicks)


@query("j3_resolve_user_ids", """
WITH a AS (SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS client, 'u' || CAST(user_id AS VARCHAR) AS client_userid,
                  CASE WHEN event_id % 4 = 0 OR user_id % 10 = 7 THEN 0 ELSE user_id END AS userid, event_id FROM events),
k AS (SELECT client, client_userid, max(userid) AS uid FROM a WHERE userid <> 0 GROUP BY ALL)
SELECT a.client, a.client_userid, CASE WHEN a.userid = 0 THEN k.uid ELSE a.userid END AS userid, a.event_id
FROM a LEFT JOIN k ON a.client = k.client AND a.client_userid = k.client_userid
WHERE (CASE WHEN a.userid = 0 THEN k.uid ELSE a.userid END) IS NOT NULL""")
def q_j3(spark, d):
    e = V.table(spark, d, "events")
    a = e.select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client"),
                 F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_userid"),
                 F.when((F.col("event_id") % 4 == 0) | (F.col("user_id") % 10 == 7), F.lit(0).cast("bigint"))
                  .otherwise(F.col("user_id")).alias("userid"), "event_id")
    return C.resolve_user_ids(a).select("client", "client_userid", "userid", "event_id")


@query("j7_attach_vertex_attributes", """
SELECT n.n_nationkey, n.n_name, COALESCE(s.n_sup, 0) AS n_sup FROM nation n
LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n_sup FROM supplier GROUP BY s_nationkey) s ON n.n_nationkey = s.s_nationkey""")
def q_j7(spark, d):
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    s = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_sup"))
    return C.attach(n, s, "n_nationkey", {"n_sup": 0})


@query("j8_with_both_dims", W("item_dim") + """
SELECT p_partkey AS item_id, p_name FROM part WHERE p_partkey IN (SELECT item_id FROM item_dim WHERE dim_id IN (1, 2, 3))
  AND p_partkey IN (SELECT item_id FROM item_dim WHERE dim_id = 77)""")
def q_j8(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    return C.with_both_dims(p, V.item_dim(spark, d), [1, 2, 3], 77)
