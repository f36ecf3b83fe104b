"""Registered queries: views, predicates, scalar functions, popularity (P, W8-W14, A6, A7, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import popularity as POP
from cairn.operators import ranking as RK
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query

R6 = 6  # decimals kept in every floating-point output (both engines)


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, R6).alias(name)


# ----------------------------------------------------------------- popularity

@query("a7_most_popular_by_dim", W("actions", "item_dim") + """,
agg AS (SELECT i.item_id, d.dim_id, i.cnt FROM
          (SELECT item_id, SUM(value + 1) AS cnt FROM actions GROUP BY item_id) i
          JOIN item_dim d ON i.item_id = d.item_id WHERE i.cnt >= 40),
rk AS (SELECT *, row_number() OVER (PARTITION BY dim_id ORDER BY cnt DESC, item_id) AS rn FROM agg)
SELECT dim_id, item_id, round(cnt, 6) AS count, rn AS rank FROM rk WHERE rn <= 10""")
def q_a7(spark, d):
    out = POP.most_popular_by_dim(V.actions(spark, d), V.item_dim(spark, d), k=10, min_count=40)
    return out.select("dim_id", "item_id", r("count", "count"), "rank")


@query("a7_most_popular_by_dim_required", W("actions", "item_dim") + """,
ok AS (SELECT DISTINCT item_id FROM item_dim WHERE dim_id IN (1, 2, 3)),
agg AS (SELECT i.item_id, d.dim_id, i.cnt FROM
          (SELECT item_id, SUM(value + 1) AS cnt FROM actions GROUP BY item_id) i
          JOIN item_dim d ON i.item_id = d.item_id
          WHERE d.item_id IN (SELECT item_id FROM ok)),
rk AS (SELECT *, row_number() OVER (PARTITION BY dim_id ORDER BY cnt DESC, item_id) AS rn FROM agg)
SELECT dim_id, item_id, round(cnt, 6) AS count, rn AS rank FROM rk WHERE rn <= 5""")
def q_a7r(spark, d):
    out = POP.most_popular_by_dim(V.actions(spark, d), V.item_dim(spark, d), k=5, required=[1, 2, 3])
    return out.select("dim_id", "item_id", r("count", "count"), "rank")


@query("a6_most_popular", W("actions") + """
SELECT item_id, COUNT(*) AS n_actions FROM actions WHERE item_id > 0 GROUP BY item_id""")
def q_a6(spark, d):
    return POP.most_popular(V.actions(spark, d))


@query("a13_action_ratings", W("actions") + """,
w(type, per_action, max_sum) AS (VALUES (1, 1.0, 3.0), (2, 0.5, 1.0)),
pt AS (SELECT user_id, item_id, type, COUNT(*) AS n FROM actions GROUP BY ALL)
SELECT user_id, item_id, round(SUM(COALESCE(least(w.per_action * pt.n, w.max_sum), 0.0)), 6) AS rating
FROM pt LEFT JOIN w ON pt.type = w.type GROUP BY user_id, item_id""")
def q_a13(spark, d):
    out = POP.action_ratings(V.actions(spark, d), {1: (1.0, 3.0), 2: (0.5, 1.0)})
    return out.select("user_id", "item_id", r("rating", "rating"))


# ------------------------------------------------------------- filters

@query("p1_filter_actions", W("actions") + """
SELECT user_id, item_id, type, value, order_key, line_no FROM actions
WHERE type IN (1, 3) AND value > 25""")
def q_p1(spark, d):
    return S.filter_actions(V.actions(spark, d), types=[1, 3], min_value=25) \
        .select("user_id", "item_id", "type", "value", "order_key", "line_no")


@query("p2_filter_users_by_activity", W("clicks") + """,
n AS (SELECT user_id, COUNT(*) AS c FROM clicks GROUP BY user_id)
SELECT event_id, user_id, item_id FROM clicks
WHERE user_id IN (SELECT user_id FROM n WHERE c >= 60 AND c <= 70)""")
def q_p2(spark, d):
    return S.filter_users_by_activity(V.clicks(spark, d), 60, 70).select("event_id", "user_id", "item_id")


@query("p2_filter_users_by_activity_strict", W("clicks") + """,
n AS (SELECT user_id, COUNT(*) AS c FROM clicks GROUP BY user_id)
SELECT event_id, user_id, item_id FROM clicks
WHERE user_id IN (SELECT user_id FROM n WHERE c > 60 AND c < 70)""")
def q_p2s(spark, d):
    return S.filter_users_by_activity(V.clicks(spark, d), 60, 70, strict=True) \
        .select("event_id", "user_id", "item_id")


@query("p3_filter_items_by_users", W("actions") + """,
p AS (SELECT DISTINCT user_id, item_id FROM actions),
n AS (SELECT item_id, COUNT(*) AS c FROM p GROUP BY item_id)
SELECT user_id, item_id FROM p WHERE item_id IN (SELECT item_id FROM n WHERE c >= 30 AND c <= 35)""")
def q_p3(spark, d):
    return S.filter_items_by_users(V.actions(spark, d), 30, 35)


@query("p4_require_dims", W("item_dim") + """
SELECT item_id, dim_id FROM item_dim
WHERE item_id IN (SELECT item_id FROM item_dim WHERE dim_id IN (5, 30))""")
def q_p4(spark, d):
    return S.require_dims(V.item_dim(spark, d).select("item_id", "dim_id"), [5, 30])


@query("p5_sample_actions", W("actions") + """
SELECT user_id, item_id, order_key, line_no FROM actions
WHERE CAST(('0x' || substr(md5('7|' || CAST(order_key AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 < 250000""")
def q_p5(spark, d):
    return S.sample_actions(V.actions(spark, d), 0.25, seed=7, keys=("order_key", "line_no")) \
        .select("user_id", "item_id", "order_key", "line_no")


@query("p6_filter_users", W("actions") + """
SELECT user_id, item_id, order_key, line_no FROM actions
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_p6(spark, d):
    allow = V.table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("user_id"))
    return S.filter_users(V.actions(spark, d), allow).select("user_id", "item_id", "order_key", "line_no")


@query("p7_p8_feature_select", """
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def q_p7(spark, d):
    c = V.table(spark, d, "customer")
    c = S.include_features(c, ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", "no_such_col"])
    c = S.exclude_features(c, ["c_nationkey", "also_missing"])
    return S.exist_features(c, ["c_acctbal", "c_mktsegment", "missing"])


# ---------------------------------------------------------- scalar functions

@query("p9_binary_feature", """
SELECT o_orderkey,
  CASE WHEN o_orderpriority IS NULL OR trim(o_orderpriority) = '' OR o_orderpriority IN ('0', '0.0') THEN 0 ELSE 1 END AS has_priority,
  CASE WHEN CAST(o_custkey % 3 AS VARCHAR) IN ('0', '0.0') THEN 0 ELSE 1 END AS cust_flag
FROM orders""")
def q_p9(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", S.binary_feature("o_orderpriority").alias("has_priority"),
                    S.binary_feature(F.col("o_custkey") % 3).alias("cust_flag"))


@query("p10_split_feature", """
SELECT p_partkey, array_to_string(list_filter(
   list_transform(string_split_regex(lower(p_name), '[\\s,]+') || string_split_regex(lower(p_type || ' ' || CAST(p_size AS VARCHAR)), '[\\s,]+'), lambda x: rtrim(x)),
   lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+(\\.[0-9]+)?$')), ' ') AS tokens
FROM part""")
def q_p10(spark, d):
    p = V.table(spark, d, "part").withColumn("type_size", F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))
    toks = S.split_feature(["p_name", "type_size", "not_a_column"], ignore_numbers=True, df_columns=p.columns)
    return p.select("p_partkey", F.array_join(toks, " ").alias("tokens"))


@query("p11_tokenize_tags", """
SELECT d.doc_id, array_to_string(list_filter(list_transform(string_split(d.tags, ','),
    lambda x: regexp_replace(lower(trim(x)), '[ :;''",]', '_', 'g')), lambda x: x <> ''), '|') AS tags
FROM (SELECT doc_id, lang || ', ' || source || ' ,' || upper(lang) || ':x;' || ',,' AS tags FROM documents) d""")
def q_p11(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(" ,"),
                           F.upper("lang"), F.lit(":x;"), F.lit(",,")).alias("tags"))
    return docs.select("doc_id", F.array_join(S.tokenize_tags("tags"), "|").alias("tags"))


@query("p12_has_tag", W("item_tags") + """
SELECT item_id FROM item_tags WHERE regexp_matches(tags, '(^|,)[ ]*ring[ ]*(,|$)')""")
def q_p12(spark, d):
    return V.item_tags(spark, d).filter(S.has_tag("tags", "ring")).select("item_id")


@query("p13_normalize_path", W("clicks") + """,
req AS (SELECT event_id,
  CASE event_type WHEN 'view' THEN '/users/' || CAST(user_id AS VARCHAR) || '/recommendations'
                  WHEN 'click' THEN '/items/' || CAST(item_id AS VARCHAR) || '/actions'
                  WHEN 'purchase' THEN '/users/' || CAST(user_id AS VARCHAR) || '/actions/' || CAST(item_id AS VARCHAR)
                  WHEN 'error' THEN '/js/' || CAST(item_id AS VARCHAR) || '/actions'
                  ELSE '/actions/' || CAST(event_id AS VARCHAR) END AS path FROM clicks)
SELECT event_id, path,
  CASE WHEN starts_with(path, '/js') THEN path
       WHEN regexp_matches(path, '^(/users/)([^/]+)(/recommendations)$') THEN regexp_replace(path, '^(/users/)([^/]+)(/recommendations)$', '\\1{userid}\\3')
       WHEN regexp_matches(path, '^(/items/)([^/]+)(/actions)$') THEN regexp_replace(path, '^(/items/)([^/]+)(/actions)$', '\\1{itemid}\\3')
       WHEN regexp_matches(path, '^(/users/)([^/]+)(/actions)$') THEN regexp_replace(path, '^(/users/)([^/]+)(/actions)$', '\\1{userid}\\3')
       WHEN regexp_matches(path, '^(/items/)([^/]+)$') THEN regexp_replace(path, '^(/items/)([^/]+)$', '\\1{itemid}')
       WHEN regexp_matches(path, '^(/users/)([^/]+)(/actions/)([^/]+)$') THEN regexp_replace(path, '^(/users/)([^/]+)(/actions/)([^/]+)$', '\\1{userid}\\3{itemid}')
       WHEN regexp_matches(path, '^(/items/)([^/]+)(/actions/)([^/]+)$') THEN regexp_replace(path, '^(/items/)([^/]+)(/actions/)([^/]+)$', '\\1{itemid}\\3{userid}')
       WHEN regexp_matches(path, '^(/actions/)([^/]+)$') THEN regexp_replace(path, '^(/actions/)([^/]+)$', '\\1{actionid}')
       ELSE path END AS template
FROM req""")
def q_p13(spark, d):
    from cairn.plans.derived import requests
    req = requests(spark, d)
    return req.select("event_id", "path", S.normalize_path("path").alias("template"))


@query("p14_distinct_api_calls", W("clicks") + """,
u AS (SELECT '/users/' || CAST(user_id % 7 AS VARCHAR) || '/recommendations?limit=' || CAST(item_id % 3 AS VARCHAR)
             || '&user=' || CAST(user_id AS VARCHAR) AS url FROM clicks)
SELECT DISTINCT regexp_replace(regexp_replace(url, '([?&])user=[^&]*(&|$)', '\\1'), '[?&]$', '') AS call FROM u""")
def q_p14(spark, d):
    c = V.clicks(spark, d)
    url = F.concat(F.lit("/users/"), (F.col("user_id") % 7).cast("string"), F.lit("/recommendations?limit="),
                   (F.col("item_id") % 3).cast("string"), F.lit("&user="), F.col("user_id").cast("string"))
    return c.select(S.strip_query_param(url, "user").alias("call")).distinct()


@query("p15_unix_day", """
SELECT o_orderkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day,
       CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s FROM orders""")
def q_p15(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", S.unix_day("o_orderdate").alias("day"), S.to_epoch("o_orderdate").alias("epoch_s"))


@query("p16_explode_recs", W("impressions") + """
SELECT event_id, CAST(x.rec_pos - 1 AS INTEGER) AS rec_pos, CAST(x.rec_item AS BIGINT) AS rec_item
FROM impressions, LATERAL (SELECT unnest(string_split(recommendations, ':')) AS rec_item,
                                  generate_subscripts(string_split(recommendations, ':'), 1) AS rec_pos) x""")
def q_p16(spark, d):
    return S.explode_recs(V.impressions(spark, d)).select("event_id", "rec_pos", "rec_item")


@query("p17_date_features", """
SELECT event_id,
  round(sin(2 * pi() * hour(ts) / 24.0), 6) AS ts_h_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) AS ts_h_cos,
  'h' || CAST(hour(ts) AS VARCHAR) AS ts_h,
  round(sin(2 * pi() * month(ts) / 12.0), 6) AS ts_m_sin, round(cos(2 * pi() * month(ts) / 12.0), 6) AS ts_m_cos,
  'm' || CAST(month(ts) AS VARCHAR) AS ts_m,
  round(sin(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7.0), 6) AS ts_w_sin, round(cos(2 * pi() * ((dayofweek(ts) + 6) % 7) / 7.0), 6) AS ts_w_cos,
  'w' || CAST((dayofweek(ts) + 6) % 7 AS VARCHAR) AS ts_w,
  'y' || CAST(year(ts) AS VARCHAR) AS ts_y
FROM events""")
def q_p17(spark, d):
    e = V.table(spark, d, "events")
    cols = S.date_features("ts", "ts")
    out = e.select("event_id", *cols)
    return out.select(*[F.round(c, R6).alias(c) if c.endswith(("_sin", "_cos")) else c for c in out.columns])


@query("p18_date_diffs", """
SELECT l_orderkey, l_linenumber,
  round((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400e6, 6) AS ship_minus_order
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_p18(spark, d):
    li = V.table(spark, d, "lineitem")
    o = V.table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", r(S.day_diff("l_shipdate", "o_orderdate"), "ship_minus_order"))


@query("p19_best_class", """
WITH p AS (SELECT vec_id, [{'prediction': CAST(embedding[1] AS DOUBLE), 'predictedClass': 'a', 'confidence': 1.0},
                          {'prediction': CAST(embedding[2] AS DOUBLE), 'predictedClass': 'b', 'confidence': 1.0},
                          {'prediction': CAST(embedding[3] AS DOUBLE), 'predictedClass': 'c', 'confidence': 1.0}] AS preds FROM embeddings),
x AS (SELECT vec_id, u.i, u.s.prediction AS score, u.s.predictedClass AS cls
      FROM p, LATERAL (SELECT unnest(preds) AS s, generate_subscripts(preds, 1) AS i) u),
b AS (SELECT vec_id, cls, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS rn FROM x)
SELECT vec_id, cls AS best_class, round(score, 6) AS best_score FROM b WHERE rn = 1""")
def q_p19(spark, d):
    from cairn.plans.derived import predictions
    p = predictions(spark, d)
    b = S.best_class("predictions")
    return p.select("vec_id", b["cls"].alias("best_class"), r(b["score"], "best_score"))


@query("p20_default_tags", W("impressions") + """
SELECT event_id, COALESCE(rectag, 'default') AS rectag,
       CASE WHEN user_id % 5 = 0 THEN 'all' ELSE abkey END AS abkey FROM impressions""")
def q_p20(spark, d):
    imp = V.impressions(spark, d).withColumn(
        "abkey", F.when(F.col("user_id") % 5 == 0, F.lit("-")).otherwise(F.col("abkey")))
    return S.default_tags(imp).select("event_id", "rectag", "abkey")


@query("p21_score_helpers", W("actions") + """,
s AS (SELECT user_id, item_id, SUM(value) AS score FROM actions GROUP BY ALL)
SELECT user_id, item_id,
  round(score / max(score) OVER (PARTITION BY user_id), 6) AS to_one,
  round(score / sum(score) OVER (PARTITION BY user_id), 6) AS to_sum,
  round(1.0 / (1.0 + exp(-(score / 50.0 - 1.0))), 6) AS sig
FROM s""")
def q_p21(spark, d):
    s = V.actions(spark, d).groupBy("user_id", "item_id").agg(F.sum("value").alias("score"))
    s = S.rescale_to_one(s, ["user_id"], out="to_one")
    s = S.normalise_sum(s, ["user_id"], out="to_sum")
    s = s.withColumn("sig", S.sigmoid(F.col("score") / 50.0 - 1.0))
    return s.select("user_id", "item_id", r("to_one", "to_one"), r("to_sum", "to_sum"), r("sig", "sig"))


@query("p22_json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       COALESCE(CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1.0) AS missing FROM events""")
def q_p22(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", S.json_field("props", "$.k", "bigint").alias("k"),
                    S.json_field("props", "$.missing", "double", -1.0).alias("missing"))


@query("p23_localize", W("item_attributes") + """,
loc AS (SELECT item_id, attr, 'fr' AS locale, lower(value) || '_fr' AS value FROM item_attributes
        WHERE attr = 'type' AND item_id % 2 = 0)
SELECT a.item_id, a.attr, COALESCE(l.value, a.value) AS value
FROM item_attributes a LEFT JOIN (SELECT * FROM loc WHERE locale = 'fr') l ON a.item_id = l.item_id AND a.attr = l.attr""")
def q_p23(spark, d):
    a = V.item_attributes(spark, d)
    loc = a.filter((F.col("attr") == "type") & (F.col("item_id") % 2 == 0)).select(
        "item_id", "attr", F.lit("fr").alias("locale"), F.concat(F.lower("value"), F.lit("_fr")).alias("value"))
    return S.localize(a, loc, "fr").select("item_id", "attr", "value")


# -------------------------------------------------------- ordering / set ops

@query("w9_global_top", W("actions") + """
SELECT item_id, COUNT(*) AS n FROM actions GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20""")
def q_w9(spark, d):
    pop = V.actions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return RK.global_top(pop, [F.desc("n"), F.asc("item_id")], 20)


@query("w10_score_by_position", """
WITH x AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part)
SELECT p_brand, p_partkey, round(1.0 - (rn - 1) * (1.0 / 5), 6) AS score FROM x WHERE rn <= 5""")
def q_w10(spark, d):
    p = V.table(spark, d, "part")
    out = RK.score_by_position(p, ["p_brand"], [F.desc("p_partkey")], 5)
    return out.select("p_brand", "p_partkey", r("score", "score"))


@query("w12_union_all", """
SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region""")
def q_w12(spark, d):
    n = V.table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    rg = V.table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    return n.unionByName(rg)


@query("w13_except_items", W("actions", "item_dim") + """
SELECT item_id FROM (SELECT DISTINCT item_id FROM actions WHERE type = 1)
EXCEPT SELECT item_id FROM actions WHERE type = 3 AND value >= 45
INTERSECT SELECT item_id FROM item_dim WHERE dim_id <= 40""")
def q_w13(spark, d):
    a = V.actions(spark, d)
    return RK.except_items(a.filter("type = 1"), a.filter("type = 3 and value >= 45"),
                           V.item_dim(spark, d).filter("dim_id <= 40"))


@query("w14_exclude_seen", W("actions", "item_dim") + """,
c AS (SELECT DISTINCT a.user_id, d2.item_id FROM actions a JOIN item_dim d1 ON a.item_id = d1.item_id
      JOIN item_dim d2 ON d1.dim_id = d2.dim_id WHERE d1.attr = 'brand' AND a.type = 3 AND a.value >= 49)
SELECT user_id, item_id FROM c
WHERE NOT EXISTS (SELECT 1 FROM actions s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)""")
def q_w14(spark, d):
    a = V.actions(spark, d)
    dims = V.item_dim(spark, d)
    d1 = dims.filter("attr = 'brand'").select("item_id", "dim_id")
    seed = a.filter("type = 3 and value >= 49").select("user_id", "item_id")
    cands = seed.join(d1, "item_id").select("user_id", "dim_id")
    return RK.exclude_seen(cands, a, lists=dims.select("dim_id", "item_id"))
