"""Registered queries: readers, writers and ingestion (S1-S21). Each writes
data Spark derives from the tables into the shared checkpoint folder and
reads it back through the library reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query
from cairn.session import ensure_checkpoint_dir
from cairn.sources import io as IO
from cairn.sources.pages import Attribute, extract_attributes


def _tmp(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io/{what}-{uuid.uuid4().hex}"


def _action_json(a):
    return F.to_json(F.struct(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_userid"),
        F.col("user_id").alias("userid"), F.col("item_id").alias("itemid"), F.col("type"), F.col("value"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"),
        F.lit("x").alias("unknown_field")))


def _bad(a):
    return (F.col("order_key") % 97 == 0)


ACTIONS_OUT_SQL = W("actions") + """
SELECT user_id AS userid, item_id AS itemid, type, value, CAST(epoch(ts) AS BIGINT) AS epoch FROM actions WHERE order_key % 97 <> 0"""


@query("s1_read_action_log", ACTIONS_OUT_SQL)
def q_s1(spark, d):
    a = V.actions(spark, d)
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("actions"),
                       F.when(_bad(a), F.lit("{not json")).otherwise(_action_json(a)))
    path = _tmp(spark, "actionlog")
    a.select(line.alias("value")).write.text(path)
    r = IO.read_action_log(spark, path)
    return r.select("userid", "itemid", "type", "value", F.unix_timestamp("ts").alias("epoch"))


@query("s2_read_actions", ACTIONS_OUT_SQL)
def q_s2(spark, d):
    a = V.actions(spark, d)
    path = _tmp(spark, "actionjson")
    a.select(F.when(_bad(a), F.lit("{broken")).otherwise(_action_json(a)).alias("value")).write.text(path)
    r = IO.read_actions(spark, path)
    return r.select("userid", "itemid", "type", "value", F.unix_timestamp("ts").alias("epoch"))


@query("s3_read_tagged_log", W("impressions") + """
SELECT event_id FROM impressions WHERE click = 'CTR'""")
def q_s3(spark, d):
    imp = V.impressions(spark, d)
    tag = F.when(F.col("click") == "CTR", "restapi.ctr").otherwise("restapi.calls")
    path = _tmp(spark, "tagged")
    imp.select(F.concat_ws("\t", F.col("t_us").cast("string"), tag,
                           F.to_json(F.struct("event_id", "consumer", "click"))).alias("value")).write.text(path)
    r = IO.read_tagged_log(spark, path, "restapi.ctr")
    return r.select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"))


@query("s4_s11_day_partitions", W("clicks") + """
SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS client, CAST(floor(t_us / 86400000000) AS BIGINT) AS day, COUNT(*) AS n, SUM(value) AS qty
FROM clicks WHERE floor(t_us / 86400000000) > 19745 - 10 AND floor(t_us / 86400000000) <= 19745 GROUP BY ALL""")
def q_s4(spark, d):
    a = V.clicks(spark, d).select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client"),
                                  F.floor(F.col("t_us") / 86400000000).cast("bigint").alias("day"), "value")
    path = _tmp(spark, "byday")
    IO.write_by_client_day(a, path, gzip=True)
    r = spark.read.schema("value double, client string, day bigint").json(path)
    return IO.day_range(r, 19745, 10).groupBy("client", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("qty"))


def _eav(spark, d):
    p = V.table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.lit(1).alias("type_id"))
    attrs = spark.createDataFrame([(1, "brand", 1, "varchar"), (2, "size", 1, "int"), (3, "type", 1, "enum"),
                                   (4, "price", 1, "double")], "attr_id int, name string, type_id int, kind string")
    types = p.select(F.col("p_type").alias("value_name")).distinct()
    enum_vals = types.select(F.lit(3).alias("attr_id"), "value_name",
                             F.dense_rank().over(Window.orderBy("value_name")).alias("value_id"))  # bounded: distinct enum values
    typed = {
        "varchar": p.select(F.col("p_partkey").alias("item_id"), F.lit(1).alias("attr_id"), F.col("p_brand").alias("value")),
        "int": p.filter("p_size > 10").select(F.col("p_partkey").alias("item_id"), F.lit(2).alias("attr_id"), F.col("p_size").alias("value")),
        "enum": p.join(enum_vals.withColumnRenamed("value_name", "p_type"), "p_type")
                 .select(F.col("p_partkey").alias("item_id"), F.lit(3).alias("attr_id"), F.col("value_id").alias("value")),
        "double": p.select(F.col("p_partkey").alias("item_id"), F.lit(4).alias("attr_id"), F.col("p_retailprice").alias("value")),
    }
    return items, attrs, typed, enum_vals


@query("s5_item_attributes", """
SELECT p_partkey AS item_id, 'brand' AS attr, p_brand AS value FROM part
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 10
UNION ALL SELECT p_partkey, 'type', p_type FROM part
UNION ALL SELECT p_partkey, 'price', CAST(p_retailprice AS VARCHAR) FROM part""")
def q_s5(spark, d):
    items, attrs, typed, enum_vals = _eav(spark, d)
    return IO.item_attributes(items, attrs, typed, enum_vals)


@query("s6_s7_item_dimensions", """
WITH ev AS (SELECT value_name, dense_rank() OVER (ORDER BY value_name) AS value_id FROM (SELECT DISTINCT p_type AS value_name FROM part))
SELECT p.p_partkey AS item_id, CAST(100 + ev.value_id AS INTEGER) AS dim_id FROM part p JOIN ev ON p.p_type = ev.value_name WHERE ev.value_id <> 2""")
def q_s6(spark, d):
    items, attrs, typed, enum_vals = _eav(spark, d)
    item_enum = typed["enum"].select("item_id", "attr_id", F.col("value").alias("value_id"))
    dims = enum_vals.select("attr_id", "value_id", (F.col("value_id") + 100).cast("int").alias("dim_id"))
    excl = spark.createDataFrame([(102,)], "dim_id int")
    excl_attr = spark.createDataFrame([(99,)], "attr_id int")
    return IO.item_dimensions(item_enum, dims, excl, excl_attr)


def _csv_lines(spark, d):
    p = V.table(spark, d, "part")
    typ = F.when(F.col("p_partkey") % 7 == 0, F.lit("CHEAP")).otherwise(F.col("p_type"))
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), typ)
    row = F.when(F.col("p_partkey") % 50 == 0, F.concat(row, F.lit(",extra"))).otherwise(row)
    header = spark.createDataFrame([(1, "id,name,brand,type")], "line_no long, value string")
    return header.unionByName(p.select((F.col("p_partkey") + 2).alias("line_no"), row.alias("value")))


S8_SQL = """
WITH r AS (SELECT p_partkey + 2 AS line_no, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'CHEAP' ELSE p_type END AS typ, p_name, p_brand FROM part),
bad AS (SELECT line_no, 'wrong number of fields' AS error FROM r WHERE p_partkey % 50 = 0
        UNION ALL SELECT line_no, 'unknown value for type' FROM r WHERE p_partkey % 50 <> 0 AND typ NOT IN (SELECT DISTINCT p_type FROM part))"""


@query("s8_validate_items_bad", S8_SQL + "\nSELECT line_no, error FROM bad")
def q_s8(spark, d):
    p = V.table(spark, d, "part")
    attr_names = spark.createDataFrame([("brand",), ("type",)], "name string")
    enum_vals = p.select(F.lit("type").alias("attr"), F.col("p_type").alias("value_name")).distinct()
    _, bad = IO.validate_items(_csv_lines(spark, d), attr_names, enum_vals, ["type"])
    return bad


@query("s8_validate_items_good", S8_SQL + """
SELECT r.line_no, COUNT(*) AS n_fields FROM r, (SELECT unnest(['id', 'name', 'brand', 'type'])) f
WHERE r.line_no NOT IN (SELECT line_no FROM bad) GROUP BY r.line_no""")
def q_s8g(spark, d):
    p = V.table(spark, d, "part")
    attr_names = spark.createDataFrame([("brand",), ("type",)], "name string")
    enum_vals = p.select(F.lit("type").alias("attr"), F.col("p_type").alias("value_name")).distinct()
    good, _ = IO.validate_items(_csv_lines(spark, d), attr_names, enum_vals, ["type"])
    return good.groupBy("line_no").agg(F.count(F.lit(1)).alias("n_fields"))


@query("s9_import_users", """
SELECT client_userid, CAST(dense_rank() OVER (ORDER BY client_userid) AS BIGINT) AS user_id
FROM (SELECT DISTINCT 'cu' || CAST(o_custkey AS VARCHAR) AS client_userid FROM orders)""")
def q_s9(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.lit("cu"), F.col("o_custkey").cast("string")).alias("client_userid"))
    return IO.import_users(o)


@query("s10_import_actions", """
WITH u AS (SELECT client_userid, dense_rank() OVER (ORDER BY client_userid) AS user_id FROM (SELECT DISTINCT 'cu' || CAST(o_custkey AS VARCHAR) AS client_userid FROM orders)),
i AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS client_itemid, p_partkey AS item_id FROM part),
a AS (SELECT 'cu' || CAST(o.o_custkey AS VARCHAR) AS client_userid, 'p' || CAST(l.l_partkey AS VARCHAR) AS client_itemid,
             l.l_quantity AS value, CAST(epoch(o.o_orderdate) AS BIGINT) AS epoch FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT a.client_userid, a.client_itemid, CAST(u.user_id AS BIGINT) AS userid, i.item_id AS itemid, 1 AS type, 'default' AS rectag, a.value,
       strftime(to_timestamp(a.epoch), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc
FROM a JOIN u ON a.client_userid = u.client_userid JOIN i ON a.client_itemid = i.client_itemid""")
def q_s10(spark, d):
    o = V.table(spark, d, "orders")
    li = V.table(spark, d, "lineitem")
    users = IO.import_users(o.select(F.concat(F.lit("cu"), F.col("o_custkey").cast("string")).alias("client_userid")))
    items = V.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("client_itemid"),
                                             F.col("p_partkey").alias("item_id"))
    acts = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("cu"), F.col("o_custkey").cast("string")).alias("client_userid"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("client_itemid"),
        F.col("l_quantity").alias("value"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch"))
    return IO.import_actions(acts, users, items)


@query("s12_vector_lines", """
SELECT CAST(vec_id AS VARCHAR) || '|' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), '|') AS value FROM embeddings""")
def q_s12(spark, d):
    e = V.table(spark, d, "embeddings")
    path = _tmp(spark, "vectors")
    IO.vector_lines(e, "vec_id", "embedding").write.text(path)
    return spark.read.text(path)


@query("s13_refresh_table")
def q_s13(spark, d):
    pop = V.actions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return IO.refresh_table(pop, "cairn_item_popularity")


@query("s14_carry_over", W("actions") + """,
nw AS (SELECT item_id, COUNT(*) / 100.0 AS score FROM actions WHERE type = 1 GROUP BY item_id),
od AS (SELECT item_id, COUNT(*) / 1000.0 AS score FROM actions WHERE type = 3 GROUP BY item_id)
SELECT item_id, round(score, 6) AS score FROM (SELECT * FROM nw UNION ALL
  SELECT item_id, score - 0.01 FROM od WHERE item_id NOT IN (SELECT item_id FROM nw)) WHERE score >= 0""")
def q_s14(spark, d):
    a = V.actions(spark, d)
    new = a.filter("type = 1").groupBy("item_id").agg((F.count(F.lit(1)) / 100.0).alias("score"))
    old = a.filter("type = 3").groupBy("item_id").agg((F.count(F.lit(1)) / 1000.0).alias("score"))
    return IO.carry_over(new, old, ["item_id"]).select("item_id", F.round("score", 6).alias("score"))


@query("s15_append_missing", W("actions") + """,
b AS (SELECT item_id, CAST(COUNT(*) AS DOUBLE) AS score FROM actions WHERE type = 1 AND value > 45 GROUP BY item_id)
SELECT * FROM b UNION ALL SELECT p_partkey, 0.0 FROM part WHERE p_partkey NOT IN (SELECT item_id FROM b)""")
def q_s15(spark, d):
    a = V.actions(spark, d)
    base = a.filter("type = 1 and value > 45").groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    extra = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lit(0.0).alias("score"))
    return IO.append_missing(base, extra, "item_id")


@query("s16_metric_points", W("impressions") + """
SELECT 'ctr' AS measurement, consumer, COUNT(*) FILTER (WHERE click = 'IMP') * 1.0 AS impressions,
       COUNT(*) FILTER (WHERE click = 'CTR') * 1.0 AS clicks, year(ts) * 10000 + month(ts) * 100 + day(ts) AS time
FROM impressions GROUP BY consumer, year(ts) * 10000 + month(ts) * 100 + day(ts)""")
def q_s16(spark, d):
    from cairn.operators.analytics import ctr_daily
    c = ctr_daily(V.impressions(spark, d), include_zero=True).withColumn("time", F.col("y") * 10000 + F.col("m") * 100 + F.col("d"))
    pts = IO.to_metric_points(c, "ctr", ["consumer"], ["impressions", "clicks"], "time")
    return pts.select("measurement", F.col("tags")["consumer"].alias("consumer"), F.col("fields")["impressions"].alias("impressions"),
                      F.col("fields")["clicks"].alias("clicks"), "time")


@query("s18_read_frame", """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer""")
def q_s18(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    p1, p2 = _tmp(spark, "frame1"), _tmp(spark, "frame2")
    c.filter("c_mktsegment < 'H'").write.json(p1)
    c.filter("c_mktsegment >= 'H' or c_mktsegment is null").write.json(p2)
    return IO.read_frame(spark, [p1, p2], "json", schema="c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


S19_SQL = """
WITH x AS (SELECT page_id, url,
  NULLIF(regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1), '') AS lang,
  NULLIF(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS title,
  NULLIF(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS h1,
  NULLIF(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*[^?#]*)', 1), '') AS baseurl,
  list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '(?s)<a[^>]*>(.*?)</a>', 1),
     lambda t: lower(trim(regexp_replace(t, '<[^>]*>', '', 'g')))), lambda t: t <> '') AS tags
  FROM pages)"""


@query("s19_extract_page_attributes", S19_SQL + """
SELECT page_id, lang, title, h1, baseurl, array_to_string(tags, '|') AS tags,
  array_to_string(CASE WHEN len(tags) > 1 THEN list_filter(list_transform(range(1, len(tags)), lambda i: tags[i] || ' ' || tags[i + 1]),
                  lambda b: contains(lower(title), b)) ELSE [] END, '|') AS bigrams
FROM x WHERE title IS NOT NULL AND h1 IS NOT NULL""")
def q_s19(spark, d):
    ok, _ = IO.extract_page_attributes(V.table(spark, d, "pages"), required=("title", "h1"))
    return ok.select("page_id", "lang", "title", "h1", "baseurl", F.array_join("tags", "|").alias("tags"),
                     F.array_join("bigrams", "|").alias("bigrams"))


S19_TEXT = "replace(replace(replace({}, '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"


@query("s19_configured_attributes", S19_SQL + f""",
y AS (SELECT x.*, {S19_TEXT.format("x.title")} AS title_text, {S19_TEXT.format("x.h1")} AS headline, p.html FROM x JOIN pages p USING (page_id))
SELECT page_id, baseurl, title_text AS title, headline,
  NULLIF(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
  NULLIF(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS first_link,
  {S19_TEXT.format("trim(regexp_replace(regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1), '\\s+', ' ', 'g'))")} AS aside,
  {S19_TEXT.format("trim(regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '\\s+', ' ', 'g'))")} AS footer, 'none' AS keywords,
  array_to_string(tags, '|') AS tags,
  array_to_string(CASE WHEN len(tags) > 1 THEN list_filter(list_transform(range(1, len(tags)), lambda i: tags[i] || ' ' || tags[i + 1]),
                  lambda b: contains(lower(title_text), b)) ELSE [] END, '|') AS bigrams
FROM y WHERE title IS NOT NULL AND h1 IS NOT NULL""")
def q_s19_configured(spark, d):
    attributes = [Attribute("title", "head title", required=True), Attribute("headline", "article h1", required=True),
                  Attribute("charset", "meta[charset]", take="charset"), Attribute("first_link", "nav li a[href]", take="href"),
                  Attribute("aside", "body div.ad"), Attribute("footer", "footer"),
                  Attribute("keywords", "meta[name=keywords]", take="content", default="none")]
    ok, _ = extract_attributes(V.table(spark, d, "pages"), attributes, tags=Attribute("tags", "nav a"), title="title")
    return ok.withColumn("tags", F.array_join("tags", "|")).withColumn("bigrams", F.array_join("bigrams", "|")).drop("url")


@query("s19_failed_pages", """
SELECT page_id, url, CASE WHEN contains(html, '<html lang="en">') THEN 'description' ELSE 'english_headline,description' END AS failed
FROM pages WHERE NOT contains(html, '<meta name="description"')""")
def q_s19_failed(spark, d):
    attributes = [Attribute("english_headline", "html[lang=en] article h1", required=True),
                  Attribute("byline", ".byline", default="unsigned", required=True),
                  Attribute("description", "meta[name=description]", take="content", required=True)]
    return extract_attributes(V.table(spark, d, "pages"), attributes)[1]


@query("s20_build_dimensions", """
WITH ev AS (SELECT 'type' AS attr, p_type AS v FROM part UNION ALL SELECT 'brand', p_brand FROM part),
sch AS (SELECT 'part' AS item_type, attr, 'enum' AS kind, string_agg(DISTINCT v, '|' ORDER BY v) AS enum_values FROM ev GROUP BY attr
        UNION ALL SELECT 'part', 'size', 'int', NULL UNION ALL SELECT 'part', 'price', 'double', NULL UNION ALL SELECT 'part', 'price', 'double', NULL
        UNION ALL SELECT 'part', 'blob', 'binary', NULL),
ok AS (SELECT * FROM sch WHERE kind IN ('int', 'bigint', 'double', 'boolean', 'datetime', 'varchar', 'text', 'enum')),
ok2 AS (SELECT * FROM ok WHERE (item_type, attr) NOT IN (SELECT item_type, attr FROM ok GROUP BY ALL HAVING COUNT(*) > 1)),
atab AS (SELECT *, CAST(dense_rank() OVER (ORDER BY item_type, attr) AS INTEGER) AS attr_id FROM ok2),
en AS (SELECT attr_id, u.value_name, CAST(u.p AS INTEGER) AS value_id FROM atab,
       LATERAL (SELECT unnest(string_split(enum_values, '|')) AS value_name, generate_subscripts(string_split(enum_values, '|'), 1) AS p) u
       WHERE kind = 'enum')
SELECT attr_id, value_name, value_id, CAST(dense_rank() OVER (ORDER BY attr_id, value_id) AS INTEGER) AS dim_id FROM en""")
def q_s20(spark, d):
    p = V.table(spark, d, "part")
    ev = p.select(F.lit("type").alias("attr"), F.col("p_type").alias("v")).unionByName(
        p.select(F.lit("brand").alias("attr"), F.col("p_brand").alias("v")))
    enums = ev.groupBy("attr").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("enum_values")) \
        .select(F.lit("part").alias("item_type"), "attr", F.lit("enum").alias("kind"), "enum_values")
    extra = spark.createDataFrame([("part", "size", "int", None), ("part", "price", "double", None),
                                   ("part", "price", "double", None), ("part", "blob", "binary", None)],
                                  "item_type string, attr string, kind string, enum_values string")
    _, dims = IO.build_dimensions(enums.unionByName(extra))
    return dims.select("attr_id", "value_name", "value_id", "dim_id")


@query("s21_ingest_users", """
WITH k AS (SELECT 'cu' || CAST(c_custkey AS VARCHAR) AS client_userid, c_custkey AS user_id FROM customer WHERE c_acctbal > 0),
s AS (SELECT DISTINCT 'cu' || CAST(o_custkey AS VARCHAR) AS client_userid FROM orders),
n AS (SELECT client_userid FROM s WHERE client_userid NOT IN (SELECT client_userid FROM k))
SELECT client_userid, user_id FROM k UNION ALL
SELECT client_userid, CAST((SELECT max(user_id) FROM k) + dense_rank() OVER (ORDER BY client_userid) AS BIGINT) FROM n""")
def q_s21(spark, d):
    c = V.table(spark, d, "customer")
    users = c.filter("c_acctbal > 0").select(F.concat(F.lit("cu"), F.col("c_custkey").cast("string")).alias("client_userid"),
                                             F.col("c_custkey").alias("user_id"))
    items = spark.createDataFrame([], "client_itemid string, item_id long")
    acts = V.table(spark, d, "orders").select(F.concat(F.lit("cu"), F.col("o_custkey").cast("string")).alias("client_userid"),
                                              F.concat(F.lit("p"), (F.col("o_orderkey") % 1).cast("string")).alias("client_itemid"))
    u, _, _ = IO.ingest_actions(acts, users, items)
    return u
