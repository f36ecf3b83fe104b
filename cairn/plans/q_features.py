"""Registered queries: feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import features as FE
from cairn.operators import affinity as AF
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query
from cairn.session import ensure_checkpoint_dir


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


FID_SQL = """
WITH c AS (SELECT o_orderpriority AS v, COUNT(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= {min_size}),
ids AS (SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS pid FROM c QUALIFY row_number() OVER (ORDER BY n DESC, v) <= {maxc})
SELECT o_orderkey, o_orderpriority, {pid} AS priority_id FROM orders LEFT JOIN ids ON orders.o_orderpriority = ids.v {where}"""


@query("f1_feature_id", FID_SQL.format(min_size=0, maxc=3, pid="COALESCE(pid, -1)", where=""))
def q_f1(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    fid = FE.FeatureId("o_orderpriority", "priority_id", max_classes=3).fit(o)
    return fid.transform(o).select("o_orderkey", "o_orderpriority", "priority_id")


@query("f1_feature_id_exclude_missing", FID_SQL.format(min_size=3000, maxc=1000, pid="pid", where="WHERE pid IS NOT NULL"))
def q_f1x(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    fid = FE.FeatureId("o_orderpriority", "priority_id", min_size=3000, exclude_missing=True).fit(o)
    return fid.transform(o).select("o_orderkey", "o_orderpriority", "priority_id")


@query("f2_svmlight", """
WITH l AS (SELECT c_custkey AS k, 'c_mktsegment_' || c_mktsegment AS name, 1.0 AS val FROM customer WHERE c_mktsegment IS NOT NULL
           UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM customer WHERE c_acctbal IS NOT NULL
           UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey IS NOT NULL),
ids AS (SELECT name, CAST(dense_rank() OVER (ORDER BY name) AS INTEGER) AS fid FROM (SELECT DISTINCT name FROM l))
SELECT k AS c_custkey, string_agg(CAST(fid AS VARCHAR) || ':' || printf('%.6f', val), ' ' ORDER BY fid, val) AS svm
FROM l JOIN ids USING (name) GROUP BY k""")
def q_f2(spark, d):
    c = V.table(spark, d, "customer")
    rows, _ = FE.svmlight_features(c, "c_custkey", ["c_mktsegment", "c_acctbal", "c_nationkey"])
    return rows


TFIDF_CTES = """
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS toks FROM documents),
n AS (SELECT COUNT(*) AS n FROM docs),
t AS (SELECT doc_id, unnest(toks) AS term FROM docs),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM t GROUP BY ALL),
dfq AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM dfq, n WHERE df >= 2 AND df <= 0.9 * n),
w AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
nr AS (SELECT doc_id, sqrt(SUM(w * w)) AS nr FROM w GROUP BY doc_id),
tw AS (SELECT w.doc_id, w.term, w.w / nr.nr AS weight FROM w JOIN nr ON w.doc_id = nr.doc_id)"""


def _tfidf(spark, d):
    docs = V.table(spark, d, "documents").repartition("doc_id").select("doc_id", FE.tokenize(F.col("text")).alias("toks"))
    return FE.tfidf(docs, "doc_id", "toks", min_df=2, max_df=0.9)


@query("f3_tfidf", TFIDF_CTES + "\nSELECT doc_id, term, round(weight, 6) AS weight FROM tw")
def q_f3(spark, d):
    return _tfidf(spark, d).select("doc_id", "term", r("weight", "weight"))


@query("f3_chi2_select", TFIDF_CTES + """,
j AS (SELECT tw.*, l.quality FROM tw JOIN labels l ON tw.doc_id = l.doc_id),
o AS (SELECT term, quality, SUM(weight) AS o FROM j GROUP BY ALL),
pr AS (SELECT quality, COUNT(*) / (SELECT COUNT(*) FROM labels) AS p FROM labels GROUP BY quality),
s AS (SELECT term, SUM(o * o / p) AS q, SUM(o) AS t FROM o JOIN pr ON o.quality = pr.quality GROUP BY term)
SELECT term, round(q / t - t, 6) AS chi2 FROM s ORDER BY round(q / t - t, 9) DESC, term LIMIT 20""")
def q_f3c(spark, d):
    out = FE.chi2_select(_tfidf(spark, d), V.table(spark, d, "labels"), "doc_id", "quality", 20)
    return out.select("term", r("chi2", "chi2"))


def _auto_frame(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
                    F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("odate"),
                    (F.col("o_custkey") % 2).cast("string").alias("flag"), F.lit("x").alias("const"),
                    F.col("o_orderstatus").alias("status_copy"))


@query("f6_f7_auto_transform", """
WITH f AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority, o_orderdate AS odate,
                  CAST(o_custkey % 2 AS VARCHAR) AS flag FROM orders),
st AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd, COUNT(*) AS n FROM f),
ss AS (SELECT status AS v FROM f GROUP BY status HAVING COUNT(*) / (SELECT n FROM st) >= 0.05),
sp AS (SELECT priority AS v FROM f GROUP BY priority HAVING COUNT(*) / (SELECT n FROM st) >= 0.05)
SELECT o_orderkey,
  CASE WHEN status IS NULL THEN 'UKN' WHEN status IN (SELECT v FROM ss) THEN replace(lower(status), ' ', '_') END AS status,
  round(COALESCE((price - (SELECT mu FROM st)) / (SELECT sd FROM st), 0.0), 6) AS price,
  CASE WHEN priority IS NULL THEN 'UKN' WHEN priority IN (SELECT v FROM sp) THEN replace(lower(priority), ' ', '_') END AS priority,
  round(sin(2 * pi() * hour(odate) / 24.0), 6) AS odate_h_sin, round(cos(2 * pi() * hour(odate) / 24.0), 6) AS odate_h_cos, 'h' || CAST(hour(odate) AS VARCHAR) AS odate_h,
  round(sin(2 * pi() * month(odate) / 12.0), 6) AS odate_m_sin, round(cos(2 * pi() * month(odate) / 12.0), 6) AS odate_m_cos, 'm' || CAST(month(odate) AS VARCHAR) AS odate_m,
  round(sin(2 * pi() * ((dayofweek(odate) + 6) % 7) / 7.0), 6) AS odate_w_sin, round(cos(2 * pi() * ((dayofweek(odate) + 6) % 7) / 7.0), 6) AS odate_w_cos,
  'w' || CAST((dayofweek(odate) + 6) % 7 AS VARCHAR) AS odate_w, 'y' || CAST(year(odate) AS VARCHAR) AS odate_y,
  CAST(flag AS INTEGER) AS flag
FROM f""")
def q_f6(spark, d):
    f = _auto_frame(spark, d)
    at = FE.AutoTransform(exclude=["o_orderkey"], min_cat_percent=0.05).fit(f)
    out = at.transform(f)
    return out.select(*[F.round(c, 6).alias(c) if c == "price" or c.endswith(("_sin", "_cos")) else
                        (F.col(c).cast("int").alias(c) if c == "flag" else F.col(c)) for c in out.columns])


@query("f8_standard_scale", """
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS scaled_c_acctbal FROM customer""")
def q_f8(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = FE.standard_scale(c, ["c_acctbal"])
    return out.select("c_custkey", r("scaled_c_acctbal", "scaled_c_acctbal"))


@query("f9_assemble")
def q_f9(spark, d):
    from pyspark.ml.functions import vector_to_array
    c = V.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    out = FE.assemble(c, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    return out.select("c_custkey", F.size(vector_to_array("features")).alias("width"))


@query("f10_f11_text_pipeline")
def q_f10(spark, d):
    import uuid
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    model = FE.text_pipeline(num_features=1 << 12).fit(docs)
    path = f"{ensure_checkpoint_dir(spark)}/models/text-{uuid.uuid4().hex}"
    FE.save_pipeline(model, path)
    loaded = FE.load_pipeline(path)
    from pyspark.ml.functions import vector_to_array
    out = loaded.transform(docs)
    return out.select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x != 0)).alias("nnz"))


@query("f12_vw_lines", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'd' || CAST(user_id % 3 AS VARCHAR) AS device FROM events),
c AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS cid FROM (SELECT DISTINCT event_type FROM events))
SELECT e.event_id, CAST(c.cid AS VARCHAR) || ' |f device_' || e.device || ' k:' || CAST(e.k AS VARCHAR) AS line
FROM e JOIN c ON e.event_type = c.event_type""")
def q_f12(spark, d):
    e = V.table(spark, d, "events")
    js = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "device": "d'),
                  (F.col("user_id") % 3).cast("string"), F.lit('"}'))
    ev = e.select("event_id", "event_type", js.alias("json"))
    return FE.vw_lines(ev, "json", "event_type")


@query("f5_tag_feature_lines", W("actions", "item_tag", "item_tags") + """,
a AS (SELECT user_id, item_id FROM actions WHERE user_id IN (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) >= 10)),
acts AS (SELECT a.* FROM a WHERE item_id IN (SELECT item_id FROM item_tag)),
tags AS (SELECT a.user_id, t.tag FROM a JOIN item_tag t ON a.item_id = t.item_id),
gl AS (SELECT tag, COUNT(*) / (SELECT COUNT(*) FROM acts) AS g FROM tags GROUP BY tag),
docs AS (SELECT user_id, COUNT(*) AS docs FROM acts GROUP BY user_id HAVING COUNT(*) >= 10),
tf AS (SELECT user_id, tag, COUNT(*) AS tf FROM tags GROUP BY ALL HAVING COUNT(*) > 4),
j AS (SELECT tf.user_id, tf.tag, (tf.tf / docs.docs - gl.g) / gl.g AS affinity FROM tf JOIN docs ON tf.user_id = docs.user_id JOIN gl ON tf.tag = gl.tag),
p AS (SELECT * FROM j WHERE affinity > 0.2),
aff AS (SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY user_id HAVING COUNT(*) <= 5)),
ut AS (SELECT user_id, string_agg(tag || ':' || printf('%.4f', affinity), ' ' ORDER BY tag) AS u FROM aff GROUP BY user_id),
pairs AS (SELECT DISTINCT user_id, item_id FROM actions)
SELECT pairs.user_id, pairs.item_id, '1 |i ' || array_to_string(list_sort(string_split(it.tags, ',')), ' ') || ' |u ' || ut.u AS line
FROM pairs JOIN ut ON pairs.user_id = ut.user_id JOIN item_tags it ON pairs.item_id = it.item_id""")
def q_f5(spark, d):
    a = V.actions(spark, d)
    aff = AF.user_tag_affinity(a, V.item_tag(spark, d), 10, 4, 0.2, 5)
    return FE.tag_feature_lines(a, V.item_tags(spark, d), aff)


F4_SQL = W("actions", "item_tags") + """,
j AS (SELECT a.*, string_split(it.tags, ',') AS tg FROM actions a JOIN item_tags it ON a.item_id = it.item_id),
c AS (SELECT *, row_number() OVER w - 1 AS c, flatten(list(tg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS hist FROM j
      WINDOW w AS (PARTITION BY user_id ORDER BY t, order_key, line_no, item_id)),
ln AS (SELECT user_id, item_id, c, array_to_string(list_concat(list_transform(tg, lambda x: 'i_' || x),
       list_transform(COALESCE(hist, []), lambda x: 'u_' || x)), ' ') AS line FROM c WHERE c >= 1 AND c <= 10),
tk AS (SELECT user_id, c, u.term, u.pos FROM ln, LATERAL (SELECT unnest(string_split(line, ' ')) AS term,
       generate_subscripts(string_split(line, ' '), 1) AS pos) u WHERE u.term <> ''),
tf AS (SELECT user_id, c, term, COUNT(*) AS tf, min(pos) AS pos FROM tk GROUP BY ALL),
m AS (SELECT COUNT(*) AS m FROM ln),
idf AS (SELECT term, CASE WHEN COUNT(*) >= 2 THEN ln(((SELECT m FROM m) + 1.0) / (COUNT(*) + 1.0)) ELSE 0.0 END AS idf FROM tf GROUP BY term),
w AS (SELECT tf.*, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
ui AS (SELECT user_id, c, string_agg(term || ':' || printf('%.6f', w), ' ' ORDER BY pos) AS ip FROM w WHERE starts_with(term, 'i_') GROUP BY ALL),
uu AS (SELECT user_id, c, string_agg(term || ':' || printf('%.6f', w), ' ' ORDER BY w, term) AS up FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY w, term) AS q FROM w WHERE starts_with(term, 'u_')) WHERE q <= 4 GROUP BY ALL),
keys AS (SELECT DISTINCT user_id, c FROM w)"""


def _f4(spark, d):
    from cairn.operators import sessions as SS
    lines = SS.history_features(V.actions(spark, d), V.item_tags(spark, d), 1, 10, seq=("t", "order_key", "line_no", "item_id"))
    return FE.history_tfidf_lines(lines, ["user_id", "c"], min_doc_freq=2, max_user_features=3)


@query("f4_history_tfidf_lines", F4_SQL + """
SELECT k.user_id, CAST(k.c AS INTEGER) AS c, '1 |i ' || COALESCE(ui.ip, '') || ' |u ' || COALESCE(uu.up, '') AS features
FROM keys k LEFT JOIN ui ON k.user_id = ui.user_id AND k.c = ui.c LEFT JOIN uu ON k.user_id = uu.user_id AND k.c = uu.c""")
def q_f4(spark, d):
    out, _ = _f4(spark, d)
    return out


@query("f4_idf_table", F4_SQL + "\nSELECT term, round(idf, 6) AS idf FROM idf")
def q_f4i(spark, d):
    _, idf = _f4(spark, d)
    return idf.select("term", r("idf", "idf"))
