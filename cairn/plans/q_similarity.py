"""Registered queries: item similarity, similarity recommender, tag co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import similarity as SIM
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


THRESH, LIMIT, CHUNK = 0.05, 20, 64   # small chunk so the grid path also runs on the test tables

M1_CTES = W("actions", "item_tag") + f""",
p AS (SELECT DISTINCT user_id, item_id FROM actions),
n AS (SELECT item_id, COUNT(*) AS c FROM p GROUP BY item_id),
co AS (SELECT a.item_id AS item1, b.item_id AS item2, COUNT(*) AS co FROM p a JOIN p b
       ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL),
s AS (SELECT item1, item2, co / sqrt(n1.c * n2.c) AS sim FROM co JOIN n n1 ON n1.item_id = item1
      JOIN n n2 ON n2.item_id = item2),
rk AS (SELECT *, row_number() OVER (PARTITION BY item1 ORDER BY sim DESC, item2) AS rn FROM s WHERE sim >= {THRESH}),
sim AS (SELECT item1, item2, sim FROM rk WHERE rn <= {LIMIT})"""


def _sim(spark, d):
    return SIM.item_similarity(V.actions(spark, d), limit=LIMIT, threshold=THRESH, chunk=CHUNK)


@query("m1_item_similarity", M1_CTES + "\nSELECT item1, item2, round(sim, 6) AS sim FROM sim")
def q_m1(spark, d):
    return _sim(spark, d).select("item1", "item2", r("sim", "sim"))


M2_CTES = M1_CTES + f""",
bo AS (SELECT item1 AS item_id, item2 AS other_id, sim FROM sim UNION SELECT item2, item1, sim FROM sim),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, other_id) AS k FROM bo) WHERE k <= {LIMIT}),
l AS (SELECT user_id, item_id, t, order_key, line_no, row_number() OVER
        (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k FROM actions),
rec AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS q FROM l WHERE k = 1) WHERE q <= 5),
sc AS (SELECT rec.user_id, nb.other_id AS item_id, SUM(nb.sim) AS score FROM rec JOIN nb ON rec.item_id = nb.item_id GROUP BY ALL),
un AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = sc.user_id AND a.item_id = sc.item_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM un)"""


@query("m2_recommend_item_similarity", M2_CTES + """
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM top WHERE rank <= 10""")
def q_m2(spark, d):
    a = V.actions(spark, d)
    nb = SIM.neighbours(_sim(spark, d), LIMIT)
    out = SIM.recommend_item_similarity(nb, a, 5, 10)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("w11_symmetric_neighbours", M2_CTES.split(",\nl AS")[0] + "\nSELECT item_id, other_id, round(sim, 6) AS sim FROM nb")
def q_w11(spark, d):
    nb = SIM.neighbours(_sim(spark, d), LIMIT)
    return nb.select("item_id", "other_id", r("sim", "sim"))


M20_CTES = W("item_tag") + """,
p AS (SELECT DISTINCT item_id AS doc_id, tag FROM item_tag),
n AS (SELECT tag, COUNT(*) AS c FROM p GROUP BY tag),
co AS (SELECT a.tag AS tag, b.tag AS other, COUNT(*) AS co FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.tag <> b.tag GROUP BY ALL),
j AS (SELECT co.tag, co.other, co.co, n1.c AS n1, n2.c AS n2, (SELECT COUNT(*) FROM n) AS ntags
      FROM co JOIN n n1 ON n1.tag = co.tag JOIN n n2 ON n2.tag = co.other)"""


@query("m20_tag_jaccard", M20_CTES + """
SELECT tag, other, round(score, 6) AS score FROM (SELECT tag, other,
  CASE WHEN n1 / ntags > 15.0 THEN 0.0 ELSE co / (n1 + n2 - co) END AS score FROM j) WHERE score > 0""")
def q_m20j(spark, d):
    out = SIM.tag_similarity(V.item_tag(spark, d).withColumnRenamed("item_id", "doc_id"), "jaccard", max_share=15.0)
    return out.select("tag", "other", r("score", "score"))


@query("m20_tag_asymmetric", M20_CTES + """
SELECT tag, other, round(score, 6) AS score FROM (SELECT tag, other,
  CASE WHEN n2 < 40 THEN 0.0 ELSE co / n2 END AS score FROM j) WHERE score > 0""")
def q_m20a(spark, d):
    out = SIM.tag_similarity(V.item_tag(spark, d).withColumnRenamed("item_id", "doc_id"), "asym", min_count=40)
    return out.select("tag", "other", r("score", "score"))


@query("m20_recommend_tags", M20_CTES + """,
sc AS (SELECT tag, other, co / (n1 + n2 - co) AS score FROM j),
q AS (SELECT item_id AS query_id, tag FROM item_tag),
agg AS (SELECT q.query_id, sc.other, SUM(sc.score) AS score FROM q JOIN sc ON q.tag = sc.tag GROUP BY ALL),
un AS (SELECT * FROM agg WHERE NOT EXISTS (SELECT 1 FROM q q2 WHERE q2.query_id = agg.query_id AND q2.tag = agg.other)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, other) AS rank FROM un)
SELECT query_id, other, round(score, 6) AS score, rank FROM rk WHERE rank <= 3""")
def q_m20r(spark, d):
    it = V.item_tag(spark, d)
    scores = SIM.tag_similarity(it.withColumnRenamed("item_id", "doc_id"), "jaccard")
    out = SIM.recommend_tags(scores, it.withColumnRenamed("item_id", "query_id"), 3)
    return out.select("query_id", "other", r("score", "score"), "rank")


@query("m18_neighbour_tag_quality", M2_CTES.split(",\nl AS")[0] + """,
ts AS (SELECT item_id, list_distinct(list(tag)) AS tg FROM item_tag GROUP BY item_id),
jj AS (SELECT nb.item_id, len(list_intersect(a.tg, b.tg)) / len(list_distinct(list_concat(a.tg, b.tg))) AS jac
       FROM nb JOIN ts a ON a.item_id = nb.item_id JOIN ts b ON b.item_id = nb.other_id),
pd AS (SELECT item_id, avg(jac) AS m FROM jj GROUP BY item_id)
SELECT round(avg(m), 6) AS score, COUNT(*) AS n_docs FROM pd""")

def q_m18(spark, d):
    nb = SIM.neighbours(_sim(spark, d), LIMIT).withColumnRenamed("item_id", "doc_id")
    out = SIM.neighbour_tag_quality(nb, V.item_tag(spark, d).withColumnRenamed("item_id", "doc_id"))
    return out.select(r("score", "score"), "n_docs")
