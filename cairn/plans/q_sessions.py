"""Registered queries: sessions, baskets, sequence features, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.scalars import filter_actions
from cairn.operators import sessions as SS
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query

GAP_US = 21600 * 1_000_000      # 6 h, in microseconds (events time)
DAY_US = 86400 * 1_000_000


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _sess_sql(src: str, gap: int, order: str, new_extra: str = "") -> str:
    cond = f"gp > {gap}" + (f" AND {new_extra}" if new_extra else "")
    return f"""
g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY {order}) AS gp FROM {src}),
s AS (SELECT *, CAST(SUM(CASE WHEN gp IS NULL OR ({cond}) THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)"""


W1_SQL = W("clicks") + """,
a AS (SELECT * FROM clicks WHERE user_id IN
        (SELECT user_id FROM clicks GROUP BY user_id HAVING count(*) >= 1 AND count(*) <= 1000)),""" + \
    _sess_sql("a", GAP_US, "t_us, event_id") + """
SELECT user_id, session_no, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY t_us, event_id) AS items,
       COUNT(*) AS n FROM s GROUP BY user_id, session_no"""


@query("w1_session_items", W1_SQL)
def q_w1(spark, d):
    return SS.session_items(V.clicks(spark, d), GAP_US, 1, 1000, t="t_us", seq=("t_us", "event_id"),
                            bucket_width=DAY_US)


@query("w1_session_items_unbucketed", W1_SQL)
def q_w1u(spark, d):
    return SS.session_items(V.clicks(spark, d), GAP_US, 1, 1000, t="t_us", seq=("t_us", "event_id"))


W2_CTES = W("impressions") + "," + _sess_sql("impressions", GAP_US, "t_us, event_id") + f""",
per AS (SELECT user_id, session_no,
          CAST(SUM(CASE WHEN gp IS NOT NULL AND gp <= {GAP_US} THEN floor(gp / 1000000) ELSE 0 END) AS BIGINT) AS secs,
          COUNT(*) AS pv FROM s GROUP BY user_id, session_no),
kept AS (SELECT user_id, session_no, CASE WHEN secs = 0 THEN 1 ELSE secs END AS secs, pv,
           CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY session_no) = 1 THEN 1 ELSE 0 END AS first
         FROM per WHERE pv <= 50),
bad AS (SELECT user_id FROM impressions GROUP BY user_id HAVING count(DISTINCT abkey) > 1),
u0 AS (SELECT user_id, first(consumer ORDER BY t_us, event_id) AS consumer,
              first(abkey ORDER BY t_us, event_id) AS abkey FROM impressions GROUP BY user_id),
m AS (SELECT k.user_id, k.session_no, k.secs, k.pv, k.first, u0.consumer, u0.abkey
      FROM kept k JOIN u0 ON k.user_id = u0.user_id WHERE k.user_id NOT IN (SELECT user_id FROM bad))"""


@query("w2_session_metrics", W2_CTES + "\nSELECT * FROM m")
def q_w2(spark, d):
    return SS.session_metrics(V.impressions(spark, d), GAP_US, 50, bucket_width=DAY_US)


@query("a3_engagement", W2_CTES + """,
per2 AS (SELECT consumer, abkey, SUM(secs) / COUNT(*) AS avg_secs, SUM(pv) / COUNT(*) AS avg_pv,
           SUM(CASE WHEN pv > 1 THEN 1 ELSE 0 END) / COUNT(*) AS plus_share FROM m GROUP BY ALL)
SELECT b.consumer, round(b.avg_secs, 6) AS b_avg_secs, round(b.avg_pv, 6) AS b_avg_pv, round(b.plus_share, 6) AS b_plus_share,
       round(n.avg_secs, 6) AS n_avg_secs, round(n.avg_pv, 6) AS n_avg_pv, round(n.plus_share, 6) AS n_plus_share,
       round(n.avg_secs - b.avg_secs, 6) AS d_avg_secs, round(n.avg_pv - b.avg_pv, 6) AS d_avg_pv,
       round(n.plus_share - b.plus_share, 6) AS d_plus_share
FROM per2 b JOIN per2 n ON b.consumer = n.consumer AND b.abkey = 'baseline' AND n.abkey = 'normal'""")
def q_a3(spark, d):
    e = SS.engagement(V.impressions(spark, d), GAP_US, 50, bucket_width=DAY_US)
    return e.select("consumer", *[r(c, c) for c in e.columns if c != "consumer"])


@query("w3_session_tags", W("actions", "item_tags") + """,
a AS (SELECT * FROM actions WHERE user_id IN
        (SELECT user_id FROM actions GROUP BY user_id HAVING count(*) > 5 AND count(*) < 100)),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, order_key, line_no, item_id) AS gp FROM a),
s AS (SELECT *, CAST(SUM(CASE WHEN gp IS NULL OR gp > 2592000 THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id ORDER BY t, order_key, line_no, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
j AS (SELECT s.user_id, s.session_no, unnest(string_split(it.tags, ',')) AS tag FROM s JOIN item_tags it ON s.item_id = it.item_id),
gg AS (SELECT user_id, session_no, list_sort(list(tag)) AS tg FROM j WHERE tag <> '' GROUP BY ALL)
SELECT user_id, session_no, array_to_string(tg, ' ') AS tags FROM gg WHERE len(tg) >= 4""")
def q_w3(spark, d):
    return SS.session_tags(V.actions(spark, d), V.item_tags(spark, d), 2592000, 5, 100, 4,
                           seq=("t", "order_key", "line_no", "item_id"))


@query("w4_baskets", W("clicks") + """,
a0 AS (SELECT * FROM clicks WHERE event_type IN ('purchase', 'error')),
a AS (SELECT * FROM a0 WHERE user_id IN
        (SELECT user_id FROM a0 GROUP BY user_id HAVING count(*) >= 2 AND count(*) <= 1000)),""" +
       _sess_sql("a", DAY_US, "t_us, event_id", "event_type = 'purchase'").replace("session_no", "segment") + """,
l AS (SELECT user_id, segment, item_id, last(event_type ORDER BY t_us, event_id) AS lt FROM s GROUP BY ALL)
SELECT user_id, segment, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS basket
FROM l WHERE lt = 'purchase' GROUP BY user_id, segment""")
def q_w4(spark, d):
    return SS.baskets(V.clicks(spark, d), "purchase", "error", DAY_US, 2, 1000)


def _hist_sql(only_prev: bool, src: str) -> str:
    hist = ("lag(tg) OVER w" if only_prev
            else "flatten(list(tg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    return W("actions", "item_tags") + f""",
j AS (SELECT a.*, string_split(it.tags, ',') AS tg FROM {src} a JOIN item_tags it ON a.item_id = it.item_id),
c AS (SELECT *, row_number() OVER w - 1 AS c, {hist} AS hist FROM j
      WINDOW w AS (PARTITION BY user_id ORDER BY t, order_key, line_no, item_id))
SELECT user_id, item_id, c, array_to_string(list_concat(list_transform(tg, lambda x: 'i_' || x),
       list_transform(COALESCE(hist, []), lambda x: 'u_' || x)), ' ') AS line
FROM c WHERE c >= 1 AND c <= 10"""


@query("w5_history_features", _hist_sql(False, "actions"))
def q_w5(spark, d):
    out = SS.history_features(V.actions(spark, d), V.item_tags(spark, d), 1, 10, seq=("t", "order_key", "line_no", "item_id"))
    return out.withColumn("c", F.col("c").cast("bigint"))


@query("w6_next_item_features", _hist_sql(True, "(SELECT * FROM actions WHERE value > 3)"))
def q_w6(spark, d):
    a = filter_actions(V.actions(spark, d), min_value=3)
    out = SS.history_features(a, V.item_tags(spark, d), 1, 10, seq=("t", "order_key", "line_no", "item_id"), only_prev=True)
    return out.withColumn("c", F.col("c").cast("bigint"))


@query("w7_recent_interactions", W("actions") + """,
l AS (SELECT user_id, item_id, t, order_key, line_no, row_number() OVER
        (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k FROM actions),
p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS pos
      FROM l WHERE k = 1),
q AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS len FROM p WHERE pos <= 10)
SELECT user_id, item_id, round((len - pos + 1) / len, 6) AS score FROM q WHERE pos <= 5""")
def q_w7(spark, d):
    out = SS.recent_interactions(V.actions(spark, d), 10, 5)
    return out.select("user_id", "item_id", r("score", "score"))


NGRAM_SQL = W("clicks") + """,
p AS (SELECT user_id, item_id, t_us, event_id, lag(item_id) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS pi FROM clicks),
d AS (SELECT * FROM p WHERE pi IS NULL OR pi <> item_id),
d2 AS (SELECT * FROM d WHERE user_id IN (SELECT user_id FROM d GROUP BY user_id HAVING count(*) > 1)),
s AS (SELECT user_id, item_id AS w1, lead(item_id, 1) OVER w AS w2, lead(item_id, 2) OVER w AS w3 FROM d2
      WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
g AS (SELECT 1 AS n, CAST(w1 AS VARCHAR) AS gram, '' AS hist FROM s
      UNION ALL SELECT 2, w1 || ' ' || w2, CAST(w1 AS VARCHAR) FROM s WHERE w2 IS NOT NULL
      UNION ALL SELECT 3, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 FROM s WHERE w3 IS NOT NULL),
c AS (SELECT n, gram, hist, count(*) AS count FROM g GROUP BY ALL),
x AS (SELECT n, hist, sum(count) AS ctx FROM c GROUP BY ALL),
model AS (SELECT c.n, c.gram, c.hist, c.count, c.count / x.ctx AS prob FROM c JOIN x ON c.n = x.n AND c.hist = x.hist
          WHERE c.n = 1 OR c.count > 1)"""


@query("a20_ngram_model", NGRAM_SQL + "\nSELECT n, gram, hist, count, round(prob, 6) AS prob FROM model")
def q_a20(spark, d):
    out = SS.ngram_model(V.clicks(spark, d), 3, order=("t_us", "event_id"), bucket_width=DAY_US)
    return out.select("n", "gram", "hist", "count", r("prob", "prob"))
