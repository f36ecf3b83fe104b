"""Registered queries: association rules and rule recommender (M7, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import rules as RU
from cairn.operators.similarity import recent_items
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


M7_CTES = W("order_baskets", "actions") + """,
tx AS (SELECT COUNT(DISTINCT basket_id) AS n FROM order_baskets),
mc AS (SELECT ceil(CAST(0.005 AS DOUBLE) * n) AS m FROM tx),
s1 AS (SELECT item, COUNT(*) AS f FROM order_baskets GROUP BY item HAVING COUNT(*) >= (SELECT m FROM mc)),
pr AS (SELECT a.item AS i1, b.item AS i2, COUNT(*) AS f FROM order_baskets a JOIN order_baskets b
       ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY ALL HAVING COUNT(*) >= (SELECT m FROM mc)),
tr AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, COUNT(*) AS f FROM order_baskets a JOIN order_baskets b
       ON a.basket_id = b.basket_id AND a.item < b.item JOIN order_baskets c ON b.basket_id = c.basket_id AND b.item < c.item
       GROUP BY ALL HAVING COUNT(*) >= (SELECT m FROM mc)),
su AS (SELECT item AS antecedent, 1 AS size, f FROM s1 UNION ALL SELECT i1 || ',' || i2, 2, f FROM pr),
ru AS (SELECT i1 AS antecedent, i2 AS consequent, f FROM pr UNION ALL SELECT i2, i1, f FROM pr
       UNION ALL SELECT i1 || ',' || i2, i3, f FROM tr UNION ALL SELECT i1 || ',' || i3, i2, f FROM tr
       UNION ALL SELECT i2 || ',' || i3, i1, f FROM tr),
rr AS (SELECT ru.antecedent, sa.size, ru.consequent, (ru.f / tx.n) / (sa.f / tx.n) AS confidence, si.f / tx.n AS si
       FROM ru JOIN su sa ON sa.antecedent = ru.antecedent JOIN s1 si ON si.item = ru.consequent, tx),
rules AS (SELECT antecedent, size, consequent, confidence, confidence - si AS interest, confidence / si AS lift FROM rr
          WHERE confidence > 0.05 AND confidence - si > -1)"""


def _rules(spark, d):
    return RU.assoc_rules(V.order_baskets(spark, d), min_support=0.005, min_confidence=0.05,
                          min_interest=-1.0, max_itemset_size=5)


@query("m7_assoc_rules", M7_CTES + """
SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(interest, 6) AS interest, round(lift, 6) AS lift FROM rules""")
def q_m7(spark, d):
    out = _rules(spark, d)
    return out.select(F.concat_ws(",", "antecedent").alias("antecedent"), "consequent",
                      r("confidence", "confidence"), r("interest", "interest"), r("lift", "lift"))


@query("m8_recommend_assoc", M7_CTES + """,
ab AS (SELECT a.user_id, p.p_brand AS item, a.t, a.order_key, a.line_no FROM actions a JOIN part p ON a.item_id = p.p_partkey),
l AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id, item ORDER BY t DESC, order_key DESC, line_no DESC) AS k,
             t, order_key, line_no FROM ab),
bk AS (SELECT user_id, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item DESC) AS q
       FROM l WHERE k = 1) WHERE q <= 3),
sb AS (SELECT user_id, item AS subset FROM bk UNION ALL
       SELECT a.user_id, a.item || ',' || b.item FROM bk a JOIN bk b ON a.user_id = b.user_id AND a.item < b.item),
sc AS (SELECT sb.user_id, rules.consequent, SUM(rules.confidence * rules.lift * rules.size) AS score
       FROM sb JOIN rules ON rules.antecedent = sb.subset GROUP BY ALL)
SELECT user_id, consequent, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM sc""")
def q_m8(spark, d):
    a = V.actions(spark, d)
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("item"))
    ab = a.join(p, "item_id").drop("item_id")
    rec = recent_items(ab, 3, item="item")
    baskets = rec.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("recent_rank", "item"))).alias("_b")) \
        .select("user_id", F.transform("_b", lambda x: x["item"]).alias("basket"))
    out = RU.recommend_assoc(_rules(spark, d), baskets)
    return out.select("user_id", "consequent", r("score", "score"))
