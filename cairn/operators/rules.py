"""Association rules and rule-based recommendation (survey M7, M8).

Frequent itemsets come from Spark ML's distributed FP-growth; rules are
derived with DataFrame joins against the itemset supports (no driver-side
map of itemsets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored


def frequent_itemsets(baskets: DataFrame, min_support: float, basket="basket_id", item="item") -> DataFrame:
    """(items sorted array<string>, freq, support) of all frequent itemsets."""
    from pyspark.ml.fpm import FPGrowth
    # baskets are counted and mined, itemsets are joined with each other: both are worked out once
    tx = stored(baskets.groupBy(basket).agg(F.collect_set(F.col(item).cast("string")).alias("items")), "baskets")
    n = tx.agg(F.count(F.lit(1))).scalar()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(tx)
    return stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets") \
        .select("items", "freq", (F.col("freq") / n).alias("support"))


def assoc_rules(baskets: DataFrame, min_support: float = 0.005, min_confidence: float = 0.2,
                min_interest: float = 0.1, min_itemset_freq: int = 0, max_itemset_size: int = 5,
                basket="basket_id", item="item") -> DataFrame:
    """M7: for every frequent itemset of size > 1 and each of its items:
    rule (itemset - item) -> item with confidence = supp(itemset)/supp(antecedent),
    interest = confidence - supp(item), lift = confidence / supp(item);
    antecedent and item supports come from itemsets with freq > min_itemset_freq
    and size <= max_itemset_size; rules kept when confidence > min_confidence
    and interest > min_interest."""
    fi = frequent_itemsets(baskets, min_support, basket, item)
    supp = fi.filter((F.col("freq") > min_itemset_freq) & (F.size("items") <= max_itemset_size)) \
        .select(F.col("items").alias("antecedent"), F.col("support").alias("_sa"))
    single = supp.filter(F.size("antecedent") == 1).select(
        F.col("antecedent")[0].alias("consequent"), F.col("_sa").alias("_si"))
    big = fi.filter(F.size("items") > 1)
    cand = big.select("items", "support", F.explode("items").alias("consequent")) \
        .withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    j = cand.join(supp, "antecedent").join(single, "consequent")
    j = j.filter((F.col("_sa") > 0) & (F.col("_si") > 0))
    conf = F.col("support") / F.col("_sa")
    out = j.select("antecedent", "consequent", conf.alias("confidence"),
                   (conf - F.col("_si")).alias("interest"), (conf / F.col("_si")).alias("lift"))
    return out.filter((F.col("confidence") > min_confidence) & (F.col("interest") > min_interest))


def basket_subsets(baskets: DataFrame, key: str, items: str = "basket") -> DataFrame:
    """All non-empty subsets (sorted arrays) of small baskets: 2^n - 1 of n items."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(items)).cast("int") - 1)
    b = baskets.select(key, F.array_sort(items).alias("_b"), F.explode(masks).alias("_m"))
    sub = F.expr("filter(_b, (x, i) -> ((_m >> i) & 1) = 1)")  # bit i of the mask selects item i
    return b.select(key, sub.alias("antecedent"))


def recommend_assoc(rules: DataFrame, baskets: DataFrame, key="user_id", items="basket",
                    max_basket: int = 3) -> DataFrame:
    """M8: each rule scores confidence * lift * |antecedent|; the basket
    (most recent first) is cut to ``max_basket`` items; every subset
    of it that equals a rule antecedent adds the rule's score to the rule's
    item; scores divided by the user's best. One-item baskets are supported. Equal baskets
    score alike: each different one (of a key's several, all together) is scored once."""
    r = rules.select("antecedent", "consequent",
                     (F.col("confidence") * F.col("lift") * F.size("antecedent")).alias("_s"))
    cut = baskets.groupBy(key).agg(F.array_sort(F.collect_list(F.array_sort(F.slice(items, 1, max_basket)))).alias("_all"))
    kinds = cut.select("_all").distinct()
    subs = basket_subsets(kinds.select("_all", F.explode("_all").alias(items)), "_all", items)
    j = subs.join(r, "antecedent").groupBy("_all", "consequent").agg(F.sum("_s").alias("score"))
    j = j.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("_all")))
    return cut.join(j, "_all").select(key, "consequent", "score")
