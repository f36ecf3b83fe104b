"""Popularity, weighted ratings and time-decayed counts (survey A6, A7, A13, A15-A19).

Every operator aggregates *before* it joins to catalogue tables, so the
shuffle carries one row per key instead of one per action, and partial
(map-side) aggregation absorbs hot keys.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import has_tag, require_dims
from cairn.operators.ranking import global_top, top_k


def most_popular(actions: DataFrame, item="item_id") -> DataFrame:
    """Number of actions per item (item ids > 0)."""
    return actions.filter(F.col(item) > 0).groupBy(item).agg(F.count(F.lit(1)).alias("n_actions"))


def most_popular_by_dim(actions: DataFrame, item_dim: DataFrame, k: int = 10,
                        min_count: float = 0.0, required: Sequence[int] | None = None,
                        item="item_id", dim="dim_id", value="value") -> DataFrame:
    """sum(value + 1) per (item, dim), kept when >= min_count, top k per dim.

    The action sum is computed per item first (one row per item crosses
    the shuffle), then fanned out to the item's dimensions."""
    per_item = actions.groupBy(item).agg(F.sum(F.col(value) + 1).alias("count"))
    dims = require_dims(item_dim.select(item, dim), required, item, dim)
    scored = per_item.join(dims, item).filter(F.col("count") >= F.lit(min_count))
    return top_k(scored, [dim], [F.desc("count"), F.asc(item)], k)


def action_ratings(actions: DataFrame, weights: Mapping[int, tuple[float, float]],
                   user="user_id", item="item_id", type_col="type") -> DataFrame:
    """Per (user, item): sum over action types of min(value_per_action * n, max_sum);
    action types without a weighting contribute 0."""
    spark = actions.sparkSession
    w = spark.createDataFrame([(int(t), float(v), float(m)) for t, (v, m) in weights.items()],
                              f"{type_col} int, per_action double, max_sum double")
    per_type = actions.groupBy(user, item, type_col).agg(F.count(F.lit(1)).alias("_n"))
    # the weight table has one row per configured action type: a bounded broadcast
    scored = per_type.join(F.broadcast(w), type_col, "left").select(
        user, item,
        F.coalesce(F.least(F.col("per_action") * F.col("_n"), F.col("max_sum")), F.lit(0.0)).alias("_s"))
    return scored.groupBy(user, item).agg(F.sum("_s").alias("rating"))


def decay_factor(now, t, alpha: float):
    """exp(-(now - t)/alpha), with times later than ``now`` clamped to it."""
    return F.exp(-F.greatest(F.lit(now) - t, F.lit(0)) / F.lit(float(alpha)))


def decayed_counts(actions: DataFrame, keys: Sequence[str], alpha: float, now: int,
                   t="t", weight=None) -> DataFrame:
    """Exponentially decayed count per key read at ``now``:
    sum(w * exp(-(now - t)/alpha)), the closed form of the running update
    c <- w + exp(-(t - t0)/alpha) c applied in time order. Also the last time."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return actions.groupBy(*keys).agg(
        F.sum(w * decay_factor(now, F.col(t), alpha)).alias("count"),
        F.max(t).alias("t"))


def cluster_counts(actions: DataFrame, user_clusters: DataFrame, alpha: float, now: int,
                   bucket: bool = True, user="user_id", item="item_id", t="t",
                   cluster="cluster_id", weight="weight") -> DataFrame:
    """Each action adds its user's cluster weight to every cluster of the
    user; users without a cluster go to cluster -1 (when ``bucket``)."""
    # pre-aggregate per (user, item): the decay is linear, so the per-user
    # partial sums can be fanned out to clusters afterwards
    ui = actions.groupBy(user, item).agg(
        F.sum(decay_factor(now, F.col(t), alpha)).alias("_c"), F.max(t).alias("_t"))
    how = "left" if bucket else "inner"
    j = ui.join(user_clusters.select(user, cluster, weight), user, how)
    j = j.select(item, F.coalesce(F.col(cluster), F.lit(-1)).alias(cluster),
                 (F.col("_c") * F.coalesce(F.col(weight), F.lit(1.0))).alias("_c"), "_t")
    return j.groupBy(cluster, item).agg(F.sum("_c").alias("count"), F.max("_t").alias("t"))


def top_counts(cc: DataFrame, limit: int, by: str = "cluster", item_dim: DataFrame | None = None,
               dims: Sequence[int] | None = None, dim2: int | None = None, item_tags: DataFrame | None = None,
               tag: str | None = None, cluster="cluster_id", item="item_id") -> DataFrame:
    """Top decayed counts per cluster (``by='cluster'``) or over all
    clusters (``by='global'``), optionally restricted to items carrying one
    of ``dims`` (and also ``dim2``), or ``tag`` in the comma list of ``item_tags``."""
    if tag is not None:
        cc = cc.join(item_tags.filter(has_tag("tags", tag)).select(item).distinct(), item, "left_semi")
    if item_dim is not None and dims:
        ok = item_dim.filter(F.col("dim_id").isin(list(dims))).select(item)
        cc = cc.join(ok.distinct(), item, "left_semi")
        if dim2 is not None:
            ok2 = item_dim.filter(F.col("dim_id") == dim2).select(item)
            cc = cc.join(ok2.distinct(), item, "left_semi")
    if by == "global":
        g = cc.groupBy(item).agg(F.sum("count").alias("count"))
        top = global_top(g, [F.desc("count"), F.asc(item)], limit)  # per-task top n, one small merge
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc(item))).cast("bigint"))
    return top_k(cc, [cluster], [F.desc("count"), F.asc(item)], limit)


def significant_counts(cc: DataFrame, alpha: float, now: int, limit: int,
                       cluster="cluster_id", item="item_id") -> DataFrame:
    """Per cluster, v = (c/sl - s/sg) / greatest(c/sl, s/sg), score = v * c,
    where c is the decayed count, s the item's total over clusters, sg the
    grand total and sl the sum of decay weights of the cluster's rows."""
    item_tot = cc.groupBy(item).agg(F.sum("count").alias("_s"))
    grand = cc.agg(F.sum("count")).scalar()  # scalar subquery
    cl = cc.groupBy(cluster).agg(F.sum(decay_factor(now, F.col("t"), alpha)).alias("_sl"))
    j = cc.join(item_tot, item).join(cl, cluster).withColumn("_sg", grand)
    a = F.col("count") / F.col("_sl")
    b = F.col("_s") / F.col("_sg")
    scored = j.select(cluster, item, "count",
                      (((a - b) / F.greatest(a, b)) * F.col("count")).alias("score"))
    return top_k(scored, [cluster], [F.desc("score"), F.asc(item)], limit)


def update_popularity(old: DataFrame, batch: DataFrame, now: int, half: float = 82400.0,
                      key="item_id") -> DataFrame:
    """Merge a batch of counts into decayed popularity:
    score <- batch + exp(-(now - last)/82400) * score; keys only in the old
    table keep their score; new keys start at the batch count. Output
    carries the update time."""
    o = old.select(key, F.col("score").alias("_old"), F.col("t").alias("_t"))
    b = batch.select(key, F.col("count").alias("_new"))
    j = o.join(b, key, "full_outer")
    decayed = F.col("_old") * decay_factor(now, F.col("_t"), half)
    return j.select(
        key,
        F.when(F.col("_new").isNull(), F.col("_old"))
         .when(F.col("_old").isNull(), F.col("_new").cast("double"))
         .otherwise(F.col("_new") + decayed).alias("score"),
        F.when(F.col("_new").isNull(), F.col("_t")).otherwise(F.lit(now).cast("bigint")).alias("t"))
