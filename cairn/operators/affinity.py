"""User affinity to dimensions and tags (survey A8-A12).

Global totals are scalar subqueries (one aggregate evaluated once); per-user shares are grouped aggregates. Nothing is collected to
the driver, and the user cap is applied with a grouped count, not a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import filter_users_by_activity


def user_dim_clusters(actions: DataFrame, item_dim: DataFrame, min_actions: int, delta: float,
                      min_size: int, user="user_id", item="item_id", dim="dim_id") -> DataFrame:
    """Users with >= min_actions actions; each (action, dim of its item) row
    counts for the dim; a user joins the cluster of dim d when their share of
    rows in d exceeds the global share + delta; clusters with fewer than
    ``min_size`` users are dropped. Output (user, dim, weight = user share)."""
    a = filter_users_by_activity(actions.select(user, item), min_actions, None, user=user)
    ud = a.join(item_dim.select(item, dim), item).select(user, dim)
    ud_counts = ud.groupBy(user, dim).agg(F.count(F.lit(1)).alias("_c"))
    total_all = ud_counts.agg(F.sum("_c")).scalar()  # scalar subquery, evaluated once
    dim_share = ud_counts.groupBy(dim).agg(F.sum("_c").alias("_dc")) \
        .select(dim, (F.col("_dc") / total_all).alias("_g"))
    per_user = ud_counts.withColumn("_ut", F.sum("_c").over(Window.partitionBy(user)))
    share = per_user.join(dim_share, dim).select(user, dim, (F.col("_c") / F.col("_ut")).alias("weight"), "_g")
    passing = share.filter(F.col("weight") > F.col("_g") + F.lit(delta)).drop("_g")
    big = passing.groupBy(dim).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_size).select(dim)
    return passing.join(big, dim, "left_semi")


def _tag_rows(actions: DataFrame, item_tag: DataFrame, min_actions: int, user: str, item: str):
    """(action joined to its item) rows and their (user, tag) explosion."""
    a = filter_users_by_activity(actions.select(user, item), min_actions, None, user=user)
    items = item_tag.select(item).distinct()
    acts = a.join(items, item)                        # one row per action with a tagged item
    tags = a.join(item_tag.select(item, "tag"), item)  # one row per (action, tag)
    return acts, tags


def user_tag_affinity(actions: DataFrame, item_tag: DataFrame, min_actions: int = 10,
                      min_tag_count: int = 4, min_pc_increase: float = 0.2,
                      max_tags: int | None = 5, tag_filter: DataFrame | None = None,
                      analysis: bool = False, user="user_id", item="item_id") -> DataFrame:
    """tf = number of the user's actions whose item has the tag;
    keep tf > min_tag_count and (tf/docs - global)/global > min_pc_increase,
    where docs = the user's actions and global = tag rows / all actions.
    Users with more than ``max_tags`` passing tags are dropped entirely
    (A10 ``analysis=True``: no cap, with the user's action count)."""
    acts, tags = _tag_rows(actions, item_tag, min_actions, user, item)
    n_all = acts.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    glob = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("_tc")) \
        .select("tag", (F.col("_tc") / n_all).alias("_g"))
    docs = acts.groupBy(user).agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_actions)
    if tag_filter is not None:
        tags = tags.join(tag_filter.select("tag").distinct(), "tag", "left_semi")
    tf = tags.groupBy(user, "tag").agg(F.count(F.lit(1)).alias("tf")).filter(F.col("tf") > min_tag_count)
    j = tf.join(docs, user).join(glob, "tag")
    j = j.withColumn("affinity", (F.col("tf") / F.col("docs") - F.col("_g")) / F.col("_g")) \
        .filter(F.col("affinity") > F.lit(min_pc_increase))
    if analysis:
        return j.select(user, "tag", "affinity", "tf", "docs")
    if max_tags is not None:
        n_tags = j.groupBy(user).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") <= max_tags).select(user)
        j = j.join(n_tags, user, "left_semi")
    return j.select(user, "tag", "affinity")


def user_tag_clusters(actions: DataFrame, item_tag: DataFrame, tag_defs: DataFrame,
                      min_actions: int = 10, min_tag_count: int = 4, min_pc_increase: float = 0.2,
                      user="user_id", item="item_id") -> tuple[DataFrame, DataFrame]:
    """Passing tags (A9 without cap, restricted to the defined tags) are
    grouped per (user, cluster): the cluster's group id, cluster id, the
    sorted tag list and count. Also returns the id table (tag, group_id, cluster_id);
    ids are dense ranks of the group / cluster names."""
    defs = tag_defs.select("tag", "group", "cluster")
    ids = defs.withColumn("group_id", F.dense_rank().over(Window.orderBy("group")) - 1) \
        .withColumn("cluster_id", F.dense_rank().over(Window.orderBy("cluster")) - 1)
    aff = user_tag_affinity(actions, item_tag, min_actions, min_tag_count, min_pc_increase,
                            max_tags=None, tag_filter=defs, user=user, item=item)
    j = aff.join(ids.select("tag", "group_id", "cluster_id"), "tag")
    out = j.groupBy(user, "group_id", "cluster_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("tag"))).alias("tags"),
        F.count(F.lit(1)).alias("n_tags"))
    return out, ids.select("tag", "group_id", "cluster_id")


def user_tag_counts(actions: DataFrame, item_tag: DataFrame, min_actions: int,
                    user="user_id", item="item_id") -> DataFrame:
    """(user, tag, n) for users with at least ``min_actions`` actions."""
    _, tags = _tag_rows(actions, item_tag, min_actions, user, item)
    return tags.groupBy(user, "tag").agg(F.count(F.lit(1)).alias("n"))


def doc_vectors(tokens: DataFrame, vocab_size: int, key="doc_id", term="term") -> DataFrame:
    """vocabulary = the ``vocab_size`` most frequent terms (ties by
    term), indexed from 0; documents as (doc, term_index, count) rows."""
    from cairn.operators.ranking import global_top
    counts = tokens.groupBy(term).agg(F.count(F.lit(1)).alias("_n"))
    vocab = global_top(counts, [F.desc("_n"), F.asc(term)], vocab_size) \
        .withColumn("term_index", (F.row_number().over(Window.orderBy(F.desc("_n"), F.asc(term))) - 1).cast("int"))
    return tokens.join(F.broadcast(vocab.select(term, "term_index")), term) \
        .groupBy(key, "term_index").agg(F.count(F.lit(1)).alias("count"))


def class_ids(df: DataFrame, target: str, out: str = "class_id") -> DataFrame:
    """Distinct target labels with dense ids from 1 (ordered by label)."""
    from cairn.functions.ids import dense_index
    return dense_index(df.select(target).filter(F.col(target).isNotNull()).distinct(), [target], out)
