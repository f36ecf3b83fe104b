"""Ordering, top-k and set helpers (survey W8-W14).

``top_k`` is written as ``row_number() <= k`` so Spark plans a
``WindowGroupLimit``: each map task keeps only its local top k per key
before the shuffle, which bounds the data a hot key can send to one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
          rank_col: str | None = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order`` (ties must be broken in ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    if rank_col:
        return out.withColumn(rank_col, F.col("_rn").cast("bigint")).drop("_rn")
    return out.drop("_rn")


def global_top(df: DataFrame, order: Sequence, limit: int) -> DataFrame:
    """Global sort + limit (planned as TakeOrderedAndProject: per-task top n
    then one merge of at most n rows per task)."""
    return df.orderBy(*_order(order)).limit(limit)


def score_by_position(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                      out: str = "score") -> DataFrame:
    """1 - rank/n for the first n rows per key (rank 0-based)."""
    ranked = top_k(df, keys, order, n, rank_col="_r")
    return ranked.withColumn(out, F.lit(1.0) - (F.col("_r") - 1) * (F.lit(1.0) / F.lit(n))).drop("_r")


def symmetric_neighbours(sim: DataFrame, a="item1", b="item2", score="sim") -> DataFrame:
    """Both directions of an undirected pair table, duplicates removed."""
    fwd = sim.select(F.col(a).alias("item_id"), F.col(b).alias("other_id"), F.col(score).alias(score))
    bwd = sim.select(F.col(b).alias("item_id"), F.col(a).alias("other_id"), F.col(score).alias(score))
    return fwd.union(bwd).distinct()


def except_items(candidates: DataFrame, excluded: DataFrame, included: DataFrame | None = None,
                 key: str = "item_id") -> DataFrame:
    """Candidates minus excluded, optionally intersected with included."""
    out = candidates.select(key).subtract(excluded.select(key))
    if included is not None:
        out = out.intersect(included.select(key))
    return out


_SLOTS = 32  # parts of a list, each an array of one row


def exclude_seen(cands: DataFrame, seen: DataFrame, keys=("user_id", "item_id"), lists: DataFrame | None = None) -> DataFrame:
    """Drop candidates the user already interacted with (anti join). With ``lists``,
    ``cands`` is (user, list) and ``lists`` (list, item), joined on the column that is not in ``keys``:
    the candidates are the distinct items of a user's lists. There may be far more of them than rows
    in any table; they are only made in the last task, never dealt or sorted."""
    if lists is None:
        return cands.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    user, item = keys
    (key,) = [c for c in lists.columns if c != item]
    # an item's class is the set of its lists that any user has: classes share no item, so users with classes
    # need no distinct; where lists do not overlap there is one for each list
    slot = F.pmod(F.xxhash64(item), F.lit(_SLOTS)).cast("int")
    classed = lists.join(cands.select(key).distinct(), key, "left_semi").groupBy(item).agg(F.array_sort(F.collect_set(key)).alias("_class")) \
        .select(item, "_class", slot.alias("_slot"))
    classes = classed.select("_class").distinct().select("_class", F.explode("_class").alias(key))
    picked = cands.select(user, key).join(classes, key).select(user, "_class").distinct()
    gone = seen.select(user, item).join(classed, item).groupBy(user, "_class", "_slot").agg(F.collect_set(item).alias("_gone"))
    parts = classed.groupBy("_class", "_slot").agg(F.collect_list(F.struct(item)).alias("_items"))  # a struct keeps a null item
    rows = picked.select(user, "_class", F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1))).alias("_slot")) \
        .join(gone, [user, "_class", "_slot"], "left").join(parts.hint("merge"), ["_class", "_slot"])
    left = F.when(F.col("_gone").isNull(), F.col("_items")) \
        .otherwise(F.filter("_items", lambda x: ~F.coalesce(F.array_contains("_gone", x[item]), F.lit(False))))
    return rows.select(user, F.explode(left).alias("_e")).select(user, f"_e.{item}")
