"""Sessionization and sequence features (survey W1-W7, A3, A20).

Session boundaries come from ``cairn.operators.sequence`` (bucketed, so a
hot user is spread over tasks). Per-session lists are only collected after
the user filter that bounds their length (``max_actions``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import filter_users_by_activity, tokenize_tags
from cairn.operators.sequence import ordered_ngrams, sessionize, time_bucket, with_prev


def _ordered_join(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sep=" ") -> DataFrame:
    """concat_ws over values sorted by ``order`` within each group."""
    s = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(value).cast("string").alias("_v"))))
    return df.groupBy(*keys).agg(F.concat_ws(sep, F.transform(s, lambda x: x["_v"])).alias("items"),
                                 F.count(F.lit(1)).alias("n"))


def session_items(actions: DataFrame, gap: float, min_actions: int = 1, max_actions: int = 1000,
                  user="user_id", item="item_id", t="t", seq=("t",), bucket_width: float | None = None,
                  types: Sequence[int] | None = None) -> DataFrame:
    """Per user (min <= #actions <= max) sessions in time order, split when
    the gap exceeds ``gap`` (``-1`` never splits); items joined by spaces."""
    if types:
        actions = actions.filter(F.col("type").isin(list(types)))
    a = filter_users_by_activity(actions, min_actions, max_actions, user=user)
    b = time_bucket(t, bucket_width) if bucket_width else None
    s = sessionize(a, user, t, gap, order=list(seq), bucket=b)
    return _ordered_join(s, [user, "session_no"], list(seq), item)


def session_metrics(imps: DataFrame, gap_us: int, max_pv: int = 50, user="user_id", t="t_us",
                    seq=("t_us", "event_id"), bucket_width: float | None = None) -> DataFrame:
    """Per session: whole seconds (each in-session gap truncated to whole
    seconds and summed; 0 counts as 1), page views; sessions with more than
    ``max_pv`` views dropped; ``first`` = 1 on the user's first kept session.
    Users seen with more than one abkey are dropped entirely."""
    b = time_bucket(t, bucket_width) if bucket_width else None
    s = sessionize(imps, user, t, gap_us, order=list(seq), bucket=b)
    in_gap = F.when(F.col("gap_prev").isNotNull() & (F.col("gap_prev") <= gap_us),
                    F.floor(F.col("gap_prev") / 1_000_000)).otherwise(F.lit(0))
    first = F.struct(*[F.col(c) for c in seq])
    per = s.groupBy(user, "session_no").agg(
        F.sum(in_gap).cast("bigint").alias("secs"),
        F.count(F.lit(1)).alias("pv"),
        F.min_by("consumer", first).alias("consumer"),
        F.min_by("abkey", first).alias("abkey"))
    per = per.withColumn("secs", F.when(F.col("secs") == 0, 1).otherwise(F.col("secs")).cast("bigint"))
    kept = per.filter(F.col("pv") <= max_pv)
    first_kept = kept.groupBy(user).agg(F.min("session_no").alias("_first"))
    kept = kept.join(first_kept, user).withColumn(
        "first", F.when(F.col("session_no") == F.col("_first"), 1).otherwise(0)).drop("_first")
    # users whose events carry more than one variation are dropped
    bad = imps.groupBy(user).agg(F.count_distinct("abkey").alias("_k")).filter("_k > 1").select(user)
    # consumer / abkey of the user's first event
    u0 = imps.groupBy(user).agg(F.min_by("consumer", first).alias("u_consumer"),
                                F.min_by("abkey", first).alias("u_abkey"))
    out = kept.join(bad, user, "left_anti").join(u0, user)
    return out.select(user, "session_no", "secs", "pv", "first",
                      F.col("u_consumer").alias("consumer"), F.col("u_abkey").alias("abkey"))


def engagement(imps: DataFrame, gap_us: int, max_pv: int = 50, bucket_width: float | None = None) -> DataFrame:
    """A3: per consumer: average session seconds, page views and share of
    sessions with more than one view for baseline and normal variations,
    and the normal - baseline differences (consumers having both)."""
    m = session_metrics(imps, gap_us, max_pv, bucket_width=bucket_width)
    per = m.groupBy("consumer", "abkey").agg(
        (F.sum("secs") / F.count(F.lit(1))).alias("avg_secs"),
        (F.sum("pv") / F.count(F.lit(1))).alias("avg_pv"),
        (F.sum(F.when(F.col("pv") > 1, 1).otherwise(0)) / F.count(F.lit(1))).alias("plus_share"))
    b = per.filter(F.col("abkey") == "baseline").select(
        "consumer", *[F.col(c).alias("b_" + c) for c in ("avg_secs", "avg_pv", "plus_share")])
    n = per.filter(F.col("abkey") == "normal").select(
        "consumer", *[F.col(c).alias("n_" + c) for c in ("avg_secs", "avg_pv", "plus_share")])
    j = b.join(n, "consumer")
    return j.select("consumer", *[c for c in j.columns if c != "consumer"],
                    *[(F.col("n_" + c) - F.col("b_" + c)).alias("d_" + c) for c in ("avg_secs", "avg_pv", "plus_share")])


def session_tags(actions: DataFrame, item_tags: DataFrame, gap: float, min_actions: int,
                 max_actions: int, min_tags: int, user="user_id", item="item_id", t="t",
                 seq=("t",)) -> DataFrame:
    """Like W1 with item tags instead of items; strict activity bounds;
    sessions with fewer than ``min_tags`` tags dropped. Tags of a session
    are emitted in sorted order."""
    a = filter_users_by_activity(actions, min_actions, max_actions, strict=True, user=user)
    s = sessionize(a, user, t, gap, order=list(seq))
    # an action's tags stay one list: the sort of a session's rows holds one row per action, not per tag
    j = s.select(user, "session_no", item).join(item_tags.select(item, tokenize_tags("tags").alias("_t")).filter(F.size("_t") > 0), item)
    g = j.groupBy(user, "session_no").agg(F.array_sort(F.flatten(F.collect_list("_t"))).alias("_tags"))
    return g.filter(F.size("_tags") >= min_tags).select(
        user, "session_no", F.concat_ws(" ", "_tags").alias("tags"))


def baskets(actions: DataFrame, add_type: str, remove_type: str, gap: float, min_actions: int = 1,
            max_actions: int = 1000, user="user_id", item="item_id", t="t_us", kind="event_type",
            seq=("t_us", "event_id")) -> DataFrame:
    """Replay add/remove actions per user in time order; when the gap
    before an *add* exceeds ``gap`` the current basket is emitted and cleared;
    the final basket is emitted when non-empty. Items of a basket sorted.

    Basket content = items whose last add/remove inside the segment is an add,
    so no per-user replay is needed."""
    a = actions.filter(F.col(kind).isin(add_type, remove_type))
    a = filter_users_by_activity(a, min_actions, max_actions, user=user)
    s = sessionize(a, user, t, gap, order=list(seq), split_also=(F.col(kind) == add_type), out="segment")
    last = s.groupBy(user, "segment", item).agg(
        F.max_by(kind, F.struct(*[F.col(c) for c in seq])).alias("_last"))
    inb = last.filter(F.col("_last") == add_type)
    return inb.groupBy(user, "segment").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string"))).alias("basket"))


def history_features(actions: DataFrame, item_tags: DataFrame, start: int, max_n: int,
                     user="user_id", item="item_id", seq=("t",), only_prev: bool = False) -> DataFrame:
    """W5 (and W6 with ``only_prev``): for the user's c-th action (0-based,
    start <= c <= max_n) a line of ``i_<tag>`` features of the item followed
    by ``u_<tag>`` features of all earlier actions (or only the previous one)."""
    w = Window.partitionBy(user).orderBy(*seq)
    # only the first max_n + 1 actions of a user matter, of those whose item has a tag row: they are found on
    # narrow rows (WindowGroupLimit keeps them map-side) and only then get their tags; an item may have several rows
    from cairn.operators.ranking import top_k
    a = actions.select(*dict.fromkeys([user, item, *seq])).join(item_tags.select(item), item, "left_semi")
    first = top_k(a, [user], list(seq), max_n + 1, rank_col=None)
    j = first.join(item_tags.select(item, tokenize_tags("tags").alias("_tags")), item)
    j = top_k(j, [user], list(seq), max_n + 1, rank_col="_k").withColumn("c", (F.col("_k") - 1).cast("int")).drop("_k")
    if only_prev:
        hist = F.coalesce(F.lag("_tags").over(w), F.array().cast("array<string>"))
    else:
        hist = F.flatten(F.collect_list("_tags").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    j = j.withColumn("_hist", hist).filter(F.col("c") >= start)
    line = F.concat_ws(" ", F.transform("_tags", lambda x: F.concat(F.lit("i_"), x)),
                       F.transform("_hist", lambda x: F.concat(F.lit("u_"), x)))
    return j.select(user, item, "c", line.alias("line"))


def recent_interactions(actions: DataFrame, recent: int, n: int, user="user_id", item="item_id",
                        order=("t", "order_key", "line_no")) -> DataFrame:
    """The user's ``recent`` most recent distinct items score recent,
    recent-1, ...; the top ``n`` are rescaled by the maximum."""
    last = actions.groupBy(user, item).agg(F.max(F.struct(*[F.col(o) for o in order])).alias("_last"))
    from cairn.operators.ranking import top_k
    r = top_k(last, [user], [F.desc("_last"), F.desc(item)], recent, rank_col="_pos")
    r = r.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(user)))
    r = r.withColumn("score", (F.col("_len") - F.col("_pos") + 1).cast("double")).filter(F.col("_pos") <= n)
    return r.select(user, item, (F.col("score") / F.col("_len")).alias("score"))


def ngram_model(actions: DataFrame, n: int = 3, user="user_id", item="item_id", order=("t",),
                bucket_width: float | None = None) -> DataFrame:
    """Per user time-ordered items with consecutive repeats collapsed
    (users with at least 2 items left) -> 1..n-gram counts; grams of length
    >= 2 seen only once are pruned; prob = count / count of all grams with
    the same history (unigrams: / all unigrams)."""
    b = time_bucket(order[0], bucket_width) if bucket_width else None
    p = with_prev(actions, [user], list(order), [item], b)
    dedup = p.filter(F.col("prev_" + item).isNull() | (F.col("prev_" + item) != F.col(item)))
    users = dedup.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(user)
    dedup = dedup.join(users, user, "left_semi")
    grams = ordered_ngrams(dedup, user, list(order), item, n, b)
    g = grams.select("n", F.concat_ws(" ", F.transform("gram", lambda x: x.cast("string"))).alias("gram"),
                     F.concat_ws(" ", F.transform(F.slice("gram", 1, F.col("n") - 1),
                                                  lambda x: x.cast("string"))).alias("hist"))
    counts = g.groupBy("n", "gram", "hist").agg(F.count(F.lit(1)).alias("count"))
    ctx = counts.groupBy("n", "hist").agg(F.sum("count").alias("_ctx"))
    out = counts.join(ctx, ["n", "hist"]).withColumn("prob", F.col("count") / F.col("_ctx"))
    return out.filter((F.col("n") == 1) | (F.col("count") > 1)).select("n", "gram", "hist", "count", "prob")


def recommend_ngram(model: DataFrame, actions: DataFrame, k: int, user="user_id", item="item_id",
                    order=("t",), bucket_width: float | None = None) -> DataFrame:
    """Next-item scores from the n-gram model: for the user's last one
    and last two (consecutive-distinct) items as history, the probabilities
    of every continuation are summed per item; top k by score (ties by item)."""
    from cairn.operators.ranking import top_k
    b = time_bucket(order[0], bucket_width) if bucket_width else None
    p = with_prev(actions, [user], list(order), [item], b)
    dedup = p.filter(F.col("prev_" + item).isNull() | (F.col("prev_" + item) != F.col(item))).drop("prev_" + item)
    # the last two items per user: a map-side limited top-k, not a full per-user sort
    last2 = top_k(dedup, [user], [F.desc(o) for o in order], 2, rank_col="_r")
    seq = last2.groupBy(user).agg(F.max_by(F.col(item).cast("string"), F.when(F.col("_r") == 1, 1).otherwise(0)).alias("_x1"),
                                  F.max_by(F.col(item).cast("string"), F.when(F.col("_r") == 2, 1).otherwise(0)).alias("_x2"),
                                  F.count(F.lit(1)).alias("_n"))
    hists = seq.select(user, F.col("_x1").alias("hist"), F.lit(2).alias("n")).unionByName(
        seq.filter(F.col("_n") == 2).select(user, F.concat_ws(" ", "_x2", "_x1").alias("hist"), F.lit(3).alias("n")))
    j = hists.join(model.select("n", "hist", "gram", "prob"), ["n", "hist"])
    cand = j.select(user, F.element_at(F.split("gram", " "), -1).cast("bigint").alias(item), "prob")
    s = cand.groupBy(user, item).agg(F.sum("prob").alias("score"))
    return top_k(s, [user], [F.desc(F.round("score", 9)), F.asc(item)], k)


def recommend_ngram_all(model: DataFrame, actions: DataFrame, k: int, n_recent: int = 5, longest: int = 3, user="user_id", item="item_id",
                        order=("t",), bucket_width: float | None = None) -> DataFrame:
    """M21 over the whole recent history: every run of 1 to ``longest`` neighbours among the user's
    last ``n_recent`` items (repeats in a row collapsed) is a prefix; the probabilities of all its
    continuations in the model are summed per item, a prefix that occurs twice counting twice. Recent
    items are not recommended. Top k by score, ties by item."""
    from cairn.operators.ranking import exclude_seen, top_k
    b = time_bucket(order[0], bucket_width) if bucket_width else None
    p = with_prev(actions, [user], list(order), [item], b)
    dedup = p.filter(F.col("prev_" + item).isNull() | (F.col("prev_" + item) != F.col(item)))
    last = top_k(dedup, [user], [F.desc(o) for o in order], n_recent, rank_col="_r").select(user, item, "_r")
    # at most n_recent items a user, oldest first
    seq = last.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(item).cast("string").alias("i"))), asc=False),
                                             lambda x: x["i"]).alias("_s"))
    sizes = F.filter(F.array(*[F.lit(i) for i in range(1, longest + 1)]), lambda n: n <= F.size("_s"))
    starts = seq.select(user, "_s", F.explode(sizes).alias("_n")) \
        .select(user, "_s", "_n", F.explode(F.sequence(F.lit(1), F.size("_s") - F.col("_n") + 1)).alias("_at"))
    hist = starts.select(user, F.concat_ws(" ", F.slice("_s", F.col("_at"), F.col("_n"))).alias("hist"), (F.col("_n") + 1).alias("n"))
    found = hist.join(model.select("n", "hist", "gram", "prob"), ["n", "hist"])
    s = found.select(user, F.element_at(F.split("gram", " "), -1).cast("bigint").alias(item), "prob") \
        .groupBy(user, item).agg(F.round(F.sum("prob"), 9).alias("score"))
    return top_k(exclude_seen(s, last, (user, item)), [user], [F.desc("score"), F.asc(item)], k)
