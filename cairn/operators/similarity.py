"""Item-item similarity and similarity-based recommendation (survey M1, M2, W11, M18-M20).

Co-occurrence counting is the sparse product X^T X of the user x item
matrix. A user with L items contributes L^2 pairs; to keep any single task
bounded, a user's item list is split into ``ceil(L / chunk)`` hash chunks
and the pairs of chunk a x chunk b are produced under the join key
(user, a, b) -- a grid, so every key meets at most ``chunk^2`` pairs and a
hot user is spread over many tasks. What is dealt is one row per list entry
with the array of its partners, not one row per pair; the pairs are unfolded
and counted where they arrive. No list is capped and no pair is dropped.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranking import exclude_seen, top_k
from cairn.session import reuse, stored

HEAVY = 20_000      # keys of an item beyond which its partners are dealt to several tasks
PAIRS = 2_000_000   # pairs counted by one task, about
ROUND = 300_000_000  # pairs dealt at once, about


def user_item_pairs(actions: DataFrame, min_items_per_user: int = 0, min_users_per_item: int = 0,
                    max_users_per_item: int | None = None, user="user_id", item="item_id") -> DataFrame:
    """Distinct (user, item) after the item filter (users per item within
    bounds) and then the user filter (items per user >= min)."""
    p = actions.select(user, item).distinct()
    if min_users_per_item <= 1 and max_users_per_item is None:      # every item has a user
        p = p.filter(F.col(item).isNotNull())
        return p if not min_items_per_user else _users_of_size(p, min_items_per_user, user)
    ic = p.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    cond = F.col("_n") >= min_users_per_item
    if max_users_per_item is not None:
        cond = cond & (F.col("_n") <= max_users_per_item)
    p = p.join(ic.filter(cond).select(item), item, "left_semi")
    return p if not min_items_per_user else _users_of_size(p, min_items_per_user, user)


def _users_of_size(p: DataFrame, least: int, user: str) -> DataFrame:
    uc = p.groupBy(user).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= least)
    return p.join(uc.select(user), user, "left_semi")


def _narrow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Integer columns in the narrowest of smallint, int and bigint that holds all their values."""
    types = dict(df.dtypes)
    wide = [c for c in dict.fromkeys(cols) if types[c] in ("int", "bigint")]
    if not wide:
        return df
    ends = df.agg(*[f(c).cast("bigint").alias(f"{g}{i}") for i, c in enumerate(wide) for f, g in ((F.min, "a"), (F.max, "b"))]).first()
    for i, c in enumerate(wide):
        if ends[f"a{i}"] is not None:
            fits = [t for t, bits in (("smallint", 15), ("int", 31)) if -(1 << bits) <= ends[f"a{i}"] and ends[f"b{i}"] < 1 << bits]
            df = df.withColumn(c, F.col(c).cast((fits + ["bigint"])[0]))
    return df


def _pair_lists(pairs: DataFrame, chunk: int, key, item: str, group: Sequence[str], carry: str | None) -> list[DataFrame]:
    """In as many frames as keep the pairs of one near ``ROUND``, each with all rows of its items (group, item1): (group..., item1, _salt, _others[, _own, _with]): for every entry of a key's list the larger entries, in as many rows
    as the grid has chunks, placed by (group, item1, _salt). ``_own`` and ``_with`` are the ``carry`` values of item1 and
    the others. An item of very many keys is dealt by the hash of its partner to several salts."""
    keys = [key] if isinstance(key, str) else list(key)
    grp = list(group)
    more = [c for c in grp if c not in keys]
    held = [F.col(item).alias("i")] + ([F.col(carry).alias("n")] if carry else [])
    p = pairs.filter(F.col(item).isNotNull())
    for k in keys:
        p = p.filter(F.col(k).isNotNull())
    p = reuse(p.select(*keys, *more, item, *([carry] if carry else [])))     # read for the sizes, the lists and the heavy items
    p = _narrow(p, [item] + ([carry] if carry else []))
    sizes = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    slots = F.greatest(F.lit(1), F.ceil(F.col("_len") / F.lit(chunk))).cast("int")
    cells = p.join(sizes, keys).withColumn("_s", slots).withColumn("_c", F.pmod(F.xxhash64(F.col(item)), F.col("_s")).cast("int"))
    cells = reuse(cells.groupBy(*keys, *more, "_s", "_c").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("_l")))
    heavy = p.groupBy(F.col(item).alias("item1")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HEAVY) \
        .select("item1", F.ceil(F.col("_n") / F.lit(HEAVY)).cast("int").alias("_salts"))      # at most rows / HEAVY items
    grid = F.sequence(F.lit(0), F.col("_s") - 1)
    many = cells.filter(F.col("_s") > 1)
    left = many.select(*keys, *more, F.col("_c").alias("_a"), F.explode(grid).alias("_b"), "_l")
    right = many.select(*keys, F.explode(grid).alias("_a"), F.col("_c").alias("_b"), F.col("_l").alias("_r"))
    lists = cells.filter(F.col("_s") == 1).select(*grp, "_l", F.col("_l").alias("_r")) \
        .unionAll(left.join(right, keys + ["_a", "_b"]).select(*grp, "_l", "_r"))
    # as many tasks as keep a task's counts near PAIRS rows, whatever the session's partitions
    total = cells.agg(F.sum(F.size("_l").cast("double") * F.size("_l") * F.col("_s") / 2)).first()[0] or 0.0
    rounds = int(total // ROUND) + 1
    larger = F.filter("_r", lambda x: x["i"] > F.col("item1"))
    own = ["_own"] if carry else []
    each = lists.select(*grp, F.explode("_l").alias("_e"), "_r") \
        .select(*grp, F.col("_e.i").alias("item1"), *([F.col("_e.n").alias("_own")] if carry else []), "_r")
    turn = F.pmod(F.xxhash64("item1", F.lit(1)), F.lit(rounds))
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / rounds // PAIRS) + 1)
    out = []
    for i in range(rounds):
        some = each.filter(turn == i) if rounds > 1 else each
        out.append(_placed(some, grp, own, larger, heavy, carry).repartition(parts, *grp, "item1", "_salt"))
    return out


def _placed(each: DataFrame, grp: list, own: list, larger, heavy: DataFrame, carry: str | None) -> DataFrame:
    """Rows of an item and its larger partners, those of a heavy item dealt to its salts."""
    return each.select(*grp, "item1", *own, larger.alias("_r")).filter(F.size("_r") > 0) \
        .join(F.broadcast(heavy), "item1", "left") \
        .withColumn("_salts", F.coalesce("_salts", F.lit(1))) \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))) \
        .withColumn("_r", F.when(F.col("_salts") == 1, F.col("_r")).otherwise(
            F.filter("_r", lambda x: F.pmod(F.xxhash64(x["i"]), F.col("_salts")) == F.col("_salt")))) \
        .select(*grp, "item1", "_salt", *own, F.col("_r.i").alias("_others"), *([F.col("_r.n").alias("_with")] if carry else []))


def co_occurrence(pairs: DataFrame, chunk: int = 2000, key="user_id", item="item_id",
                  group: tuple = (), carry: str | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group..., item1 < item2, co) = number of keys holding both items, via
    the chunked grid self-join described in the module doc. ``key`` may be a
    list of columns; ``group`` columns must be determined by the key, and the
    ``carry`` column, which comes out as <carry>1 and <carry>2, by the item.

    Of very many pairs those of some items at a time are dealt, counted and stored, after ``then``, which
    sees all rows of its items (as item1)."""
    then = then or (lambda x: x)
    found = [then(_counted(lists, dict(pairs.dtypes), item, list(group), carry))
             for lists in _pair_lists(pairs, chunk, key, item, list(group), carry)]
    if len(found) > 1:
        found = [stored(x, "pairs") for x in found]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _counted(lists: DataFrame, kind: dict, item: str, group: list, carry: str | None) -> DataFrame:
    place = [*group, "item1", "_salt"]
    out = [*group, *[F.col(c).cast(kind[item]).alias(c) for c in ("item1", "item2")], "co"]
    if not carry:
        each = lists.select(*place, F.explode("_others").alias("item2"))
        return each.groupBy(*place, "item2").agg(F.count(F.lit(1)).alias("co")).select(*out)
    each = lists.select(*place, "_own", F.explode(F.arrays_zip("_others", "_with")).alias("_e")) \
        .select(*place, "_own", F.col("_e._others").alias("item2"), F.col("_e._with").alias("_with"))
    return each.groupBy(*place, "item2").agg(F.count(F.lit(1)).alias("co"), F.first("_own").alias("_o"), F.first("_with").alias("_w")) \
        .select(*out, F.col("_o").cast(kind[carry]).alias(f"{carry}1"), F.col("_w").cast(kind[carry]).alias(f"{carry}2"))


def item_similarity(actions: DataFrame, limit: int = 100, threshold: float = 0.0,
                    min_items_per_user: int = 0, min_users_per_item: int = 0,
                    max_users_per_item: int | None = None, chunk: int = 2000,
                    user="user_id", item="item_id") -> DataFrame:
    """M1: exact cosine of binary user vectors, |A n B| / sqrt(|A| |B|),
    for item1 < item2 with sim >= threshold; the ``limit`` best item2 per item1."""
    p = reuse(user_item_pairs(actions, min_items_per_user, min_users_per_item, max_users_per_item, user, item))
    n = p.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    # the items' counts travel with the lists: the pairs are not dealt again to find them
    def best(co: DataFrame) -> DataFrame:
        s = co.select("item1", "item2", (F.col("co") / F.sqrt(F.col("_n1") * F.col("_n2"))).alias("sim"))
        if threshold > 0:
            s = s.filter(F.col("sim") >= threshold)
        return top_k(s, ["item1"], [F.desc("sim"), F.asc("item2")], limit, rank_col=None)

    return co_occurrence(p.join(n, item), chunk, user, item, carry="_n", then=best)


def neighbours(sim: DataFrame, limit: int, a="item1", b="item2", score="sim") -> DataFrame:
    """W11 + top-k: both directions of each similarity pair, the ``limit``
    best neighbours per item (bounds the fan-out of later joins). The pairs are read twice, so they are stored."""
    sim = stored(sim.select(a, b, score), "similarity")
    both = sim.select(F.col(a).alias("item_id"), F.col(b).alias("other_id"), F.col(score).alias("sim")) \
        .unionByName(sim.select(F.col(b).alias("item_id"), F.col(a).alias("other_id"), F.col(score).alias("sim"))) \
        .distinct()
    return top_k(both, ["item_id"], [F.desc("sim"), F.asc("other_id")], limit, rank_col=None)


def recent_items(actions: DataFrame, n_recent: int, user="user_id", item="item_id",
                 order=("t", "order_key", "line_no")) -> DataFrame:
    """The user's ``n_recent`` most recently used distinct items."""
    last = actions.groupBy(user, item).agg(F.max(F.struct(*[F.col(o) for o in order])).alias("_last"))
    return top_k(last, [user], [F.desc("_last"), F.desc(item)], n_recent, rank_col="recent_rank").drop("_last")


def recommend_item_similarity(nbrs: DataFrame, actions: DataFrame, n_recent: int, n: int,
                              user="user_id", item="item_id", order=("t", "order_key", "line_no")) -> DataFrame:
    """M2: score(candidate) = sum of its similarity to the user's ``n_recent``
    most recent items; items the user has already seen removed; top ``n``
    per user, scores divided by the user's best score."""
    rec = recent_items(actions, n_recent, user, item, order)
    j = rec.join(nbrs, rec[item] == nbrs["item_id"]).select(user, F.col("other_id").alias(item), "sim")
    scored = j.groupBy(user, item).agg(F.sum("sim").alias("score"))
    scored = exclude_seen(scored, actions.select(user, item), (user, item))
    best = top_k(scored, [user], [F.desc("score"), F.asc(item)], n)
    from pyspark.sql import Window
    return best.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(user)))


def tag_similarity(doc_tags: DataFrame, metric: str = "jaccard", max_share: float | None = None,
                   min_count: int | None = None, doc="doc_id", tag="tag", chunk: int = 2000) -> DataFrame:
    """Tag-tag scores from the documents they share.

    jaccard(t1, t2) = |D1 n D2| / |D1 u D2|, 0 when |D1| / #tags > max_share;
    asymmetric(t1 -> t2) = |D1 n D2| / |D2|, 0 when |D2| < min_count.
    Returns both directions (tag, other, score) with score > 0."""
    p = doc_tags.select(doc, tag).distinct()
    n = p.groupBy(tag).agg(F.count(F.lit(1)).alias("_n"))
    n_tags = n.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    co = co_occurrence(p.withColumnRenamed(tag, "item_id").withColumnRenamed(doc, "_doc"), chunk,
                       key="_doc", item="item_id")
    both = co.select(F.col("item1").alias("tag"), F.col("item2").alias("other"), "co") \
        .unionByName(co.select(F.col("item2").alias("tag"), F.col("item1").alias("other"), "co"))
    j = both.join(n.select(F.col(tag).alias("tag"), F.col("_n").alias("_n1")), "tag") \
        .join(n.select(F.col(tag).alias("other"), F.col("_n").alias("_n2")), "other") \
        .withColumn("_tags", n_tags)
    if metric == "jaccard":
        score = F.col("co") / (F.col("_n1") + F.col("_n2") - F.col("co"))
        if max_share is not None:
            score = F.when(F.col("_n1") / F.col("_tags") > max_share, F.lit(0.0)).otherwise(score)
    else:
        score = F.col("co") / F.col("_n2")
        if min_count is not None:
            score = F.when(F.col("_n2") < min_count, F.lit(0.0)).otherwise(score)
    return j.select("tag", "other", score.alias("score")).filter(F.col("score") > 0)


def recommend_tags(tag_scores: DataFrame, query_tags: DataFrame, k: int, key="query_id") -> DataFrame:
    """For each query (a set of tags) sum the scores of co-occurring tags
    over its tags; query tags themselves excluded; top k."""
    j = query_tags.join(tag_scores, "tag").groupBy(key, "other").agg(F.sum("score").alias("score"))
    j = j.join(query_tags.select(key, F.col("tag").alias("other")), [key, "other"], "left_anti")
    return top_k(j, [key], [F.desc("score"), F.asc("other")], k)


def neighbour_tag_quality(nn: DataFrame, doc_tags: DataFrame, doc="doc_id", other="other_id") -> DataFrame:
    """Mean over documents of the mean Jaccard similarity between the
    document's tag set and each neighbour's tag set."""
    sets = doc_tags.groupBy(doc).agg(F.collect_set("tag").alias("_t"))
    j = nn.join(sets, doc).join(sets.select(F.col(doc).alias(other), F.col("_t").alias("_o")), other)
    jac = F.size(F.array_intersect("_t", "_o")) / F.size(F.array_union("_t", "_o"))
    per_doc = j.groupBy(doc).agg(F.avg(jac).alias("_m"))
    return per_doc.agg(F.avg("_m").alias("score"), F.count(F.lit(1)).alias("n_docs"))
