"""Batch recommendation for all users at once (survey R1-R23, A16-A18 consumers).

Every recommender returns (user, item, score) for all users. Candidate
lists shared by many users (most popular, newest items, a cluster's top
counts) are attached with equi-joins on a key the user row carries
(cluster, category, list position); a user row only ever meets a bounded
number of candidates: n plus the number of items the user has already seen.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import hash_bucket
from cairn.operators.ranking import exclude_seen, global_top, top_k


def rescale_top(df: DataFrame, n: int, user="user_id", item="item_id", score="score") -> DataFrame:
    """Top ``n`` per user by score (ties by item), divided by the user's best."""
    t = top_k(df, [user], [F.desc(score), F.asc(item)], n)
    return t.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy(user)))


def ranked_list(items: DataFrame, order: Sequence[Column], length: int, item="item_id") -> DataFrame:
    """The first ``length`` items of a global ordering with their 1-based
    position: a per-task top-n, then numbering of at most ``length`` rows."""
    top = global_top(items, order, length)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def max_seen(seen: DataFrame, user="user_id") -> int:
    """Largest number of distinct items one user has seen (one small aggregate)."""
    v = seen.groupBy(user).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
    return int(v or 0)


def recommend_from_list(users: DataFrame, ranked: DataFrame, seen: DataFrame, n: int,
                        user="user_id", item="item_id", key: str | None = None) -> DataFrame:
    """Each user takes the first n unseen items of a ranked list (optionally
    one list per ``key`` carried by the user row). The user explodes only the
    positions it can need, 1 .. n + |seen|, and joins the list on position."""
    keys = [key] if key else []
    s = seen.select(user, item).distinct()
    ns = s.groupBy(user).agg(F.count(F.lit(1)).alias("_ns"))
    u = users.select(user, *keys).distinct().join(ns, user, "left") \
        .select(user, *keys, F.explode(F.sequence(F.lit(1), F.lit(n) + F.coalesce("_ns", F.lit(0)))).alias("pos"))
    c = u.join(ranked, keys + ["pos"])
    c = exclude_seen(c, s, (user, item))
    return top_k(c, [user], [F.asc("pos")], n, rank_col="rank")


def recommend_popular(actions: DataFrame, users: DataFrame, n: int, item_dim: DataFrame | None = None,
                      dims: Sequence[int] | None = None, user="user_id", item="item_id") -> DataFrame:
    """Most popular items (optionally only items in ``dims``) the user has
    not seen; scores = popularity rescaled so the user's best is 1."""
    pop = actions.groupBy(item).agg(F.count(F.lit(1)).alias("score"))
    if item_dim is not None and dims:
        pop = pop.join(item_dim.filter(F.col("dim_id").isin(list(dims))).select(item).distinct(), item, "left_semi")
    seen = actions.select(user, item).distinct()
    ranked = ranked_list(pop, [F.desc("score"), F.asc(item)], n + max_seen(seen, user), item)
    out = recommend_from_list(users, ranked, seen, n, user, item)
    return out.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(user))) \
        .select(user, item, "score", "rank")


def reorder_by_popularity(recs: DataFrame, pop: DataFrame, item="item_id") -> DataFrame:
    """R2: replace recommendation scores by item popularity (0 when unknown)."""
    return recs.drop("score").join(pop.select(item, F.col("score").alias("_p")), item, "left") \
        .withColumn("score", F.coalesce(F.col("_p").cast("double"), F.lit(0.0))).drop("_p")


def recommend_recent(items: DataFrame, users: DataFrame, seen: DataFrame, n: int,
                     category: str | None = None, user="user_id", item="item_id", order="item_id") -> DataFrame:
    """Newest items (by ``order`` desc) not seen, score 1 - (rank-1)/n;
    with ``category`` the candidates must share the user's current category."""
    s = seen.select(user, item).distinct()
    k = n + max_seen(s, user)
    cols = [item, order] if order != item else [item]
    cand = items.select(*cols, *([category] if category else []))
    if category:
        ranked = top_k(cand, [category], [F.desc(order), F.desc(item)], k, rank_col="pos")
    else:
        ranked = ranked_list(cand, [F.desc(order), F.desc(item)], k, item)
    out = recommend_from_list(users, ranked, s, n, user, item, key=category)
    return out.withColumn("score", F.lit(1.0) - (F.col("rank") - 1) * (F.lit(1.0) / F.lit(n))) \
        .select(user, item, "score", "rank")


def recommend_popular_in_session(recent: DataFrame, item_dim: DataFrame, dim_top: DataFrame, n: int,
                                 seen: DataFrame, user="user_id", item="item_id") -> DataFrame:
    """R4 (depth 1): for the dims of the user's most recent item, the dims'
    most popular items (A7 output: dim_id, item_id, count) normalised by the
    dim's best count; seen items removed; top n."""
    cur = recent.filter(F.col("recent_rank") == 1).select(user, F.col(item).alias("_cur"))
    dims = cur.join(item_dim.select(F.col(item).alias("_cur"), "dim_id"), "_cur").select(user, "dim_id")
    top = dim_top.withColumn("_s", F.col("count") / F.max("count").over(Window.partitionBy("dim_id")))
    j = dims.join(top.select("dim_id", item, "_s"), "dim_id").groupBy(user, item).agg(F.max("_s").alias("score"))
    return rescale_top(exclude_seen(j, seen, (user, item)), n, user, item)


def recommend_session_depth(recent: DataFrame, item_dim: DataFrame, dim_top: DataFrame, n: int, seen: DataFrame, attrs: Sequence[str],
                            depth: int, dims: Sequence[int] | None = None, user="user_id", item="item_id") -> DataFrame:
    """For each of the ``depth`` most recent items, newest first, and each of its attributes in the
    order of ``attrs`` the dimension's most popular items (A7 output) are added up. A list's scores are its
    counts over its first count, times the lowest score of the list before it at the same depth (1 after a list of
    which all is seen). Once ``n`` items have a score the rest of that depth is left out, and every further
    depth gives one item of its first attribute. Top n rescaled to 1.

    What is folded is a user's depth x attributes x list length rows at most."""
    order = F.array(*[F.lit(a) for a in attrs])
    slots = recent.filter(F.col("recent_rank") <= depth).select(user, F.col("recent_rank").alias("_d"), F.col(item).alias("_i"),
                                                                F.posexplode(order).alias("_a", "attr"))
    own = item_dim.select(F.col(item).alias("_i"), "attr", "dim_id")
    known = dim_top.select("dim_id").distinct().withColumn("_has", F.lit(True))
    slots = slots.join(own, ["_i", "attr"], "left").join(known, "dim_id", "left")
    top = dim_top.select("dim_id", item, F.col("count").cast("double").alias("count"))
    if dims:
        allowed = item_dim.filter(F.col("dim_id").isin(list(dims))).select(item).distinct()
        top = top.join(allowed, item, "left_semi")
    rows = exclude_seen(slots.select(user, "_d", "_a", "dim_id").join(top, "dim_id"), seen, (user, item))
    lists = rows.groupBy(user, "_d", "_a").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col(item).alias("i")))).alias("_l"))
    per_user = slots.join(lists, [user, "_d", "_a"], "left").groupBy(user).agg(F.array_sort(F.collect_list(F.struct(
        "_d", "_a", F.coalesce("_has", F.lit(False)).alias("has"), F.col("_l").alias("l")))).alias("_lists"))

    kind = recent.schema[item].dataType.simpleString()
    added = F.array().cast(f"array<struct<i:{kind},s:double>>")
    names = F.array().cast(f"array<{kind}>")

    def one_item(acc, x):
        score = x["c"] / acc["first"] * acc["lowest"]
        seen_names = F.array_union(acc["names"], F.array(x["i"]))
        return F.when(acc["stop"], acc).otherwise(F.struct(
            acc["first"].alias("first"), acc["lowest"].alias("lowest"), score.alias("low"), (F.size(seen_names) >= n).alias("stop"),
            seen_names.alias("names"), F.concat(acc["added"], F.array(F.struct(x["i"].alias("i"), score.alias("s")))).alias("added")))

    def one_list(acc, x):
        fresh = acc["d"] != x["_d"]
        lowest, stop = F.when(fresh, F.lit(1.0)).otherwise(acc["lowest"]), F.when(fresh, F.lit(False)).otherwise(acc["stop"])
        items = F.coalesce(x["l"], F.array().cast(f"array<struct<c:double,i:{kind}>>"))
        start = F.struct(F.coalesce(F.get(items, F.lit(0))["c"], F.lit(-1.0)).alias("first"), lowest.alias("lowest"), F.lit(1.0).alias("low"),
                         F.lit(False).alias("stop"), acc["names"].alias("names"), acc["added"].alias("added"))
        done = F.aggregate(items, start, one_item)
        use = ~stop & x["has"]
        return F.struct(
            x["_d"].alias("d"), F.when(use, done["low"]).otherwise(lowest).alias("lowest"),
            F.when(stop, F.lit(True)).otherwise(F.size(F.when(use, done["names"]).otherwise(acc["names"])) >= n).alias("stop"),
            F.when(use, done["names"]).otherwise(acc["names"]).alias("names"), F.when(use, done["added"]).otherwise(acc["added"]).alias("added"))

    begin = F.struct(F.lit(0).cast(recent.schema["recent_rank"].dataType).alias("d"), F.lit(1.0).alias("lowest"), F.lit(False).alias("stop"),
                     names.alias("names"), added.alias("added"))
    scored = per_user.select(user, F.explode(F.aggregate("_lists", begin, one_list)["added"]).alias("_e")) \
        .groupBy(user, F.col("_e.i").alias(item)).agg(F.round(F.sum("_e.s"), 12).alias("score"))
    return rescale_top(scored, n, user, item)


def recommend_static(table: DataFrame, n: int, item_dim: DataFrame | None = None,
                     dims: Sequence[int] | None = None, user="user_id", item="item_id") -> DataFrame:
    """Precomputed (user, item, score > 0) limited to items in ``dims``; top n rescaled."""
    table = table.filter(F.col("score") > 0)
    if item_dim is not None and dims:
        table = table.join(item_dim.filter(F.col("dim_id").isin(list(dims))).select(item).distinct(), item, "left_semi")
    return rescale_top(table, n, user, item)


def recommend_cluster_counts(cc: DataFrame, user_clusters: DataFrame, seen: DataFrame, n: int,
                             min_items: int = 1, long_term_weight: float = 1.0, top_factor: int = 5,
                             score_col: str = "count", user="user_id", item="item_id",
                             cluster="cluster_id", weight="weight") -> DataFrame:
    """Per cluster of the user, the cluster's top (top_factor * n) items by
    decayed count, each scored count / cluster max * user weight * long-term
    weight; seen items removed; summed per item; users with fewer than
    min(min_items, n) candidates get nothing; top n rescaled to 1.
    ``score_col='score'`` with A18 output gives the significant variant."""
    top = top_k(cc.select(cluster, item, F.col(score_col).alias("_c")), [cluster],
                [F.desc("_c"), F.asc(item)], top_factor * n, rank_col=None)
    top = top.withColumn("_m", F.max("_c").over(Window.partitionBy(cluster))).filter(F.col("_m") > 0)
    j = user_clusters.select(user, cluster, weight).join(top, cluster)
    j = j.select(user, item, (F.col("_c") / F.col("_m") * F.col(weight) * F.lit(long_term_weight)).alias("_s"))
    j = exclude_seen(j, seen, (user, item)).groupBy(user, item).agg(F.sum("_s").alias("score"))
    enough = j.groupBy(user).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min(min_items, n))
    return rescale_top(j.join(enough.select(user), user, "left_semi"), n, user, item)


def sort_by_clusters(items_to_sort: DataFrame, cc: DataFrame, user_clusters: DataFrame,
                     user="user_id", item="item_id", cluster="cluster_id", weight="weight") -> DataFrame:
    """Rank the given (user, item) rows by the user's weighted cluster
    counts; items scoring 0 are trimmed."""
    j = items_to_sort.select(user, item).join(user_clusters.select(user, cluster, weight), user) \
        .join(cc.select(cluster, item, "count"), [cluster, item])
    s = j.groupBy(user, item).agg(F.sum(F.col("count") * F.col(weight)).alias("score")).filter(F.col("score") > 0)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), F.asc(item))))


def recommend_tag_affinity(affinity: DataFrame, tag_counts: DataFrame, seen: DataFrame, n: int,
                           per_tag: int = 50, user="user_id", item="item_id") -> DataFrame:
    """score = sum over the user's tags of affinity * count / max count over
    the tag's top ``per_tag`` items; seen removed; top n rescaled."""
    top = top_k(tag_counts, ["tag"], [F.desc("count"), F.asc(item)], per_tag, rank_col=None)
    top = top.withColumn("_m", F.max("count").over(Window.partitionBy("tag")))
    # a row of affinity becomes per_tag rows here, of which few share their user and item: they are dealt as
    # they come, so that the sums are held by tasks of the size of these rows, not of the affinity's
    j = affinity.select(user, "tag", "affinity").join(top, "tag").repartition(user, item)
    j = j.groupBy(user, item).agg(F.sum(F.col("affinity") * F.col("count") / F.col("_m")).alias("score"))
    return rescale_top(exclude_seen(j, seen, (user, item)), n, user, item)


def referrer_clusters(visits: DataFrame, referrer_map: DataFrame, referrer="referrer") -> DataFrame:
    """Every configured referrer that is a prefix of the visit's referrer
    contributes its cluster. The visit referrer is cut at each configured
    prefix length (a handful of distinct lengths) and equi-joined."""
    lengths = referrer_map.select(F.length("prefix").alias("_len")).distinct()
    lens = lengths.agg(F.collect_set("_len")).scalar()  # distinct prefix lengths of the (bounded) config
    cut = visits.select("*", F.explode(lens).alias("_len")) \
        .filter(F.length(referrer) >= F.col("_len")) \
        .withColumn("prefix", F.substring(F.col(referrer), F.lit(1), F.col("_len")))
    return cut.join(referrer_map.select("prefix", "cluster_id"), "prefix").drop("_len")


def combine_first(result_sets: DataFrame, n: int, user="user_id", item="item_id") -> DataFrame:
    """The first algorithm (by alg_order) with at least n results,
    otherwise the one with most results (earliest on ties); its top n."""
    sizes = result_sets.groupBy(user, "alg", "alg_order").agg(F.count(F.lit(1)).alias("_k"))
    enough = F.when(F.col("_k") >= n, 0).otherwise(1)
    w = Window.partitionBy(user).orderBy(enough, F.when(F.col("_k") >= n, F.col("alg_order")).otherwise(-F.col("_k")),
                                         F.col("alg_order"))
    pick = sizes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(user, "alg")
    chosen = result_sets.join(pick, [user, "alg"])
    return top_k(chosen, [user], [F.desc("score"), F.asc(item)], n)


def combine_rank_sum(result_sets: DataFrame, n: int, strict: bool = False, max_sets: int | None = None,
                     user="user_id", item="item_id") -> DataFrame:
    """Each list gives n - rank (rank 0-based by score) to its top n
    items; strict mode uses only lists with at least n items; summed."""
    rs = result_sets
    if max_sets is not None:
        rs = rs.filter(F.col("alg_order") < max_sets)
    if strict:
        sizes = rs.groupBy(user, "alg").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= n)
        rs = rs.join(sizes.select(user, "alg"), [user, "alg"], "left_semi")
    w = Window.partitionBy(user, "alg").orderBy(F.desc("score"), F.asc(item))
    ranked = rs.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") < n)
    return ranked.groupBy(user, item).agg(F.sum(F.lit(n) - F.col("_r")).cast("double").alias("score"))


def combine_score(result_sets: DataFrame, n: int, user="user_id", item="item_id") -> DataFrame:
    """Max score per item across lists; top n."""
    m = result_sets.groupBy(user, item).agg(F.max("score").alias("score"))
    return top_k(m, [user], [F.desc("score"), F.asc(item)], n)


def diversify(recs: DataFrame, n: int, level: int, round_id: int = 0, user="user_id", item="item_id") -> DataFrame:
    """From the top n*level candidates keep n chosen by a per-round hash
    (reproducible), returned in score order."""
    cand = top_k(recs, [user], [F.desc("score"), F.asc(item)], n * level, rank_col=None)
    h = F.md5(F.concat_ws("|", F.col(user).cast("string"), F.col(item).cast("string"), F.lit(str(round_id))))
    pick = top_k(cand.withColumn("_h", h), [user], [F.asc("_h")], n, rank_col=None).drop("_h")
    return pick.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), F.asc(item))))


def assign_variation(users: DataFrame, ratios: Sequence[tuple[str, float]], user="user_id",
                     salt: str = "ab") -> DataFrame:
    """bucket = md5 hash of the user mod 100, plus 1; variations own
    consecutive ranges of buckets proportional to their (normalised) ratios."""
    total = float(sum(r for _, r in ratios))
    b = hash_bucket([user], 100, salt) + 1
    expr, acc = None, 0.0
    for name, ratio in ratios:
        acc += ratio / total
        hi = int(round(acc * 100))
        expr = F.when(b <= hi, name) if expr is None else expr.when(b <= hi, name)
    return users.select(user, b.alias("bucket"), expr.otherwise(ratios[-1][0]).alias("variation"))


def route_by_rectag(requests: DataFrame, strategies: DataFrame, default: str, rectag="rectag") -> DataFrame:
    """Strategy by rectag, the default strategy otherwise."""
    return requests.join(F.broadcast(strategies.select(rectag, "strategy")), rectag, "left") \
        .withColumn("strategy", F.coalesce("strategy", F.lit(default)))


def map_dimensions(requests: DataFrame, mapping: DataFrame, user="user_id") -> DataFrame:
    """A requested dim the user has a mapping for is replaced by the
    user's mapped dims; other requests keep their dim."""
    j = requests.join(mapping.select(user, F.col("from_dim").alias("dim_id"), "to_dim"), [user, "dim_id"], "left")
    return j.select("*", F.coalesce("to_dim", "dim_id").alias("mapped_dim")).drop("to_dim")


def ignored_recs(shown: DataFrame, clicks: DataFrame, user="user_id", list_col="recommendations") -> DataFrame:
    """When a user clicks item x of the last shown list, the items listed
    before x are ignored (nothing when x is not in the list)."""
    ex = shown.select(user, "list_id", F.posexplode(F.split(list_col, ":")).alias("pos", "_i")) \
        .withColumn("item_id", F.col("_i").cast("bigint")).drop("_i")
    cpos = ex.join(clicks.select(user, "list_id", F.col("clicked").alias("item_id")), [user, "list_id", "item_id"]) \
        .select(user, "list_id", F.col("pos").alias("_cp"))
    return ex.join(cpos, [user, "list_id"]).filter(F.col("pos") < F.col("_cp")).select(user, "list_id", "item_id", "pos")


def explain(recs: DataFrame, explanations: DataFrame, locale: str, default_locale: str = "en") -> DataFrame:
    """Recommender name (text before ':') + locale -> explanation, with
    the default locale as fallback."""
    r = recs.withColumn("_alg", F.split_part(F.col("recommender"), F.lit(":"), F.lit(1)))
    loc = explanations.filter(F.col("locale") == locale).select(F.col("alg").alias("_alg"), F.col("text").alias("_t1"))
    dft = explanations.filter(F.col("locale") == default_locale).select(F.col("alg").alias("_alg"), F.col("text").alias("_t2"))
    return r.join(loc, "_alg", "left").join(dft, "_alg", "left") \
        .withColumn("explanation", F.coalesce("_t1", "_t2")).drop("_alg", "_t1", "_t2")


def recent_items_with_tags(items: DataFrame, tags: Sequence[str], limit: int, item="item_id",
                           order="item_id") -> DataFrame:
    """Newest items whose tag list overlaps ``tags``."""
    want = F.array(*[F.lit(t) for t in tags])
    ok = items.filter(F.arrays_overlap(F.split("tags", ","), want))
    return global_top(ok, [F.desc(order), F.desc(item)], limit)


def exclude_by_tag_cluster(cands: DataFrame, user_tag_cluster: DataFrame, item_tag_cluster: DataFrame,
                           user="user_id", item="item_id") -> DataFrame:
    """A user in some cluster of a tag group has candidates removed that
    are tagged for another cluster of that group, unless the item is also
    tagged for one of the user's own clusters."""
    uc = user_tag_cluster.select(user, "group_id", "cluster_id")
    ic = item_tag_cluster.select(item, "group_id", F.col("cluster_id").alias("_ic"))
    j = cands.select(user, item).join(uc, user).join(ic, [item, "group_id"])
    other = j.filter(F.col("_ic") != F.col("cluster_id")).select(user, item).distinct()
    own = j.filter(F.col("_ic") == F.col("cluster_id")).select(user, item).distinct()
    bad = other.join(own, [user, item], "left_anti")
    return cands.join(bad, [user, item], "left_anti")


def suggest_clusters(user_tags: DataFrame, tag_cluster_sim: DataFrame, top: int = 10,
                     min_sim: float = 0.5, user="user_id") -> DataFrame:
    """Tag -> cluster similarities above ``min_sim`` summed per user and
    cluster; best ``top`` clusters, weight 0.5 * score / best score."""
    j = user_tags.select(user, "tag").join(tag_cluster_sim.filter(F.col("sim") > min_sim), "tag")
    s = j.groupBy(user, "cluster_id").agg(F.sum("sim").alias("_s"))
    t = top_k(s, [user], [F.desc("_s"), F.asc("cluster_id")], top)
    return t.withColumn("weight", F.lit(0.5) * F.col("_s") / F.max("_s").over(Window.partitionBy(user))).drop("_s")


def candidates(kind: str, actions: DataFrame | None = None, items: DataFrame | None = None,
               n: int = 100, explicit: Sequence[int] | None = None, item="item_id") -> DataFrame:
    """Candidate item sets: newest items, most popular items or an explicit list."""
    if kind == "recent":
        return global_top(items.select(item), [F.desc(item)], n)
    if kind == "popular":
        pop = actions.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
        return global_top(pop, [F.desc("_n"), F.asc(item)], n).select(item)
    return items.filter(F.col(item).isin(list(explicit or []))).select(item)


def weights_table(spark, mapping: Mapping[str, float], key: str, value: str) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in mapping.items()], f"{key} string, {value} double")


def recommend(strategy: Sequence[tuple[str, DataFrame]], n: int, combiner: str = "first") -> DataFrame:
    """Strategy cascade: algorithms in order, each a (user, item, score)
    frame; combined per user by the first algorithm with enough results
    (``first``), rank sums (``rank_sum``) or best scores (``score``)."""
    sets = None
    for order, (name, recs) in enumerate(strategy):
        s = recs.select("user_id", "item_id", "score").withColumn("alg", F.lit(name)).withColumn("alg_order", F.lit(order))
        sets = s if sets is None else sets.unionByName(s)
    if combiner == "rank_sum":
        return combine_rank_sum(sets, n)
    if combiner == "score":
        return combine_score(sets, n)
    return combine_first(sets, n)
