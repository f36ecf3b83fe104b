"""Model-fit and vector operators on Spark ML (survey M3-M6, M9-M17, M19, M25-M33).

Fits are Spark ML estimators (distributed); nothing is collected except
fitted parameters of bounded size. Vector neighbours over whole tables are
exact (``nearest``: blocks pruned by the triangle inequality); a bounded, size-checked set of reference vectors (query terms, anomaly spheres) is
compared per row with higher-order functions over one array value.
"""

from __future__ import annotations

import math
import random
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.nearest import nearest, top_unseen
from cairn.operators.ranking import exclude_seen, top_k
from cairn.operators.term_lists import TermLists, projected, random_index, term_lists
from cairn.session import reuse, stored

BLOCK_RATINGS = 1_000_000    # ratings of a block of the factorization
MAX_REFERENCE_ROWS = 100_000  # bound for reference sets compared row by row


def _checked_array(df: DataFrame, limit: int = MAX_REFERENCE_ROWS) -> Column:
    """All rows of a small reference frame (fitted parameters: centroids,
    spheres) as one array literal, after checking its size. Columns must be
    scalars or arrays of numbers."""
    n = df.count()
    if n > limit:
        raise ValueError(f"reference set has {n} rows, more than the bound {limit}")
    rows = df.collect()  # bounded above
    def lit(v):
        if isinstance(v, (list, tuple)):
            return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")
        return F.lit(v)
    return F.array(*[F.struct(*[lit(r[c]).alias(c) for c in df.columns]) for r in rows])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def unit(a) -> Column:
    """``a`` over its norm, which is worked out once for a vector (an expression in a lambda is for every component)."""
    return F.transform(F.array(norm(a)), lambda size: F.transform(a, lambda x: x / size))[0]


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def as_double_array(c) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


# ----------------------------------------------------------- matrix factorization

def fit_mf(ratings: DataFrame, rank: int = 30, reg: float = 0.01, alpha: float = 1.0, iters: int = 5,
           seed: int = 1, user="user_id", item="item_id", rating="rating"):
    """M3: implicit-feedback ALS. A task holds the ratings of a block, so their number follows that of the ratings,
    which are worked out once; up to ten blocks' worth it is Spark's ten."""
    from pyspark.ml.recommendation import ALS
    rows = stored(ratings.select(F.col(user).cast("int"), F.col(item).cast("int"), rating), "ratings")
    blocks = max(10, -(-rows.count() // BLOCK_RATINGS))
    als = ALS(rank=rank, regParam=reg, alpha=alpha, maxIter=iters, seed=seed, implicitPrefs=True, numUserBlocks=blocks, numItemBlocks=blocks,
              userCol=user, itemCol=item, ratingCol=rating, coldStartStrategy="drop")
    return als.fit(rows)


def recommend_factors(user_factors: DataFrame, item_factors: DataFrame, seen: DataFrame, n: int, user="user_id", item="item_id",
                      vec="features") -> DataFrame:
    """M4: top n unseen items per user by dot(user, item). A few more than n are asked for
    every user first, and more only for users whose history takes them away."""
    users = user_factors.select(user, as_double_array(vec).alias("vec"))
    return top_unseen(item_factors.select(item, as_double_array(vec).alias("vec")), users, seen, n, None, item, user)


def recommend_mf(model, seen: DataFrame, n: int, user="user_id", item="item_id") -> DataFrame:
    """M4 from a fitted ALS model."""
    return recommend_factors(model.userFactors.withColumnRenamed("id", user), model.itemFactors.withColumnRenamed("id", item), seen, n, user, item)


def factors_long(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    return vectors.select(key, F.posexplode(vec).alias("dim", "v"))


def recent_mf_user_vectors(recent: DataFrame, item_vectors: DataFrame, user="user_id", item="item_id",
                           vec="features") -> DataFrame:
    """M5: user vector = sum of the recent items' factor vectors divided by
    its L1 norm, as long rows (user, dim, value)."""
    fl = factors_long(item_vectors.withColumnRenamed(item, "_i"), "_i", vec)
    s = recent.select(user, F.col(item).alias("_i")).join(fl, "_i").groupBy(user, "dim").agg(F.sum("v").alias("v"))
    l1 = s.groupBy(user).agg(F.sum(F.abs("v")).alias("_l1"))
    return s.join(l1, user).select(user, "dim", F.when(F.col("_l1") > 0, F.col("v") / F.col("_l1")).otherwise(0.0).alias("value"))


def gram_matrix(item_vectors: DataFrame, vec="features"):
    """The factors' Gram matrix, rank x rank: every task adds up its own rows, the
    sums of the tasks are added by position."""
    import numpy as np
    import pyarrow as pa

    def partial(batches):
        total = None
        for batch in batches:
            lists = batch.column(0)
            m = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()].reshape(len(lists), -1)
            if len(m):
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = item_vectors.select(as_double_array(vec).alias("v")).mapInArrow(partial, "cell bigint, v double") \
        .groupBy("cell").agg(F.sum("v").alias("v")).collect()          # rank x rank numbers
    rank = int(round(len(cells) ** 0.5))
    gram = np.zeros(rank * rank)
    for c in cells:
        gram[c.cell] = c.v
    return gram.reshape(rank, rank)


def _times(vec, matrix) -> Column:
    """Row vector times a small fitted matrix (rank rows)."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in column]) for column in matrix.T])
    return F.transform(columns, lambda c: dot(c, vec))


def _multiplied(df: DataFrame, matrix) -> DataFrame:
    """``df`` with its row vectors ``vec``, which have no null components, times a small fitted matrix, a batch at a time."""
    import numpy as np
    import pyarrow as pa

    def product(batches):
        for batch in batches:
            lists = batch.column("vec")
            m = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()].reshape(len(lists), -1) @ matrix
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([out if c == "vec" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    whole = F.col("vec").isNotNull() & (F.size("vec") == matrix.shape[0]) & F.forall("vec", lambda x: x.isNotNull())
    return df.filter(whole).mapInArrow(product, df.schema)


def fold_in_users(recent: DataFrame, item_vectors: DataFrame, user="user_id", item="item_id", vec="features") -> DataFrame:
    """M5 (fold-in): user vector = sum over the recent items of their rows of the
    factors' pseudo-inverse, that is (sum of their factors) times the inverse Gram
    matrix; (user, vec). Recent items without factors are left out."""
    import numpy as np

    inverse = np.linalg.pinv(gram_matrix(item_vectors, vec))
    return _multiplied(_sums(recent.select(user, item).distinct(), item_vectors, user, item, vec), inverse)


def _sums(recent: DataFrame, item_vectors: DataFrame, user: str, item: str, vec: str) -> DataFrame:
    """(user, vec): the sum of the recent items' vectors (a short list); items without one are left out, and null components."""
    v = item_vectors.select(F.col(item).alias("_i"), F.col(vec).alias("_v"))
    lists = recent.select(user, F.col(item).alias("_i")).join(v, "_i").groupBy(user).agg(F.array_sort(F.collect_list("_v")).alias("_l"))
    plus = lambda x, y: F.coalesce(x + y.cast("double"), x, y.cast("double"))
    total = F.aggregate("_l", F.array().cast("array<double>"), lambda s, x: F.zip_with(s, x, plus))
    return lists.select(user, total.alias("vec")).filter(F.size("vec") > 0)


def recommend_recent_mf(recent: DataFrame, item_vectors: DataFrame, n: int, fold_in: bool = False, user="user_id",
                        item="item_id", vec="features") -> DataFrame:
    """M5: top n items by dot(item factors, user vector), recent items removed; the user
    vector is folded in or averaged from the recent items. (user, item, score, rank)."""
    recent = stored(recent.select(user, item), "recent")        # read for the users' vectors and as what they have seen
    if fold_in:
        users = fold_in_users(recent, item_vectors, user, item, vec)
    else:
        s = _sums(recent, item_vectors, user, item, vec)
        l1 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(x), F.lit(0.0)))
        users = s.withColumn("_l1", l1).select(user, F.transform("vec", lambda x: F.when(F.col("_l1") > 0, x / F.col("_l1")).otherwise(0.0)).alias("vec"))
    items = item_vectors.select(item, as_double_array(vec).alias("vec"))
    return top_unseen(items, users, recent.select(user, item), n, None, item, user)


def mf_user_clusters(user_factors: DataFrame, k: int = 20, dims: int = 10, iters: int = 200, seed: int = 1,
                     user="id", vec="features") -> DataFrame:
    """M6: project user factors to ``dims`` principal components, KMeans into
    k clusters; (user, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    v = user_factors.select(user, array_to_vector(as_double_array(vec)).alias("_v"))
    pca = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v)
    p = pca.transform(v)
    km = KMeans(k=k, maxIter=iters, seed=seed, featuresCol="_p", predictionCol="cluster").fit(p)
    return km.transform(p).select(user, "cluster")


def mf_archetypes(user_factors: DataFrame, item_factors: DataFrame, k: int = 20, dims: int = 10, n: int = 200, iters: int = 200,
                  seed: int = 1, clusters: DataFrame | None = None, user="user_id", item="item_id",
                  vec="features") -> tuple[DataFrame, DataFrame]:
    """M6: users are projected on the ``dims`` leading principal axes of the item factors, scaled by
    the singular values, and clustered (or ``clusters``, (user, cluster), are given); each
    cluster's mean is mapped back to factors and ranks all items once. Returns (user, cluster) and
    (cluster, item, score, rank) with the ``n`` best items of each cluster."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    values, axes = np.linalg.eigh(gram_matrix(item_factors, vec))
    lead = np.argsort(-values)[:dims]
    scale, axes = np.sqrt(np.maximum(values[lead], 0.0)), axes[:, lead]
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 1e-12 * max(scale.max(), 1e-300))
    placed = user_factors.select(user, _times(as_double_array(vec), axes * scale).alias("_p"))
    if clusters is None:
        points = reuse(placed.withColumn("_v", array_to_vector("_p")))
        model = KMeans(k=k, maxIter=iters, seed=seed, featuresCol="_v", predictionCol="cluster").fit(points)
        placed = model.transform(points).select(user, "cluster", "_p")
    else:
        placed = placed.join(clusters.select(user, "cluster"), user)
    means = placed.select("cluster", F.posexplode("_p").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("v")) \
        .groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("_m"))
    archetypes = means.select(F.col("cluster").cast("bigint").alias("cluster"), _times(F.col("_m"), inverse[:, None] * axes.T).alias("vec"))
    items = item_factors.select(item, as_double_array(vec).alias("vec"))
    none = archetypes.select("cluster", F.lit(None).cast("bigint").alias(item)).limit(0)
    return placed.select(user, F.col("cluster").cast("bigint").alias("cluster")), top_unseen(items, archetypes, none, n, None, item, "cluster")


def recommend_user_cluster(user_clusters: DataFrame, archetype_items: DataFrame, seen: DataFrame, n: int, user="user_id",
                           item="item_id") -> DataFrame:
    """M6: the first n unseen items of the user's cluster, scores rescaled to 1. The clusters' lists
    are few and short: each is one row, from which a user takes the first n that their own seen
    items of the lists leave, so no user's whole list is dealt out."""
    at = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), F.asc(item)))
    lists = archetype_items.select("cluster", item, "score").withColumn("_at", at) \
        .groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_at", item, "score"))).alias("_list"))
    listed = seen.select(user, item).join(F.broadcast(archetype_items.select(item).distinct()), item, "left_semi")
    gone = listed.groupBy(user).agg(F.collect_set(item).alias("_gone"))
    left = F.filter("_list", lambda x: ~F.coalesce(F.array_contains("_gone", x[item]), F.lit(False)))
    c = user_clusters.join(gone, user, "left").join(F.broadcast(lists), "cluster") \
        .select(user, F.explode(F.slice(left, 1, n)).alias("_e")).select(user, f"_e.{item}", "_e.score")
    t = top_k(c, [user], [F.desc("score"), F.asc(item)], n)
    return t.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(user)))


# ----------------------------------------------------------- topics

def fit_topics(user_tags: DataFrame, k: int = 50, iters: int = 20, seed: int = 1, vocab: int = 10000,
               user="user_id") -> tuple[DataFrame, DataFrame]:
    """M9: LDA over per-user tag documents; returns (user, topic, weight) and
    (tag, topic, weight) for the 50 best terms per topic (topics 1-based). ``user_tags`` has a
    ``tag`` a row, or a list of ``tags``, which is dealt as one row. The documents are stored
    once: vocabulary, every iteration and the topics read them."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array
    words = F.flatten(F.collect_list("tags")) if "tags" in user_tags.columns else F.collect_list("tag")
    docs = stored(user_tags.groupBy(user).agg(words.alias("_t")), "tag-documents")
    cv = CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=vocab).fit(docs)
    c = cv.transform(docs)
    lda = LDA(k=k, maxIter=iters, seed=seed, featuresCol="_c", topicDistributionCol="_d").fit(c)
    ut = lda.transform(c).select(user, F.posexplode(vector_to_array("_d")).alias("topic", "weight")) \
        .withColumn("topic", F.col("topic") + 1)
    vocab_arr = F.array(*[F.lit(w) for w in cv.vocabulary])  # bounded by vocabSize
    tt = lda.describeTopics(50).select((F.col("topic") + 1).alias("topic"),
                                       F.arrays_zip("termIndices", "termWeights").alias("_z")) \
        .select("topic", F.explode("_z").alias("_e")) \
        .select(F.element_at(vocab_arr, F.col("_e.termIndices") + 1).alias("tag"), "topic", F.col("_e.termWeights").alias("weight"))
    return ut, tt


def item_topic_vectors(item_tags: DataFrame, tag_topics: DataFrame, min_tags: int, item="item_id") -> DataFrame:
    """Item topic weights = sum of its tags' topic weights / total, for
    items with at least ``min_tags`` tags; (item, topic, weight)."""
    n = item_tags.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_tags)
    j = item_tags.join(n.select(item), item).join(tag_topics, "tag").groupBy(item, "topic").agg(F.sum("weight").alias("w"))
    tot = j.groupBy(item).agg(F.sum("w").alias("_t"))
    return j.join(tot, item).select(item, "topic", (F.col("w") / F.col("_t")).alias("weight"))


def recommend_topics(user_topics: DataFrame, item_topics: DataFrame, candidates: DataFrame, seen: DataFrame,
                     n: int, user="user_id", item="item_id") -> DataFrame:
    """score(user, candidate) = dot(user topics, item topics) over the
    user's candidate items; seen removed; top n rescaled to 1."""
    c = exclude_seen(candidates.select(user, item).distinct(), seen, (user, item))
    j = c.join(item_topics, item).join(user_topics.select(user, "topic", F.col("weight").alias("_u")), [user, "topic"])
    s = j.groupBy(user, item).agg(F.sum(F.col("weight") * F.col("_u")).alias("score"))
    # rank on the score rounded to 9 decimals so float noise cannot reorder ties
    t = top_k(s, [user], [F.desc(F.round("score", 9)), F.asc(item)], n)
    return t.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(user)))


def recent_topic_vectors(recent: DataFrame, item_topics: DataFrame, user="user_id", item="item_id") -> DataFrame:
    """User topic vector = average of the topic vectors of recent items."""
    n = recent.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    s = recent.select(user, item).join(item_topics, item).groupBy(user, "topic").agg(F.sum("weight").alias("_s"))
    return s.join(n, user).select(user, "topic", (F.col("_s") / F.col("_n")).alias("weight"))


# ----------------------------------------------------------- word / item vectors

def fit_item2vec(sessions: DataFrame, dim: int = 30, min_count: int = 50, seed: int = 1, tokens="items"):
    """Skip-gram Word2Vec on session item sequences (space separated)."""
    from pyspark.ml.feature import Word2Vec
    d = sessions.select(F.split(tokens, " ").alias("_t"))
    return Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, inputCol="_t", outputCol="_v").fit(d)


def vector_neighbours(vectors: DataFrame, k: int, key="id", vec="vec") -> DataFrame:
    """The k nearest vectors by cosine, excluding self (``nearest``: exact, all
    rows); a zero vector has similarity 0 to all. (key, other, sim, rank)."""
    return nearest(vectors, k, key, vec).withColumnRenamed("id", key)


def _recent_units(recent: DataFrame, vectors: DataFrame, user: str, item: str, key: str, vec: str) -> DataFrame:
    """(user, units, vec): unit vectors of the user's recent items (a short list) and their sum;
    items without a vector or with a zero vector are left out."""
    v, size = as_double_array(vec), norm(as_double_array(vec))
    units = vectors.filter(size > 0).select(F.col(key).alias(item), unit(v).alias("_u"))
    total = F.aggregate("units", F.transform(F.col("units")[0], lambda x: F.lit(0.0)), lambda s, u: F.zip_with(s, u, lambda x, y: x + y))
    return recent.select(user, item).distinct().join(units, item).groupBy(user).agg(F.array_sort(F.collect_list("_u")).alias("units")) \
        .withColumn("vec", total)


def recommend_vectors(vectors: DataFrame, recent: DataFrame, seen: DataFrame, n: int, drop_perfect: bool = True,
                      user="user_id", item="item_id", key="id", vec="vec") -> DataFrame:
    """Score of every item with a vector = sum of its cosine to the user's
    recent items, perfect matches (1.0) optionally dropped; seen removed; top n
    rescaled. All items are candidates: the sum of the unit vectors is one query."""
    v, size = as_double_array(vec), norm(as_double_array(vec))
    units = vectors.filter(size > 0).select(F.col(key).alias(item), unit(v).alias("vec"))
    recent = stored(recent.select(user, item), "recent")
    queries = _recent_units(recent, vectors, user, item, key, vec)

    def mark(own):      # along one direction: as near to each other as the vectors at least
        return F.aggregate(F.transform(own, lambda x, i: x * F.sin(i + 1)), F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(own))

    def doubtful(own):  # unit vectors of cosine 1 to 9 decimals differ by less than 3.2e-5
        return F.exists("marks", lambda m: F.abs(m - own) < 4e-5)

    def score(_, own):
        kept = F.filter(F.transform("units", lambda u: dot(u, own)), lambda c: F.round(c, 9) != 1.0)
        return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)

    if drop_perfect:
        t = top_unseen(units, queries.withColumn("marks", F.transform("units", mark)), seen, n, score, item, user, mark=mark, doubtful=doubtful)
    else:
        t = top_unseen(units, queries.select(user, "vec"), seen, n, None, item, user)
    return t.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(user)))


def sort_by_vectors(items_to_sort: DataFrame, vectors: DataFrame, recent: DataFrame, seen: DataFrame,
                    user="user_id", item="item_id", key="id", vec="vec") -> DataFrame:
    """Order given items: unseen ones with a vector by their summed cosine to the
    recent items, then seen (or recent) ones, then those without a vector. Users without an
    unseen item to score, or without a recent item that has a vector, get no list."""
    q = _recent_units(recent, vectors, user, item, key, vec).select(user, F.col("vec").alias("_q"))
    known = seen.select(user, item).unionByName(recent.select(user, item)).distinct().withColumn("_seen", F.lit(True))
    size = norm(as_double_array(vec))
    # a user's sum is only joined where the user's rows are; on the way there only unseen items have their vectors, as they were given
    given = vectors.filter(size > 0).select(F.col(key).alias(item), F.col(vec).alias("_v"))
    j = items_to_sort.select(user, item).distinct().join(known, [user, item], "left").join(given, item, "left")
    place = F.when(F.col("_seen").isNotNull(), 1).when(F.col("_v").isNull(), 2).otherwise(0)
    j = j.select(user, item, place.alias("place"), F.when(place == 0, F.col("_v")).alias("_v")).join(q, user)
    j = j.select(user, item, "place", F.when(F.col("place") == 0, F.round(dot("_q", unit(as_double_array("_v"))), 9)).alias("score"))
    order = Window.partitionBy(user).orderBy("place", F.desc_nulls_last("score"), F.asc(item))
    return j.withColumn("_any", F.min("place").over(Window.partitionBy(user))).filter(F.col("_any") == 0) \
        .withColumn("rank", F.row_number().over(order).cast("bigint")).drop("_any")


def recommend_docs(neighbours: DataFrame, recent: DataFrame, n: int, user="user_id", item="item_id") -> DataFrame:
    """score(document) = sum of its similarity over the neighbour lists (id, other,
    sim; 10 n long each) of the user's recent documents; top n."""
    j = recent.select(user, F.col(item).alias("id")).distinct().join(neighbours, "id")
    s = j.groupBy(user, F.col("other").alias(item)).agg(F.round(F.sum("sim"), 9).alias("score"))
    return top_k(s, [user], [F.desc("score"), F.asc(item)], n)


def nearest_reference(vectors: DataFrame, refs: DataFrame, key="id", vec="vec", ref_key="ref", ref_vec="vec",
                      min_sim: float = 0.15) -> DataFrame:
    """For each vector the most similar of a bounded reference set
    (e.g. rating-suffix vectors or query-term sums) when cosine > min_sim."""
    arr = _checked_array(refs.select(F.col(ref_key).alias("k"), as_double_array(ref_vec).alias("v")))
    v = as_double_array(vec)
    scored = F.transform(arr, lambda r: F.struct(r["k"].alias("k"), cosine(v, r["v"]).alias("s")))
    best = F.aggregate(scored, F.struct(F.lit(None).cast(refs.schema[ref_key].dataType).alias("k"), F.lit(-2.0).alias("s")),
                       lambda acc, x: F.when(x["s"] > acc["s"], x).otherwise(acc))
    out = vectors.select(key, best.alias("_b"))
    return out.filter(F.col("_b.s") > min_sim).select(key, F.col("_b.k").alias("best"), F.col("_b.s").alias("sim"))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group (posexplode + grouped average)."""
    l = vectors.select(group, F.posexplode(as_double_array(vec)).alias("dim", "v")).groupBy(group, "dim").agg(F.avg("v").alias("v"))
    return l.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("_s")) \
        .select(group, F.transform("_s", lambda x: x["v"]).alias(vec))


def random_index_vectors(doc_terms: DataFrame, dim: int = 64, seeds: int = 4, seed: int = 1,
                         key="doc_id", term="term", dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """M16 (random indexing): each term gets a sparse ternary index vector
    (``seeds`` +1/-1 entries at hashed positions); a document vector is the
    sum of its terms' index vectors; a term vector is the sum of the
    vectors of the documents containing it. Returns (doc, dim, value),
    (term, dim, value), or with ``dense`` (doc, vec), (term, vec). ``doc_terms`` has a term a row, or a
    list of ``terms``, whose set is the document's: documents are then summed where they are."""
    docs, terms = random_index(doc_terms, dim, seeds, seed, key, term)
    if dense:
        return tuple(x.withColumn("vec", F.transform("vec", lambda v: F.coalesce(v, F.lit(0.0)))) for x in (docs, terms))
    return tuple(x.select(name, F.posexplode("vec").alias("dim", "value")).filter(F.col("value").isNotNull())
                 .select(name, F.col("dim").cast("bigint").alias("dim"), "value") for x, name in ((docs, key), (terms, term)))


def project_weights(weights: DataFrame | TermLists, key: str, term: str, weight: str, dim: int = 64, seeds: int = 4,
                    seed: int = 1) -> DataFrame:
    """Random projection of sparse (key, term, weight) rows, or lists, onto
    ``dim`` dimensions with hashed ternary index vectors; (key, vec array)."""
    return projected(weights if isinstance(weights, TermLists) else term_lists(weights, key, term, weight), dim, seeds, seed)


# ----------------------------------------------------------- anomaly (iNNE)

def _dist(metric: str):
    if metric == "chebyshev":
        return lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "kolmogorov":
        def dot(a, b):
            return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

        def overlap(a, b):
            unit = (F.round(F.sqrt(dot(a, a)), 10) == 1) & (F.round(F.sqrt(dot(b, b)), 10) == 1)
            return F.when(unit, F.sqrt(F.greatest(1 - F.abs(dot(a, b)), F.lit(0.0)))).otherwise(
                F.raise_error(F.lit("the kolmogorov metric takes unit vectors only")).cast("double"))
        return overlap
    return lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def fit_inne(df: DataFrame, key: str, vec: str, t: int = 100, psi: int = 8, seed: int = 1,
             metric: str = "euclidean") -> DataFrame:
    """M25 fit: ``t`` samples of ``psi`` points (hash-chosen, reproducible);
    each sampled point is a sphere centre with radius = distance to its
    nearest other point of the same sample; ``nn_radius`` = radius of that
    nearest point. Returns the t*psi spheres (a bounded table)."""
    v = as_double_array(vec)
    base = df.select(key, v.alias("_v"))
    samples = base.select(key, "_v", F.explode(F.sequence(F.lit(0), F.lit(t - 1))).alias("s")) \
        .withColumn("_h", F.xxhash64(F.col(key), F.col("s"), F.lit(seed)))
    picked = top_k(samples, ["s"], [F.asc("_h"), F.asc(key)], psi, rank_col=None)
    d = _dist(metric)
    grouped = picked.groupBy("s").agg(F.collect_list(F.struct(key, "_v")).alias("_pts"))  # psi points per sample
    sph = grouped.select("s", F.explode("_pts").alias("c"), "_pts")
    sph = sph.select("s", F.col(f"c.{key}").alias("center_id"), F.col("c._v").alias("center"),
                     F.filter("_pts", lambda p: p[key] != F.col(f"c.{key}")).alias("_others"))
    with_nn = sph.select("s", "center_id", "center",
                         F.aggregate(F.transform("_others", lambda p: F.struct(d(F.col("center"), p["_v"]).alias("dd"), p[key].alias("id"))),
                                     F.struct(F.lit(float("inf")).alias("dd"), F.lit(None).cast(df.schema[key].dataType).alias("id")),
                                     lambda acc, x: F.when(x["dd"] < acc["dd"], x).otherwise(acc)).alias("_nn"))
    r = with_nn.select("s", "center_id", "center", F.col("_nn.dd").alias("radius"), F.col("_nn.id").alias("nn_id"))
    radii = r.select("s", F.col("center_id").alias("nn_id"), F.col("radius").alias("nn_radius"))
    return r.join(radii, ["s", "nn_id"])


def score_inne(df: DataFrame, spheres: DataFrame, key: str, vec: str, t: int, metric: str = "euclidean") -> DataFrame:
    """M25 score: per sample, the smallest sphere containing the point gives
    1 - nn_radius / radius, no covering sphere gives 1; averaged over samples."""
    arr = _checked_array(spheres.select("s", "center", "radius", "nn_radius"))
    d = _dist(metric)
    v = as_double_array(vec)
    cover = F.filter(F.transform(arr, lambda sp: F.struct(sp["s"].alias("s"), sp["radius"].alias("r"), sp["nn_radius"].alias("nr"),
                                                          (d(v, sp["center"]) <= sp["radius"]).alias("in"))),
                     lambda x: x["in"])
    per = df.select(key, cover.alias("_c")).select(key, F.explode_outer("_c").alias("c"))
    best = per.groupBy(key, F.col("c.s").alias("s")).agg(F.min_by(F.struct(F.col("c.r").alias("r"), F.col("c.nr").alias("nr")), F.col("c.r")).alias("_b"))
    sc = best.select(key, "s", F.when(F.col("s").isNull(), 1.0).otherwise(
        F.when(F.col("_b.r") > 0, 1.0 - F.col("_b.nr") / F.col("_b.r")).otherwise(0.0)).alias("_sc"))
    agg = sc.groupBy(key).agg(F.sum(F.when(F.col("s").isNotNull(), F.col("_sc")).otherwise(0.0)).alias("_sum"),
                              F.count("s").alias("_covered"))
    return agg.select(key, ((F.col("_sum") + (F.lit(t) - F.col("_covered"))) / F.lit(float(t))).alias("score"))


# ----------------------------------------------------------- classifiers

def fit_classifier(df: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", seed: int = 1):
    """Tabular classifiers on assembled features (Spark ML)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                           OneVsRest, RandomForestClassifier)
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    if kind == "gbt":
        est = GBTClassifier(labelCol=label, seed=seed, maxIter=20)
    elif kind == "forest":
        est = RandomForestClassifier(labelCol=label, seed=seed, numTrees=20)
    elif kind == "mlp":
        est = MultilayerPerceptronClassifier(labelCol=label, seed=seed, layers=[len(features), 8, 2], maxIter=50)
    elif kind == "ova":
        est = OneVsRest(classifier=LogisticRegression(maxIter=20), labelCol=label)
    else:
        est = LogisticRegression(labelCol=label, maxIter=50)
    return Pipeline(stages=[va, est]).fit(df)


def cross_validate(df: DataFrame, features: Sequence[str], label: str, k: int = 3, seed: int = 1,
                   metric: str = "areaUnderROC", grid: dict | None = None):
    """K-fold cross validation over a parameter grid (random search
    = a sampled grid); refits the best on all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    lr = LogisticRegression(labelCol=label, maxIter=30)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), lr])
    g = ParamGridBuilder()
    for name, values in (grid or {"regParam": [0.0, 0.1]}).items():
        g = g.addGrid(getattr(lr, name), values)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=g.build(), numFolds=k, seed=seed,
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName=metric))
    return cv.fit(df)


def linear_score(features: DataFrame, weights: DataFrame, classes: Sequence[str], key="id") -> DataFrame:
    """Per class sum(value * weight[class, feature]) + constant, sigmoid,
    normalised to sum 1 over classes; (key, class, prob). A row whose features
    all lack weights scores by the constants."""
    f = features.select(key, "feature", "value")
    cells = f.select(key).distinct().withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    w = weights.select("cls", "feature", "weight")
    j = f.join(w, "feature").groupBy(key, "cls").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    const = w.filter(F.col("feature") == "constant").select("cls", F.col("weight").alias("_c"))
    z = F.coalesce("_s", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))
    s = cells.join(j, [key, "cls"], "left").join(const, "cls", "left").select(key, "cls", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("_p"))
    return s.withColumn("prob", F.col("_p") / F.sum("_p").over(Window.partitionBy(key))).drop("_p")


def explain_features(rows: DataFrame, model, features: Sequence[str], key: str, n: int = 10, share: float = 0.3,
                     sd: float = 0.1, seed: int = 1) -> DataFrame:
    """Perturbation importance. For each row, n noisy copies (gaussian
    noise on a share of features); for each feature the copy with that
    feature zeroed; importance = mean |(logp - logp_zeroed) / logp| of the
    row's winning class. Rows x samples x features are generated by explode
    (bounded by n * #features per row) and scored in one transform."""
    from pyspark.ml.functions import vector_to_array
    feats = list(features)
    base = rows.select(key, *feats)
    samples = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_s"))
    noisy = samples.select(key, "_s", *[
        F.when((F.col("_s") > 0) & (F.rand(seed + i) < share), F.col(c) + F.randn(seed + 100 + i) * sd).otherwise(F.col(c)).alias(c)
        for i, c in enumerate(feats)])
    variants = noisy.select(key, "_s", F.explode(F.sequence(F.lit(-1), F.lit(len(feats) - 1))).alias("_f"), *feats)
    zeroed = variants.select(key, "_s", "_f", *[F.when(F.col("_f") == i, F.lit(0.0)).otherwise(F.col(c)).alias(c)
                                                for i, c in enumerate(feats)])
    p = model.transform(zeroed).select(key, "_s", "_f", vector_to_array("probability").alias("_p"))
    win = p.filter("_f = -1").select(key, "_s", F.array_position(F.col("_p"), F.array_max("_p")).alias("_w"),
                                     F.log(F.array_max("_p")).alias("_lp"))
    j = p.filter("_f >= 0").join(win, [key, "_s"]).select(
        key, "_f", F.abs((F.col("_lp") - F.log(F.element_at("_p", F.col("_w").cast("int")))) / F.col("_lp")).alias("_imp"))
    names = F.array(*[F.lit(c) for c in feats])
    return j.groupBy(key, "_f").agg(F.avg("_imp").alias("importance")) \
        .select(key, F.element_at(names, F.col("_f") + 1).alias("feature"), "importance")


def search_vectors(items: DataFrame, queries: DataFrame, k: int, key="id", vec="vec", query_key="query",
                   query_vec="vec") -> DataFrame:
    """The k items most similar (cosine) to each query vector of a
    bounded, size-checked query set; (query, item, sim, rank)."""
    arr = _checked_array(queries.select(F.col(query_key).alias("q"), as_double_array(query_vec).alias("v")))
    v = as_double_array(vec)
    sims = F.transform(arr, lambda r: F.struct(r["q"].alias("q"), cosine(v, r["v"]).alias("s")))
    ex = items.select(key, F.explode(sims).alias("_x")).select(F.col("_x.q").alias(query_key), key, F.col("_x.s").alias("sim"))
    return top_k(ex, [query_key], [F.desc("sim"), F.asc(key)], k)
