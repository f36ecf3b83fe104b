"""Registered queries: model fits and vector operators.

Seeded stochastic fits (ALS, LDA, KMeans, Word2Vec, tree models) are
rows-only; operators that consume given factors / weights carry SQL twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import features as FE
from cairn.operators import hashed_linear as HL
from cairn.operators import latent as LA
from cairn.operators import models as M
from cairn.operators import popularity as POP
from cairn.operators.recommend import ranked_list
from cairn.operators.sessions import session_items
from cairn.operators.similarity import recent_items
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query
from cairn.session import stored


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _ratings(spark, d):
    return POP.action_ratings(V.actions(spark, d), {1: (1.0, 3.0), 2: (0.5, 1.0), 3: (0.2, 1.0)})


@query("m3_fit_mf")
def q_m3(spark, d):
    model = M.fit_mf(_ratings(spark, d), rank=10, iters=5, seed=3)
    return model.userFactors.select(F.col("id").cast("bigint").alias("user_id"), F.size("features").alias("rank"))


@query("m4_recommend_mf")
def q_m4(spark, d):
    model = M.fit_mf(_ratings(spark, d), rank=10, iters=5, seed=3)
    return M.recommend_mf(model, V.actions(spark, d).select("user_id", "item_id"), 5)


@query("m5_recent_mf_vectors", W("actions") + """,
l AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k,
             t, order_key, line_no FROM actions),
rec AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS q
        FROM l WHERE k = 1) WHERE q <= 5),
fl AS (SELECT vec_id, CAST(u.p - 1 AS INTEGER) AS dim, CAST(u.v AS DOUBLE) AS v FROM embeddings,
       LATERAL (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p) u),
s AS (SELECT rec.user_id, fl.dim, SUM(fl.v) AS v FROM rec JOIN fl ON rec.item_id = fl.vec_id GROUP BY ALL),
l1 AS (SELECT user_id, SUM(abs(v)) AS l1 FROM s GROUP BY user_id)
SELECT s.user_id, s.dim, round(CASE WHEN l1 > 0 THEN v / l1 ELSE 0.0 END, 6) AS value FROM s JOIN l1 ON s.user_id = l1.user_id""")
def q_m5(spark, d):
    rec = recent_items(V.actions(spark, d), 5)
    iv = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), M.as_double_array("embedding").alias("features"))
    out = M.recent_mf_user_vectors(rec, iv)
    return out.select("user_id", "dim", r("value", "value"))


@query("m6_mf_user_clusters")
def q_m6(spark, d):
    model = M.fit_mf(_ratings(spark, d), rank=12, iters=5, seed=3)
    return M.mf_user_clusters(model.userFactors, k=5, dims=4, iters=20, seed=3)


def _user_tags(spark, d):
    tags = V.item_tag(spark, d).groupBy("item_id").agg(F.collect_list("tag").alias("tags"))
    return V.actions(spark, d).select("user_id", "item_id").join(tags, "item_id").select("user_id", "tags")


@query("m9_fit_topics")
def q_m9(spark, d):
    ut, tt = M.fit_topics(_user_tags(spark, d), k=5, iters=10, seed=3)
    return ut


TOPIC_SQL = W("actions", "item_tag") + """,
ut0 AS (SELECT a.user_id, t.tag AS topic, COUNT(*) AS c FROM actions a JOIN item_tag t ON a.item_id = t.item_id GROUP BY ALL),
ut AS (SELECT user_id, topic, c / SUM(c) OVER (PARTITION BY user_id) AS weight FROM ut0),
nt AS (SELECT item_id FROM item_tag GROUP BY item_id HAVING COUNT(*) >= 3),
it0 AS (SELECT t.item_id, t.tag AS topic, SUM(1.0) AS w FROM item_tag t JOIN nt ON t.item_id = nt.item_id GROUP BY ALL),
it AS (SELECT item_id, topic, w / SUM(w) OVER (PARTITION BY item_id) AS weight FROM it0),
pop AS (SELECT item_id, COUNT(*) AS n FROM actions GROUP BY item_id ORDER BY n DESC, item_id LIMIT 30),
cand AS (SELECT u.user_id, pop.item_id FROM (SELECT DISTINCT user_id FROM actions) u, pop
         WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = u.user_id AND a.item_id = pop.item_id))"""


def _topic_inputs(spark, d):
    a = V.actions(spark, d)
    it = V.item_tag(spark, d)
    ut = a.select("user_id", "item_id").join(it, "item_id").groupBy("user_id", F.col("tag").alias("topic")).agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window
    ut = ut.select("user_id", "topic", (F.col("c") / F.sum("c").over(Window.partitionBy("user_id"))).alias("weight"))
    tag_topics = it.select("tag").distinct().select("tag", F.col("tag").alias("topic"), F.lit(1.0).alias("weight"))
    item_topics = M.item_topic_vectors(it.select("item_id", "tag"), tag_topics, 3)
    pop = a.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_list(pop, [F.desc("n"), F.asc("item_id")], 30)
    users = a.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("pos"))
    cands = users.join(ranked.select("pos", "item_id"), "pos").select("user_id", "item_id")
    return a, ut, item_topics, cands


@query("m10_recommend_topics", TOPIC_SQL + """,
sc AS (SELECT c.user_id, c.item_id, SUM(it.weight * ut.weight) AS score FROM cand c JOIN it ON c.item_id = it.item_id
       JOIN ut ON ut.user_id = c.user_id AND ut.topic = it.topic GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 5""")
def q_m10(spark, d):
    a, ut, item_topics, cands = _topic_inputs(spark, d)
    out = M.recommend_topics(ut, item_topics, cands, a.select("user_id", "item_id"), 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m11_recent_topics", TOPIC_SQL + """,
l AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k,
             t, order_key, line_no FROM actions),
rec AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS q
        FROM l WHERE k = 1) WHERE q <= 5),
rn AS (SELECT user_id, COUNT(*) AS n FROM rec GROUP BY user_id),
uv AS (SELECT rec.user_id, it.topic, SUM(it.weight) / max(rn.n) AS weight FROM rec JOIN it ON rec.item_id = it.item_id
       JOIN rn ON rn.user_id = rec.user_id GROUP BY ALL),
sc AS (SELECT c.user_id, c.item_id, SUM(it.weight * uv.weight) AS score FROM cand c JOIN it ON c.item_id = it.item_id
       JOIN uv ON uv.user_id = c.user_id AND uv.topic = it.topic GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM rk WHERE rank <= 5""")
def q_m11(spark, d):
    a, _, item_topics, cands = _topic_inputs(spark, d)
    rec = recent_items(a, 5)
    uv = M.recent_topic_vectors(rec, item_topics)
    out = M.recommend_topics(uv, item_topics, cands, a.select("user_id", "item_id"), 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m12_item2vec")
def q_m12(spark, d):
    sess = session_items(V.clicks(spark, d), 21600 * 1_000_000, 1, 1000, t="t_us", seq=("t_us", "event_id"))
    model = M.fit_item2vec(sess, dim=16, min_count=5, seed=3)
    from pyspark.ml.functions import vector_to_array
    return model.getVectors().select("word", F.size(vector_to_array("vector")).alias("dim"))


def _emb(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


# Unit vectors, and the five most recent items of every user.
UNITS = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE list_dot_product(v, v) > 0)"""
RECENT = """
l AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, order_key DESC, line_no DESC) AS k,
             t, order_key, line_no FROM actions),
lr AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, order_key DESC, line_no DESC, item_id DESC) AS q
        FROM l WHERE k = 1),
rec AS (SELECT user_id, item_id FROM lr WHERE q <= 5)"""


@query("m13_vector_neighbours", f"""WITH {UNITS},
s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s)
SELECT id, other, round(sim, 6) AS sim, rank FROM k WHERE rank <= 5""")
def q_m13(spark, d):
    out = M.vector_neighbours(_emb(spark, d), 5)
    return out.select("id", "other", r("sim", "sim"), F.col("rank").cast("bigint").alias("rank"))


@query("m14_recommend_vectors", W("actions") + f", {UNITS}, {RECENT}" + """,
c AS (SELECT rec.user_id, b.vec_id AS item_id, list_dot_product(a.v, b.v) AS cosine FROM rec JOIN u a ON a.vec_id = rec.item_id, u b),
s AS (SELECT user_id, item_id, round(coalesce(sum(cosine) FILTER (WHERE round(cosine, 9) <> 1.0), 0.0), 9) AS score FROM c GROUP BY ALL),
n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = s.user_id AND a.item_id = s.item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM n)
SELECT user_id, item_id, rank, round(score / max(score) OVER (PARTITION BY user_id), 6) AS score FROM k WHERE rank <= 5""")
def q_m14(spark, d):
    a = V.actions(spark, d)
    out = M.recommend_vectors(_emb(spark, d), recent_items(a, 5), a.select("user_id", "item_id"), 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m15_sort_by_vectors", W("actions") + f", {UNITS}, {RECENT}" + """,
given AS (SELECT user_id, item_id FROM lr WHERE q <= 20),
q AS (SELECT rec.user_id, a.v FROM rec JOIN u a ON a.vec_id = rec.item_id),
p AS (SELECT g.user_id, g.item_id, CASE WHEN rec.item_id IS NOT NULL THEN 1 WHEN u.vec_id IS NULL THEN 2 ELSE 0 END AS place, u.v
      FROM given g LEFT JOIN rec ON rec.user_id = g.user_id AND rec.item_id = g.item_id LEFT JOIN u ON u.vec_id = g.item_id),
s AS (SELECT p.user_id, p.item_id, p.place, round(sum(list_dot_product(q.v, p.v)) FILTER (WHERE p.place = 0), 9) AS score
      FROM p JOIN q ON q.user_id = p.user_id GROUP BY p.user_id, p.item_id, p.place),
f AS (SELECT *, min(place) OVER (PARTITION BY user_id) AS least FROM s)
SELECT user_id, item_id, place, round(score, 6) AS score,
       row_number() OVER (PARTITION BY user_id ORDER BY place, score DESC NULLS LAST, item_id) AS rank FROM f WHERE least = 0""")
def q_m15(spark, d):
    """The 20 last items of every user, of which the last five count as seen."""
    rec = stored(recent_items(V.actions(spark, d), 20), "recent")
    last = rec.filter("recent_rank <= 5").select("user_id", "item_id")
    out = M.sort_by_vectors(rec.select("user_id", "item_id"), _emb(spark, d), last, last)
    return out.select("user_id", "item_id", "place", r("score", "score"), "rank")


@query("m19_recommend_docs", W("clicks") + f", {UNITS}" + """,
lc AS (SELECT user_id, item_id, max(t_us) AS t, arg_max(event_id, (t_us, event_id)) AS e FROM clicks GROUP BY ALL),
rec AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, e DESC, item_id DESC) AS q FROM lc) WHERE q <= 5),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS q FROM s),
t AS (SELECT rec.user_id, k.other AS item_id, round(sum(k.sim), 9) AS score FROM rec JOIN k ON k.id = rec.item_id AND k.q <= 50 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM t)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM o WHERE rank <= 5""")
def q_m19(spark, d):
    rec = recent_items(V.clicks(spark, d), 5, order=("t_us", "event_id"))
    out = M.recommend_docs(M.vector_neighbours(_emb(spark, d), 50), rec, 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m5_recommend_recent_mf", W("actions") + f", {UNITS}, {RECENT}" + """,
fl AS (SELECT vec_id, w.p AS dim, w.x AS v FROM e, LATERAL (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p) w),
s AS (SELECT rec.user_id, fl.dim, sum(fl.v) AS v FROM rec JOIN fl ON rec.item_id = fl.vec_id GROUP BY ALL),
w AS (SELECT user_id, dim, v / sum(abs(v)) OVER (PARTITION BY user_id) AS v FROM s),
g AS (SELECT user_id, list(v ORDER BY dim) AS v FROM w GROUP BY user_id),
c AS (SELECT g.user_id, e.vec_id AS item_id, round(list_dot_product(g.v, e.v), 9) AS score FROM g, e),
n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.user_id = c.user_id AND rec.item_id = c.item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM n)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM k WHERE rank <= 5""")
def q_m5_recommend(spark, d):
    items = _emb(spark, d).select(F.col("id").alias("item_id"), F.col("vec").alias("features"))
    out = M.recommend_recent_mf(recent_items(V.actions(spark, d), 5), items, 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m5_fold_in_vectors")
def q_m5_fold_in(spark, d):
    """Users folded into the item factors and scored; no matrix inverse in SQL: tested against numpy."""
    items = _emb(spark, d).select(F.col("id").alias("item_id"), F.col("vec").alias("features"))
    out = M.recommend_recent_mf(recent_items(V.actions(spark, d), 5), items, 5, fold_in=True)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


# Given factors: items are the embeddings, user u has those of row u modulo the number of rows.
FACTORS = """
uf AS (SELECT c.user_id, e.v FROM (SELECT DISTINCT user_id FROM actions) c JOIN e ON e.vec_id = c.user_id % (SELECT count(*) FROM embeddings))"""


def _given_factors(spark, d):
    items = _emb(spark, d).select(F.col("id").alias("item_id"), F.col("vec").alias("features"))
    a = V.actions(spark, d)
    users = a.select("user_id").distinct().withColumn("id", F.pmod("user_id", items.select(F.count(F.lit(1))).scalar()))
    return a, items, users.join(items.withColumnRenamed("item_id", "id"), "id").select("user_id", "features")


@query("m4_recommend_given_factors", W("actions") + f", {UNITS}, {FACTORS}" + """,
c AS (SELECT uf.user_id, e.vec_id AS item_id, round(list_dot_product(uf.v, e.v), 9) AS score FROM uf, e),
n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = c.user_id AND a.item_id = c.item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM n)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM k WHERE rank <= 5""")
def q_m4_given(spark, d):
    a, items, users = _given_factors(spark, d)
    out = M.recommend_factors(users, items, a.select("user_id", "item_id"), 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


@query("m6_archetype_items", W("actions") + f", {UNITS}, {FACTORS}" + """,
x AS (SELECT user_id % 7 AS cluster, w.p AS dim, w.x AS v FROM uf, LATERAL (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p) w),
m AS (SELECT cluster, dim, avg(v) AS v FROM x GROUP BY ALL),
g AS (SELECT cluster, list(v ORDER BY dim) AS v FROM m GROUP BY cluster),
s AS (SELECT g.cluster, e.vec_id AS item_id, round(list_dot_product(g.v, e.v), 9) AS score FROM g, e),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, item_id) AS rank FROM s)
SELECT cluster, item_id, rank, round(score, 6) AS score FROM k WHERE rank <= 20""")
def q_m6_archetypes(spark, d):
    """Given clusters and all axes: an archetype is then the mean of its users' factors."""
    _, items, users = _given_factors(spark, d)
    clusters = users.select("user_id", F.pmod("user_id", F.lit(7)).alias("cluster"))
    _, out = M.mf_archetypes(users, items, dims=64, n=20, clusters=clusters)
    return out.select("cluster", "item_id", "rank", r("score", "score"))


@query("m6_recommend_user_cluster")
def q_m6_recommend(spark, d):
    model = M.fit_mf(_ratings(spark, d), rank=12, iters=5, seed=3)
    users, items = (f.withColumnRenamed("id", name) for f, name in ((model.userFactors, "user_id"), (model.itemFactors, "item_id")))
    clusters, ranked = M.mf_archetypes(users, items, k=5, dims=4, n=200, iters=20, seed=3)
    out = M.recommend_user_cluster(clusters, ranked, V.actions(spark, d).select("user_id", "item_id"), 5)
    return out.select("user_id", "item_id", "rank", r("score", "score"))


def _doc_terms(spark, d):
    return V.table(spark, d, "documents").select("doc_id", FE.tokenize(F.col("text")).alias("terms"))


@query("m16_random_index")
def q_m16(spark, d):
    docs, terms = M.random_index_vectors(_doc_terms(spark, d), dim=64)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("nnz"))


@query("m17_doc_similarity")
def q_m17(spark, d):
    """tf-idf weights projected on random ternary index vectors (64 dims), then
    the 5 nearest documents of every document that has a weight."""
    docs = V.table(spark, d, "documents").select("doc_id", FE.tokenize(F.col("text")).alias("toks"))
    w = FE.tfidf(docs, "doc_id", "toks", min_df=2, max_df=0.5, lists=True)
    proj = M.project_weights(w, "doc_id", "term", "weight", dim=64)
    return M.vector_neighbours(proj.withColumnRenamed("doc_id", "id"), 5) \
        .select("id", "other", r("sim", "sim"), "rank")


@query("m17_doc_similarity_lsi")
def q_m17_lsi(spark, d):
    """tf-idf weights reduced to 16 latent directions, then the 5 nearest documents of every document."""
    docs = V.table(spark, d, "documents").select("doc_id", FE.tokenize(F.col("text")).alias("toks"))
    w = FE.tfidf(docs, "doc_id", "toks", min_df=2, max_df=0.5, lists=True)
    return M.vector_neighbours(LA.lsi(w, 16).withColumnRenamed("doc_id", "id"), 5).select("id", "other", r("sim", "sim"), "rank")


@query("m31_predict_rating", """
WITH e AS (SELECT vec_id, label, CAST(u.v AS DOUBLE) AS v, u.p AS dim FROM embeddings,
           LATERAL (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p) u),
c AS (SELECT label, dim, avg(v) AS cv FROM e GROUP BY ALL),
dt AS (SELECT e.vec_id, c.label AS ref, SUM(e.v * c.cv) AS dp FROM e JOIN c ON e.dim = c.dim GROUP BY ALL),
ne AS (SELECT vec_id, sqrt(SUM(v * v)) AS n FROM e GROUP BY vec_id),
nc AS (SELECT label, sqrt(SUM(cv * cv)) AS n FROM c GROUP BY label),
cs AS (SELECT dt.vec_id, dt.ref, CASE WHEN ne.n = 0 OR nc.n = 0 THEN 0.0 ELSE dp / (ne.n * nc.n) END AS sim
       FROM dt JOIN ne ON dt.vec_id = ne.vec_id JOIN nc ON dt.ref = nc.label),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref) AS q FROM cs)
SELECT vec_id AS id, ref AS best, round(sim, 6) AS sim FROM b WHERE q = 1 AND sim > 0.15""")
def q_m31(spark, d):
    e = _emb(spark, d)
    refs = M.centroids(e, "label", "vec").withColumnRenamed("label", "ref")
    out = M.nearest_reference(e, refs, key="id", vec="vec", ref_key="ref", ref_vec="vec", min_sim=0.15)
    return out.select("id", "best", r("sim", "sim"))


@query("m25_inne_anomaly")
def q_m25(spark, d):
    e = _emb(spark, d)
    sph = M.fit_inne(e, "id", "vec", t=20, psi=8, seed=3)
    return M.score_inne(e, sph, "id", "vec", t=20)


def _doc_features(spark, d):
    docs = V.table(spark, d, "documents")
    lab = V.table(spark, d, "labels")
    f = docs.join(lab, "doc_id").select("doc_id", F.log1p("n_chars").alias("len"),
                                         (F.col("lang") == "en").cast("double").alias("is_en"),
                                         F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"),
                                         F.col("quality").cast("double").alias("label"))
    return f


@query("m26_m28_classifiers")
def q_m26(spark, d):
    f = _doc_features(spark, d)
    model = M.fit_classifier(f, ["len", "is_en", "digits"], "label", kind="gbt", seed=3)
    return model.transform(f).select("doc_id", F.col("prediction").alias("predicted"))


@query("m29_m30_cross_validate")
def q_m29(spark, d):
    f = _doc_features(spark, d)
    cv = M.cross_validate(f, ["len", "is_en", "digits"], "label", k=3, seed=3, grid={"regParam": [0.0, 0.1, 1.0]})
    return spark.createDataFrame([(float(m),) for m in cv.avgMetrics], "auc double")


@query("m27_linear_score", """
WITH f AS (SELECT doc_id, 'lang_' || lang AS feature, 1.0 AS value FROM documents
           UNION ALL SELECT doc_id, 'src_' || source, 1.0 FROM documents
           UNION ALL SELECT doc_id, 'len', ln(1 + n_chars) / 10.0 FROM documents),
fn AS (SELECT DISTINCT feature FROM f UNION ALL SELECT 'constant'),
w AS (SELECT c.cls, fn.feature, (CAST(('0x' || substr(md5(c.cls || '|' || fn.feature), 1, 4)) AS BIGINT) % 200 - 100) / 100.0 AS weight
      FROM fn, (VALUES ('q0'), ('q1')) c(cls)),
s AS (SELECT f.doc_id, w.cls, SUM(f.value * w.weight) AS s FROM f JOIN w ON f.feature = w.feature GROUP BY ALL),
p AS (SELECT s.doc_id, s.cls, 1.0 / (1.0 + exp(-(s.s + COALESCE(k.weight, 0.0)))) AS p FROM s LEFT JOIN (SELECT cls, weight FROM w WHERE feature = 'constant') k ON s.cls = k.cls)
SELECT doc_id AS id, cls, round(p / SUM(p) OVER (PARTITION BY doc_id), 6) AS prob FROM p""")
def q_m27(spark, d):
    docs = V.table(spark, d, "documents")
    f = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("lang_"), "lang").alias("feature"), F.lit(1.0).alias("value")) \
        .unionByName(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("src_"), "source").alias("feature"), F.lit(1.0).alias("value"))) \
        .unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("len").alias("feature"), (F.log(1 + F.col("n_chars")) / 10.0).alias("value")))
    names = f.select("feature").distinct().unionByName(spark.createDataFrame([("constant",)], "feature string"))
    wt = (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "cls", "feature")), 1, 4), 16, 10).cast("bigint"), F.lit(200)) - 100) / 100.0
    weights = names.select("feature", F.explode(F.array(F.lit("q0"), F.lit("q1"))).alias("cls")) \
        .select("cls", "feature", wt.alias("weight"))
    out = M.linear_score(f, weights, ["q0", "q1"])
    return out.select("id", "cls", r("prob", "prob"))


BITS = 10

# Features and weights of the query above, in 2**10 buckets.
@query("m27_linear_score_hashed", f"""
WITH f0 AS (SELECT doc_id, 'lang_' || lang AS feature, 1.0 AS value FROM documents
           UNION ALL SELECT doc_id, 'src_' || source, 1.0 FROM documents
           UNION ALL SELECT doc_id, 'len', ln(1 + n_chars) / 10.0 FROM documents),
f AS (SELECT doc_id, CAST(('0x' || substr(md5(feature), 1, 8)) AS BIGINT) % {1 << BITS} AS bucket, sum(CAST(value AS DOUBLE)) AS value FROM f0
      WHERE feature IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
fn AS (SELECT CAST(unnest(range(0, {1 << BITS})) AS VARCHAR) AS feature UNION ALL SELECT 'constant'),
w AS (SELECT c.cls, fn.feature, (CAST(('0x' || substr(md5(c.cls || '|' || fn.feature), 1, 4)) AS BIGINT) % 200 - 100) / 100.0 AS weight
      FROM fn, (VALUES ('q0'), ('q1')) c(cls)),
s AS (SELECT f.doc_id, w.cls, SUM(f.value * w.weight) AS s FROM f JOIN w ON CAST(f.bucket AS VARCHAR) = w.feature GROUP BY ALL),
p AS (SELECT s.doc_id, s.cls, 1.0 / (1.0 + exp(-(s.s + k.weight))) AS p FROM s JOIN (SELECT cls, weight FROM w WHERE feature = 'constant') k ON s.cls = k.cls)
SELECT doc_id AS id, cls, round(p / SUM(p) OVER (PARTITION BY doc_id), 6) AS prob FROM p""")
def q_m27_hashed(spark, d):
    docs = V.table(spark, d, "documents")
    f = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(
        F.struct(F.concat(F.lit("lang_"), "lang").alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("src_"), "source").alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.lit("len").alias("feature"), (F.log(1 + F.col("n_chars")) / 10.0).alias("value")))).alias("f")).select("id", "f.*")
    names = spark.range(1 << BITS).select(F.col("id").cast("string").alias("feature")).unionByName(
        spark.createDataFrame([("constant",)], "feature string"))
    wt = (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "cls", "feature")), 1, 4), 16, 10).cast("bigint"), F.lit(200)) - 100) / 100.0
    weights = names.select("feature", F.explode(F.array(F.lit("q0"), F.lit("q1"))).alias("cls")).select("cls", "feature", wt.alias("weight"))
    return HL.score_hashed(f, weights, ["q0", "q1"], BITS).select("id", "cls", r("prob", "prob"))


@query("m26_hashed_linear")
def q_m26_hashed(spark, d):
    """Quality of the labelled documents from their words, fitted on the rows whose id is not
    divisible by 4; every document gets a verdict."""
    docs = V.table(spark, d, "documents")
    # dealt once by document, as texts: the words' counts and all later steps by id are made there
    words = docs.repartition("doc_id").select(F.col("doc_id").alias("id"), FE.tokenize(F.col("text")).alias("w"), "lang", "source")
    feats = words.select("id", F.explode(F.concat(F.transform("w", lambda x: F.concat(F.lit("w_"), x)),
                                                  F.array(F.concat(F.lit("l_"), "lang"), F.concat(F.lit("s_"), "source")))).alias("feature")) \
        .groupBy("id", "feature").agg(F.log1p(F.count(F.lit(1))).alias("value"))
    lab = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label")).dropDuplicates(["id"])
    rows = HL.hashed_rows(feats, docs.select(F.col("doc_id").alias("id")).join(lab, "id", "left"), 16)
    weights = HL.fit_hashed_linear(rows.filter("label is not null and id % 4 <> 0"), ["0", "1"], 16, epochs=8)
    return HL.predict_hashed(rows, weights, ["0", "1"]).select("id", "label", "cls", r("prob", "prob"))


@query("m30_search_ranges")
def q_m30_ranges(spark, d):
    """Logistic regression's penalty and iterations by successive halving; every run as a row."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=["len", "is_en", "digits"], outputCol="features").transform(_doc_features(spark, d))
    fit = lambda f, p: LogisticRegression(labelCol="label", **p).fit(f)
    auc = BinaryClassificationEvaluator(labelCol="label")
    _, _, log = HL.search_ranges(rows.select("doc_id", "features", "label"), "doc_id", fit, lambda m, f: auc.evaluate(m.transform(f)),
                                 {"regParam": (1e-4, 1.0, "log"), "maxIter": (5, 40)}, trials=6, keep=3, least_share=1 / 3, seed=3)
    return log.select("rung", "trial", "share", r("score", "score"), "params", "kept")


@query("m33_explain_features")
def q_m33(spark, d):
    f = _doc_features(spark, d)
    model = M.fit_classifier(f, ["len", "is_en", "digits"], "label", kind="logistic", seed=3)
    return M.explain_features(f.select("doc_id", "len", "is_en", "digits"), model, ["len", "is_en", "digits"], "doc_id", n=5)
