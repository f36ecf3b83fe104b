"""Hashed linear classifiers, search over ranges and cluster archetypes against numpy."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import hashed_linear as HL
from cairn.operators import models as MO


def bucket(feature, bits):
    return int(hashlib.md5(feature.encode()).hexdigest()[:8], 16) % (1 << bits)


def sentences(n=600, seed=1):
    rnd = random.Random(seed)
    words = {"a": ["alpha", "apple", "ant"], "b": ["beta", "bread", "bee"], "c": ["gamma", "cat", "cup"]}
    noise = [f"n{i}" for i in range(40)]
    out = []
    for i in range(n):
        cls = "abc"[min(2, int(rnd.random() * 4))]        # c twice as often
        out.append((i, cls, rnd.choices(words[cls], k=2) + rnd.choices(noise, k=6) + rnd.choices(sum(words.values(), []), k=1)))
    return out


def test_features_meet_in_buckets(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (1, "x", 0.5), (2, "z", 1.0), (3, None, 1.0), (3, "x", None)],
                               "id bigint, feature string, value double")
    for bits in (1, 3, 18):
        want = {}
        for i, f, v in ((1, "x", 1.5), (1, "y", 2.0), (2, "z", 1.0)):
            want[i, bucket(f, bits)] = want.get((i, bucket(f, bits)), 0.0) + v
        assert {(r.id, r.bucket): r.value for r in HL.hash_features(df, bits).collect()} == want
    with pytest.raises(ValueError):
        HL.hash_features(df, 40)


def test_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(1)
    row, col, val = np.repeat(np.arange(20), 4), rnd.integers(0, 9, 80), rnd.normal(size=80)
    w, truth = rnd.normal(size=(2, 9)), rnd.integers(0, 2, (20, 2)).astype(float)

    def loss(w):
        m = HL.margins(w, row, col, val, 20)
        return float((np.log1p(np.exp(m)) - truth * m).sum())

    got = HL.gradient(w, row, col, val, truth)
    for c in range(2):
        for b in range(9):
            d = np.zeros_like(w)
            d[c, b] = 1e-6
            assert abs((loss(w + d) - loss(w - d)) / 2e-6 - got[c, b]) < 1e-5


def test_fit_beats_the_constant_on_other_rows(spark):
    data = sentences()
    feats = spark.createDataFrame([(i, w, 1.0) for i, _, ws in data for w in ws], "id bigint, feature string, value double")
    rows = spark.createDataFrame([(i, c) for i, c, _ in data] + [(10_000, "a")], "id bigint, label string").repartition(3)
    ready = HL.hashed_rows(feats, rows, 12)
    train, test = ready.filter("id % 4 <> 0"), ready.filter("id % 4 = 0")
    weights = HL.fit_hashed_linear(train, ["a", "b", "c"], 12, epochs=8)
    out = HL.predict_hashed(test, weights, ["a", "b", "c"]).collect()
    right = np.mean([r.label == r.cls for r in out])
    common = max(np.mean([r.label == c for r in out]) for c in "abc")
    assert right > 0.9 > common + 0.2
    assert next(r.cls for r in out if r.id == 10_000) == "c"          # no feature: the constant says the commonest
    # the table form gives the same probabilities
    table = HL.weight_table(spark, weights, ["a", "b", "c"], 12)
    unit = test.select("id", F.explode(F.arrays_zip("buckets", "values")).alias("x")) \
        .select("id", F.when(F.col("x.buckets") == 1 << 12, "none").otherwise(F.col("x.buckets").cast("string")).alias("feature"), F.col("x.values").alias("value"))
    probs = {(r.id, r.cls): r.prob for r in MO.linear_score(unit, table, ["a", "b", "c"]).collect()}
    assert all(abs(probs[r.id, r.cls] - r.prob) < 1e-9 for r in out)


def test_fit_without_rows(spark):
    none = HL.hashed_rows(spark.createDataFrame([], "id bigint, feature string, value double"),
                          spark.createDataFrame([], "id bigint, label string"), 4)
    assert not HL.fit_hashed_linear(none, ["a", "b"], 4, epochs=2).any()


def test_search_keeps_the_best_of_each_rung(spark):
    df = spark.range(4000).withColumn("y", F.col("id") % 7)
    fits = []

    def fit(rows, params):
        fits.append((rows.count(), params["x"]))
        return params

    model, best, log = HL.search_ranges(df, "id", fit, lambda m, rows: -(m["x"] - 3.0) ** 2 - m["k"] * 0 * rows.count(),
                                        {"x": (0.0, 10.0), "k": (1, 5), "r": (1e-4, 1.0, "log")}, trials=9, keep=3)
    runs = log.collect()
    assert [sum(r.rung == i for r in runs) for i in range(3)] == [9, 3, 1]
    draws = HL.draw({"x": (0.0, 10.0), "k": (1, 5), "r": (1e-4, 1.0, "log")}, 9, 1)
    assert best == min(draws, key=lambda d: abs(d["x"] - 3.0)) == model
    assert all(isinstance(d["k"], int) and 1 <= d["k"] <= 5 and 1e-4 <= d["r"] <= 1 for d in draws)
    assert fits[-1] == (4000, best["x"]) and [r.share for r in runs][-1] == 1.0
    sizes = [n for n, _ in fits[:-1]]
    assert sizes[0] < sizes[9] < sizes[12] < 4000
    assert {json.loads(r.params)["x"] for r in runs if r.rung == 0} == {d["x"] for d in draws}


def test_archetypes_of_few_axes(spark):
    rnd = np.random.default_rng(3)
    items, users = rnd.normal(size=(60, 6)) * [3, 2, 2, 1, .5, .1], rnd.normal(size=(40, 6))
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} bigint, features array<double>").repartition(3)
    clusters = spark.createDataFrame([(i, i % 4) for i in range(40)], "user_id bigint, cluster int")
    own, ranked = MO.mf_archetypes(frame(users, "user_id"), frame(items, "item_id"), dims=3, n=5, clusters=clusters)
    _, s, v = np.linalg.svd(items, full_matrices=False)
    for c in range(4):
        centre = (users[c::4] @ v[:3].T * s[:3]).mean(axis=0)
        want = items @ ((centre / s[:3]) @ v[:3])
        got = [(r.item_id, r.score) for r in ranked.filter(F.col("cluster") == c).orderBy("rank").collect()]
        assert [i for i, _ in got] == [int(i) for i in np.argsort(-want)[:5]] and np.allclose([x for _, x in got], np.sort(-want)[:5] * -1, atol=1e-7)
    assert own.count() == 40
    fitted, _ = MO.mf_archetypes(frame(users, "user_id"), frame(items, "item_id"), k=3, dims=2, n=5, iters=10)
    assert {r.cluster for r in fitted.collect()} == {0, 1, 2}
    seen = spark.createDataFrame([(0, ranked.filter("cluster = 0 and rank = 1").first().item_id)], "user_id bigint, item_id bigint")
    recs = MO.recommend_user_cluster(own, ranked, seen, 2).filter("user_id = 0").orderBy("rank").collect()
    assert [r.item_id for r in recs] == [r.item_id for r in ranked.filter("cluster = 0 and rank in (2, 3)").orderBy("rank").collect()]
    assert recs[0].score == 1.0
