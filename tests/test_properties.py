"""Random small inputs against plain Python models (W1, W4, A15, T5 hashing)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.operators import models as MO
from cairn.operators import popularity as POP
from cairn.operators import rules as RU
from cairn.operators import sessions as SS
from cairn.operators.sequence import ordered_ngrams, running_sum, time_bucket, with_prev
from cairn.streaming.streams import _decay_state_fn

EVENTS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400), st.integers(0, 5)), min_size=1, max_size=40)


def py_sessions(ev, gap):
    out = {}
    for u in sorted({e[0] for e in ev}):
        seq = sorted((t, i, it) for i, (uu, t, it) in enumerate(ev) if uu == u)
        s, last = 0, None
        for t, i, it in seq:
            if last is None or t - last > gap:
                s += 1
            out[i] = s
            last = t
    return out


@settings(max_examples=15, deadline=None)
@given(EVENTS, st.sampled_from([None, 7, 50]))
def test_sessionize_matches_python(spark, ev, bucket):
    df = spark.createDataFrame([(u, t, it, i) for i, (u, t, it) in enumerate(ev)], "user_id long, t long, item_id long, seq long")
    b = time_bucket("t", bucket) if bucket else None
    from cairn.operators.sequence import sessionize
    got = {r["seq"]: r["session_no"] for r in sessionize(df, "user_id", "t", 30, order=["t", "seq"], bucket=b).collect()}
    assert got == py_sessions(ev, 30)


@settings(max_examples=10, deadline=None)
@given(EVENTS)
def test_running_sum_and_prev(spark, ev):
    df = spark.createDataFrame([(u, t, i) for i, (u, t, it) in enumerate(ev)], "user_id long, t long, seq long")
    got = {r["seq"]: (r["pos"], r["prev_t"]) for r in
           running_sum(with_prev(df, ["user_id"], ["t", "seq"], ["t"], time_bucket("t", 13)), ["user_id"], ["t", "seq"],
                       F.lit(1), "pos", time_bucket("t", 13)).collect()}
    for u in {e[0] for e in ev}:
        seq = sorted((t, i) for i, (uu, t, _) in enumerate(ev) if uu == u)
        for k, (t, i) in enumerate(seq):
            assert got[i] == (k + 1, seq[k - 1][0] if k else None)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.sampled_from(["add", "rm"]), st.integers(0, 100)),
                min_size=1, max_size=25))
def test_baskets_match_replay(spark, ev):
    df = spark.createDataFrame([(u, it, k, t, i) for i, (u, it, k, t) in enumerate(ev)],
                               "user_id long, item_id long, event_type string, t_us long, event_id long")
    got = sorted((r["user_id"], r["basket"]) for r in SS.baskets(df, "add", "rm", 20).collect())
    want = []
    for u in sorted({e[0] for e in ev}):
        seq = sorted((t, i, it, k) for i, (uu, it, k, t) in enumerate(ev) if uu == u)
        basket, last = set(), None
        for t, i, it, k in seq:
            if last is not None and t - last > 20 and k == "add":
                if basket:
                    want.append((u, " ".join(str(x) for x in sorted(basket))))
                basket = set()
            basket.add(it) if k == "add" else basket.discard(it)
            last = t
        if basket:
            want.append((u, " ".join(str(x) for x in sorted(basket))))
    assert got == sorted(want)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1000)), min_size=1, max_size=30))
def test_decayed_counts_match_running_update(spark, ev):
    df = spark.createDataFrame(ev, "k long, t long")
    got = {r["k"]: r["count"] for r in POP.decayed_counts(df, ["k"], 100.0, 2000).collect()}
    for k in {e[0] for e in ev}:
        c, last = 0.0, None
        for t in sorted(t for kk, t in ev if kk == k):
            c = 1.0 + (math.exp(-(t - last) / 100.0) * c if last is not None else 0.0)
            last = t
        c *= math.exp(-(2000 - last) / 100.0)
        assert abs(got[k] - c) < 1e-9 * max(1.0, c)


def test_ngrams_positions(spark):
    rnd = random.Random(3)
    data = [(0, t, rnd.randrange(3)) for t in range(12)]
    df = spark.createDataFrame(data, "user_id long, t long, item_id long")
    grams = ordered_ngrams(df, "user_id", ["t"], "item_id", 3, time_bucket("t", 5))
    tri = sorted(tuple(r["gram"]) for r in grams.filter("n = 3").collect())
    want = sorted(tuple(x[2] for x in data[i:i + 3]) for i in range(len(data) - 2))
    assert tri == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 3)), min_size=1, max_size=12), st.integers(1, 5), st.booleans())
def test_decay_state_ignores_chunks_and_order(ev, size, started):
    class State:
        exists, get = started, (2.0, 20.0)

        def update(self, value):
            self.value = value

    whole, parts = State(), State()
    pdf = pd.DataFrame(ev, columns=["t", "w"])
    list(_decay_state_fn(10.0)((1,), [pdf], whole))
    list(_decay_state_fn(10.0)((1,), [pdf[::-1][i:i + size] for i in range(0, len(pdf), size)], parts))
    assert np.allclose(whole.value, parts.value)
    c, last = (2.0, 20.0) if started else (0.0, 0.0)
    for t, w in sorted((max(t, last), w) for t, w in ev):
        c, last = w + c * math.exp(-(t - last) / 10.0), t
    assert np.allclose(whole.value, (c, last))


def test_linear_score_of_rows_without_weights(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (2, "unknown", 1.0)], "id long, feature string, value double")
    w = spark.createDataFrame([("p", "a", 2.0), ("p", "constant", 1.0), ("q", "constant", 1.0)], "cls string, feature string, weight double")
    got = {(r["id"], r["cls"]): r["prob"] for r in MO.linear_score(f, w, ["p", "q"]).collect()}
    p, q = 1 / (1 + math.exp(-3)), 1 / (1 + math.exp(-1))
    assert abs(got[1, "p"] - p / (p + q)) < 1e-12 and got[2, "p"] == got[2, "q"] == 0.5


def test_overlap_distance_takes_unit_vectors(spark):
    d = MO._dist("kolmogorov")
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    assert abs(df.select(d(F.col("a"), F.col("b"))).first()[0] - math.sqrt(0.4)) < 1e-9
    with pytest.raises(Exception, match="unit vectors"):
        df.select(d(F.col("a"), F.transform("b", lambda x: 2 * x))).collect()


def test_rules_of_larger_itemsets(spark):
    rows = [(i, x) for i in range(4) for x in "abc"] + [(9, "d")]
    rules = RU.assoc_rules(spark.createDataFrame(rows, "basket_id long, item string"), 0.1, 0.0, -1.0)
    assert sorted(len(r["antecedent"]) for r in rules.collect()) == [1] * 6 + [2] * 3
