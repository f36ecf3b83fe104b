"""Streams with state over several runs: the split must not show in the result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators.minhash import PRIME, coefficients
from cairn.streaming import stateful as SF
from cairn.streaming import streams as ST

DAY = 86400
BEGIN = 100 * DAY * 1_000_000


def test_monotone_minima_are_those_of_the_window():
    rnd = random.Random(1)
    for _ in range(60):
        h, window = rnd.randint(1, 3), rnd.randint(1, 6)
        steps = {at: (rnd.randint(1, 5), [rnd.randint(0, 9) for _ in range(h)]) for at in range(1, 30) if rnd.random() < 0.6}
        m = SF.MonotoneMinima(h)
        for at in range(1, 40):
            if at in steps:
                m.settle(at, *steps[at])
            m.expire(at - window)
            own = [steps[x] for x in range(at - window + 1, at + 1) if x in steps]
            assert bool(m.counts) == bool(own)
            if own:
                assert m.signature() == (sum(n for n, _ in own), [min(v) for v in zip(*(s for _, s in own))])
            m = SF.MonotoneMinima(h, m.minima(), m.counts)         # as state brings it back
            assert all(len(x) <= window for x in m.lists)


def events(spark, seed=2, n=300):
    rnd = random.Random(seed)
    rows = [(rnd.randint(1, 4), rnd.randint(1, 30), BEGIN + rnd.randint(0, 20 * DAY * 1_000_000), i) for i in range(n)]
    rows += [(5, 1, BEGIN, n), (5, 1, BEGIN + 2 * DAY * 1_000_000, n + 1)]
    return rows, spark.createDataFrame(rows, "item_id bigint, user_id bigint, t_us bigint, event_id bigint") \
        .withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")


@pytest.mark.parametrize("slices", [1, 3])
def test_rolling_minhash(spark, slices):
    rows, df = events(spark)
    ab = coefficients(3, 7)
    want = {}
    for at in range(99 * DAY, 130 * DAY, DAY):
        for item in range(1, 6):
            own = [u for i, u, t, _ in rows if i == item and at - 4 * DAY < t / 1e6 <= at]
            if len(own) >= 2:
                want[at, item] = (len(own), [min((a * u + b) % PRIME for u in own) for a, b in ab])
    # a time at the very start belongs to the step that ends there
    own = [u for i, u, t, _ in rows if t == BEGIN]
    assert len(own) == 1
    out = SF.run_in_slices(df, "ts", lambda e: SF.stream_rolling_minhash(e, 4 * DAY, DAY, 3, 7, 2), slices, close_after_s=6 * DAY)
    got = out.collect()
    assert len(got) == len(want) and {(r["at"], r["item"]): (r.activity, r.sig) for r in got} == want


@pytest.mark.parametrize("slices", [1, 4])
def test_decayed_runs(spark, slices):
    rows, df = events(spark, 3, 120)
    alpha, idle = 3 * DAY, DAY // 2
    want = []
    for item in range(1, 6):
        t = sorted(t for i, _, t, _ in rows if i == item)
        runs = np.split(t, np.flatnonzero(np.diff(t) > idle * 1_000_000) + 1)
        want += [(item, int(r[0]), int(r[-1]), len(r), round(float(np.exp(-(r[-1] - r) / 1e6 / alpha).sum()), 9)) for r in runs]
    out = SF.run_in_slices(df, "ts", lambda e: SF.stream_decayed_runs(e, "item_id", alpha, idle), slices, close_after_s=2 * DAY)
    assert sorted((r.key, r.begin_us, r.last_us, r.n, round(r["count"], 9)) for r in out.collect()) == sorted(want)


def test_popularity_carries_over_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "state")
    batch = lambda rows: spark.createDataFrame(rows, "item_id bigint, t bigint")
    for i, rows in enumerate(([(1, 100), (1, 100), (2, 100)], [], [(2, 200)])):
        out = ST.stream_popularity_batch(batch(rows), path, i, half=100.0).collect()
    assert {r.item_id: (round(r.score, 9), r.t) for r in out} == {1: (2.0, 100), 2: (round(1 + np.exp(-1.0), 9), 200)}


def test_an_empty_table_gives_an_empty_result(spark):
    _, df = events(spark)
    out = SF.run_in_slices(df.limit(0), "ts", lambda e: SF.stream_decayed_runs(e, "item_id", 1.0, 1), 2)
    assert out.collect() == [] and out.columns == ["key", "begin_us", "last_us", "n", "count"]
