"""Popular-in-session with depth against a plain fold."""

import random

import pytest

from cairn.operators import recommend as RC

ATTRS = ["x", "y", "z"]


def folded(recent, dim_of, top, n, seen, depth):
    """One user's lists in order, as stated by the operator."""
    scores = {}
    for item in recent[:depth]:
        lowest = 1.0
        for attr in ATTRS:
            dim = dim_of.get((item, attr))
            if dim in top:
                first, low = 0.0, 1.0
                for i, c in top[dim]:
                    if i in seen:
                        continue
                    first = first or c
                    low = c / first * lowest
                    scores[i] = scores.get(i, 0.0) + low
                    if len(scores) >= n:
                        break
                lowest = low
            if len(scores) >= n:
                break
    best = sorted(((round(s, 12), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:n]
    return [(i, round(s / best[0][0], 9)) for s, i in best]


@pytest.mark.parametrize("n", [1, 4, 9, 40])
def test_session_depth_is_the_fold(spark, n):
    rnd = random.Random(n)
    dim_of = {(i, a): 10 * k + rnd.randint(0, 4) for i in range(30) for k, a in enumerate(ATTRS) if rnd.random() < 0.85}
    top = {}
    for d in sorted(set(dim_of.values())):
        if rnd.random() < 0.85:
            own = rnd.sample(range(30), rnd.randint(1, 5))
            top[d] = sorted(((i, float(rnd.randint(1, 9))) for i in own), key=lambda x: (-x[1], x[0]))
    users = {u: rnd.sample(range(30), rnd.randint(1, 4)) for u in range(25)}
    seen = {u: set(r) | set(rnd.sample(range(30), rnd.choice([0, 3, 15]))) for u, r in users.items()}
    out = RC.recommend_session_depth(
        spark.createDataFrame([(u, i, k + 1) for u, r in users.items() for k, i in enumerate(r)], "user_id long, item_id long, recent_rank long"),
        spark.createDataFrame([(i, d, a) for (i, a), d in dim_of.items()], "item_id long, dim_id int, attr string"),
        spark.createDataFrame([(d, i, c) for d, own in top.items() for i, c in own], "dim_id int, item_id long, count double"), n,
        spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "user_id long, item_id long"), ATTRS, 3)
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, round(r.score, 9)))
    want = {u: folded(r, dim_of, top, n, seen[u], 3) for u, r in users.items() if any(
        i not in seen[u] for x in r[:3] for a in ATTRS for i, _ in top.get(dim_of.get((x, a)), []))}
    assert got == {u: w for u, w in want.items() if w}


def test_lists_scale_below_each_other(spark):
    recent = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "user_id long, item_id long, recent_rank long")
    idim = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "x")], "item_id long, dim_id int, attr string")
    top = spark.createDataFrame([(1, 10, 8.0), (1, 11, 4.0), (2, 12, 6.0), (2, 10, 3.0), (3, 13, 5.0)], "dim_id int, item_id long, count double")
    out = RC.recommend_session_depth(recent, idim, top, 9, recent.select("user_id", "item_id"), ["x", "y"], 2)
    # 10: 1 + 0.5 * 0.5; 11: 0.5; 12: 0.5 * 1; 13: 1
    assert [(r.item_id, r.score) for r in out.orderBy("rank").collect()] == [(10, 1.0), (13, 0.8), (11, 0.4), (12, 0.4)]
