"""Documents as lists of terms: nothing is dealt by document and term, results are those of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import features as FE
from cairn.operators import latent as LA
from cairn.operators import models as M
from cairn.operators import term_lists as TL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, twice):
    rnd = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rnd.integers(0, 60, 900) ** 1.3 // 3]
    rows = [(i, words[i * 20:i * 20 + 5 + i % 16]) for i in range(45)] + [(None, ["w1", "w2"]), (50, []), (51, None), (52, ["only"])]
    return spark.createDataFrame(rows + ([(3, ["w2", "new"]), (None, ["w2"])] if twice else []), "doc_id bigint, toks array<string>")


def test_hashes_are_those_of_spark(spark):
    df = spark.createDataFrame([("a",), ("",), ("größe",), (None,)], "t string")
    for x in (0, 7, 31108, -3):
        rows = df.select(F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(x), F.lit(2)).alias("want")).collect()
        got = TL.mixed(TL.mixed(np.array([r.h for r in rows]), x), 2)
        assert got.tolist() == [r.want for r in rows]


@pytest.mark.parametrize("twice", [False, True])
def test_tfidf_lists_are_the_rows(spark, twice):
    docs = documents(spark, twice)
    want = {(r.doc_id, r.h): r.weight for r in FE.tfidf(docs, "doc_id", "toks", 2, 0.5, ["w3"]).select("doc_id", F.xxhash64("term").alias("h"), "weight").collect()}
    lists = FE.tfidf(docs, "doc_id", "toks", 2, 0.5, ["w3"], lists=True)
    rows = lists.rows.collect()
    got = {(r.doc_id, int(lists.hashes[c])): w for r in rows for c, w in zip(r.codes, r.weights)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len({r.doc_id for r in rows}) == len(rows) and ("Exchange" in plan(lists.rows)) == twice
    vec = {r.doc_id: np.array(r.vec) for r in M.project_weights(lists, "doc_id", "term", "weight", dim=8).collect()}
    sums = {}
    for (d, h), w in want.items():
        for at, sign in TL.spots(np.array([h]), 8, 4, 1):
            sums.setdefault(d, np.zeros(8))[at[0]] += sign[0] * w
    assert vec.keys() == sums.keys() and all(np.allclose(vec[d], sums[d]) for d in sums)


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("rows_held", [150_000, 3])
def test_index_vectors_of_lists(spark, monkeypatch, twice, rows_held):
    """A list's set of terms gives what rows of document and term give, without dealing them."""
    monkeypatch.setattr(TL, "TERM_ROWS", rows_held)
    docs = documents(spark, twice).repartition(3)
    rows = docs.select("doc_id", F.explode("toks").alias("term")).distinct()
    dv, tv = M.random_index_vectors(docs.select("doc_id", F.col("toks").alias("terms")), dim=70)
    assert twice or "hashpartitioning" not in plan(dv)
    held = [tuple(r) for r in rows.collect()]
    h = {r.term: r.h for r in rows.select("term", F.xxhash64("term").alias("h")).collect()}
    doc = {}
    for d, t in held:
        for at, sign in TL.spots(np.array([h[t]]), 70, 4, 1):
            doc[d, at[0]] = doc.get((d, at[0]), 0.0) + sign[0]
    term = {}
    for d, t in held:
        if d is not None:
            for (e, at), v in doc.items():
                if e == d:
                    term[t, at] = term.get((t, at), 0.0) + v
    assert {(r.doc_id, r.dim): r.value for r in dv.collect()} == doc
    assert {(r.term, r.dim): r.value for r in tv.collect()} == term
    of_rows = M.random_index_vectors(rows, dim=70)
    assert {(r.term, r.dim): r.value for r in of_rows[1].collect()} == term


def test_reduction_by_groups_of_columns_and_slabs(spark, monkeypatch):
    lists = FE.tfidf(documents(spark, False), "doc_id", "toks", 1, 1.0, lists=True)
    want = {r.doc_id: np.array(r.vec) for r in LA.lsi(lists, 5).collect()}
    monkeypatch.setattr(LA, "TERM_BYTES", 4 * 8 * len(lists.hashes))
    monkeypatch.setattr(LA, "SLAB", 7)
    monkeypatch.setattr(LA, "BLOCK_ENTRIES", 50)
    got = {r.doc_id: np.array(r.vec) for r in LA.lsi(lists, 5).collect()}
    keys = sorted(want)
    a, b = (np.stack([x[k] for k in keys]) for x in (got, want))
    assert sorted(got) == keys and np.allclose(a @ a.T, b @ b.T, atol=1e-8)
