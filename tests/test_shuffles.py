"""What queries deal between tasks: pairs are counted where a list's rows arrive, documents are dealt once."""

import pytest

from cairn.functions import features as FE
from cairn.operators import graph as G
from cairn.operators import models as M
from cairn.operators import nearest as N
from cairn.operators import similarity as SIM


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def baskets(spark):
    rows = [(u, i) for u in range(30) for i in range(u % 7, 40, 1 + u % 5)] + [(3, None), (None, 3), (None, 4)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint")


def counted(rows):
    sets = {}
    for u, i in rows:
        if u is not None and i is not None:
            sets.setdefault(u, []).append(i)
    out = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    out[a, b] = out.get((a, b), 0) + 1
    return out


@pytest.mark.parametrize("chunk, heavy", [(2000, 20_000), (4, 20_000), (2000, 5), (4, 5)])
def test_pairs_with_chunks_and_heavy_items(spark, monkeypatch, chunk, heavy):
    monkeypatch.setattr(SIM, "HEAVY", heavy)
    p = baskets(spark)
    p = p.unionByName(p.limit(7))          # repeated rows count as often as they are held
    want = counted([tuple(r) for r in p.collect()])
    got = SIM.co_occurrence(p, chunk)
    assert got.schema.simpleString() == "struct<item1:bigint,item2:bigint,co:bigint>"
    assert {(r.item1, r.item2): r.co for r in got.collect()} == want


def test_similarity_deals_no_pairs(spark):
    s = SIM.item_similarity(baskets(spark), limit=5, threshold=0.1)
    assert "hashpartitioning(item2" not in plan(s) and "SortMergeJoin [item2" not in plan(s)
    n = {}
    for r in baskets(spark).dropna(subset=["item_id"]).distinct().collect():       # a null user is one user
        n[r.item_id] = n.get(r.item_id, 0) + 1
    co = counted([tuple(r) for r in baskets(spark).collect()])
    for r in s.collect():
        assert abs(r.sim - co[r.item1, r.item2] / (n[r.item1] * n[r.item2]) ** 0.5) < 1e-12


def test_triangles_send_what_follows(spark):
    pairs = [(a, b) for a in range(14) for b in range(a + 1, 14) if (a * b + a + b) % 3]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    have = set(pairs)
    want = {p: sum((min(p[0], c), max(p[0], c)) in have and (min(p[1], c), max(p[1], c)) in have for c in range(14)) for p in pairs}
    t = G.edge_triangles(e)
    assert "slice" in plan(t)
    assert {(r.src, r.dst): r.triangles for r in t.collect()} == {p: c for p, c in want.items() if c}


def test_groups_of_a_search_follow_the_cores():
    """Candidate blocks go to every group: their number follows the cores, and a task's memory bounds them."""
    assert N._group_size(360, 12, 6) == 30
    assert N._group_size(3, 12, 6) == 1
    assert N._group_size(10 ** 6, 12, 51) * 51 * N.BLOCK_ROWS <= N.GROUP_CELLS


def test_tfidf_deals_documents_once(spark):
    docs = spark.createDataFrame([(i, "a b b c".split() + [f"w{i % 4}"]) for i in range(20)] + [(None, ["a"]), (3, ["a", "x"])],
                                 "doc_id bigint, toks array<string>")
    w = FE.tfidf(docs.repartition("doc_id"), "doc_id", "toks")
    assert "hashpartitioning(term" not in plan(w) and "hashpartitioning(doc_id, " + "term" not in plan(w)
    assert {(r.doc_id, r.term) for r in w.collect()} >= {(3, "x"), (0, "b")}


def test_term_vectors_sum_whole_documents(spark):
    rows = [(d, f"t{(d * j) % 9}") for d in range(8) for j in range(5)]
    docs, terms = M.random_index_vectors(spark.createDataFrame(rows, "doc_id bigint, term string"), dim=16)
    assert "posexplode" in plan(terms)
    of = {}
    for r in docs.collect():
        of.setdefault(r.doc_id, {})[r.dim] = r.value
    want = {}
    for d, t in set(rows):
        for i, v in of.get(d, {}).items():
            want[t, i] = want.get((t, i), 0.0) + v
    assert {(r.term, r.dim): r.value for r in terms.collect()} == want
