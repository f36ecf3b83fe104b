"""Substring, byte-string and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cairn.llm import near_dup, substring_dedup, suffix_dedup

SCHEMA = "doc_id bigint, text string, key string, rid string, h string, n_words string"


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, ties and odd rows."""
    rnd = random.Random(seed)
    word = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]

    def text(n):
        return " ".join(rnd.choices(word, k=n))

    passage, base = text(60), text(120)
    texts = [text(rnd.randint(1, 90)) for _ in range(20)]
    texts += [f"{text(15)} {passage}\t{text(9)}" for _ in range(8)] + [base] * 5
    for _ in range(12):
        w = base.split()
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += ["", None, " \n\t", "one", "One two", "one two", "a " * 300, "a " * 300, "x" * 1000, "na " * 90]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", "h", "n") for i, t in rows], SCHEMA).repartition(5)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_substrings(spark):
    rows = corpus()
    first = {}
    want = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s:s + 20])
            if first.setdefault(g, (i, s)) < (i, s):
                gone[s:s + 20] = [True] * 20
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest())
    out = substring_dedup.digest(substring_dedup.deduplicated(frame(spark, rows))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
    assert any(x[1] for x in want.values())


def test_substrings_of_tied_rows_both_stay(spark):
    t = " ".join(map(str, range(30)))
    out = substring_dedup.digest(substring_dedup.deduplicated(frame(spark, [(1, t), (1, t), (2, t), (None, t)]))).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in out) == [(False, 0, 0), (True, 1, 30), (True, 1, 30), (True, 2, 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_strings(spark, seed):
    rows = corpus(seed)
    seen = Counter(b[s:s + 200] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - 199))
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [0] * len(b)
        for s in range(len(b) - 199):
            if seen[b[s:s + 200]] > 1:
                gone[s:s + 200] = [1] * 200
        spans = sum(x > y for x, y in zip(gone, [0, *gone]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    out = suffix_dedup.digest(suffix_dedup.deduplicated(frame(spark, rows))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


@pytest.mark.parametrize("rounds,block", [(2, 256), (0, 4)])
def test_near_duplicates(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus()
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(rows)


def test_full_sets_deal_no_texts(spark):
    """All sets asked for come, others in two bitmaps by chance only; no text
    is shuffled, also if no side is small enough to be broadcast by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(400)] + [(None, "a b"), (3, "other words")]
    docs = frame(spark, rows)
    signed = near_dup.signed(docs.select("doc_id", "text")).filter("key IS NOT NULL")
    reps = signed.filter("n_shingles = 5").selectExpr("key", "doc_id AS rep").localCheckpoint()
    keys = reps.filter("rep % 40 = 3").select("key")
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        sets = near_dup.full_sets(keys, reps, docs.select("doc_id", "text"))
        plan = sets._jdf.queryExecution().executedPlan().toString()
        got = {bytes(r.key): len(r.s) for r in sets.collect()}
    finally:
        spark.conf.set(name, before)
    want = {bytes(r.key) for r in keys.collect()}
    assert len(want) == 10 and want <= got.keys() and len(got) < 60 and {got[k] for k in want} == {5}
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan


def test_pipeline_links_from_eighty_percent(spark):
    """A text of 104 words has 100 shingles; the last k words changed leave
    100 - k of 100 + k: 83 % at k = 9, 78 % at k = 12."""
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), *((k, " ".join(base[:-k] + [f"{k}x{i}" for i in range(k)])) for k in (9, 12))]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in near_dup.filtered(docs).collect()) == [1, 9, 12]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 12]


def test_near_duplicates_without_id_are_not_linked(spark):
    out = near_dup.near_duplicates(frame(spark, [(None, "a b c"), (4, "A b c"), (3, "a b c"), (3, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out) == [(0, None, True), (3, 3, True), (3, 3, True), (4, 3, False)]


def test_filtered_keeps_one_row_of_a_group_and_rows_without_id(spark):
    near, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, near), (1, near), (2, near), (2, other), (None, near), (None, None), (3, ""), (3, "")]
    kept = near_dup.filtered(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        [(1, near), (2, other), (None, near), (None, None), (3, ""), (3, "")])


def test_pruning_keeps_pairs_at_the_threshold():
    table = near_dup.pruning_table(0.85, 96)
    assert all(bound < 0.85 * n - 4 * (n * 0.85 * 0.15) ** 0.5 for n, bound in table.items() if bound >= 0)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).filter("false")
    assert near_dup.near_duplicates(none).count() == 0
    assert substring_dedup.deduplicated(none).count() == 0
    assert suffix_dedup.deduplicated(none).count() == 0


def test_filtered_keeps_columns(spark):
    docs = frame(spark, corpus())
    kept = near_dup.filtered(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(int)
    for _, (_, c, _) in brute_components(corpus()).items():
        groups[c] += 1
    assert kept.count() == len(groups)
