"""Toxicity, quality, token counts, secrets, URL rules, tokens, test items."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, quality, secrets, token_counts, toxicity
from cairn.llm.common import BATCH_BYTES, keyed_text
from cairn.llm.queries import VOCABULARY, op1_toxicity, vocabulary

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, t in enumerate(texts)], DOCS)


def test_clauses_not_words():
    g = toxicity.Grammar({"=idiot": 4.0})
    plain = g.clause("such an idiot".split())
    assert g.clause("you are an idiot".split()) > plain > g.clause("not an idiot".split())
    assert plain > g.clause("she said idiot".split()) / toxicity.TARGET_FACTOR
    assert g.clause("a fine day".split()) == 0


def test_toxicity_on_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(r.predicted, toxic[r.doc_id]) for r in op1_toxicity(spark, "/root/testdata/sf0.1").collect()
            if r.held_out and r.doc_id in toxic]
    hit = sum(p and y for p, y in rows)
    assert hit >= 0.85 * sum(y for _, y in rows)
    assert hit >= 0.85 * sum(p for p, _ in rows)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [None, "", "you idiot", "x " * 5000])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(out) == 4 and all(0 <= s <= 1 for s in out.values()) and out[2] > 0.3 > out[0]


def brute_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def quality_texts(spark):
    """Good English texts of sf0.01."""
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    return spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars BETWEEN 1000 AND 3000") \
        .join(good, "doc_id").orderBy("doc_id").dropDuplicates(["text"]).limit(20).collect()


def test_quality_base_counts(spark):
    rnd = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    texts += [None, "", " \n", "a b c d e f g h " * 9, "é#\n\né#\n#", " ".join(rnd.choices("ab", k=400))]
    out = quality.digest(quality.judge(frame(spark, texts))).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in out)
    assert quality.judge(frame(spark, texts).filter("false")).count() == 0


def test_quality_verdict_on_other_labels(spark):
    """The bounds are fitted on labels with an even id; these are the odd ones."""
    sf = "/root/testdata/sf0.1"
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id % 2}
    rows = [(quality_of[r.doc_id], r.kept) for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()
            if r.doc_id in quality_of and not r.base_failed]
    low, good = [k for q, k in rows if not q], [k for q, k in rows if q]
    assert len(low) > 150 and len(good) > 1500
    assert sum(low) <= 0.05 * len(low)
    assert sum(good) >= 0.995 * len(good)


def test_quality_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert quality.filtered(docs).columns == docs.columns


def test_quality_judges_rows_not_ids(spark):
    """Clean rows without an id, or with the id of a rejected row, stay."""
    texts = [r.text for r in quality_texts(spark)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "junk"), (None, texts[1]), (None, "junk"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS).withColumnRenamed("spans", "Row")
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()) == \
        sorted([(False, i, t) for i, t in enumerate(texts)] + [(True, 0, texts[1])])


def test_commit_sums_in_all_shuffle_partitions(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    docs = spark.range(200).selectExpr("id AS doc_id", "'x y' AS text", "'en' AS lang", "CAST(id AS string) AS source")
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        token_counts.commit(str(tmp_path), "a", token_counts.inserts(docs))
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "a").glob("part-*"))) == 4
    assert token_counts.totals(spark, str(tmp_path), ["a"]).count() == 400


def test_rollups_are_idempotent(spark, tmp_path):
    a, b = frame(spark, ["x y", "1 2", None]), frame(spark, ["z"])
    path = str(tmp_path)
    token_counts.commit(path, "a", token_counts.inserts(a))
    token_counts.commit(path, "a", token_counts.inserts(a))
    token_counts.commit(path, "b", token_counts.revisions(a.filter("doc_id = 1"), b))
    one = {r.tokenizer: (r.n_docs, r.n_tokens, r.n_chars) for r in token_counts.totals(spark, path, ["a", "b", "a"]).collect()}
    assert one == {"words-1": (3, 3, 4), "words-2": (3, 3, 4)}
    names = token_counts.compact(spark, path, ["a", "b"], "base")
    assert {r.tokenizer: r.n_docs for r in token_counts.totals(spark, path, names).collect()} == {"words-1": 3, "words-2": 3}
    token_counts.commit(path, "c", token_counts.deletes(a.filter("doc_id <> 1").union(b)))
    assert token_counts.totals(spark, path, [*names, "c"]).count() == 0


def test_token_counts_after_a_failed_commit(spark, tmp_path):
    path, one = str(tmp_path), spark.createDataFrame([(1, "s", "en", "a b")], "doc_id int, source string, lang string, text string")
    bad = one.withColumn("source", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        token_counts.commit(path, "new", token_counts.inserts(bad))
    with pytest.raises(ValueError, match="not committed: new"):
        token_counts.totals(spark, path, ["new"])
    token_counts.commit(path, "a", token_counts.inserts(one))
    with pytest.raises(Exception, match="lost"):
        token_counts.commit(path, "a", token_counts.inserts(bad), replace=True)
    assert {r.n_docs for r in token_counts.totals(spark, path, ["a"]).collect()} == {1}
    token_counts.commit(path, "a", token_counts.inserts(one.union(one)))
    assert {r.n_docs for r in token_counts.totals(spark, path, ["a"]).collect()} == {1}
    token_counts.commit(path, "a", token_counts.inserts(one.union(one)), replace=True)
    assert {r.n_docs for r in token_counts.totals(spark, path, ["a"]).collect()} == {2}


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path(VOCABULARY)))
    texts = [None, "", "é" * 300, "<|endoftext|> it's  3.14\n\n", "a" * 3000, "日本語 текст 😀"]
    codec = vocabulary(spark)
    out = bpe.decode(bpe.encode(frame(spark, texts), codec), codec).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in out} == {
        i: (lib.encode_ordinary(t or ""), t or "") for i, t in enumerate(texts)}


def test_tokens_with_few_states(spark, monkeypatch):
    """States and the steps between them are dropped together when either is too
    many, also while words that were never met before keep coming."""
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "MAX_STEPS", 500)
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=ranks)
    rnd, transducer = random.Random(5), bpe.Transducer(ranks)
    for _ in range(3000):
        word = " " + "".join(rnd.choices(["tre", "tion", "è", "ment", "eau", "ou", "ê", "Ai", "qu", "日", "x", "й", "aa"], k=rnd.randint(1, 8)))
        assert transducer.encode(word.encode()) == lib._encode_single_piece(word)
        assert len(transducer._step) <= 500 + 40


def test_texts_go_to_python_in_small_batches(spark):
    """Half a partition's texts never make one batch, though there are fewer than
    Spark's default number of rows."""
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    rows = [r.n for r in keyed_text(docs).mapInArrow(sizes, "n bigint").collect()]
    assert sum(rows) == 6000 and max(rows) * 5000 < 2 * BATCH_BYTES


def brute_secrets(text):
    rules = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
             ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]
    found = [(m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(rules)
             for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= least]
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_secrets(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", "é token='abcdef1' PassWord : x", "AKIA" + "Z9" * 10, "f" * 5000, "api_key=secret=abcdefgh"]
    out = secrets.digest(secrets.find_secrets(frame(spark, texts))).collect()
    assert {r.doc_id: r.base_sha256 for r in out} == {
        i: hashlib.sha256(brute_secrets(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_redaction_leaves_no_base_secret(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert not any(brute_secrets(r.text) for r in clean.collect())


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "")], "item_id bigint, text string")
    docs = frame(spark, ["a b " * 20 + item.upper() + " c", None, "", "these only three words stay or go not", "q1 q2 q3"])
    out = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in
           decontaminate.digest(decontaminate.contamination(docs, bench)).collect()}
    assert out == {0: (14, 1, True), 1: (0, 0, False), 2: (0, 0, False), 3: (3, 1, True), 4: (0, 0, False)}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.contamination(clean, bench)).collect())
