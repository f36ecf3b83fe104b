"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles; equal sets are one class, and all further
work is on classes. MinHash signatures are cut into bands; classes with an equal
band share a bucket. Candidates come from buckets in rounds: each open bucket
(one whose members are not all in one component) compares a pivot with its
other members; what is still open after ``ROUNDS`` is compared in blocks of at
most ``BLOCK`` members, inside tasks that hold the members' full sets, verify
there and emit spanning links only (fewer than the members they read). So no
bucket's pairs are ever written out, and no pair of different components is
left out.

A candidate's signatures are read in batches. After each, the posterior
probability (uniform prior) that the similarity reaches the threshold is bounded;
below ``MISS`` the pair goes. Survivors are verified exactly on their full sets.

Defined cases: a text without words, or none, has an empty set and is linked
with nothing; a row without an id is linked with nothing, its component is null
and it is kept; rows of one id are judged each and share a component only if
their sets are linked; a component is named by its smallest id. Long texts cost
time and memory in proportion to their length; empty tables give empty results;
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import gram_hashes, keyed_text, numbered, release, scratch_scope, scratch_table, text_blocks, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 85      # percent; the operator's default
BANDS, ROWS = 24, 4  # a pair at 85 % shares no band with probability 2e-8, one at 80 % with 3e-6
BATCH = 16
MISS = 1e-9
ROUNDS = 2
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20  # members of a block, and shingles of all its sets
SALTS = 32
OWN_SALT = f"CAST(pmod(xxhash64(key), {SALTS}) AS INT)"
USED_SALTS = f"filter(sequence(0, {SALTS - 1}), i -> (shiftright(used, i) & 1L) = 1L)"  # of a bitmap ``used``
BITS, PAGE = 16, 1 << 15  # bits of a bitmap for each value, and bits of one of its rows
CHUNK = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_FAMILY = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch):
    """For each text of a batch, in order, its sorted distinct shingle hashes."""
    for rows, data, off in text_blocks(batch):
        data = _LOWER[data]
        start, end, first = word_spans(data, off)
        values = word_hashes(data, start, end)
        for a, b in zip(first[:-1], first[1:]):
            if a == b:
                yield np.zeros(0, np.int64)
                continue
            at = np.arange(a, max(a + 1, b - SHINGLE + 1))
            v = values[a:b]
            yield np.unique(gram_hashes(v, at - a, np.minimum(at - a + SHINGLE, b - a))).view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.sha256(s.tobytes()).digest()[:16]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of sets that are not empty, one row each."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    # Runs of sets of about CHUNK hashes, so that the passes stay in the cache.
    run = np.cumsum(sizes) // CHUNK
    cuts = np.flatnonzero(np.diff(run)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sets)]):
        x = np.concatenate(sets[lo:hi]).view(np.uint64)
        first = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        h = np.empty_like(x)
        for k, (m, c) in enumerate(_FAMILY):
            np.multiply(x, m, out=h)
            h += c
            out[lo:hi, k] = np.minimum.reduceat(h, first) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The band values of each signature (one row each)."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), 1))
    for k in range(ROWS):
        h = (h ^ rows[:, :, k]) * np.uint64(0xD1342543DE82EF95)
        h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, sig, bands) of every row; key, sig and bands
    are null for empty sets and rows without id."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            sets = list(shingle_sets(batch))
            at = [i for i, s in enumerate(sets) if len(s) and ids[i].is_valid]
            key, sig, bands = ([None] * len(sets) for _ in range(3))
            if at:
                mins = signatures([sets[i] for i in at])
                for i, row, band in zip(at, mins, band_keys(mins)):
                    key[i], sig[i], bands[i] = set_key(sets[i]), row.tobytes(), band
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(key, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "sig", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key binary, n_shingles bigint, sig binary, bands array<bigint>")


def pruning_table(threshold: float, n_hashes: int, miss: float = MISS) -> dict[int, int]:
    """By number of hashes compared, the largest number of agreements at which
    P(similarity >= threshold) < miss under a uniform prior (-1: none)."""
    def posterior(m, n):
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold)**(n + 1 - j) for j in range(m + 1))

    return {n: max([m for m in range(n + 1) if posterior(m, n) < miss], default=-1) for n in range(BATCH, n_hashes + 1, BATCH)}


def survivors(a: np.ndarray, b: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """Indices of the signature pairs that no batch prunes by its bound."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), np.int64)
    for n, bound in bounds.items():
        agree = agree + (a[alive, n - BATCH:n] == b[alive, n - BATCH:n]).sum(axis=1)
        keep = agree > bound
        alive, agree = alive[keep], agree[keep]
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _salted(edges: DataFrame, side: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the one row of ``side`` (a, ...) of their a. A hot
    ``a`` is dealt over SALTS tasks by its b; a row of ``side`` is copied to those
    tasks only that hold an edge of it, so there are never more copies than edges."""
    salt = f"CAST(pmod(xxhash64(b), {SALTS}) AS INT)"
    used = edges.groupBy("a").agg(F.expr(f"bit_or(shiftleft(1L, {salt}))").alias("used"))
    copies = side.join(used, "a").withColumn("salt", F.explode(F.expr(USED_SALTS))).drop("used")
    return edges.withColumn("salt", F.expr(salt)).join(copies, ["a", "salt"]).drop("salt")


def prune(pairs: DataFrame, sigs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the candidate pairs that sequential verification lets through;
    many pairs may share their a."""
    bounds = pruning_table(threshold / 100, BANDS * ROWS)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), bounds))
                yield batch.select(["a", "b"]).take(keep)

    def side(x):
        return sigs.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    near = _salted(pairs, side("a")).join(side("b"), "b") \
        .filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def might_hold(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` is in the one column of ``wanted``, and about one
    in ``BITS`` of the others, without a shuffle of ``rows``: a bitmap of ``BITS``
    bits for each wanted value goes to all tasks."""
    pages = -(-wanted.count() * BITS // PAGE) or 1

    def page(x):
        return F.pmod(F.xxhash64(x), F.lit(pages))

    def bit(x):
        return F.pmod(F.shiftrightunsigned(F.xxhash64(x), 32), F.lit(PAGE))

    value = wanted.columns[0]
    bitmap = wanted.groupBy(page(value).alias("_page")).agg(F.bitmap_construct_agg(bit(value)).alias("_bits"))
    at = bit(rows[column])
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0
    return rows.join(F.broadcast(bitmap), (page(rows[column]) == F.col("_page")) & held, "left_semi")


def full_sets(keys: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, s) of the classes ``keys`` and a few others; sets are made anew from
    the texts of these classes only, where the texts are read: no text is dealt."""
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "s"])

    wanted = scratch_table(keys.distinct().join(reps.select("key", "rep"), "key"), "wanted")
    sets = might_hold(docs, "doc_id", wanted.select("rep")).select("text").mapInArrow(run, "key binary, s array<bigint>")
    return might_hold(sets, "key", wanted.select("key")).dropDuplicates(["key"])


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    keys = pairs.select(F.col("a").alias("key")).distinct().union(pairs.select(F.col("b").alias("key")).distinct())
    sets = scratch_table(full_sets(keys, reps, docs), "sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    return _salted(pairs, sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))) \
        .join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b") \
        .withColumn("n", shared) \
        .filter(100 * F.col("n") >= threshold * (F.size("sa") + F.size("sb") - F.col("n"))) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex of an edge, but for roots, and the smallest vertex
    of its component, by alternating large and small stars."""
    seen, given = None, edges
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch_table(_salted(both.filter("b > a"), lows).select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .filter("a <> b").distinct(), "large")
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _salted(large, lows).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, scratch_table(small.union(lows.select("a", "m")).distinct(), "small")
        release(large, *([] if last is given else [last]))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            return edges
        seen = now


def _exact(x: np.ndarray, sizes: np.ndarray, values: np.ndarray, first: np.ndarray, at: np.ndarray, marks: np.ndarray,
           threshold: int) -> np.ndarray:
    """Which of the sets ``at`` reach the threshold with the set x. Sets are runs
    of ``values`` (numbers from 0 on); ``marks`` is all False before and after."""
    marks[x] = True
    shared = np.array([np.count_nonzero(marks[values[first[y]:first[y] + sizes[y]]]) for y in at], np.int64)
    marks[x] = False
    return at[100 * shared >= threshold * (len(x) + sizes[at] - shared)]


def _in_blocks(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links between the components of the open buckets in ``rows`` (band, blocks,
    key, root, sig, s), by pairs of member blocks. A cell gives only links that
    join two components not joined in it yet; all its other links follow from
    them, so they are fewer than its members."""
    bounds = pruning_table(threshold / 100, BANDS * ROWS)

    def run(cell, table):
        table = table.combine_chunks()
        key, block = table.column("key").to_pylist(), np.array(table.column("block"))
        names = {r: k for k, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
        root = np.array([names[r] for r in table.column("root").to_pylist()], np.int64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sig = _matrix(table.column("sig"))
        s = table.column("s").chunk(0) if table.column("s").num_chunks else table.column("s")
        first = np.asarray(s.offsets)[:-1].astype(np.int64)
        sizes = np.diff(np.asarray(s.offsets)).astype(np.int64)
        values = np.unique(np.asarray(s.values), return_inverse=True)[1].reshape(-1)
        marks = np.zeros(len(values) + 1, bool)
        a, b = [], []
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[root[ys] != root[x]]
            ys = ys[100 * np.minimum(sizes[ys], sizes[x]) >= threshold * np.maximum(sizes[ys], sizes[x])]
            if not len(ys):
                continue
            ys = ys[survivors(np.broadcast_to(sig[x], (len(ys), sig.shape[1])), sig[ys], bounds)]
            for y in _exact(values[first[x]:first[x] + sizes[x]], sizes, values, first, ys, marks, threshold):
                if root[x] != root[y]:
                    a.append(min(key[x], key[y]))
                    b.append(max(key[x], key[y]))
                    root[root == root[y]] = root[x]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    own = F.col("block")
    cells = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least(own, "other")).withColumn("j", F.greatest(own, "other"))
    return cells.select("band", "i", "j", "block", "key", "root", "sig", "s").groupBy("band", "i", "j") \
        .applyInArrow(run, "a binary, b binary").distinct()


def _judged(texts: DataFrame, threshold: int) -> DataFrame:
    full = scratch_table(signed(texts), "signed")
    rows = scratch_table(full.select("doc_id", "key", "n_shingles"), "keys")
    reps = scratch_table(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    # One row of each class: signatures and bands.
    classes = full.join(reps, (full["key"] == reps["key"]) & (full["doc_id"] == reps["rep"]), "left_semi").dropDuplicates(["key"])
    classes = scratch_table(classes.select("key", "n_shingles", "sig", "bands"), "signatures")
    release(full)
    banded = classes.select("key", "n_shingles", F.explode("bands").alias("band"))
    # Only bands of two or more classes can ever be open; a hot one is dealt over SALTS tasks.
    crowd = scratch_table(banded.groupBy("band").agg(F.count("*").alias("n"), F.expr(f"bit_or(shiftleft(1L, {OWN_SALT}))").alias("used"))
                          .filter("n > 1").drop("n"), "crowd")
    banded = scratch_table(might_hold(banded, "band", crowd.select("band")).withColumn("salt", F.expr(OWN_SALT))
                           .join(crowd.withColumn("salt", F.explode(F.expr(USED_SALTS))).drop("used"), ["band", "salt"]).drop("salt"), "crowded")
    release(crowd)

    links = roots = None
    for turn in range(ROUNDS + 1):
        members = banded.withColumn("root", F.col("key"))
        if roots is not None:
            members = banded.join(roots.select(F.col("a").alias("key"), F.col("b").alias("r")), "key", "left") \
                .select("band", "key", "n_shingles", F.coalesce("r", "key").alias("root"))
        pivot = F.min(F.struct(F.xxhash64("key", F.lit(turn)), F.col("key"), F.col("root")))
        open_ = scratch_table(members.groupBy("band").agg(
            pivot.alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"),
            F.sum("n_shingles").alias("size"), F.expr(f"bit_or(shiftleft(1L, {OWN_SALT}))").alias("used"))
            .filter((F.col("lo") != F.col("hi")) & (F.col("n") > (1 if turn == 0 else 2))), "open")
        if open_.isEmpty():
            break
        # A hot band is dealt over SALTS tasks, to which its one row goes along.
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
        each = open_.withColumn("salt", F.explode(F.expr(USED_SALTS))) \
            .select("band", "salt", blocks.alias("blocks"), F.col("p.key").alias("pk"), F.col("p.root").alias("pr"))
        inside = members.withColumn("salt", F.expr(OWN_SALT)).join(each, ["band", "salt"])
        if turn < ROUNDS:
            pairs = scratch_table(inside.filter("root <> pr").select(F.col("pk").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
            near = scratch_table(prune(pairs, classes, threshold), "near")
            release(pairs, open_)
            found = scratch_table(verified(near, reps, texts, threshold), "links")
            release(near)
        else:
            inside = scratch_table(inside.select("band", "blocks", "key", "root"), "inside")
            release(open_)
            sets = full_sets(inside.select("key"), reps, texts).join(classes.select("key", "sig"), "key")
            found = scratch_table(_in_blocks(inside.join(sets, "key"), threshold), "links")
        # Roots of earlier rounds stand for all their links.
        links = found if roots is None else found.union(roots)
        roots = components(links)

    tops = reps.withColumn("root", F.col("key"))
    if roots is not None:
        tops = reps.join(roots.select(F.col("a").alias("key"), F.col("b").alias("r")), "key", "left") \
            .select("key", "rep", F.coalesce("r", "key").alias("root"))
    tops = scratch_table(tops, "roots")
    least = scratch_table(tops.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    # Only classes of linked sets need another name than their own smallest id.
    named = scratch_table(tops.join(least, "root").select("key", "component_id"), "named")
    return rows.select("doc_id", "key", "n_shingles").join(named, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; sets
    with a similarity of ``threshold`` percent or more are linked."""
    with scratch_scope():
        return scratch_table(_judged(keyed_text(docs, id_col, text_col), threshold), "components", keep=True)


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of every component, that of the smallest id (of the smallest text
    hash among rows of that id), and all rows without an id; columns unchanged."""
    rows, row = numbered(docs, "near-rows")
    key = F.when(F.col(id_col).isNotNull(), F.struct(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(row).alias("row")))
    keyed = rows.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    with scratch_scope():
        judged = near_duplicates(keyed, threshold=threshold)
        gone = scratch_table(judged.filter("NOT kept").select(F.col("doc_id.row").alias(row)), "near-gone", keep=True)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(list_slice(w, i, least(i + 4, len(w))), ' ')))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.c < b.c
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT c, c FROM classes),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id, s.doc_id = coalesce(m, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN reach ON c.c = reach.a"""
