"""Hard-negative mining with Kronecker-packed inner products.

Method. Components are integers, ``floor(256 * x)``. Candidates' components are biased to be
non-negative and several candidates' values of one component are put into separate fields of
one wide integer; each anchor component, biased too, multiplies that integer once. The sum over the components holds
one candidate's sum in each field, as no field can overflow: its width is taken from the largest
norms of the rows at hand (Cauchy-Schwarz). Taking the biases off leaves the exact inner products.

Two widths of the same arithmetic. Where two or more fields fit into 53 bits the wide integers are held in
doubles, which are exact there, and one matrix product does all anchors of a block. Larger values use Python's
integers, with ``WIDE_FIELDS`` candidates in each; nothing overflows at any size.

Scale. Anchors are a stated query set (a hundredth of the rows) against all rows, in blocks: rows are packed once
into blocks of ``BLOCK_ROWS`` (a few bytes a component) in the scratch folder; anchors go to them in rounds of
at most ``ROUND_ANCHORS`` rows and about ``ROUND_BYTES``, which bounds the broadcast of a round, so neither side is
shuffled. A task keeps, for each anchor of the round, its best positives (or the best negatives under each positive's bounds) over all of its blocks and
emits these alone; ranks over the tasks' lists come from a window with few rows for each anchor. Copies, hot labels and ties
change nothing in the amount of work.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
with a null id; missing components of a shorter vector count as 0; repeated rows are rows of their own, and
so each anchor and each other's positives; an empty vector has score 0 with all; scaled components beyond 64 bits
stay at that limit, and so do scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import scratch_table

BLOCK_ROWS = 2048
ANCHOR_ROWS = 512
ROUND_ANCHORS = 1 << 15
ROUND_BYTES = 1 << 24
WIDE_FIELDS = 512
EXACT_BITS = 53
POSITIVES, NEGATIVES = 5, 10
LONG = (-2**63, 2**63 - 1)


# ---- products --------------------------------------------------------------------------------------------

def _top_value(m: np.ndarray) -> int:
    """The largest absolute value."""
    return max(-int(m.min()), int(m.max()))


def _norm(m: np.ndarray) -> int:
    """A whole number that no row's Euclidean norm exceeds (components below 2**40)."""
    x = m.astype(np.float64)
    return int(np.sqrt((x * x).sum(axis=1).max()) * (1 + 1e-9)) + 1


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of whole numbers, exact; beyond 64 bits they stay at the limit."""
    width = max(anchors.shape[1], rows.shape[1])
    if not width or not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    a, c = (np.pad(m.astype(np.int64), ((0, 0), (0, width - m.shape[1]))) for m in (anchors, rows))
    if _top_value(a) * _top_value(c) * width >= 1 << 60:
        return _in_wide_integers(a, c)
    bias_a, bias_c = -min(0, int(a.min())), -min(0, int(c.min()))
    bits = (_norm(a + bias_a) * _norm(c + bias_c)).bit_length() + 1
    if 2 * bits > EXACT_BITS:
        return _in_wide_integers(a, c)
    sums = _in_doubles(a + bias_a, c + bias_c, bits, EXACT_BITS // bits)
    # sum (a + p)(c + q) = sum a c + q sum a + p sum c + p q width
    return sums - bias_c * a.sum(axis=1)[:, None] - bias_a * c.sum(axis=1)[None, :] - bias_a * bias_c * width


def _in_doubles(a: np.ndarray, c: np.ndarray, bits: int, fields: int) -> np.ndarray:
    """Sums of non-negative products; field ``k`` of wide integer ``j`` is row ``j + k * columns``."""
    columns = -(-len(c) // fields)
    packed = np.zeros((columns, c.shape[1]))
    for k in range(fields):
        part = c[k * columns:(k + 1) * columns]
        packed[:len(part)] += part * float(1 << (k * bits))
    wide = (a.astype(np.float64) @ packed.T).astype(np.int64)
    mask = (1 << bits) - 1
    return np.concatenate([(wide >> (k * bits)) & mask for k in range(fields)], axis=1)[:, :len(c)]


def _in_wide_integers(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products by Python's integers, ``WIDE_FIELDS`` rows of ``c`` in each."""
    bias_a, bias_c = -min(0, int(a.min())), -min(0, int(c.min()))
    top_a, top_c = int(a.max()) + bias_a, int(c.max()) + bias_c
    size = -(-(max(top_a * top_c, 1) * a.shape[1]).bit_length() // 8)
    out = np.empty((len(a), len(c)), np.int64)
    sum_c = c.astype(object).sum(axis=1)
    for lo in range(0, len(c), WIDE_FIELDS):
        part = c[lo:lo + WIDE_FIELDS]
        packed = [int.from_bytes(b"".join((v + bias_c).to_bytes(size, "little") for v in column), "little")
                  for column in part.T.tolist()]
        for i, anchor in enumerate(a.tolist()):
            wide = sum((x + bias_a) * p for x, p in zip(anchor, packed)).to_bytes(size * len(part), "little")
            less = bias_c * sum(anchor) + bias_a * bias_c * len(anchor)
            out[i, lo:lo + len(part)] = [
                min(max(int.from_bytes(wide[k * size:(k + 1) * size], "little") - less - bias_a * sum_c[lo + k], LONG[0]), LONG[1])
                for k in range(len(part))]
    return out


# ---- packed blocks -----------------------------------------------------------------------------------------

def _arrow(spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))


_BLOCK = "rows binary, ids binary, labels binary, width int, kind string, vectors binary"


def _block(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list) -> dict:
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, :len(v)] = v
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not m.size or np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max)
    return {"rows": rows.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(),
            "width": width, "kind": kind, "vectors": m.astype(kind).tobytes()}


class _Rows:
    """An unpacked block."""

    def __init__(self, row: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(row[k], "<i8") for k in ("rows", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.rows), row["width"])


def _packed(batches, size: int, schema: pa.Schema, more: tuple[str, ...] = (), **fixed):
    """Blocks of ``size`` rows, in the order that the rows come."""
    names = ("row", "vec_id", "label", "q", *more)
    held: dict[str, list] = {k: [] for k in names}

    def block():
        out = _block(*(np.array(held[k], np.int64) for k in names[:3]), held["q"])
        if more:
            for k in more:
                flat = np.full((len(held["q"]), POSITIVES), LONG[0], np.int64)
                for i, v in enumerate(held[k]):
                    flat[i, :len(v)] = v
                out[k] = flat.tobytes()
        return out

    for batch in batches:
        columns = {k: batch.column(k) for k in names}
        lists = columns["q"]
        values, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        q = [values[a:b] for a, b in zip(off[:-1], off[1:])]
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, lo + size - len(held["q"]))
            for k in names:
                held[k] += q[lo:hi] if k == "q" else columns[k].slice(lo, hi - lo).to_pylist()
            lo = hi
            if len(held["q"]) == size:
                yield pa.RecordBatch.from_pylist([block() | fixed], schema=schema)
                held = {k: [] for k in names}
    if held["q"]:
        yield pa.RecordBatch.from_pylist([block() | fixed], schema=schema)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, q): rows that take part, components scaled and floored."""
    x = F.col("v")
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
                & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))) \
        .select("vec_id", "label", F.transform(x, lambda c: F.floor(c * 256)).alias("q"))


# ---- best scores ---------------------------------------------------------------------------------------------

_POSITIVE = "anchor_row bigint, slot int, positive_id bigint, positive_row bigint, positive_score bigint"
_NEGATIVE = "anchor_row bigint, slot int, negative_id bigint, negative_row bigint, negative_score bigint"


class _Best:
    """For each anchor of a block the best ``k`` candidates so far: score, id, row; free places have row -1."""

    def __init__(self, anchors: int, k: int):
        self.score, self.id, self.row = (np.full((anchors, k), v, np.int64) for v in (LONG[0], LONG[1], -1))

    def offer(self, scores: np.ndarray, allowed: np.ndarray, found: _Rows) -> None:
        k = self.score.shape[1]
        allowed &= scores >= self.score[:, -1:]           # no better than the last kept: out at once
        if allowed.sum() > 8 * k * len(scores):
            low = np.where(allowed, scores, LONG[0])
            allowed &= low >= np.partition(low, -k, axis=1)[:, -k][:, None]     # the k best and all that tie with the last
        anchor, place = np.nonzero(allowed)
        if not len(anchor):
            return
        own = np.repeat(np.arange(len(scores)), k)
        anchor = np.concatenate([own, anchor])
        score, i, row = (np.concatenate(x) for x in ((self.score.ravel(), scores[allowed]), (self.id.ravel(), found.ids[place]),
                                                     (self.row.ravel(), found.rows[place])))
        order = np.lexsort((row, i, row < 0, ~score, anchor))      # ~score falls as score rises, without overflow
        first = np.searchsorted(anchor[order], np.arange(len(scores)))
        kept = order[first[:, None] + np.arange(k)]
        self.score, self.id, self.row = score[kept], i[kept], row[kept]

    def rows(self, anchors: _Rows, slot: int) -> list[np.ndarray]:
        at, place = np.nonzero(self.row >= 0)
        return [anchors.rows[at], np.full(len(at), slot), self.id[at, place], self.row[at, place], self.score[at, place]]


class _Anchors(_Rows):
    """An anchor block of the round, with what a task has found for it so far. ``low`` and ``high``: for each
    anchor and positive the least and largest score of its negatives."""

    def __init__(self, row: dict, lists: int, k: int):
        super().__init__(row)
        self.best = [_Best(len(self.rows), k) for _ in range(lists)]
        if "scores" in row:
            p = np.frombuffer(row["scores"], "<i8").reshape(-1, POSITIVES).astype(object)
            # 30 p <= 100 s <= 90 p in whole numbers; no score lies within the bounds of a free place
            self.low = np.where(p == LONG[0], 1, -(-3 * p // 10)).astype(np.int64)
            self.high = np.where(p == LONG[0], 0, 9 * p // 10).astype(np.int64)


def _scan(batches, schema: pa.Schema, lists: int, k: int, offer):
    """Every joined pair of a candidate and an anchor block; at the end what is best of all."""
    anchors: dict[bytes, _Anchors] = {}
    last, found = None, None
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if row["rows"] != last:
                last, found = row["rows"], _Rows(row)
            key = row["a_rows"]
            if key not in anchors:
                anchors[key] = _Anchors({c[2:]: v for c, v in row.items() if c.startswith("a_")}, lists, k)
            offer(anchors[key], found, products(anchors[key].vectors, found.vectors))
    for a in anchors.values():
        for slot, b in enumerate(a.best):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(b.rows(a, slot), schema)], schema=schema)


def _offer_positives(a: _Anchors, found: _Rows, scores: np.ndarray) -> None:
    a.best[0].offer(scores, (a.labels[:, None] == found.labels) & (a.rows[:, None] != found.rows), found)


def _offer_negatives(a: _Anchors, found: _Rows, scores: np.ndarray) -> None:
    other = a.labels[:, None] != found.labels
    for i, best in enumerate(a.best):
        best.offer(scores, other & (scores >= a.low[:, i:i + 1]) & (scores <= a.high[:, i:i + 1]), found)


def _against(blocks: DataFrame, anchors: DataFrame, rounds: int, spec: str, lists: int, k: int, offer) -> DataFrame:
    """The best of every pair of a block and an anchor block, round by round. A round's anchors
    have a proven size, hence the broadcast."""
    schema = _arrow(spec)
    named = anchors.select("round", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "round"])
    out = blocks.sparkSession.createDataFrame([], spec)
    for r in range(rounds):
        joined = blocks.withColumn("round", F.lit(r)).join(F.broadcast(named.filter(F.col("round") == r)), "round").drop("round")
        out = out.unionByName(joined.mapInArrow(lambda b: _scan(b, schema, lists, k, offer), spec))
    return out


def _first(df: DataFrame, by: list[str], score: str, tie: list[str], n: int, out: str) -> DataFrame:
    order = [F.col(score).desc(), *[F.col(c) for c in tie]]
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)


def _dealt(anchors: DataFrame, rounds: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Anchors packed into blocks, each of one round."""
    spec = f"round int, {_BLOCK}" + "".join(f", {k} binary" for k in more)
    schema = _arrow(spec)

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in pa.compute.unique(batch.column("round")).to_pylist():
                held.setdefault(r, []).append(batch.filter(pa.compute.equal(batch.column("round"), r)))
        for r, own in held.items():
            yield from _packed(own, ANCHOR_ROWS, schema, more, round=r)

    return scratch_table(anchors.withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds)).cast("int"))
                         .repartition(rounds, "round").mapInArrow(pack, spec), "anchors")


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         anchor_step: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows
    whose id is divisible by ``anchor_step``."""
    rows = scratch_table(quantised(vectors, id_col, vector_col, label_col)
                         .withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = _arrow(_BLOCK)
    blocks = scratch_table(rows.mapInArrow(lambda b: _packed(b, BLOCK_ROWS, schema), _BLOCK), "vector-blocks")
    anchors = rows.filter(F.pmod("vec_id", F.lit(anchor_step)) == 0)
    count, width = anchors.agg(F.count("row"), F.max(F.size("q"))).first()
    rounds = max(1, -(-count // max(ANCHOR_ROWS, min(ROUND_ANCHORS, ROUND_BYTES // (8 * max(width or 1, 1))))))

    near = _against(blocks, _dealt(anchors, rounds), rounds, _POSITIVE, 1, POSITIVES, _offer_positives).drop("slot")
    near = scratch_table(_first(near, ["anchor_row"], "positive_score", ["positive_id", "positive_row"], POSITIVES, "slot")
                         .withColumn("slot", (F.col("slot") - 1).cast("int")), "positives")
    lists = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    scored = anchors.join(lists.select(F.col("anchor_row").alias("row"), F.col("p.positive_score").alias("scores")), "row")
    hard = _first(_against(blocks, _dealt(scored, rounds, ("scores",)), rounds, _NEGATIVE, POSITIVES, NEGATIVES, _offer_negatives),
                  ["anchor_row", "slot"], "negative_score", ["negative_id", "negative_row"], NEGATIVES, "rank")
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return hard.join(near, ["anchor_row", "slot"]).join(named, "anchor_row") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """The query's labels: where the id is divisible by 7, (label + 1) % 10."""
    return vectors.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
