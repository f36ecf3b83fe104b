"""Repeated byte strings by distributed prefix doubling on sampled suffixes.

A position's rank names the bytes that follow it. Ranks of all positions would
be rows for every byte of the corpus, so the doubling starts sparse: of every
``LENGTH`` bytes one suffix is sampled (the least hash of its first
``LENGTH / 2`` bytes, the rightmost of equals; equal strings sample the same
place), Spark ranks the samples, and a sample of unique rank settles all strings
that chose it. The strings of a repeated sample form a run of positions; runs
whose bytes are equal as a whole are settled together, by rank of the run. Only
what then differs goes on position by position: the pair (rank at the position,
rank at the position + ``LENGTH / 2``) is grouped, and a pair that occurs
again names a repeated string of ``LENGTH`` bytes.

Ranks are 64-bit hashes, pairs 128-bit; no rank table of all positions exists.
Each byte inside a repeated string goes, first occurrences, too.

Defined cases: null and empty texts have no bytes, short ones no strings; long
texts take memory in proportion to one text; repeated rows repeat each other;
empty tables give empty results; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import byte_table, gram_hashes, release, scratch_scope, scratch_table, text_blocks
from cairn.llm.substring_dedup import chosen, repeated_anchors, with_row_id

LENGTH = 200
HALF = LENGTH // 2


def long_texts(batch: pa.RecordBatch):
    """(row, bytes) of the texts of ``LENGTH`` bytes or more."""
    row = 0
    for _, data, off in text_blocks(batch):
        for k in np.flatnonzero(np.diff(off) >= LENGTH):
            yield row + int(k), data[off[k]:off[k + 1]]
        row += len(off) - 1


def ranks(data: np.ndarray, size: int, which: int) -> np.ndarray:
    """Name of the ``size`` bytes at every position that has as many."""
    at = np.arange(len(data) - size + 1)
    return gram_hashes(byte_table(which)[data], at, at + size, which)


def sampled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all positions, and of each sampled one: position, first and
    last start of the strings that chose it."""
    h = ranks(data, HALF, 0)
    at = chosen(h, LENGTH - HALF + 1)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h, at[edge], edge, np.concatenate([edge[1:], [len(at)]]) - 1


def _columns(rid, rows, **parts) -> pa.RecordBatch:
    take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    out = {"rid": rid.take(take)}
    for name, (kind, values) in parts.items():
        out[name] = pa.array(np.concatenate(values).astype(kind, copy=False) if values else np.zeros(0, kind))
    return pa.RecordBatch.from_pydict(out)


def runs(texts: DataFrame) -> DataFrame:
    """(rid, h, back, first, last, body): for every sampled suffix, by its rank,
    the strings that chose it, their distance before it, and the rank of all
    their bytes."""
    def run(batches):
        for batch in batches:
            rows, out = [], {c: [] for c in ("h", "back", "first", "last", "body")}
            for k, data in long_texts(batch):
                h, at, first, last = sampled(data)
                body = gram_hashes(byte_table(1)[data], first, last + LENGTH, 1)
                rows.append(np.full(len(at), k))
                for name, v in (("h", h[at].view(np.int64)), ("back", at - first), ("first", first), ("last", last),
                                ("body", body.view(np.int64))):
                    out[name].append(v)
            yield _columns(batch.column("rid"), rows, **{
                n: (np.int64 if n in ("h", "body") else np.int32, v) for n, v in out.items()})

    return texts.mapInArrow(run, "rid bigint, h bigint, back int, first int, last int, body bigint")


def pairs(expanded: DataFrame) -> DataFrame:
    """(rid, r1, r2, start, settled): rank pairs of every start in the runs."""
    def run(batches):
        for batch in batches:
            rows, one, two, starts, flags = [], [], [], [], []
            todo = batch.column("runs")
            for k, data in long_texts(batch):
                h = ranks(data, HALF, 0)
                for r in todo[k].as_py():
                    s = np.arange(r["first"], r["last"] + 1)
                    rows.append(np.full(len(s), k))
                    one.append(h[s].view(np.int64))
                    two.append(h[s + HALF].view(np.int64))
                    starts.append(s)
                    flags.append(np.full(len(s), r["settled"]))
            yield _columns(batch.column("rid"), rows, r1=(np.int64, one), r2=(np.int64, two), start=(np.int32, starts),
                           settled=(np.bool_, flags))

    return expanded.mapInArrow(run, "rid bigint, r1 bigint, r2 bigint, start int, settled boolean")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(rid, gone): runs (first, last) of starts of repeated strings."""
    found = repeated_anchors(scratch_table(runs(texts.select("rid", "text")), "all-runs"))
    shape = ["h", "back", F.expr("last - first").alias("more"), "body"]
    key = ["h", "back", "more", "body"]
    shaped = found.select("rid", "first", "last", *shape)
    classes = scratch_table(shaped.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "first", "last")).alias("one")), "classes")
    whole = scratch_table(shaped.join(classes.filter("n > 1").select(*key), key, "left_semi").select("rid", "first", "last"), "whole")
    release(found)
    # Samples whose runs differ go on, one run of each class.
    mixed = scratch_table(classes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "mixed")
    open_ = classes.join(mixed, "h", "left_semi").select("one.*", (F.col("n") > 1).alias("settled")) \
        .groupBy("rid").agg(F.collect_list(F.struct("first", "last", "settled")).alias("runs"))
    open_ = scratch_table(open_, "open")
    release(classes, mixed)
    ranked = scratch_table(pairs(texts.dropDuplicates(["rid"]).join(open_, "rid").select("rid", "text", "runs")), "pairs")
    twice = scratch_table(ranked.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min("settled").alias("all"))
                          .filter("n > 1 AND NOT all").select("r1", "r2"), "twice")
    single = ranked.filter("NOT settled").join(twice, ["r1", "r2"], "left_semi") \
        .select("rid", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.union(single).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the byte spans that go (maximal, end
    exclusive) and the bytes that stay."""
    texts = with_row_id(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            n, spans, kept = [], [], []
            gone = batch.column("gone")
            row = 0
            for _, block, off in text_blocks(batch):
                for a, b in zip(off[:-1], off[1:]):
                    data, found = block[a:b], []
                    if gone[row].is_valid:
                        v = gone[row].values
                        step = np.zeros(len(data) + 1, np.int64)
                        np.add.at(step, v.field("first").to_numpy(zero_copy_only=False), 1)
                        np.add.at(step, v.field("last").to_numpy(zero_copy_only=False) + LENGTH, -1)
                        mask = np.cumsum(step[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                        found = [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()]
                        data = data[~mask]
                    n.append(int(b - a))
                    spans.append(found)
                    kept.append(data.tobytes())
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    with scratch_scope():
        gone = scratch_table(repeated_runs(texts), "gone", keep=True)
    return texts.join(gone, "rid", "left").select("doc_id", "text", "gone").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                         F.sha2(F.col("kept"), 256).alias("kept_sha256"))
