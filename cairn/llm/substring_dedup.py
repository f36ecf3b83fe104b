"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``SIZE`` consecutive words, the least hash
of its ``GRAM``-word windows (the rightmost of equals), so equal windows of
``SIZE`` words choose the same anchor at the same offset, and an anchor that
occurs once in the corpus rules out every window that chose it. The windows of
one anchor are a run: the anchor extended to both sides as far as it is chosen.
Documents are joined on the anchors that occur again. Runs of equal words are one
class, all but its first occurrence go as a whole; where an anchor has several
classes, their first occurrences are opened and compared window by window.
Windows found earlier are merged into maximal repeats, and their words go.

"Earlier" is a smaller id, or the same id and a smaller start; occurrences that
tie (rows of one id with the same start) are not earlier than each other. A null
id is the smallest. Hot anchors and passages are counted map-side and joined
with one row each, never with each other. Windows are compared by an anchor and
a window hash of 64 bits each, of two independent families.

Defined cases: null, empty and short texts have no windows; long texts are
hashed whole in memory in proportion to one text; repeated rows are rows of one
id; empty tables give empty results; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import gram_hashes, keyed_text, release, scratch_scope, scratch_table, text_blocks, word_hashes, word_spans

SIZE = 20
GRAM = 10


def chosen(h: np.ndarray, w: int) -> np.ndarray:
    """For every ``w`` consecutive hashes, the position of the rightmost least."""
    best, span = np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return best


def documents_words(batch: pa.RecordBatch):
    """(row, hashes of its words in both families) of texts with a window."""
    row = 0
    for rows, data, off in text_blocks(batch):
        start, end, first = word_spans(data, off)
        if len(start):
            one, two = (word_hashes(data, start, end, f) for f in (0, 1))
            for k in np.flatnonzero(np.diff(first) >= SIZE):
                a, b = first[k], first[k + 1]
                yield row + k, one[a:b], two[a:b]
        row += len(off) - 1


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram, and the anchor's position of every window."""
    at = np.arange(len(words) - GRAM + 1)
    h = gram_hashes(words, at, at + GRAM)
    return h, chosen(h, SIZE - GRAM + 1)


def _flat(batch, rows, **columns) -> pa.RecordBatch:
    take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    arrays = {"rid": batch.column("rid").take(take), "doc_id": batch.column("doc_id").take(take)}
    for name, parts in columns.items():
        kind = np.int64 if name in ("h", "w", "body") else np.int32
        arrays[name] = pa.array(np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind))
    return pa.RecordBatch.from_pydict(arrays)


def anchored_runs(texts: DataFrame) -> DataFrame:
    """(rid, doc_id, h, back, first, last, body): for every anchor the windows
    that chose it, their first one's distance before it and the hash of all
    their words."""
    def run(batches):
        for batch in batches:
            rows, out = [], {c: [] for c in ("h", "back", "first", "last", "body")}
            for k, one, two in documents_words(batch):
                h, at = anchors_of(one)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.concatenate([first[1:], [len(at)]]) - 1
                at = at[first]
                rows.append(np.full(len(at), k))
                body = gram_hashes(two, first, last + SIZE, 1)
                for name, v in (("h", h[at].view(np.int64)), ("back", at - first), ("first", first), ("last", last),
                                ("body", body.view(np.int64))):
                    out[name].append(v)
            yield _flat(batch, rows, **out)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"rid bigint, doc_id {kind}, h bigint, back int, first int, last int, body bigint")


def windows_of(opened: DataFrame) -> DataFrame:
    """(rid, doc_id, h, w, start): every window of the runs, by the hash of its
    anchor and of its words."""
    def run(batches):
        for batch in batches:
            rows, hs, ws, ss = [], [], [], []
            todo = batch.column("runs")
            for k, one, two in documents_words(batch):
                h, at = anchors_of(one)
                v = todo[int(k)].values
                first, last = (v.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
                n = last - first + 1
                start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows.append(np.full(len(start), k))
                hs.append(h[at[start]].view(np.int64))
                ws.append(gram_hashes(two, start, start + SIZE, 1).view(np.int64))
                ss.append(start)
            yield _flat(batch, rows, h=hs, w=ws, start=ss)

    kind = opened.schema["doc_id"].dataType.simpleString()
    return opened.mapInArrow(run, f"rid bigint, doc_id {kind}, h bigint, w bigint, start int")


def with_row_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of equal id and text share ``rid``."""
    return keyed_text(docs, id_col, text_col).withColumn("rid", F.xxhash64("doc_id", "text"))


def repeated_anchors(every: DataFrame) -> DataFrame:
    """The runs ``every``, a scratch table that goes, whose anchor ``h`` occurs again."""
    again = scratch_table(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    found = scratch_table(every.join(again, "h", "left_semi"), "runs")
    release(every, again)
    return found


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(rid, gone): runs (first, last) of starts of windows whose words start
    earlier, too."""
    found = repeated_anchors(scratch_table(anchored_runs(texts), "all-runs"))
    key, place = ["h", "back", "more", "body"], F.struct("doc_id", "first")
    shaped = found.withColumn("more", F.expr("last - first"))
    classes = scratch_table(shaped.groupBy(*key).agg(F.min(place).alias("lead"), F.count("*").alias("n")), "classes")
    mixed = scratch_table(classes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "mixed")
    whole = scratch_table(shaped.join(classes.filter("n > 1"), key).filter(place > F.col("lead")).select("rid", "first", "last"), "whole")
    leads = shaped.join(classes.join(mixed, "h", "left_semi"), key).filter(~(place > F.col("lead"))) \
        .groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    windows = scratch_table(windows_of(texts.join(scratch_table(leads, "leads"), "rid").select("rid", "doc_id", "text", "runs")), "windows")
    release(found, classes, mixed)
    place = F.struct("doc_id", "start")
    firsts = windows.groupBy("h", "w").agg(F.min(place).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(scratch_table(firsts, "firsts"), ["h", "w"]).filter(place > F.col("lead")) \
        .select("rid", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.union(later).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("gone"))


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Words inside the windows that start from ``first`` to ``last``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + SIZE, -1)
    return np.cumsum(step[:-1]) > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept_text): the maximal repeats that go, as
    word spans (end exclusive), and the words that stay, joined by one space."""
    texts = with_row_id(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            n, spans, kept = [], [], []
            for text, found in zip(batch.column("text"), batch.column("gone")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                runs = []
                if found.is_valid:
                    gone = covered(*(found.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last")), len(words))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    runs = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                spans.append(runs)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "spans", "kept_text"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    with scratch_scope():
        gone = scratch_table(repeated_runs(texts), "gone", keep=True)
    return texts.join(gone, "rid", "left").select("doc_id", "text", "gone").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
marked AS (SELECT e.doc_id, e.x, e.p, g.p IS NOT NULL AS gone FROM each e
  LEFT JOIN (SELECT doc_id, unnest(p) AS p FROM gone) g ON e.doc_id = g.doc_id AND e.p = g.p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id"""
