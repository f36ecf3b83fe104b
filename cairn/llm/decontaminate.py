"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items are put into one suffix automaton over words. A
training text's words are streamed through it, which keeps the longest suffix
read so far that occurs in some item; where that length reaches a window's, the
window occurs in the text and its words are hit. Whole items shorter than a
window are windows themselves.

Items are gathered in blocks of at most ``block_words`` words, so that every
automaton that is sent to the tasks has a bounded size; texts run through one
block after the other and the hits are joined.

Defined cases: null or wordless texts have no words and no hits; a null or
wordless item has no window; items with equal words are all reported; long
texts are streamed once per block; repeated rows and empty tables (of either
kind) need nothing special; other columns, also ones with the names of the
results, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, keyed_text

# Normalisation: A-Z lower-cased; words are runs of digits, letters and
# everything beyond ASCII.
_FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences (Blumer et al.), with the
    items whose window, or whole short text, a match shows."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.size)
        self.items: list[tuple] = [()] * n    # by state: items with a full window here
        self.short: list[tuple] = [()] * n    # by state: (length, item) of whole short items, own or by links
        owners: dict[int, set] = {}
        whole: dict[int, set] = {}
        for item, words in items:
            s = length = 0
            for w in words:
                s, length = self.follow(s, length, w)
                if len(words) >= window and length >= window:
                    owners.setdefault(self.window_state(s), set()).add(item)
            if 0 < len(words) < window:
                while self.size[self.link[s]] >= len(words):
                    s = self.link[s]
                whole.setdefault(s, set()).add((len(words), item))
        for s in sorted(range(1, n), key=self.size.__getitem__):
            self.short[s] = self.short[self.link[s]] + tuple(sorted(whole.get(s, ())))
            if s in owners:
                self.items[s] = tuple(sorted(owners[s]))
        # Matches of a full window stop at this state when links are followed.
        self.at_window = [self.window_state(s) if self.size[s] >= window else -1 for s in range(n)]

    def _extend(self, p: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[p].get(w)) is not None:
            if size[q] == size[p] + 1:
                return q
            return self._split(p, q, w)
        cur = len(size)
        nxt.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def follow(self, s: int, length: int, w: bytes) -> tuple[int, int]:
        """Longest suffix of the match so far plus ``w`` that occurs in an item."""
        while s >= 0 and w not in self.next[s]:
            s = self.link[s]
            length = self.size[s] if s >= 0 else 0
        return (self.next[s][w], length + 1) if s >= 0 else (0, 0)

    def window_state(self, s: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``s``."""
        while self.size[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged hit spans (word offsets, end exclusive), the items whose
        windows occur, and the longest match."""
        nxt, window, root = self.next, self.window, self.next[0]
        spans: list[list[int]] = []
        found: set = set()
        s = length = longest = 0
        for i, w in enumerate(words, 1):
            t = nxt[s].get(w)
            if t is not None:
                s = t
                length += 1
            elif s == 0 or w not in root:  # most words are in no item
                s = length = 0
                continue
            else:
                s, length = self.follow(s, length, w)
            if length > longest:
                longest = length
            hit = 0
            if length >= window:
                found.update(self.items[self.at_window[s]])
                hit = window
            for size, item in self.short[s]:
                if size <= length:
                    found.add(item)
                    hit = max(hit, size)
            if hit:
                if spans and i - hit <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], i - hit)
                    spans[-1][1] = i
                else:
                    spans.append([i - hit, i])
        return [(a, b) for a, b in spans], found, longest


def item_blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str):
    """Items with words, as (id, words), in blocks of about ``block_words``."""
    block, n = [], 0
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")) \
        .filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if words:
            block.append((row["item_id"], words))
            n += len(words)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Matcher:
    """Broadcast item blocks; each task builds their automata once."""

    blocks: list
    window: int

    def __post_init__(self):
        self._automata = None

    def __getstate__(self):
        return self.__dict__ | {"_automata": None}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        if self._automata is None:
            self._automata = [SuffixAutomaton(b.value, self.window) for b in self.blocks]
        results = [a.scan(words) for a in self._automata]
        return (merge_spans([x for spans, _, _ in results for x in spans]),
                set().union(*[f for _, f, _ in results]), max([0, *[n for _, _, n in results]]))


def matcher(benchmark: DataFrame, window: int = 10, block_words: int = 200_000,
            item_col: str = "item_id", text_col: str = "text") -> Matcher:
    sc = benchmark.sparkSession.sparkContext
    return Matcher([sc.broadcast(b) for b in item_blocks(benchmark, block_words, item_col, text_col)], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, item_ids, longest): hit word spans of each text,
    the items whose windows occur in it (as strings, sorted) and the longest match."""
    found = matcher(benchmark, window)
    schema = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("item_ids", pa.list_(pa.string())), ("longest", pa.int64())])

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                spans, items, longest = found.scan(words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans],
                             "item_ids": sorted(map(str, items)), "longest": longest})
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], names=["doc_id", *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(
        scan, f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>, longest bigint")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and all between their first and
    last byte; what stands around them stays."""
    data = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(data.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:start[a]])
        at = int(end[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the hit spans; a text of which more than ``max_coverage``
    of the words are hit goes altogether. All columns stay as they are."""
    bound_batches(docs.sparkSession)
    found = matcher(benchmark, window)
    names = docs.columns
    at = names.index(text_col)

    def clean(batches):
        for batch in batches:
            keep, texts = [], []
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                words = words_of(text)
                spans, _, _ = found.scan(words)
                if sum(b - a for a, b in spans) > max_coverage * len(words):
                    continue
                keep.append(i)
                texts.append(cut_words(text, spans) if spans else text)
            out = batch.take(pa.array(keep, pa.int64()))
            yield out.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = """
WITH norm AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM norm, sizes WHERE len(w) >= size),
grams AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM starts),
hits AS (SELECT doc_id, i, g.size, item_id FROM grams g JOIN windows v ON g.win = v.win AND g.size = v.size),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
  (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT n.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM norm n LEFT JOIN hit_words h ON n.doc_id = h.doc_id LEFT JOIN hit_items t ON n.doc_id = t.doc_id"""
