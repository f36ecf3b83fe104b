"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Method: interval coalescing. The tokens of A and of B over one text are half-open
byte intervals. All of them are lexsorted by start; ``maximum.accumulate`` over the
ends gives the furthest byte covered so far, and a group breaks where a start
reaches that running maximum. Within a group every token but the first meets exactly
one token of the other side that is still open, so the overlaps expand to
``n_a + n_b - n_groups`` links. A slice of many texts is aligned at once: texts
are laid end to end, and a text's end is a break like any other.

Corpus statistics. Texts are aligned in blocks of bounded size, one row each. A block
keeps its distinct id pairs once (its dictionary) and, for every text, how often it
has each of them. Only dictionaries are shuffled to count pairs over the corpus, so a
pair that all texts hold is one row a block; the totals go back to the blocks by a
join on the pair, which AQE splits where one pair is in very many blocks.

Cost. Encoding is most of the work and is done once; texts in scripts whose character classes are settled are
encoded by a faster library with A's merges as ranks, which gives the same ids.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the
text (a normaliser changed them), have no tokens, all counts 0 and an empty
digest; a text of any length is aligned whole (its block is then larger); repeated rows
are aligned alike and each counts; null ids stay; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import keyed_text, scratch_table, text_blocks

BLOCK_SLICES = 8          # slices of about a megabyte of text in a block
BLOCK_TEXTS = 32_768      # texts in a block at most, short as they may be


# ---- alignment of token intervals ------------------------------------------------------------------

@dataclass
class Alignment:
    """``order``: tokens (A first, then B, by number) sorted by start; ``group``: group
    number of each sorted token; ``a``, ``b``: token numbers of every link, by position."""
    order: np.ndarray
    group: np.ndarray
    a: np.ndarray
    b: np.ndarray


def coalesce(end_a: np.ndarray, end_b: np.ndarray) -> Alignment:
    """Align two tilings of the same bytes, given by their tokens' end offsets."""
    n_a, n_b = len(end_a), len(end_b)
    end = np.concatenate([end_a, end_b])
    start = np.zeros(n_a + n_b, np.int64)
    start[1:n_a] = end_a[:-1]
    start[n_a + 1:] = end_b[:-1]
    side = np.zeros(n_a + n_b, np.int8)
    side[n_a:] = 1
    order = np.lexsort((side, start))
    s, e = start[order], end[order]
    reach = np.maximum.accumulate(e)
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] >= reach[:-1]
    group = np.cumsum(fresh) - 1
    # overlaps within a group: each later token meets the open token of the other side
    is_b = side[order].astype(np.int64)
    seen_b = np.cumsum(is_b) - 1
    seen_a = np.cumsum(1 - is_b) - 1
    link = ~fresh
    return Alignment(order, group, seen_a[link], seen_b[link])


# ---- tokenizers -----------------------------------------------------------------------------------

# Scripts whose character classes no Unicode version has changed: A's pieces are then the same for any library.
_SETTLED = re.compile("[\t\n\r -~\u00a0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")

# Fixed value: the pattern of byte-level pre-tokenization.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(0x100 + n)] = b
    return table


def _numbers(count: int, after: bytes) -> list[bytes]:
    return [b"%d" % i + after for i in range(count)]


class _Loaded:
    """Both tokenizers in a worker, and the ids of the chunks met so far."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(file_a)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_level_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if alphabet.keys() >= set(token) else token.encode()
        self.ranked = self._by_ranks(json.loads(file_a))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # decimal ids with what may follow them in a digest, A's then B's
        self.printed = [x for side in (self.bytes_a, self.bytes_b) for c in (b",", b"|", b";") for x in _numbers(len(side), c)]

    def _by_ranks(self, spec: dict):
        """The same encoding by a faster library, if A is plain byte-level BPE whose ids count its merges."""
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        special = {t["id"] for t in spec["added_tokens"]}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
                 and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged))))
        if not plain:
            return None
        ranks = {t: i for i, t in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("a", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and of B; both empty if they do not spell a space and the text."""
        if self.ranked is not None and _SETTLED.fullmatch(text):
            a = self.ranked.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = b" " + text.encode()
        spelt = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if spelt else ([], [])


class Tokenizers:
    """The two vocabularies, loaded once in each Python worker. The files' bytes are
    broadcast (their size is fixed by the files, not by the data)."""

    _workers: dict[str, _Loaded] = {}

    def __init__(self, spark: SparkSession, path_a: str, path_b: str):
        import sentencepiece

        files = []
        for path in (path_a, path_b):
            with open(path, "rb") as f:
                files.append(f.read())
        self.key = hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in files)).hexdigest()
        self.size_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
        self._files = spark.sparkContext.broadcast(files)

    def __getstate__(self):
        return {"key": self.key, "size_b": self.size_b, "_files": self._files}

    def loaded(self) -> _Loaded:
        if self.key not in self._workers:
            self._workers.clear()
            self._workers[self.key] = _Loaded(*self._files.value)
        return self._workers[self.key]


# ---- slices and blocks of texts -------------------------------------------------------------------

CODE_BITS = 40


class _Slice:
    """Tokens of a few texts, aligned in one pass: counts and digest of every text, and
    its distinct id pairs (``codes[offsets[i]:offsets[i + 1]]``) with their numbers of links."""

    def __init__(self, texts: list[str | None], t: _Loaded):
        ids = [t.encode(x) if x else ([], []) for x in texts]
        self.n_a = np.array([len(a) for a, _ in ids], np.int64)
        self.n_b = np.array([len(b) for _, b in ids], np.int64)
        a = np.fromiter(chain.from_iterable(a for a, _ in ids), np.int64, int(self.n_a.sum()))
        b = np.fromiter(chain.from_iterable(b for _, b in ids), np.int64, int(self.n_b.sum()))
        del ids
        al = coalesce(np.cumsum(t.len_a[a]), np.cumsum(t.len_b[b]))
        rows = np.arange(len(texts) + 1)
        in_a = np.repeat(rows[:-1], self.n_a)
        text = np.concatenate([in_a, np.repeat(rows[:-1], self.n_b)])[al.order]
        first = np.searchsorted(text, rows)
        groups = np.append(al.group, al.group[-1] + 1 if len(al.group) else 0)[first]
        self.n_groups = np.diff(groups)
        self.digests = self._digests(a, b, al, first, t)
        code = in_a[al.a] << CODE_BITS | a[al.a] * len(t.bytes_b) + b[al.b]
        self.n_links = np.bincount(in_a[al.a], minlength=len(texts))
        code, self.times = np.unique(code, return_counts=True)
        self.offsets = np.searchsorted(code >> CODE_BITS, rows)
        self.codes = code & ((1 << CODE_BITS) - 1)

    @staticmethod
    def _digests(a: np.ndarray, b: np.ndarray, al: Alignment, first: np.ndarray, t: _Loaded) -> list[str]:
        """Digest of every text's groups, written ``a1,a2|b1;a3|b2,b3``."""
        side = al.order >= len(a)
        place = np.lexsort((side, al.group))             # within a group A before B, each in order
        token, side, group = al.order[place], side[place], al.group[place]
        ends_group, ends_side = np.ones(len(token), bool), np.ones(len(token), bool)
        ends_group[:-1] = group[1:] != group[:-1]
        ends_side[:-1] = side[1:] != side[:-1]
        after = np.where(ends_group, 2, ends_side)       # which of , | ; follows
        printed = np.where(side, 3 * len(t.bytes_a) + after * len(t.bytes_b), after * len(t.bytes_a)) \
            + np.concatenate([a, b])[token]
        get = t.printed.__getitem__
        return [hashlib.sha256(b"".join(map(get, printed[lo:hi].tolist()))[:-1]).hexdigest() if hi > lo else ""
                for lo, hi in zip(first[:-1], first[1:])]


class _Block:
    """Slices of a task until there are enough for a row."""

    def __init__(self):
        self.ids: list = []
        self.slices: list[_Slice] = []

    def full(self, texts: int) -> bool:
        return len(self.slices) >= BLOCK_SLICES or len(self.ids) >= texts

    def row(self, number: int) -> dict:
        """The block's columns. ``pairs`` holds, compressed, the number of distinct pairs of
        each text, their places in the dictionary (differences within a text) and their links."""
        join = lambda name: np.concatenate([getattr(s, name) for s in self.slices])
        codes, place = np.unique(join("codes"), return_inverse=True)
        times = join("times")
        size = np.concatenate([np.diff(s.offsets) for s in self.slices])
        step = np.diff(place, prepend=0)
        begin = (np.cumsum(size) - size)[size > 0]
        step[begin] = place[begin]
        pairs = zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<u4").tobytes() for x in (size, step, times)))
        return {"block": number, "doc_ids": self.ids, "groups_sha256": list(chain.from_iterable(s.digests for s in self.slices)),
                **{k: join(k).tolist() for k in ("n_a", "n_b", "n_groups", "n_links")},
                "codes": codes.tolist(), "times": np.bincount(place, times, len(codes)).astype(np.int64).tolist(), "pairs": pairs}


def _unpacked(pairs: bytes, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the dictionary, links) of every entry that ``_Block.row`` packed."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(pairs), "<u4").astype(np.int64)
    size, step, times = flat[:texts], *np.split(flat[texts:], 2)
    text = np.repeat(np.arange(texts), size)
    total = np.cumsum(step)
    begin = (np.cumsum(size) - size)[size > 0]
    return text, total - np.repeat((total[begin] - step[begin]), size[size > 0]), times


_BLOCK_LISTS = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>"


def _aligned(batches, tokenizers: Tokenizers, texts: int, schema: pa.Schema):
    base, number, block = TaskContext.get().partitionId() << 32, 0, _Block()
    t = tokenizers.loaded()
    for batch in batches:
        for rows, _, _ in text_blocks(batch):
            part = batch.slice(rows.start, rows.stop - rows.start)
            block.ids += part.column("doc_id").to_pylist()
            block.slices.append(_Slice(part.column("text").to_pylist(), t))
            if block.full(texts):
                yield pa.RecordBatch.from_pylist([block.row(base + number)], schema=schema)
                number, block = number + 1, _Block()
    if block.ids:
        yield pa.RecordBatch.from_pylist([block.row(base + number)], schema=schema)


def _resolved(batches, schema: pa.Schema):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            n = len(row["doc_ids"])
            text, place, times = _unpacked(row["pairs"].as_py(), n)
            table = row["pair_counts"].values if row["pair_counts"].is_valid else None
            if table is None:
                best = total = np.zeros(n, np.int64)
            else:
                counts = table.field("total").to_numpy()[place] * times
                best = np.bincount(text, table.field("best").to_numpy(zero_copy_only=False)[place] * times, n)
                total = np.add.reduceat(np.append(counts, 0), np.searchsorted(text, np.arange(n))) if len(text) else np.zeros(n, np.int64)
                total[np.bincount(text, minlength=n) == 0] = 0
            yield pa.RecordBatch.from_arrays([
                row["doc_ids"].values, row["n_a"].values, row["n_b"].values, row["n_groups"].values, row["n_links"].values,
                pa.array(best.astype(np.int64)), pa.array(total.astype(np.int64)), row["groups_sha256"].values], schema=schema)


# ---- DataFrames ---------------------------------------------------------------------------------

def aligned_blocks(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                   block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """One row for each block of texts, written once to the scratch folder: the texts' counts and
    digests, the block's distinct pairs (``codes``) with their links (``times``), and the pairs of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    spec = (f"block bigint, doc_ids array<{kind}>, {_BLOCK_LISTS}, groups_sha256 array<string>, "
            "codes array<bigint>, times array<bigint>, pairs binary")
    schema = _arrow(docs.sparkSession, spec)
    return scratch_table(keyed_text(docs, id_col, text_col).mapInArrow(lambda b: _aligned(b, tokenizers, block_texts, schema), spec), "aligned")


def _arrow(spark: SparkSession, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))


def pair_totals(blocks: DataFrame, size_b: int) -> DataFrame:
    """(code, total, best): the links of each pair over all texts, and whether no pair
    with the same B id has more."""
    totals = blocks.select(F.explode(F.arrays_zip("codes", "times")).alias("p")) \
        .groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("total"))
    # a B id has at most as many pairs as A has ids
    per_b = Window.partitionBy(F.pmod("code", F.lit(size_b)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(per_b))


def pair_table(blocks: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(a_id, b_id, links, best): how often tokens of the two ids overlap in the corpus."""
    size_b = tokenizers.size_b
    return pair_totals(blocks, size_b).select(
        F.floor(F.col("code") / size_b).alias("a_id"), F.pmod("code", F.lit(size_b)).alias("b_id"),
        F.col("total").alias("links"), "best")


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
          block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The columns of the query, one row for every text."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = aligned_blocks(docs, tokenizers, id_col, text_col, block_texts)
    totals = pair_totals(blocks, tokenizers.size_b)
    pairs = blocks.select("block", F.posexplode("codes").alias("place", "code"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.select("block").count() // 16)
    tables = pairs.join(totals, "code").select("block", F.struct("place", "total", "best").alias("p")) \
        .repartition(parts, "block").groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("pair_counts"))
    spec = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
            "count_sum bigint, groups_sha256 string")
    schema = _arrow(spark, spec)
    return blocks.drop("codes", "times").repartition(parts, "block").join(tables, "block", "left") \
        .mapInArrow(lambda b: _resolved(b, schema), spec)
