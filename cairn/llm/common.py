"""Shared pieces of the text operators: scratch tables, Arrow text blocks and
vectorised hashing of words and byte strings."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import ensure_checkpoint_dir

# ASCII white space of the word definition: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BLOCK_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


# Spark deletes the shuffle files of a write as soon as the write is done.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Scratch tables of the open scopes, the innermost last: (frame, path) each.
_scopes: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())


def scratch_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage ends there and lost executors re-read files. What the
    write shuffled is deleted with its end. The table goes with the innermost
    ``scratch_scope``; with ``keep`` with the one around that, if any."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append((table, path))
    return table


def _delete(table: DataFrame, path: str) -> None:
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Delete scratch tables of the innermost scope before it ends; to be called
    when everything that reads them has been written. Other frames stay."""
    for scope in _scopes.get()[-1:]:
        for entry in [e for e in scope if any(e[0] is t for t in tables)]:
            scope.remove(entry)
            _delete(*entry)


@contextmanager
def scratch_scope():
    """Scratch tables written inside the block are deleted when it ends. What
    leaves the block must have been written with ``keep``."""
    scope: list = []
    token = _scopes.set((*_scopes.get(), scope))
    try:
        yield
    finally:
        _scopes.reset(token)
        for entry in scope:
            _delete(*entry)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs``, written once as a scratch table with a number for every row,
    and the name of that new column. Numbers do not change once written."""
    column, taken = "row", {c.lower() for c in docs.columns}
    while column in taken:
        column += "_"
    return scratch_table(docs.withColumn(column, F.monotonically_increasing_id()), name), column


# Text bytes that go to a Python task at once. JVM and Python hold a batch, its result and what is made of it.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the memory of a Python task not grow with its partition: by default ten
    thousand texts, often the whole partition, are one batch. Smaller bounds of
    the session stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if BATCH_BYTES < int(str(spark.conf.get(name)).rstrip("bB")):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns never clash.
    They go to Python tasks in batches of bounded size."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def text_blocks(batch: pa.RecordBatch, column: str = "text"):
    """Slices of a record batch of about ``BLOCK_BYTES`` text bytes each (a
    longer text is a slice of its own): (row slice, bytes, offsets).

    Null texts have length 0."""
    arr = batch.column(column)
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if n and arr.buffers()[2] is not None and arr.buffers()[2].size \
        else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + BLOCK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield slice(lo, hi), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray):
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` of the texts,
    and for each text the index of its first word (length texts + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


@lru_cache(maxsize=4)
def byte_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# Odd multipliers of the polynomial hashes; inverses modulo 2**64.
MULT = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INV = tuple(pow(m, -1, 2**64) for m in MULT)


class Poly:
    """Powers of a multiplier, grown on demand, for hashes of substrings:
    with prefix sums S of ``v[i] * m**i``, the hash of ``v[a:b]`` is
    ``(S[b] - S[a]) * m**-a`` modulo 2**64."""

    def __init__(self, which: int):
        self.m, self.inv = np.uint64(MULT[which]), np.uint64(_INV[which])
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        for name, m in (("up", self.m), ("down", self.inv)):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            setattr(self, name, np.multiply.accumulate(x))

    def sums(self, v: np.ndarray) -> np.ndarray:
        self._grow(len(v) + 1)
        s = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * self.up[:len(v)], out=s[1:])
        return s

    def of(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (s[b] - s[a]) * self.down[a]


@lru_cache(maxsize=2)
def poly(which: int) -> Poly:
    return Poly(which)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word; two independent families (which 0 or 1)."""
    p = poly(which)
    return mix(p.of(p.sums(byte_table(which)[data]), start, end) + (end - start).astype(np.uint64))


def gram_hashes(values: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[a:b]`` for each pair of bounds."""
    p = poly(which)
    return mix(p.of(p.sums(values), a, b))


def sliding_min_positions(h: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen by winnowing: for every ``w`` consecutive hashes the
    rightmost least one. Fewer than ``w`` hashes: the rightmost least of all."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    pos = np.arange(n)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    # Doubling: best[i] is the chosen position among h[i:i+span].
    best, span = pos, 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return np.unique(best)


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
