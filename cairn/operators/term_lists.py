"""Documents as lists of terms, one row a document, worked through where they are (survey M16, M17).

A document's terms go to numpy as 64-bit hashes; the vocabulary, which is read once anyway, says whether two
terms share one, and then another hash is taken. Documents are dealt only if an id comes twice; rows of document
and term are never dealt. What tasks send is one row for each of their terms, or a few numbers a term.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import freed_shuffles, release, stored

_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@dataclass
class TermLists:
    """``rows``: (key, codes array<int>, weights array<double>), one row a document; a code is the place of the
    term's hash in ``hashes``, which are sorted."""
    rows: DataFrame
    key: str
    hashes: np.ndarray


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def hash_of(term, salt: int = 0) -> Column:
    return F.xxhash64(term, F.lit(salt)) if salt else F.xxhash64(term)


def settled(vocabulary: DataFrame, term: str = "term") -> int:
    """A salt with which no two terms share a hash."""
    for salt in range(64):
        with freed_shuffles(vocabulary.sparkSession):
            alone = vocabulary.groupBy(hash_of(F.col(term), salt).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        if alone:
            return salt
    raise ValueError("no hash without collisions found")


def mixed(h: np.ndarray, x: int) -> np.ndarray:
    """``xxhash64`` of a row whose columns so far have the hashes ``h`` and whose next is the integer ``x``."""
    with np.errstate(over="ignore"):
        v = h.view(np.uint64) + _P5 + np.uint64(4)
        v ^= np.uint64(x & 0xFFFFFFFF) * _P1
        v = ((v << np.uint64(23)) | (v >> np.uint64(41))) * _P2 + _P3
        for shift, factor in ((33, _P2), (29, _P3)):
            v ^= v >> np.uint64(shift)
            v *= factor
        v ^= v >> np.uint64(32)
    return v.view(np.int64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends, from 0 on, of a list column without null lists."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], (off[1:] - off[0]).astype(np.int64)


def listed(values: np.ndarray, ends: np.ndarray, kind: pa.DataType, mask=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, mask=mask), type=kind)


def merged(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, terms): the lists of a key as one row. Documents are dealt, as they are, only if a key comes twice."""
    docs = docs.select(key, terms)
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.filter(F.col(terms).isNotNull())
    return docs.repartition(key).groupBy(key).agg(F.flatten(F.collect_list(terms)).alias(terms))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# ---- weights ---------------------------------------------------------------------------------------------

def tfidf_lists(docs: DataFrame, key: str, tokens: str, min_df: int, max_df: float, stop_words: Sequence[str]) -> TermLists:
    """``features.tfidf`` as lists. The idf of the kept terms, 16 bytes a term, goes to every task."""
    toks = F.filter(tokens, lambda x: ~x.isin(list(stop_words))) if stop_words else F.col(tokens)
    rows = merged(docs.select(key, toks.alias("terms")), key, "terms")
    n = docs.count()
    vocabulary = stored(rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    salt = settled(vocabulary)
    kept = vocabulary.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n)) \
        .select(hash_of(F.col("term"), salt).alias("h"), (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")).toArrow()
    release(vocabulary)
    hashes, idf = (kept.column(c).to_numpy() for c in ("h", "idf"))
    order = np.argsort(hashes)
    hashes, idf = hashes[order], idf[order]
    spec = f"`{key}` {_kind(docs, key)}, codes array<int>, weights array<double>"
    schema = schema_of(spec)
    known = docs.sparkSession.sparkContext.broadcast((hashes, idf))

    def weighted(batches):
        hashes, idf = known.value
        for batch in batches:
            h, ends = flat(batch.column("h"))
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            there = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            cell, tf = np.unique(doc[there] * len(hashes) + at[there], return_counts=True)
            doc, code = np.divmod(cell, max(1, len(hashes)))
            w = tf * idf[code]
            norm = np.sqrt(np.bincount(doc, w * w, minlength=len(ends)))
            size = np.bincount(doc, minlength=len(ends))
            some = size > 0
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(some)), listed(code.astype(np.int32), np.cumsum(size[some]), schema.field("codes").type),
                                              listed(w / norm[doc], np.cumsum(size[some]), schema.field("weights").type)], schema=schema)

    hashed = rows.filter(F.col(key).isNotNull()).select(key, F.transform("terms", lambda x: hash_of(x, salt)).alias("h"))
    return TermLists(hashed.mapInArrow(weighted, spec), key, hashes)


def term_lists(weights: DataFrame, key: str, term: str, weight: str) -> TermLists:
    """Rows of (key, term, weight) as lists; rows with a null are left out."""
    w = weights.select(key, F.col(term).alias("term"), F.col(weight).cast("double").alias("w")).dropna()
    vocabulary = stored(w.select("term").distinct(), "vocabulary")
    salt = settled(vocabulary)
    hashes = np.sort(vocabulary.select(hash_of(F.col("term"), salt).alias("h")).toArrow().column("h").to_numpy())
    release(vocabulary)
    spec = f"`{key}` {_kind(weights, key)}, codes array<int>, weights array<double>"
    schema = schema_of(spec)
    known = weights.sparkSession.sparkContext.broadcast(hashes)

    def coded(batches):
        for batch in batches:
            (h, ends), (w, _) = flat(batch.column("h")), flat(batch.column("w"))
            codes = np.searchsorted(known.value, h).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), listed(codes, ends, schema.field("codes").type), listed(w, ends, schema.field("weights").type)], schema=schema)

    lists = w.groupBy(key).agg(F.collect_list(F.struct(hash_of(F.col("term"), salt).alias("h"), "w")).alias("_l"))
    return TermLists(lists.select(key, F.col("_l.h").alias("h"), F.col("_l.w").alias("w")).mapInArrow(coded, spec), key, hashes)


# ---- random index vectors --------------------------------------------------------------------------------

def spots(h: np.ndarray, dim: int, seeds: int, seed: int):
    """The entries of the terms' index vectors, one at a time: places and signs."""
    for i in range(seeds):
        yield mixed(h, seed * 1000 + i) % dim, np.where(mixed(h, seed * 7777 + i) % 2 == 0, 1.0, -1.0)


def projected(lists: TermLists, dim: int, seeds: int, seed: int) -> DataFrame:
    """(key, vec): the documents' weights times the index vectors of their terms."""
    spec = f"`{lists.key}` {_kind(lists.rows, lists.key)}, vec array<double>"
    schema, key = schema_of(spec), lists.key
    known = lists.rows.sparkSession.sparkContext.broadcast(lists.hashes)

    def vectors(batches):
        for batch in batches:
            (codes, ends), (w, _) = flat(batch.column("codes")), flat(batch.column("weights"))
            doc, total = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.zeros(len(ends) * dim)
            for at, sign in spots(known.value[codes], dim, seeds, seed):
                total += np.bincount(doc * dim + at, w * sign, minlength=len(total))
            yield pa.RecordBatch.from_arrays([batch.column(key), listed(total, np.arange(1, len(ends) + 1) * dim, schema.field("vec").type)], schema=schema)

    return lists.rows.mapInArrow(vectors, spec)


TERM_ROWS = 150_000     # terms whose sums a task holds at once, about
_BITS = 62              # dimensions whose presence one number says


def _indexed(h: np.ndarray, ends: np.ndarray, dim: int, seeds: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every document the sum of its terms' index vectors and which dimensions any has; the place of every term's document."""
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    total, count = np.zeros(len(ends) * dim), np.zeros(len(ends) * dim, np.int64)
    for at, sign in spots(h, dim, seeds, seed):
        total += np.bincount(doc * dim + at, sign, minlength=len(total))
        count += np.bincount(doc * dim + at, minlength=len(total))
    return total.reshape(-1, dim), (count > 0).reshape(-1, dim), doc


def _distinct(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A list's hashes once each."""
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.cumsum(np.bincount(doc[first], minlength=len(ends)))


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sums, bits) parts as one with every hash once."""
    h, sums, bits = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(sums[order], starts, axis=0), np.bitwise_or.reduceat(bits[order], starts, axis=0)


def _of_terms(h: np.ndarray, ends: np.ndarray, dim: int, seeds: int, seed: int, sets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every term of a batch the sum of its documents' vectors, and the bits of the dimensions any has."""
    once, once_ends = _distinct(h, ends)
    total, there, _ = _indexed(once if sets else h, once_ends if sets else ends, dim, seeds, seed)
    words = -(-dim // _BITS)
    bits = np.zeros((len(ends), words), np.int64)
    for i in range(dim):
        bits[:, i // _BITS] |= there[:, i].astype(np.int64) << (i % _BITS)
    total = total.astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(once_ends, prepend=0))
    order = np.argsort(once, kind="stable")
    once, doc = once[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]]))
    out = []
    for lo in range(0, len(starts), 8192):
        a, b = starts[lo], starts[lo + 8192] if lo + 8192 < len(starts) else len(once)
        for x, put in ((total, np.add), (bits, np.bitwise_or)):
            out.append(put.reduceat(x[doc[a:b]], starts[lo:lo + 8192] - a, axis=0))
    return once[starts], np.concatenate(out[::2]), np.concatenate(out[1::2])


def random_index(doc_terms: DataFrame, dim: int, seeds: int, seed: int, key: str, term: str) -> tuple[DataFrame, DataFrame]:
    """(key, vec) and (term, vec) of ``models.random_index_vectors``; null where no term has an entry."""
    sets = "terms" in doc_terms.columns
    if sets:
        lists = merged(doc_terms, key, "terms")
        terms = lists.select(F.explode(F.array_distinct("terms")).alias("term"))
    else:
        lists, terms = doc_terms.select(key, F.col(term).alias("terms")), doc_terms.select(F.col(term).alias("term"))
    vocabulary = stored(terms.distinct(), "vocabulary")
    salt = settled(vocabulary)
    if sets:
        hashed = lists.select(key, F.transform("terms", lambda x: hash_of(x, salt)).alias("h"))
    else:
        hashed = lists.select(key, hash_of(F.col("terms"), salt).alias("h")).groupBy(key).agg(F.collect_list("h").alias("h"))
    doc_spec = f"`{key}` {_kind(doc_terms, key)}, vec array<double>"
    words = -(-dim // _BITS)
    term_spec = ", ".join(["h bigint", *[f"c{i} bigint" for i in range(dim)], *[f"b{i} bigint" for i in range(words)]])
    doc_schema, term_schema = schema_of(doc_spec), schema_of(term_spec)

    def of_documents(batches):
        for batch in batches:
            h, ends = flat(batch.column("h"))
            total, there, _ = _indexed(*(_distinct(h, ends) if sets else (h, ends)), dim, seeds, seed)
            vec = listed(total.ravel(), np.arange(1, len(ends) + 1) * dim, doc_schema.field("vec").type, mask=~there.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), vec], schema=doc_schema)

    def shown(part):
        h, sums, bits = part
        for lo in range(0, len(h), 8192):
            x, y = sums[lo:lo + 8192], bits[lo:lo + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(h[lo:lo + 8192]), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(dim)],
                                              *[pa.array(np.ascontiguousarray(y[:, i])) for i in range(words)]], schema=term_schema)

    def of_terms(batches):
        held = []
        for batch in batches:
            h, ends = flat(batch.column("h"))
            if len(h):
                held.append(_of_terms(h, ends, dim, seeds, seed, sets))
            if sum(len(x[0]) for x in held) > TERM_ROWS:
                held = [_added(held)]
                if len(held[0][0]) > TERM_ROWS // 2:
                    yield from shown(held.pop())
        if held:
            yield from shown(_added(held))

    docs = hashed.mapInArrow(of_documents, doc_spec)
    sums = hashed.filter(F.col(key).isNotNull()).mapInArrow(of_terms, term_spec).groupBy("h") \
        .agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(dim)], *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(words)])
    vec = F.array(*[F.when(F.get(F.array(*[F.col(f"b{w}") for w in range(words)]), F.lit(i // _BITS)).bitwiseAND(F.lit(1 << (i % _BITS))) != 0,
                           F.col(f"c{i}").cast("double")) for i in range(dim)])
    out = sums.join(vocabulary.select("term", hash_of(F.col("term"), salt).alias("h")), "h").select(F.col("term").alias(term), vec.alias("vec"))
    return docs, out
