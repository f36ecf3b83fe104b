"""Windowed MinHash item similarity (survey T5).

Per window and item, h min-hashes of its users: min over the window's events
of (a_j * x + b_j) mod 4294967311 with x the user id mod 2^32 and seeded
coefficients (a_j < 2^30, b_j < 2^31, so every product fits in 64 bits).
Items with enough activity are paired when they share a min-hash value for
the same hash function -- a grouping on (window, j, value), run through the
chunked co-occurrence join -- and jaccard = shared minima / h.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.similarity import co_occurrence

# Fixed value: the prime modulus of the min-hash family.
PRIME = 4294967311


def coefficients(h: int, seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 30), rng.randrange(0, 1 << 31)) for _ in range(h)]


def signatures(events: DataFrame, window_s: int, h: int, seed: int, min_activity: int,
               item="item_id", user="user_id", t="t") -> DataFrame:
    """(window, item, activity, sig array<bigint>) for items with >= min_activity events."""
    x = F.pmod(F.col(user), F.lit(1 << 32))
    hashes = [F.pmod(F.lit(a) * x + F.lit(b), F.lit(PRIME)) for a, b in coefficients(h, seed)]
    w = (F.floor(F.col(t) / window_s) * window_s).cast("bigint")
    ev = events.select(w.alias("window"), F.col(item).alias("item"), *[hh.alias(f"_h{j}") for j, hh in enumerate(hashes)])
    sig = ev.groupBy("window", "item").agg(F.count(F.lit(1)).alias("activity"),
                                          *[F.min(f"_h{j}").alias(f"_m{j}") for j in range(h)])
    sig = sig.filter(F.col("activity") >= min_activity)
    return sig.select("window", "item", "activity", F.array(*[F.col(f"_m{j}") for j in range(h)]).alias("sig"))


def minhash_similarity(events: DataFrame, window_s: int, h: int = 100, seed: int = 1, min_activity: int = 1,
                       item="item_id", user="user_id", t="t", chunk: int = 2000) -> DataFrame:
    """T5 (batch window form): (window, item1 < item2, jaccard estimate > 0)."""
    sig = signatures(events, window_s, h, seed, min_activity, item, user, t)
    ex = sig.select("window", "item", F.posexplode("sig").alias("j", "v"))
    co = co_occurrence(ex, chunk=chunk, key=["window", "j", "v"], item="item", group=("window",))
    return co.select("window", "item1", "item2", (F.col("co") / F.lit(float(h))).alias("jaccard"))
