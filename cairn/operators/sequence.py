"""Skew-safe ordered primitives over keyed sequences.

A per-user window (``Window.partitionBy(user).orderBy(t)``) sends all rows
of a user to one task; a user holding a third of the data would then run on
one core. The helpers here split each key into ordered *buckets* (for
example one per day of its timeline): the window runs per (key, bucket), and
only one summary row per (key, bucket) crosses to a per-key window that
stitches neighbouring buckets together. A hot key is thereby spread over as
many tasks as it has buckets, while results equal the plain per-key window.

With ``bucket=None`` the plain per-key window is used.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def time_bucket(t: str, width: float) -> Column:
    """Bucket id of a numeric time column (same unit as ``width``)."""
    return F.floor(F.col(t) / F.lit(width)).cast("bigint")


def with_prev(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str],
              bucket: Column | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row of the key in ``order``.

    ``bucket`` must be non-decreasing along ``order`` within a key."""
    key = list(key)
    if bucket is None:
        w = Window.partitionBy(*key).orderBy(*_cols(order))
        for c in cols:
            df = df.withColumn(prefix + c, F.lag(c).over(w))
        return df
    df = df.withColumn("_b", bucket)
    wb = Window.partitionBy(*key, "_b").orderBy(*_cols(order))
    df = df.withColumn("_rb", F.row_number().over(wb))
    for c in cols:
        df = df.withColumn(prefix + c, F.lag(c).over(wb))
    # last row of each (key, bucket), then the previous bucket's last row per key
    tail = df.groupBy(*key, "_b").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*_cols(order))).alias("_last"))
    tail = tail.withColumn("_pl", F.lag("_last").over(Window.partitionBy(*key).orderBy("_b"))) \
        .select(*key, "_b", "_pl")
    df = df.join(tail, key + ["_b"], "left")
    for c in cols:
        df = df.withColumn(prefix + c, F.when(F.col("_rb") == 1, F.col("_pl")[c]).otherwise(F.col(prefix + c)))
    return df.drop("_pl", "_rb", "_b")


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str | Column,
                out: str, bucket: Column | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` along ``order`` within the key (inclusive)."""
    key = list(key)
    v = F.col(value) if isinstance(value, str) else value
    if bucket is None:
        w = Window.partitionBy(*key).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(v).over(w))
    df = df.withColumn("_b", bucket).withColumn("_v", v)
    wb = Window.partitionBy(*key, "_b").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_rs", F.sum("_v").over(wb))
    tot = df.groupBy(*key, "_b").agg(F.sum("_v").alias("_bt"))
    wk = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wk), F.lit(0))).select(*key, "_b", "_off")
    return df.join(tot, key + ["_b"], "left").withColumn(out, F.col("_rs") + F.col("_off")) \
        .drop("_b", "_v", "_rs", "_off")


def sessionize(df: DataFrame, user: str, t: str, gap: float, order: Sequence[str] | None = None,
               split_also: Column | None = None, bucket: Column | None = None,
               out: str = "session_no") -> DataFrame:
    """Number sessions per user (1-based): a new session starts at the first
    row and whenever the time since the previous row exceeds ``gap``
    (and ``split_also`` holds on the row, when given). ``gap < 0``: never
    split. Adds ``prev_t`` and ``gap_prev`` (null on the first row)."""
    order = list(order or [t])
    df = with_prev(df, [user], order, [t], bucket)
    df = df.withColumn("gap_prev", F.col(t) - F.col("prev_" + t))
    if gap < 0:
        return df.withColumn(out, F.lit(1).cast("bigint"))
    cond = F.col("gap_prev") > F.lit(gap)
    if split_also is not None:
        cond = cond & split_also
    df = df.withColumn("_new", F.when(F.col("gap_prev").isNull() | cond, 1).otherwise(0))
    return running_sum(df, [user], order, "_new", out, bucket).withColumn(out, F.col(out).cast("bigint")).drop("_new")


def ordered_ngrams(df: DataFrame, key: str, order: Sequence[str], token: str, n: int,
                   bucket: Column | None = None) -> DataFrame:
    """All 1..n-grams of the token sequence of each key, as (key, pos, n, gram array).

    Positions are assigned with ``running_sum`` and neighbours fetched by
    equi-joins on (key, pos + i): unique keys, so no hot partition."""
    pos = running_sum(df, [key], order, F.lit(1), "pos", bucket).select(key, "pos", token)
    grams = pos.select(key, "pos", F.lit(1).alias("n"), F.array(F.col(token)).alias("gram"))
    cur = pos.select(key, "pos", F.array(F.col(token)).alias("gram"))
    for i in range(1, n):
        nxt = pos.select(key, (F.col("pos") - i).alias("pos"), F.col(token).alias("_nx"))
        cur = cur.join(nxt, [key, "pos"]).select(key, "pos", F.concat("gram", F.array("_nx")).alias("gram"))
        grams = grams.unionByName(cur.select(key, "pos", F.lit(i + 1).alias("n"), "gram"))
    return grams


def carry_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], col: str, out: str,
                  bucket: Column | None = None) -> DataFrame:
    """``out`` = the last non-null ``col`` on an earlier row of the key (an
    as-of lookup). Bucketed like ``with_prev``: within (key, bucket) a
    window, across buckets the last non-null value of each earlier bucket."""
    key = list(key)
    prev_rows = Window.unboundedPreceding, -1
    if bucket is None:
        w = Window.partitionBy(*key).orderBy(*_cols(order)).rowsBetween(*prev_rows)
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    df = df.withColumn("_b", bucket)
    wb = Window.partitionBy(*key, "_b").orderBy(*_cols(order)).rowsBetween(*prev_rows)
    df = df.withColumn(out, F.last(col, ignorenulls=True).over(wb))
    tail = df.filter(F.col(col).isNotNull()).groupBy(*key, "_b").agg(
        F.max_by(F.col(col), F.struct(*_cols(order))).alias("_lb"))
    # one row per (key, bucket): the latest non-null value of the earlier buckets
    buckets = df.select(*key, "_b").distinct().join(tail, key + ["_b"], "left")
    buckets = buckets.withColumn("_carry", F.last("_lb", ignorenulls=True).over(
        Window.partitionBy(*key).orderBy("_b").rowsBetween(*prev_rows))).select(*key, "_b", "_carry")
    return df.join(buckets, key + ["_b"], "left") \
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_b", "_carry")
