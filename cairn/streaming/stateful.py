"""Streams that carry state over many runs: rolling MinHash, decayed counts that
expire, and a runner that feeds a table slice by slice (survey T4, T5, T6, T9).

State lives in the state store (RocksDB) under the query's checkpoint in the shared
checkpoint folder; event-time timers emit and drop it, so state is bounded by the keys that
are active within the window, not by the length of the stream. Each slice is
a run of its own with the same checkpoint, as a scheduled ``availableNow`` job: state and
watermark come back from the checkpoint every time.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from cairn.operators.minhash import PRIME, coefficients
from cairn.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_in_slices(rows: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], slices: int = 4, close_after_s: int = 0,
                  keys: Sequence[str] | None = None, mode: str = "append",
                  batch_fn: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Feed ``rows`` to the stream ``build`` in ``slices`` runs of equal spans of the time
    column ``ts`` and return all that came out (the latest row of each of ``keys``, if given).
    With ``close_after_s`` a last run brings one row that has nothing but a time, so much after the last: it
    moves the watermark on, so that what is still open comes out as well."""
    spark = rows.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    rows.limit(0).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    first, last = rows.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    if first is None:
        return spark.createDataFrame([], build(stream).schema)
    step = (last - first) // slices + 1
    at = lambda us: F.timestamp_micros(F.lit(us)).cast(rows.schema[ts].dataType)
    parts = [rows.filter((F.col(ts) >= at(first + i * step)) & (F.col(ts) < at(first + (i + 1) * step))) for i in range(slices)]
    if close_after_s:
        end = last + close_after_s * 1_000_000
        parts.append(spark.range(1).select(*[(at(end) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))

    def write(batch: DataFrame, number: int) -> None:
        b = batch_fn(batch, number) if batch_fn else batch
        b.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/v={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{base}/in")
            build(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint") \
                .trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    try:
        out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("v")
    except AnalysisException as e:  # nothing came out
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], build(stream).schema)
    if keys:
        latest = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
        out = out.withColumn("_v", F.row_number().over(latest)).filter("_v = 1").drop("_v")
    return out.drop("_batch")


# ---- rolling MinHash (T5) ------------------------------------------------------------------------------

SIGNATURES = "at bigint, item bigint, activity bigint, sig array<bigint>"


class MonotoneMinima:
    """For each of h hashes the minima of steps that can still be the least of a window: an
    older one that is not smaller than a newer one never will be, and is dropped. ``counts`` has the events of each step."""

    def __init__(self, h: int, minima=(), counts=()):
        self.lists: list[list[tuple[int, int]]] = [[] for _ in range(h)]
        for j, at, v in minima:
            self.lists[j].append((at, v))
        self.counts = list(counts)

    def settle(self, at: int, count: int, sig) -> None:
        """Add a step later than all before."""
        for own, v in zip(self.lists, sig):
            while own and own[-1][1] >= v:
                own.pop()
            own.append((at, v))
        self.counts.append((at, count))

    def expire(self, until: int) -> None:
        """Drop steps that ended at ``until`` or earlier."""
        self.counts = [c for c in self.counts if c[0] > until]
        for own in self.lists:
            while own and own[0][0] <= until:
                own.pop(0)

    def signature(self) -> tuple[int, list[int]]:
        return sum(n for _, n in self.counts), [own[0][1] for own in self.lists]

    def minima(self) -> list[tuple[int, int, int]]:
        return [(j, at, v) for j, own in enumerate(self.lists) for at, v in own]


class RollingMinHash(StatefulProcessor):
    """Per item: steps still open (count and minima of each), the settled window, and the time up to
    which it is settled. Events of (at - step, at] belong to the step that ends ``at``; at each end the window
    (at - window, at] is emitted as long as it holds events, then the item's state is gone."""

    def __init__(self, window_s: int, step_s: int, h: int, seed: int, min_activity: int):
        self.window, self.step, self.h, self.least = window_s, step_s, h, min_activity
        ab = np.array(coefficients(h, seed), np.uint64)
        self.a, self.b = ab[:, 0], ab[:, 1]

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at bigint", "count bigint, sig array<bigint>")
        self.minima = handle.getValueState("minima", "until bigint, j array<int>, at array<bigint>, v array<bigint>, steps array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        settled = timerValues.getCurrentWatermarkInMs() // 1000
        for pdf in rows:
            end = -(-pdf["t_us"].to_numpy(np.int64) // (self.step * 1_000_000)) * self.step
            x = pdf["x"].to_numpy(np.int64).astype(np.uint64)
            for at in np.unique(end).tolist():
                if at <= settled:
                    continue                    # its window has been emitted
                own = x[end == at]
                sig = ((self.a[:, None] * own[None, :] + self.b[:, None]) % np.uint64(PRIME)).min(axis=1).astype(np.int64)
                count = len(own)
                if self.open.containsKey((at,)):
                    n, old = self.open.getValue((at,))
                    count, sig = count + n, np.minimum(sig, np.array(old, np.int64))
                else:
                    self.handle.registerTimer(at * 1000)
                self.open.updateValue((at,), (count, sig.tolist()))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        window = MonotoneMinima(self.h)
        if self.minima.exists():
            until, j, ends, v, steps, counts = self.minima.get()
            if at <= until:
                return                          # emitted with an earlier timer
            window = MonotoneMinima(self.h, zip(j, ends, v), zip(steps, counts))
        waiting = {k[0]: v for k, v in self.open.iterator()} if self.open.exists() else {}
        out = []
        # every end up to the watermark, in order, whichever timer came first
        while at <= now and (waiting or window.counts):
            if at in waiting:
                count, sig = waiting.pop(at)
                self.open.removeKey((at,))
                window.settle(at, count, sig)
            window.expire(at - self.window)
            if window.counts:
                activity, sig = window.signature()
                if activity >= self.least:
                    out.append((at, key[0], activity, sig))
                at += self.step
            elif waiting:
                at = min(waiting)
        if window.counts:
            j, ends, v = zip(*window.minima())
            steps, counts = zip(*window.counts)
            self.minima.update((at - self.step, list(j), list(ends), list(v), list(steps), list(counts)))
            self.handle.registerTimer(at * 1000)
        else:
            self.minima.clear()
        if out:
            yield pd.DataFrame(out, columns=["at", "item", "activity", "sig"])

    def close(self) -> None:
        pass


def stream_rolling_minhash(events: DataFrame, window_s: int, step_s: int, h: int = 100, seed: int = 1, min_activity: int = 1,
                           watermark: str = "1 hour", item="item_id", user="user_id", ts="ts") -> DataFrame:
    """T5: (at, item, activity, sig) at every end of a step, over the events of (at - window, at]; ``window_s`` is a
    multiple of ``step_s``. Append mode."""
    if window_s % step_s:
        raise ValueError("the window has to be a multiple of the step")
    e = events.withWatermark(ts, watermark).select(
        F.col(item).cast("bigint").alias("item"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"),
        F.pmod(F.coalesce(F.col(user), F.lit(0)), F.lit(1 << 32)).alias("x"))
    return e.groupBy("item").transformWithStateInPandas(
        RollingMinHash(window_s, step_s, h, seed, min_activity), SIGNATURES, "Append", "EventTime")


def signature_similarity(signatures: DataFrame, h: int, chunk: int = 2000) -> DataFrame:
    """(at, item1 < item2, jaccard > 0): share of equal minima."""
    from cairn.operators.similarity import co_occurrence

    ex = signatures.select("at", "item", F.posexplode("sig").alias("j", "v"))
    co = co_occurrence(ex, chunk=chunk, key=["at", "j", "v"], item="item", group=("at",))
    return co.select("at", "item1", "item2", (F.col("co") / F.lit(float(h))).alias("jaccard"))


# ---- decayed counts that expire (T6) ------------------------------------------------------------------------

DECAYED = "key bigint, begin_us bigint, last_us bigint, n bigint, count double"


class DecayedRun(StatefulProcessor):
    """Per key the decayed count c <- w + exp(-(t - t0) / alpha) c of a run of events no more than ``idle`` apart. A run is
    emitted when a later event or the watermark shows that it is over; then its state is gone."""

    def __init__(self, alpha_s: float, idle_s: int):
        self.alpha, self.idle = alpha_s * 1e6, idle_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "begin bigint, last bigint, n bigint, count double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        frames = [p for p in rows]
        pdf = pd.concat(frames).sort_values("t_us")
        t, w = pdf["t_us"].to_numpy(np.int64), pdf["w"].to_numpy(float)
        out = []
        run = tuple(self.run.get()) if self.run.exists() else None
        cuts = np.flatnonzero(np.diff(t) > self.idle) + 1
        for own, weight in zip(np.split(t, cuts), np.split(w, cuts)):
            if run is not None and own[0] - run[1] > self.idle:
                out.append((key[0], *run))
                run = None
            if run is None:
                run = (int(own[0]), int(own[0]), 0, 0.0)
            begin, last, n, count = run
            own = np.maximum(own, last) if n else own      # times before the state's are clamped
            new = int(own[-1])
            count = count * np.exp(-(new - last) / self.alpha) + float((weight * np.exp(-(new - own) / self.alpha)).sum())
            run = (begin, new, n + len(own), float(count))
        self.run.update(run)
        self.handle.registerTimer(-(-(run[1] + self.idle) // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "begin_us", "last_us", "n", "count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        run = tuple(self.run.get())
        if expiredTimerInfo.getExpiryTimeInMs() * 1000 > run[1] + self.idle:       # no later event has come since
            self.run.clear()
            yield pd.DataFrame([(key[0], *run)], columns=["key", "begin_us", "last_us", "n", "count"])

    def close(self) -> None:
        pass


def stream_decayed_runs(events: DataFrame, key: str, alpha_s: float, idle_s: int, weight: str | None = None,
                        watermark: str = "1 hour", ts="ts") -> DataFrame:
    """T6 with expiry: (key, begin_us, last_us, n, count), one row for each run, the count decayed to its last event. Append mode."""
    e = events.withWatermark(ts, watermark).select(
        F.col(key).cast("bigint").alias("key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"),
        (F.coalesce(F.col(weight), F.lit(0.0)).cast("double") if weight else F.lit(1.0)).alias("w"))
    return e.groupBy("key").transformWithStateInPandas(DecayedRun(alpha_s, idle_s), DECAYED, "Append", "EventTime")
