"""Linear classifiers over hashed features, one against all (survey M26, M27), and a
search over parameter ranges (M30).

A feature is hashed to one of ``2 ** bits`` weights; what collides is added up. A row is
its label and two short arrays (weight numbers, values). Every epoch is one pass: tasks add
up the gradient of their own rows, weight by weight, the sums of the tasks are added by a
``groupBy``, and the weights are updated with a step of their own size each. Weights are bounded by the
number of bits and classes, not by the data, which is why they may be sent to every task.
"""

from __future__ import annotations

import json
import random
from typing import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.models import linear_score
from cairn.session import stored

MAX_BITS = 22


def hash_features(features: DataFrame, bits: int = 18, key="id") -> DataFrame:
    """(key, bucket, value): ``feature`` hashed to 0 .. 2**bits - 1 (md5, the same on
    any engine), values that meet in a bucket added; the constant is bucket 2**bits."""
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"bits is {bits}, it has to be 1 to {MAX_BITS}")
    bucket = F.pmod(F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("bigint"), F.lit(1 << bits))
    return features.filter(F.col("feature").isNotNull() & F.col("value").isNotNull()) \
        .groupBy(key, bucket.alias("bucket")).agg(F.sum(F.col("value").cast("double")).alias("value"))


def hashed_rows(features: DataFrame, rows: DataFrame, bits: int, key="id") -> DataFrame:
    """``rows`` with their weight numbers and values, the values scaled to length 1, and a
    constant of 1. Rows without a feature have the constant alone."""
    h = hash_features(features, bits, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("_f"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    scale = F.when(F.col("_n") > 0, 1.0 / F.col("_n")).otherwise(0.0)
    nothing = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    return rows.join(h, key, "left").select(
        *rows.columns,
        F.concat(F.coalesce(F.transform("_f", lambda x: x["bucket"]), nothing[0]), F.array(F.lit(1 << bits).cast("bigint"))).alias("buckets"),
        F.concat(F.coalesce(F.transform("_f", lambda x: x["value"] * scale), nothing[1]), F.array(F.lit(1.0))).alias("values"))


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, weight number and value of every entry of a batch."""
    buckets, values = batch.column("buckets"), batch.column("values")
    off = buckets.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(off))
    pick = lambda c: c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py():c.offsets[-1].as_py()]
    return row, pick(buckets).astype(np.int64), pick(values).astype(float)


def margins(weights: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Rows x classes."""
    return np.stack([np.bincount(row, value * w[bucket], n) for w in weights], axis=1)


def gradient(weights: np.ndarray, row, bucket, value, truth: np.ndarray) -> np.ndarray:
    """Of the logistic losses, classes x weights; ``truth`` is rows x classes."""
    miss = 1.0 / (1.0 + np.exp(-margins(weights, row, bucket, value, len(truth)))) - truth
    return np.stack([np.bincount(bucket, value * miss[row, c], weights.shape[1]) for c in range(len(weights))])


def fit_hashed_linear(rows: DataFrame, classes: Sequence, bits: int = 18, epochs: int = 10, rate: float = 0.5, l2: float = 0.0,
                      label="label") -> np.ndarray:
    """Weights, classes x (2**bits + 1). ``rows`` as ``hashed_rows`` gives them, with a label;
    rows whose label is null or no class are counterexamples of every class."""
    spark = rows.sparkSession
    names = list(classes)
    size = (1 << bits) + 1
    data = stored(rows.select(F.col(label).alias("label"), "buckets", "values"), "hashed-rows")
    weights, square = np.zeros((len(names), size)), np.full((len(names), size), 1e-12)
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast(weights)       # bounded by bits and classes

        def partial(batches):
            total = np.zeros((len(names), size))
            some = False
            for batch in batches:
                given = batch.column("label").to_pylist()
                truth = np.array([[float(g == c) for c in names] for g in given]).reshape(len(given), len(names))
                total += gradient(sent.value, *_flat(batch), truth)
                some = some or bool(len(given))
            if some:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "g"])

        cells = data.mapInArrow(partial, "cell bigint, g double").groupBy("cell").agg(F.sum("g").alias("g")).toPandas()
        step = np.zeros(weights.size)
        step[cells["cell"].to_numpy(np.int64)] = cells["g"].to_numpy(float)
        step = step.reshape(weights.shape) + l2 * weights
        square += step * step
        weights = weights - rate * step / np.sqrt(square)
        sent.unpersist()
    return weights


def weight_table(spark, weights: np.ndarray, classes: Sequence, bits: int) -> DataFrame:
    """(cls, feature, weight): the weights that are not 0, for ``linear_score`` over buckets."""
    c, b = np.nonzero(weights)
    feature = np.where(b == 1 << bits, "constant", b.astype(str))
    rows = [(str(classes[i]), str(f), float(w)) for i, f, w in zip(c, feature, weights[c, b])]
    return spark.createDataFrame(rows, "cls string, feature string, weight double")


def score_hashed(features: DataFrame, weights: DataFrame, classes: Sequence[str], bits: int, key="id") -> DataFrame:
    """M27 over hashed features: (key, cls, prob); ``weights`` (cls, feature, weight) are keyed by
    the bucket's number as text, or ``constant``."""
    h = hash_features(features, bits, key).select(key, F.col("bucket").cast("string").alias("feature"), "value")
    return linear_score(h, weights, classes, key)


def predict_hashed(rows: DataFrame, weights: np.ndarray, classes: Sequence) -> DataFrame:
    """``rows`` (as ``hashed_rows`` gives them) with the most likely class and its probability,
    the classes' sigmoids scaled to sum 1; ties go to the earlier class."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sent = rows.sparkSession.sparkContext.broadcast(weights)
    names = [str(c) for c in classes]
    keep = [c for c in rows.columns if c not in ("buckets", "values")]
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", cls string, prob double"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def predict(batches):
        for batch in batches:
            p = 1.0 / (1.0 + np.exp(-margins(sent.value, *_flat(batch), batch.num_rows)))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in keep], pa.array([names[i] for i in best], pa.string()),
                pa.array(p[np.arange(len(p)), best] / p.sum(axis=1))], schema=schema)

    return rows.mapInArrow(predict, spec)


# ---- search over ranges -----------------------------------------------------------------------------------

def draw(ranges: Mapping[str, tuple], trials: int, seed: int) -> list[dict]:
    """Seeded parameter sets: whole numbers from ranges of whole numbers, else real ones; a third
    entry ``"log"`` draws evenly by order of magnitude."""
    rnd = random.Random(seed)

    def one(lo, hi, how=None):
        if how == "log":
            return float(np.exp(rnd.uniform(np.log(lo), np.log(hi))))
        return rnd.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rnd.uniform(lo, hi)

    return [{k: one(*v) for k, v in sorted(ranges.items())} for _ in range(trials)]


def search_ranges(df: DataFrame, key: str, fit: Callable, score: Callable, ranges: Mapping[str, tuple], trials: int = 9, keep: int = 3,
                  least_share: float = 1 / 9, seed: int = 1):
    """M30 by successive halving: ``trials`` drawn parameter sets are fitted on a sample of the rows, the best
    1 / ``keep`` go on to a ``keep`` times larger one, until one run has all rows. The sample and the held-out
    fifth are chosen by a hash of ``key``, so larger samples hold the smaller. ``fit(rows, params)`` gives a model,
    ``score(model, rows)`` a number (larger is better). Returns the model refitted on all rows, its
    parameters, and every run as (rung, trial, share, score, params, kept)."""
    spark = df.sparkSession
    draws = draw(ranges, trials, seed)
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    held = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(5)) == 0
    data = stored(df.withColumn("_unit", unit).withColumn("_held", held), "search")
    alive, share, rung, log = list(range(trials)), least_share, 0, []
    while True:
        share = min(1.0, share) if len(alive) > 1 else 1.0
        part = data.filter(F.col("_unit") < share).drop("_unit")
        train, test = (part.filter(c).drop("_held") for c in (~F.col("_held"), F.col("_held")))
        got = {i: float(score(fit(train, draws[i]), test)) for i in alive}
        order = sorted(alive, key=lambda i: (-got[i], i))
        stay = order[:max(1, len(order) // keep)]
        log += [(rung, i, float(share), got[i], json.dumps(draws[i], sort_keys=True), i in stay) for i in sorted(alive)]
        if share >= 1.0:
            break
        alive, share, rung = stay, share * keep, rung + 1
    best = stay[0]
    model = fit(data.drop("_unit", "_held"), draws[best])
    return model, draws[best], spark.createDataFrame(log, "rung int, trial int, share double, score double, params string, kept boolean")
