"""Impression / request / prediction reports (survey A1, A2, A4, A5, A14).

CTR is one scan with conditional aggregation instead of joining two
aggregates; every report is a partial+final hash aggregate, so hot
consumers are combined map-side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import best_class, default_tags, explode_recs, normalize_path, unix_day

PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.99]


def _ymd(ts="ts"):
    c = F.col(ts)
    return [F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("d")]


def _ctr(df: DataFrame, keys, include_zero: bool) -> DataFrame:
    g = df.groupBy(*keys).agg(
        F.count_if(F.col("click") == "IMP").alias("impressions"),
        F.count_if(F.col("click") == "CTR").alias("clicks"))
    if not include_zero:
        g = g.filter((F.col("impressions") > 0) & (F.col("clicks") > 0))
    return g.withColumn("ctr", F.when(F.col("impressions") > 0,
                                      F.col("clicks") / F.col("impressions") * 100.0))


def ctr_daily(imps: DataFrame, include_zero: bool = False) -> DataFrame:
    """A1: per consumer and day: impressions, clicks, clicks/impressions*100.
    Days without clicks are absent unless ``include_zero``."""
    return _ctr(imps.select("consumer", "click", *_ymd()), ["consumer", "y", "m", "d"], include_zero)


def ctr_by_rectag(imps: DataFrame, users: DataFrame | None = None, include_zero: bool = False) -> DataFrame:
    """A2: CTR per consumer, variation (abkey), rectag and day; optional user allow-list."""
    df = default_tags(imps)
    if users is not None:
        df = df.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return _ctr(df.select("consumer", "abkey", "rectag", "click", *_ymd()),
                ["consumer", "abkey", "rectag", "y", "m", "d"], include_zero)


def recency_percentiles(imps: DataFrame, publish: DataFrame, pct: Sequence[float] = PERCENTILES) -> DataFrame:
    """A4: recency (whole seconds between impression and item publish time) of
    every recommended item; exact interpolated percentiles per hour."""
    ex = explode_recs(imps.filter(F.col("click") == "IMP"))
    j = ex.join(publish.select(F.col("item_id").alias("rec_item"), F.col("publish_ts")), "rec_item")
    rec = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) -
                   F.unix_micros(F.col("publish_ts").cast("timestamp"))) / 1_000_000)
    j = j.select(*_ymd(), F.hour("ts").alias("h"), rec.alias("recency"))
    g = j.groupBy("y", "m", "d", "h").agg(F.percentile("recency", list(pct)).alias("_p"),
                                          F.count(F.lit(1)).alias("n"))
    return g.select("y", "m", "d", "h", "n",
                    *[F.col("_p")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(pct)])


def unique_users(actions: DataFrame, min_days: int, user="user_id", client_id="client_userid",
                 ts="ts") -> DataFrame:
    """A5: users active on at least ``min_days`` distinct days, with one client id."""
    return actions.groupBy(user).agg(F.count_distinct(unix_day(ts)).alias("n_days"),
                                     F.min(client_id).alias(client_id)) \
        .filter(F.col("n_days") >= min_days)


def impression_stats(imps: DataFrame, click_is_ctr_only: bool = True) -> DataFrame:
    """Impressions and clicks per consumer, rectag, variation and second.
    ``click_is_ctr_only=False`` counts anything but IMP as a click."""
    df = default_tags(imps)
    click = (F.col("click") == "CTR") if click_is_ctr_only else (F.col("click") != "IMP")
    return df.groupBy("consumer", "rectag", "abkey",
                      F.floor(F.col("t_us") / 1_000_000).cast("bigint").alias("second")).agg(
        F.count_if(F.col("click") == "IMP").alias("impressions"),
        F.count_if(click).alias("clicks"))


def request_stats(requests: DataFrame) -> DataFrame:
    """API calls per consumer, method, templated path and second:
    count and mean execution time."""
    return requests.groupBy("consumer", "httpmethod", normalize_path("path").alias("path"),
                            F.col("time").alias("second")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("exectime").alias("exectime"))


def prediction_stats(preds: DataFrame) -> DataFrame:
    """Predictions per consumer, variation, model, best class and
    second: count and mean best score."""
    b = best_class("predictions")
    df = preds.select("consumer", "variation", "model", F.col("time").alias("second"),
                      b["cls"].alias("predicted_class"), b["score"].alias("score"))
    return df.groupBy("consumer", "variation", "model", "predicted_class", "second").agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("score"))
