"""Inputs derived row-by-row from the test tables for operators whose
reference input is an API log (requests, predictions). Each row is a pure
function of one table row, so these grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans import views as V


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API request log: path chosen by event type; exectime from value."""
    return requests_of(V.clicks(spark, sf_dir))


def requests_of(c: DataFrame) -> DataFrame:
    """``requests`` over any clicks frame (batch or stream)."""
    uid, iid = F.col("user_id").cast("string"), F.col("item_id").cast("string")
    path = (F.when(F.col("event_type") == "view", F.concat(F.lit("/users/"), uid, F.lit("/recommendations")))
             .when(F.col("event_type") == "click", F.concat(F.lit("/items/"), iid, F.lit("/actions")))
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit("/users/"), uid, F.lit("/actions/"), iid))
             .when(F.col("event_type") == "error", F.concat(F.lit("/js/"), iid, F.lit("/actions")))
             .otherwise(F.concat(F.lit("/actions/"), F.col("event_id").cast("string"))))
    return c.select(
        "event_id",
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("httpmethod"),
        path.alias("path"),
        F.floor(F.col("value") * 10).cast("int").alias("exectime"),
        F.floor(F.col("t_us") / 1000000).cast("bigint").alias("time"),
        "ts")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: three scored classes per embedding row."""
    return predictions_of(V.table(spark, sf_dir, "embeddings"))


def predictions_of(e: DataFrame) -> DataFrame:
    """``predictions`` over any embeddings frame (batch or stream)."""
    preds = F.array(*[
        F.struct(F.element_at("embedding", i + 1).cast("double").alias("prediction"),
                 F.lit(cls).alias("predictedClass"), F.lit(1.0).alias("confidence"))
        for i, cls in enumerate("abc")])
    return e.select("vec_id",
                    F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("consumer"),
                    F.when(F.col("label") == 0, "v0").otherwise("v1").alias("variation"),
                    F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"),
                    (F.col("vec_id") * 10).cast("bigint").alias("time"),
                    F.timestamp_seconds(F.col("vec_id") * 10).alias("ts"),
                    preds.alias("predictions"))


def tag_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag definitions (tag, group, cluster): group 'type' for part-type words,
    else 'name'; cluster = group + first letter of the tag."""
    types = V.table(spark, sf_dir, "part").select(F.lower("p_type").alias("tag")).distinct() \
        .withColumn("_is_type", F.lit(True))
    t = V.item_tag(spark, sf_dir).select("tag").distinct().join(types, "tag", "left")
    grp = F.when(F.col("_is_type"), "type").otherwise("name")
    return t.select("tag", grp.alias("group"), F.concat(grp, F.lit("_"), F.substring("tag", 1, 1)).alias("cluster"))
