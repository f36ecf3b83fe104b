"""Logical inputs of the library built from the test tables.

Each view is a lazy DataFrame over the parquet tables, so Catalyst prunes
columns and pushes filters of the consuming query into the scans. The
DuckDB twin of each view lives in ``cairn.plans.oracle`` and must stay
row-for-row identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_s(col) -> F.Column:
    """Whole epoch seconds of a (possibly timestamp_ntz) column, in UTC."""
    return F.unix_timestamp(F.col(col).cast("timestamp")) if isinstance(col, str) \
        else F.unix_timestamp(col.cast("timestamp"))


def epoch_us(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-item actions: lineitem joined to its order.

    user = o_custkey, item = l_partkey, type from l_returnflag (A 1, N 2, R 3),
    value = l_quantity, time = o_orderdate, tie-break (order_key, line_no).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2)
         .when(F.col("l_returnflag") == "R", 3).otherwise(0).alias("type"),
        F.col("l_quantity").alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        epoch_s("o_orderdate").alias("t"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-dense user-item stream from ``events``: item = props.k."""
    return clicks_of(table(spark, sf_dir, "events"))


def clicks_of(e: DataFrame) -> DataFrame:
    """``clicks`` over any events frame (batch or stream)."""
    return e.select(
        F.col("event_id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("event_type"),
        F.col("value"),
        F.col("ts").cast("timestamp").alias("ts"),
        epoch_us("ts").alias("t_us"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impression/click log from view/click events.

    consumer = 'c' || user_id % 3; click = IMP for view, CTR for click;
    abkey = baseline / normal by user parity; rectag = 'rt' || k % 4 with
    k % 4 = 0 left null (to be defaulted); shown list = k, k+1, k+7 (mod 100).
    """
    return impressions_of(clicks(spark, sf_dir))


def impressions_of(clicks_df: DataFrame) -> DataFrame:
    """``impressions`` over any clicks frame (batch or stream)."""
    c = clicks_df.filter(F.col("event_type").isin("view", "click"))
    k = F.col("item_id")
    return c.select(
        "event_id",
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"),
        F.col("user_id"),
        F.when(F.col("event_type") == "view", "IMP").otherwise("CTR").alias("click"),
        F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("normal").alias("abkey"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("rt"), (k % 4).cast("string"))).alias("rectag"),
        F.concat_ws(":", k.cast("string"), ((k + 1) % 100).cast("string"),
                    ((k + 7) % 100).cast("string")).alias("recommendations"),
        k.alias("item_id"),
        "ts", "t_us",
    )


def item_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (entity, attr, value) catalogue of parts: brand, type, size."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.explode(F.array(
            F.struct(F.lit("brand").alias("attr"), F.col("p_brand").alias("value")),
            F.struct(F.lit("type").alias("attr"), F.col("p_type").alias("value")),
            F.struct(F.lit("size").alias("attr"), F.col("p_size").cast("string").alias("value")),
        )).alias("a")).select("item_id", "a.attr", "a.value")


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension table: one id per distinct (attr, value); ids dense from 1.

    Ranked on the distinct catalogue values only (bounded by the number of
    attribute values, not by items), then joined back."""
    from pyspark.sql import Window as W
    d = item_attributes(spark, sf_dir).select("attr", "value").distinct()
    return d.withColumn("dim_id", F.dense_rank().over(W.orderBy("attr", "value")).cast("int"))


def item_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = item_attributes(spark, sf_dir)
    return a.join(dimensions(spark, sf_dir), ["attr", "value"]).select("item_id", "dim_id", "attr")


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma tag list per part: distinct lowercased words of p_name and p_type, sorted."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.split(
            F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")))).alias("tags"))


def item_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded (item_id, tag), distinct."""
    t = item_tags(spark, sf_dir)
    return t.select("item_id", F.explode(F.split("tags", ",")).alias("tag")) \
        .filter(F.col("tag") != "").distinct()


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket_id, item) with item = p_brand of each line of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item")).distinct()
