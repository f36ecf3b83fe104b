"""Sources, sinks and ingestion (survey S1-S21).

Readers take explicit schemas (no inference pass over 100 TB), parse with
``from_json`` in PERMISSIVE mode and drop malformed lines. Writers are
single-pass partitioned writes (``partitionBy``), never one job per client.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.ids import dense_index

ACTION_SCHEMA = T.StructType([
    T.StructField("client", T.StringType()), T.StructField("client_userid", T.StringType()),
    T.StructField("userid", T.LongType()), T.StructField("itemid", T.LongType()),
    T.StructField("client_itemid", T.StringType()), T.StructField("rectag", T.StringType()),
    T.StructField("type", T.IntegerType()), T.StructField("value", T.DoubleType()),
    T.StructField("timestamp_utc", T.StringType()),
])


def _parse_actions(json_col) -> F.Column:
    return F.from_json(json_col, ACTION_SCHEMA, {"mode": "PERMISSIVE"})


def read_action_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines "<time> <tag> <json>" split on the first two whitespace runs;
    JSON fields typed by schema, unknown fields ignored, malformed lines dropped."""
    lines = spark.read.text(path)
    parts = F.split(F.col("value"), r"\s+", 3)
    df = lines.select(parts[0].alias("log_time"), parts[1].alias("tag"), _parse_actions(parts[2]).alias("a"))
    return df.filter(F.col("a").isNotNull() & F.col("a.client").isNotNull()).select("log_time", "tag", "a.*") \
        .withColumn("ts", F.to_timestamp("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON action per line, typed by the action schema."""
    return spark.read.schema(ACTION_SCHEMA).option("mode", "DROPMALFORMED").json(path) \
        .withColumn("ts", F.to_timestamp("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def read_tagged_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """S3: tab separated (time, tag, json) lines of one tag."""
    df = spark.read.schema("time string, tag string, json string").option("sep", "\t").option("quote", "").csv(path)
    return df.filter(F.col("tag") == tag)


def day_range(df: DataFrame, start_day: int, days: int, day_col: str = "day") -> DataFrame:
    """The ``days`` unix days ending at ``start_day`` (a partition filter:
    on a ``partitionBy('client', 'day')`` table only those folders are read)."""
    return df.filter((F.col(day_col) > start_day - days) & (F.col(day_col) <= start_day))


def write_by_client_day(df: DataFrame, path: str, gzip: bool = False, fmt: str = "json") -> None:
    """One folder per client and unix day, written in a single pass; rows
    are first clustered by (client, day) so each folder gets one file per
    writer instead of one per input task."""
    w = df.repartition("client", "day").write.mode("overwrite").partitionBy("client", "day")
    if gzip:
        w = w.option("compression", "gzip")
    w.format(fmt).save(path)


def item_attributes(items: DataFrame, attrs: DataFrame, typed: Mapping[str, DataFrame],
                    enum_values: DataFrame | None = None) -> DataFrame:
    """Items x attribute definitions, left-joined to every typed value
    table (entity, attr_id, value), coalesced to one string; enum values
    resolved to their names; rows without a value removed."""
    base = items.select("item_id", "type_id").join(attrs.select("attr_id", "name", "type_id", "kind"), "type_id")
    vals = []
    for kind, t in typed.items():
        v = t.select("item_id", "attr_id", F.col("value").cast("string").alias(f"_v_{kind}"))
        base = base.join(v, ["item_id", "attr_id"], "left")
        vals.append(F.col(f"_v_{kind}"))
    out = base.withColumn("value", F.coalesce(*vals))
    if enum_values is not None:
        ev = enum_values.select("attr_id", F.col("value_id").cast("string").alias("value"), F.col("value_name"))
        out = out.join(ev, ["attr_id", "value"], "left") \
            .withColumn("value", F.when(F.col("kind") == "enum", F.col("value_name")).otherwise(F.col("value")))
    return out.filter(F.col("value").isNotNull()).select("item_id", F.col("name").alias("attr"), "value")


def item_dimensions(item_enum: DataFrame, dims: DataFrame, exclude_dims: DataFrame | None = None,
                    exclude_attrs: DataFrame | None = None) -> DataFrame:
    """Item -> dim through (attr, enum value); dim ids below 65535;
    minus excluded dimensions and attributes (anti joins)."""
    j = item_enum.join(dims, ["attr_id", "value_id"]).filter(F.col("dim_id") < 65535)
    if exclude_dims is not None:
        j = j.join(exclude_dims.select("dim_id"), "dim_id", "left_anti")
    if exclude_attrs is not None:
        j = j.join(exclude_attrs.select("attr_id"), "attr_id", "left_anti")
    return j.select("item_id", "dim_id")


def validate_items(csv_lines: DataFrame, attr_names: DataFrame, enum_values: DataFrame,
                   enum_attrs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """CSV item rows (text lines, first line the header) are checked:
    field count equals the header's, every header field is id, name or a
    known attribute, enum fields hold a known value. Returns (good rows as
    (line_no, field, value), bad rows as (line_no, error))."""
    numbered = csv_lines.select(F.col("line_no"), F.split("value", ",", -1).alias("f"))
    header = numbered.filter("line_no = 1").select(F.col("f").alias("h"))
    rows = numbered.filter("line_no > 1").withColumn("h", header.select(F.col("h")).scalar())
    n_header = F.size("h")
    bad_count = rows.filter(F.size("f") != n_header).select("line_no", F.lit("wrong number of fields").alias("error"))
    ok = rows.filter(F.size("f") == n_header)
    long = ok.select("line_no", F.explode(F.arrays_zip(F.col("h").alias("field"), F.col("f").alias("value"))).alias("kv")) \
        .select("line_no", F.col("kv.field").alias("field"), F.col("kv.value").alias("value"))
    known = attr_names.select(F.col("name").alias("field")).union(
        csv_lines.sparkSession.createDataFrame([("id",), ("name",)], "field string"))
    unknown = long.join(known, "field", "left_anti").select("line_no", F.concat(F.lit("unknown attribute "), "field").alias("error"))
    enum_rows = long.filter(F.col("field").isin(list(enum_attrs)))
    bad_enum = enum_rows.join(enum_values.select(F.col("attr").alias("field"), F.col("value_name").alias("value")),
                              ["field", "value"], "left_anti") \
        .select("line_no", F.concat(F.lit("unknown value for "), "field").alias("error"))
    bad = bad_count.unionByName(unknown).unionByName(bad_enum)
    good = long.join(bad.select("line_no").distinct(), "line_no", "left_anti")
    return good, bad


def import_users(users_csv: DataFrame, client_col: str = "client_userid", start_id: int = 1) -> DataFrame:
    """Distinct client user ids with generated internal ids (dense rank)."""
    d = users_csv.select(client_col).distinct()
    return dense_index(d, [client_col], "user_id", start_id)


def import_actions(actions_csv: DataFrame, users: DataFrame, items: DataFrame, rectag: str = "default") -> DataFrame:
    """Client ids translated to internal ids, epoch to a UTC string, type 1."""
    j = actions_csv.join(users.select("client_userid", "user_id"), "client_userid") \
        .join(items.select("client_itemid", "item_id"), "client_itemid")
    return j.select("client_userid", "client_itemid", F.col("user_id").alias("userid"), F.col("item_id").alias("itemid"),
                    F.lit(1).alias("type"), F.lit(rectag).alias("rectag"), F.col("value").cast("double").alias("value"),
                    F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Model rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def vector_lines(vectors: DataFrame, key: str, vec: str, sep: str = "|") -> DataFrame:
    """S12: "key|v1|v2..." text lines of a vector table."""
    return vectors.select(F.concat_ws(sep, F.col(key).cast("string"),
                                      F.transform(vec, lambda x: F.format_string("%.6f", x.cast("double")))).alias("value"))


def refresh_table(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Write the new version to its own folder, then point the
    (external) table at it: readers see the old or the new version, never a
    partial one, and the old files stay for in-flight readers."""
    import uuid
    from cairn.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{base or ensure_checkpoint_dir(spark) + '/tables'}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=path, source="parquet")
    return spark.table(name)


def carry_over(new: DataFrame, old: DataFrame, keys: Sequence[str], score: str = "score",
               decay: float = 0.01) -> DataFrame:
    """New scores win; keys only in the old table survive with score -
    decay; negative scores removed."""
    kept = old.join(new.select(*keys), list(keys), "left_anti").withColumn(score, F.col(score) - F.lit(decay))
    return new.unionByName(kept).filter(F.col(score) >= 0)


def append_missing(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Add rows of ``extra`` whose key is not yet in ``base``."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))


def to_metric_points(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], time: str) -> DataFrame:
    """Time-series points (measurement, tags map, fields map, time)."""
    return df.select(F.lit(measurement).alias("measurement"),
                     F.create_map(*[x for t in tags for x in (F.lit(t), F.col(t).cast("string"))]).alias("tags"),
                     F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("double"))]).alias("fields"),
                     F.col(time).alias("time"))


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON topic as a stream (needs the Kafka connector on the classpath)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("j")).select("j.*")


def write_kafka_csv(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """CSV lines to a topic, each micro-batch bracketed by START / END markers."""
    def send(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = spark.createDataFrame([(f"START,{batch_id}",)], "value string")
        end = spark.createDataFrame([(f"END,{batch_id}",)], "value string")
        body = batch.select(F.concat_ws(",", *[F.col(c).cast("string") for c in batch.columns]).alias("value"))
        for part in (start, body, end):
            part.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    return df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()


def read_frame(spark: SparkSession, locations: Sequence[str], fmt: str = "json", schema=None) -> DataFrame:
    """One frame from part files in several locations."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(list(locations))


def build_dimensions(schema_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attribute schema (item_type, attr, kind, enum values) -> attribute
    ids, and for each enum value a value id and a dimension id. Rows with an
    unknown kind or a duplicate (type, attr) are rejected."""
    kinds = ["int", "bigint", "double", "boolean", "datetime", "varchar", "text", "enum"]
    ok = schema_rows.filter(F.col("kind").isin(kinds))
    dup = ok.groupBy("item_type", "attr").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ok = ok.join(dup.select("item_type", "attr"), ["item_type", "attr"], "left_anti")
    attrs = ok.withColumn("attr_id", F.dense_rank().over(Window.orderBy("item_type", "attr")).cast("int"))
    enums = attrs.filter(F.col("kind") == "enum").select("item_type", "attr", "attr_id",
                                                         F.posexplode(F.split("enum_values", "\\|")).alias("_p", "value_name"))
    enums = enums.withColumn("value_id", (F.col("_p") + 1).cast("int")) \
        .withColumn("dim_id", F.dense_rank().over(Window.orderBy("attr_id", "value_id")).cast("int")).drop("_p")
    return attrs.select("item_type", "attr", "kind", "attr_id"), enums


def ingest_actions(actions: DataFrame, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New users and items (not yet known) get appended with the next
    ids; actions get internal ids. Returns (users, items, actions)."""
    def extend(known: DataFrame, seen: DataFrame, client: str, key: str) -> DataFrame:
        new = seen.select(client).distinct().join(known.select(client), client, "left_anti")
        top = known.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        new = dense_index(new, [client], key, int(top) + 1)
        return known.select(client, key).unionByName(new)
    u = extend(users, actions, "client_userid", "user_id")
    i = extend(items, actions, "client_itemid", "item_id")
    a = actions.join(u, "client_userid").join(i, "client_itemid")
    return u, i, a


def extract_page_attributes(pages: DataFrame, required: Sequence[str] = ("title",)) -> tuple[DataFrame, DataFrame]:
    """S19 (HTML already fetched): per page the html lang, title, first h1,
    base url (protocol://host/path of the page url), the link texts of the
    navigation as tags (lower-cased) and bigrams of neighbouring tags that
    occur in the title. Pages missing a required attribute are failed with
    the list of missing attributes."""
    html = F.col("html")
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    blank = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c))
    nav = F.regexp_extract(html, r"(?s)<nav[^>]*>(.*?)</nav>", 1)
    links = F.regexp_extract_all(nav, F.lit(r"(?s)<a[^>]*>(.*?)</a>"), F.lit(1))
    tags = F.filter(F.transform(links, lambda x: F.lower(F.trim(F.regexp_replace(x, "<[^>]*>", "")))), lambda x: x != "")
    df = pages.select(
        "page_id", "url",
        F.regexp_extract(html, r"<html[^>]*\blang=\"([^\"]*)\"", 1).alias("lang"),
        strip(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        strip(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"),
        F.regexp_extract(F.col("url"), r"^([a-zA-Z]+://[^/?#]*[^?#]*)", 1).alias("baseurl"),
        tags.alias("tags"))
    df = df.select("page_id", "url", *[blank(c).alias(c) for c in ("lang", "title", "h1", "baseurl")], "tags")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tags") - 1, F.lit(1))),
                        lambda i: F.concat_ws(" ", F.element_at("tags", i), F.element_at("tags", i + 1)))
    df = df.withColumn("bigrams", F.when(F.size("tags") > 1, F.filter(pairs, lambda b: F.lower(F.col("title")).contains(b)))
                       .otherwise(F.array().cast("array<string>")))
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    df = df.withColumn("_missing", missing)
    ok = df.filter(F.size("_missing") == 0).drop("_missing")
    failed = df.filter(F.size("_missing") > 0).select("page_id", "url", F.concat_ws(",", "_missing").alias("failed"))
    return ok, failed
