"""Column-level functions and row filters (survey group P).

All are built-in Spark expressions, so they stay inside whole-stage codegen
and filters reach the parquet scan when applied to a base table.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- row filters

def filter_actions(df: DataFrame, types: Iterable[int] | None = None,
                   min_value: float | None = None, type_col="type", value_col="value") -> DataFrame:
    """Keep allowed action types and values strictly above ``min_value``."""
    if types:
        df = df.filter(F.col(type_col).isin(list(types)))
    if min_value is not None:
        df = df.filter(F.col(value_col) > F.lit(min_value))
    return df


def filter_users_by_activity(df: DataFrame, lo: int | None = None, hi: int | None = None,
                             strict: bool = False, user="user_id") -> DataFrame:
    """Keep users whose number of rows is within [lo, hi] (or (lo, hi)).

    Counted with a partial/final aggregate (skew-safe: a hot user is
    pre-aggregated map-side) and applied back with a semi join."""
    counts = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((F.col("_n") > lo) if strict else (F.col("_n") >= lo))
    if hi is not None:
        cond = cond & ((F.col("_n") < hi) if strict else (F.col("_n") <= hi))
    return df.join(counts.filter(cond).select(user), user, "left_semi")


def filter_items_by_users(df: DataFrame, lo: int | None = None, hi: int | None = None,
                          user="user_id", item="item_id") -> DataFrame:
    """Distinct (user, item) pairs of items with lo <= #users <= hi."""
    pairs = df.select(user, item).distinct()
    counts = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("_n") >= lo)
    if hi is not None:
        cond = cond & (F.col("_n") <= hi)
    return pairs.join(counts.filter(cond).select(item), item, "left_semi")


def require_dims(item_dim: DataFrame, dims: Sequence[int] | None, item="item_id",
                 dim="dim_id") -> DataFrame:
    """Keep every (item, dim) row of items carrying at least one required dim."""
    if not dims:
        return item_dim
    ok = item_dim.filter(F.col(dim).isin(list(dims))).select(item)
    return item_dim.join(ok, item, "left_semi")


def hash_bucket(cols: Sequence[str | Column], buckets: int, seed: str = "") -> Column:
    """Portable deterministic bucket: first 8 hex digits of md5 mod ``buckets``.

    md5 exists with the same output in every SQL engine, which keeps the
    sampling / A-B split checkable against an oracle."""
    key = F.concat_ws("|", F.lit(seed), *[_c(c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def sample_actions(df: DataFrame, p: float, seed: int = 1, keys=("user_id", "item_id"),
                   deterministic: bool = True) -> DataFrame:
    """P5: Bernoulli sample with probability ``p``.

    The deterministic variant keeps a row iff its key hash falls below p,
    so reruns after executor loss pick the same rows."""
    if not deterministic:
        return df.sample(fraction=p, seed=seed)
    return df.filter(hash_bucket(list(keys), 1_000_000, str(seed)) < F.lit(int(round(p * 1_000_000))))


def filter_users(df: DataFrame, users: DataFrame, user="user_id") -> DataFrame:
    """User allow-list (semi join; AQE broadcasts the list when it is small)."""
    return df.join(users.select(user).distinct(), user, "left_semi")


def include_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns; unknown names are ignored."""
    keep = [c for c in df.columns if c in set(cols)]
    return df.select(*keep)


def exclude_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the listed columns; unknown names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def exist_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any listed (existing) column."""
    present = [c for c in cols if c in df.columns]
    return df.dropna(subset=present) if present else df


# ------------------------------------------------------------ value functions

def binary_feature(col) -> Column:
    """1 iff the value is present and not 0, "0" or empty."""
    s = _c(col).cast("string")
    return F.when(s.isNull() | (F.trim(s) == "") | (s == "0") | (s == "0.0"), 0).otherwise(1)


def split_feature(cols: Sequence[str], pattern: str = r"[\s,]+", ignore_numbers: bool = False,
                  df_columns: Sequence[str] | None = None) -> Column:
    """P10: split several string columns by a regex, rstrip + lowercase each
    token, drop empties (and purely numeric tokens), concatenated in column order."""
    present = [c for c in cols if df_columns is None or c in df_columns]
    if not present:
        return F.array().cast("array<string>")
    parts = [F.coalesce(F.split(F.lower(F.col(c).cast("string")), pattern),
                        F.array().cast("array<string>")) for c in present]
    toks = F.transform(F.concat(*parts), lambda x: F.rtrim(x))
    cond = (lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.[0-9]+)?$")) if ignore_numbers \
        else (lambda x: x != "")
    return F.filter(toks, cond)


def tokenize_tags(col) -> Column:
    """Comma list -> array of trimmed, lowercased tags with the
    characters space : ; ' " , replaced by underscores; empties dropped."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), ",")
    cleaned = F.transform(parts, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[ :;'\",]", "_"))
    return F.filter(cleaned, lambda x: x != "")


def has_tag(col, tag: str) -> Column:
    """The comma list contains ``tag`` (surrounding spaces allowed)."""
    import re
    return _c(col).rlike(r"(^|,)[ ]*" + re.escape(tag) + r"[ ]*(,|$)")


# URL path templates for API statistics, tried in this order
# (a path starting with /js is left as it is).
PATH_TEMPLATES = [
    (r"^(/users/)([^/]+)(/recommendations)$", "$1{userid}$3"),
    (r"^(/items/)([^/]+)(/actions)$", "$1{itemid}$3"),
    (r"^(/users/)([^/]+)(/actions)$", "$1{userid}$3"),
    (r"^(/items/)([^/]+)$", "$1{itemid}"),
    (r"^(/users/)([^/]+)(/actions/)([^/]+)$", "$1{userid}$3{itemid}"),
    (r"^(/items/)([^/]+)(/actions/)([^/]+)$", "$1{itemid}$3{userid}"),
    (r"^(/actions/)([^/]+)$", "$1{actionid}"),
]


def normalize_path(col) -> Column:
    """Replace ids in API paths by placeholders (first matching template)."""
    p = _c(col)
    expr = p
    for pat, rep in reversed(PATH_TEMPLATES):
        expr = F.when(p.rlike(pat), F.regexp_replace(p, pat, rep)).otherwise(expr)
    return F.when(p.startswith("/js"), p).otherwise(expr)


def strip_query_param(col, param: str) -> Column:
    """P14 helper: remove ``param=...`` from the query string of a URL path."""
    c = _c(col)
    no_param = F.regexp_replace(c, "([?&])" + param + "=[^&]*(&|$)", "$1")
    return F.regexp_replace(no_param, "[?&]$", "")


def unix_day(col) -> Column:
    """Unix day number of a timestamp."""
    return F.floor(F.unix_timestamp(_c(col).cast("timestamp")) / 86400).cast("bigint")


def to_epoch(col) -> Column:
    """Epoch seconds of a UTC timestamp or ``yyyy-MM-dd'T'HH:mm:ss'Z'`` string."""
    c = _c(col)
    return F.coalesce(F.unix_timestamp(c.cast("timestamp")),
                      F.unix_timestamp(c.cast("string"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def explode_recs(df: DataFrame, col="recommendations", out="rec_item", pos="rec_pos") -> DataFrame:
    """One row per item of a colon list, with its 0-based position."""
    return df.select("*", F.posexplode(F.split(F.col(col), ":")).alias(pos, "_v")) \
        .withColumn(out, F.col("_v").cast("bigint")).drop("_v")


def date_features(col, prefix: str, which: Sequence[str] = ("h", "m", "w", "y")) -> list[Column]:
    """Cyclic encodings (sin/cos of 2*pi*x/period) and label tokens.

    h = hour/24, m = month/12, w = weekday/7 (Monday = 0); labels h3, m4, w0, y2016."""
    c = _c(col).cast("timestamp")
    out = []
    units = {"h": (F.hour(c), 24.0), "m": (F.month(c), 12.0), "w": (F.weekday(c), 7.0)}
    for w in which:
        if w in units:
            x, period = units[w]
            ang = F.lit(2 * math.pi) * x / F.lit(period)
            out += [F.sin(ang).alias(f"{prefix}_{w}_sin"), F.cos(ang).alias(f"{prefix}_{w}_cos"),
                    F.concat(F.lit(w), x.cast("string")).alias(f"{prefix}_{w}")]
        elif w == "y":
            out.append(F.concat(F.lit("y"), F.year(c).cast("string")).alias(f"{prefix}_y"))
    return out


def day_diff(a, b) -> Column:
    """(a - b) in days as a double."""
    return (F.unix_micros(_c(a).cast("timestamp")) - F.unix_micros(_c(b).cast("timestamp"))) / F.lit(86400e6)


def best_class(col, seed_with_first: bool = True) -> Column:
    """(class, score) of the highest prediction in an array of
    structs(prediction, predictedClass, confidence). The first element wins ties.

    ``seed_with_first=False`` mimics starting from score 0: when every score
    is <= 0 the result is the null class with score 0."""
    arr = _c(col)
    init = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("cls")) \
        if seed_with_first else F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("cls"))

    def step(acc, x):
        better = acc["score"].isNull() | (x["prediction"] > acc["score"])
        return F.when(better, F.struct(x["prediction"].alias("score"), x["predictedClass"].alias("cls"))) \
            .otherwise(acc)

    return F.aggregate(arr, init, step)


def default_tags(df: DataFrame, rectag="rectag", abkey="abkey") -> DataFrame:
    """P20: rectag null -> 'default'; abkey '-' (or null) -> 'all'."""
    out = df
    if rectag in df.columns:
        out = out.withColumn(rectag, F.coalesce(F.col(rectag), F.lit("default")))
    if abkey in df.columns:
        out = out.withColumn(abkey, F.when(F.col(abkey).isNull() | (F.col(abkey) == "-"), "all")
                             .otherwise(F.col(abkey)))
    return out


def rescale_to_one(df: DataFrame, part: Sequence[str], score="score", out="score") -> DataFrame:
    """Divide scores by the partition maximum (max becomes 1)."""
    w = Window.partitionBy(*part)
    return df.withColumn(out, F.col(score) / F.max(score).over(w))


def normalise_sum(df: DataFrame, part: Sequence[str], score="score", out="score") -> DataFrame:
    """Divide scores by the partition sum."""
    w = Window.partitionBy(*part)
    return df.withColumn(out, F.col(score) / F.sum(score).over(w))


def sigmoid(col) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def json_field(col, path: str, dtype: str = "string", default=None) -> Column:
    """Typed field of a JSON string column with an optional default."""
    v = F.get_json_object(_c(col), path).cast(dtype)
    return F.coalesce(v, F.lit(default).cast(dtype)) if default is not None else v


def localize(attrs: DataFrame, locale_attrs: DataFrame, locale: str,
             keys=("item_id", "attr")) -> DataFrame:
    """A localized value overrides the default value of the same attribute."""
    loc = locale_attrs.filter(F.col("locale") == locale).select(*keys, F.col("value").alias("_lv"))
    return attrs.join(loc, list(keys), "left") \
        .withColumn("value", F.coalesce("_lv", "value")).drop("_lv")
