"""Catalogue and history lookups as DataFrame queries (survey C1-C10, S5, S6, S20, J3, J7, J8)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.ids import dense_index
from cairn.operators.ranking import top_k


def recent_actions(actions: DataFrame, limit: int, by: Sequence[str] = ("user_id",), type_: int | None = None,
                   order=("t", "order_key", "line_no", "item_id")) -> DataFrame:
    """Newest actions per key (user, item, user+item ...), optionally of one type."""
    if type_ is not None:
        actions = actions.filter(F.col("type") == type_)
    return top_k(actions, list(by), [F.desc(o) for o in order], limit)


def list_items(items: DataFrame, order: str = "newest", skip: int = 0, limit: int = 20) -> DataFrame:
    """Newest (id desc) or alphabetical (name asc, id desc) page of items."""
    o = [F.desc("item_id")] if order == "newest" else [F.asc("name"), F.desc("item_id")]
    return items.orderBy(*o).offset(skip).limit(limit)


def list_items_of_dimension(items: DataFrame, dims: DataFrame, dim_id: int, order: str = "newest", skip: int = 0, limit: int = 20,
                            type_col: str = "type") -> DataFrame:
    """C2 by dimension: a page of the items of the dimension's item type (``dims``: dim_id and
    item type); an unknown dimension has no items."""
    kind = dims.filter(F.col("dim_id") == dim_id).select(F.col("item_type").alias(type_col)).distinct()
    return list_items(items.join(kind, type_col, "left_semi"), order, skip, limit)


def items_by_name(items: DataFrame, text: str, limit: int) -> DataFrame:
    """Case-insensitive substring match on the name, newest first."""
    return items.filter(F.lower("name").contains(text.lower())).orderBy(F.desc("item_id")).limit(limit)


def min_item_after(items: DataFrame, ts_col: str, after) -> DataFrame:
    """C4: the first item whose time is at or after ``after`` (0 when none)."""
    first = items.filter(F.col(ts_col) >= F.lit(after)).agg(
        F.min_by("item_id", F.struct(F.col(ts_col), F.col("item_id"))).alias("item_id"))
    return first.select(F.coalesce("item_id", F.lit(0).cast("bigint")).alias("item_id"))


def items_from_actions(actions: DataFrame, action_types: DataFrame, type_name: str, limit: int) -> DataFrame:
    """Per user, items acted on with the named action type, latest first. The types are a short
    configured table: they go to the actions, which are never dealt by type."""
    t = action_types.filter(F.col("name") == type_name).select("type")
    a = actions.join(F.broadcast(t), "type", "left_semi").groupBy("user_id", "item_id").agg(F.max("t").alias("last_t"))
    return top_k(a, ["user_id"], [F.desc("last_t"), F.desc("item_id")], limit)


def dimension_of(dims: DataFrame, attr: str, value: str) -> DataFrame:
    """Dimension id of an (attribute, value) pair, matched lower-cased and trimmed."""
    return dims.filter((F.lower(F.trim("attr")) == attr.strip().lower()) &
                       (F.lower(F.trim("value")) == value.strip().lower())).select("dim_id")


def item_dimension_names(item_dim: DataFrame, dims: DataFrame) -> DataFrame:
    """(item, dim, attribute name, value) for every dimension of each item."""
    return item_dim.select("item_id", "dim_id").join(dims, "dim_id")


def users_with(user_attrs: DataFrame, attr: str, value: str) -> DataFrame:
    """Users whose attribute ``attr`` equals ``value``."""
    return user_attrs.filter((F.col("attr") == attr) & (F.col("value") == value)).select("user_id").distinct()


def demographics(user_attrs: DataFrame) -> DataFrame:
    """(demo_id, attr, value), one demographic for each value of a user attribute, ids from 1 in their order."""
    return dense_index(user_attrs.select("attr", "value").filter(F.col("value").isNotNull()).distinct(), ["attr", "value"], "demo_id")


def demographics_named(demos: DataFrame, attr: str, value: str) -> DataFrame:
    """The demographic of an attribute and a value, matched lower-cased and trimmed."""
    return demos.filter((F.lower(F.trim("attr")) == attr.strip().lower()) & (F.lower(F.trim("value")) == value.strip().lower()))


def user_demographics(user_attrs: DataFrame, demos: DataFrame) -> DataFrame:
    """(user, demo_id) of every user."""
    return user_attrs.join(demos, ["attr", "value"]).select("user_id", "demo_id").distinct()


def wide_attributes(long_attrs: DataFrame, attrs: Sequence[str], key="item_id") -> DataFrame:
    """Long (key, attr, value) -> one column per attribute (listed
    values make the pivot a single pass without a distinct-values job)."""
    return long_attrs.groupBy(key).pivot("attr", list(attrs)).agg(F.first("value"))


def rating_stats(actions: DataFrame, by: str = "item_id", value="value") -> DataFrame:
    """Average and population standard deviation of the rating value."""
    return actions.groupBy(by).agg(F.avg(value).alias("avgrating"), F.stddev_pop(value).alias("stddevrating"),
                                   F.count(F.lit(1)).alias("n"))


def attribute_clicks(shown: DataFrame, clicks: DataFrame, user="user_id", order=("t_us", "event_id"),
                     bucket_width: float | None = 86400e6) -> DataFrame:
    """Each click is attributed to the latest list shown to the user
    before it: the clicked item's position in that list (null when absent),
    the list's algorithm (rectag) and variation (abkey). The as-of lookup is
    bucketed by time (``sequence.carry_forward``) so a hot user is split."""
    s = shown.select(user, *order, F.struct("event_id", "recommendations", "rectag", "abkey").alias("_list"),
                     F.lit(None).cast("bigint").alias("clicked"))
    c = clicks.select(user, *order, F.lit(None).cast("struct<event_id:bigint,recommendations:string,rectag:string,abkey:string>").alias("_list"),
                      F.col("item_id").alias("clicked"))
    from cairn.operators.sequence import carry_forward, time_bucket
    b = time_bucket(order[0], bucket_width) if bucket_width else None
    u = carry_forward(s.unionByName(c), [user], list(order), "_list", "_last", b)
    k = u.filter(F.col("clicked").isNotNull() & F.col("_last").isNotNull())
    pos = F.array_position(F.split(F.col("_last.recommendations"), ":"), F.col("clicked").cast("string"))
    return k.select(user, F.col("event_id").alias("click_id"), F.col("_last.event_id").alias("list_id"), "clicked",
                    F.when(pos > 0, pos - 1).cast("int").alias("position"),
                    F.col("_last.rectag").alias("algorithm"), F.col("_last.abkey").alias("variation"))


def resolve_user_ids(actions: DataFrame) -> DataFrame:
    """Rows with userid 0 take the id of a resolved row with the same
    (client, client_userid) -- the largest -- and are dropped when there is none."""
    known = actions.filter(F.col("userid") != 0).groupBy("client", "client_userid").agg(F.max("userid").alias("_uid"))
    j = actions.join(known, ["client", "client_userid"], "left")
    return j.withColumn("userid", F.when(F.col("userid") == 0, F.col("_uid")).otherwise(F.col("userid"))) \
        .filter(F.col("userid").isNotNull()).drop("_uid")


def attach(vertices: DataFrame, attrs: DataFrame, key: str, default=None) -> DataFrame:
    """Outer join of vertex attributes (vertices without one keep ``default``)."""
    out = vertices.join(attrs, key, "left")
    if default is not None:
        out = out.fillna(default)
    return out


def with_both_dims(df: DataFrame, item_dim: DataFrame, dims: Sequence[int], dim2: int, item="item_id") -> DataFrame:
    """Items carrying a dimension in ``dims`` and also ``dim2`` (two semi joins)."""
    a = item_dim.filter(F.col("dim_id").isin(list(dims))).select(item).distinct()
    b = item_dim.filter(F.col("dim_id") == dim2).select(item).distinct()
    return df.join(a, item, "left_semi").join(b, item, "left_semi")


def join_items(actions: DataFrame, items: DataFrame, key="item_id") -> DataFrame:
    """Inner equi-join of actions with item attributes (AQE picks
    broadcast or sort-merge from runtime sizes)."""
    return actions.join(items, key)


def lookup(df: DataFrame, small: DataFrame, on, max_rows: int = 1_000_000) -> DataFrame:
    """Map-side lookup: the small side is broadcast only after its row
    count is checked against ``max_rows``; otherwise a shuffled join."""
    n = small.count()
    return df.join(F.broadcast(small) if n <= max_rows else small, on)


def without(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with no match in ``other`` (anti join)."""
    return df.join(other, on, "left_anti")


def only(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with a match in ``other`` (semi join)."""
    return df.join(other, on, "left_semi")
