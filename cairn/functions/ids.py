"""Dense sequential ids without a single-partition window.

``Window.orderBy(...)`` with no partition sorts every row in one task. Here
the frame is range-partitioned by the sort key, sorted, numbered within each range and written
once under the shared checkpoint folder; the ranges are shifted by the prefix
sum of the preceding ranges' sizes -- a table of one row per partition. Range numbers
and places are stored with the rows, so the sizes and the rows come from the same
ranges whatever is planned, pruned or lost afterwards.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored

_RANGE_BITS = 33          # monotonically_increasing_id: partition number above, row number below


def dense_index(df: DataFrame, order: Sequence, out: str = "id", start: int = 1) -> DataFrame:
    """Row number (from ``start``) of every row in the global ``order``;
    give distinct rows to get a dense rank. Rows that tie are numbered in any order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    place, taken = "_place", {c.lower() for c in df.columns}
    while place in taken:
        place += "_"
    ranged = stored(df.orderBy(*cols).withColumn(place, F.monotonically_increasing_id()), "ids")
    number = F.shiftright(place, _RANGE_BITS)
    sizes = ranged.groupBy(number.alias(f"{place}range")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a short window and a bounded broadcast
    before = F.sum("_n").over(Window.orderBy(f"{place}range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(f"{place}range", F.coalesce(before, F.lit(0)).alias(f"{place}before"))
    local = F.col(place).bitwiseAND((1 << _RANGE_BITS) - 1)
    return ranged.withColumn(f"{place}range", number).join(F.broadcast(offsets), f"{place}range") \
        .withColumn(out, (F.col(f"{place}before") + local + F.lit(start)).cast("bigint")) \
        .drop(place, f"{place}range", f"{place}before")
