"""DuckDB SQL twins of ``cairn.plans.views`` for the oracle check.

``W("actions", "item_dim")`` returns a ``WITH`` clause defining the named
views (and the views they depend on) over the pre-registered tables.
"""

from __future__ import annotations

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "actions": ((), """
        SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
               CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS type,
               l.l_quantity AS value, o.o_orderdate AS ts,
               CAST(epoch(o.o_orderdate) AS BIGINT) AS t,
               l.l_orderkey AS order_key, l.l_linenumber AS line_no
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "clicks": ((), """
        SELECT event_id, user_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
               event_type, value, ts, epoch_us(ts) AS t_us
        FROM events"""),
    "impressions": (("clicks",), """
        SELECT event_id, 'c' || CAST(user_id % 3 AS VARCHAR) AS consumer, user_id,
               CASE WHEN event_type = 'view' THEN 'IMP' ELSE 'CTR' END AS click,
               CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'normal' END AS abkey,
               CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'rt' || CAST(item_id % 4 AS VARCHAR) END AS rectag,
               CAST(item_id AS VARCHAR) || ':' || CAST((item_id + 1) % 100 AS VARCHAR) || ':'
                 || CAST((item_id + 7) % 100 AS VARCHAR) AS recommendations,
               item_id, ts, t_us
        FROM clicks WHERE event_type IN ('view', 'click')"""),
    "item_attributes": ((), """
        SELECT p_partkey AS item_id, 'brand' AS attr, p_brand AS value FROM part
        UNION ALL SELECT p_partkey, 'type', p_type FROM part
        UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part"""),
    "dimensions": (("item_attributes",), """
        SELECT attr, value, CAST(dense_rank() OVER (ORDER BY attr, value) AS INTEGER) AS dim_id
        FROM (SELECT DISTINCT attr, value FROM item_attributes)"""),
    "item_dim": (("item_attributes", "dimensions"), """
        SELECT a.item_id, d.dim_id, a.attr
        FROM item_attributes a JOIN dimensions d ON a.attr = d.attr AND a.value = d.value"""),
    "item_tags": ((), """
        SELECT p_partkey AS item_id,
               array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))), ',') AS tags
        FROM part"""),
    "item_tag": (("item_tags",), """
        SELECT DISTINCT item_id, tag FROM (
          SELECT item_id, unnest(string_split(tags, ',')) AS tag FROM item_tags) WHERE tag <> ''"""),
    "order_baskets": ((), """
        SELECT DISTINCT l.l_orderkey AS basket_id, p.p_brand AS item
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for dep in VIEW_SQL[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def W(*names: str) -> str:
    """WITH clause for the given views; extend with ``, x AS (...)``."""
    parts = [f"{n} AS ({VIEW_SQL[n][1]})" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n"
