"""Row-level changes over orders, lineitem, customer and events.

Earlier and later states of a table are cut out of it by date or status, so that
target and source together cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.columns import conform
from ..operators.keyfilter import change_touched_rows
from ..operators.latest import latest_per_key
from ..operators.rowlevel import (
    change_in_key_range,
    count_unstamped,
    delete_insert,
    delete_matching,
    delete_where,
    incremental_extract,
    incremental_upsert,
    insert_partial,
    keep_matching,
    latest_then_replace,
    merge_upsert,
    update_where,
    upsert_metrics,
)
from .registry import load, register

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- deletes and updates -------------------------------------------------------


@register(
    "delete_where",
    """
    WITH t AS (SELECT * REPLACE (CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS o_orderstatus) FROM orders)
    SELECT * FROM t WHERE NOT coalesce(o_orderstatus = 'F', false)
    """,
)
def delete_where_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    orders = load(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(~low, F.col("o_orderstatus")))
    return delete_where(orders, F.col("o_orderstatus") == "F")


@register(
    "delete_in_keys",
    """
    SELECT * FROM customer c WHERE NOT EXISTS (
        SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2001-01-01')
    """,
)
def delete_in_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_matching(load(spark, sf_dir, "customer"), _recent_buyers(spark, sf_dir), ["c_custkey"])


@register(
    "keep_in_keys",
    """
    SELECT * FROM customer c WHERE EXISTS (
        SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2001-01-01')
    """,
)
def keep_in_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_matching(load(spark, sf_dir, "customer"), _recent_buyers(spark, sf_dir), ["c_custkey"])


@register(
    "delete_composite_keys",
    """
    SELECT * FROM lineitem l WHERE NOT EXISTS (
        SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'R'
        AND s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber)
    """,
)
def delete_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return delete_matching(lines, lines.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


def _recent_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _at("2001-01-01 00:00:00"))
    return recent.select(F.col("o_custkey").alias("c_custkey"))


@register(
    "update_in_list",
    """
    SELECT c_custkey, c_name, c_nationkey,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1250.0 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'HEAVY' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def update_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return update_where(load(spark, sf_dir, "customer"), heavy, {"c_acctbal": 1250, "c_mktsegment": "HEAVY"})


@register(
    "update_less_than",
    """
    SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_name END AS c_name,
        CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal) FROM customer
    """,
)
def update_less_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    return update_where(customer, F.col("c_acctbal") < 0, {"c_name": "in debt", "c_acctbal": F.col("c_acctbal") * 2})


# --- inserts -------------------------------------------------------------------


@register(
    "append_rows",
    """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
    UNION ALL VALUES (-1, 'A', 1, 10.5), (-2, 'B', 2, NULL)
    """,
)
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier")
    rows = spark.sql(
        "SELECT * FROM VALUES (10.5D, -1, 'A', 1), (NULL, -2, 'B', 2) AS t(s_acctbal, s_suppkey, s_name, s_nationkey)"
    )
    return supplier.unionByName(conform(rows, supplier.schema))


@register(
    "insert_partial",
    """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_nationkey, NULL FROM customer
    """,
)
def insert_partial_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").selectExpr(
        "c_name AS s_name", "c_custkey AS s_suppkey", "c_nationkey AS s_nationkey"
    )
    return insert_partial(load(spark, sf_dir, "supplier"), rows)


# --- merges --------------------------------------------------------------------

_MERGE_ORDERS = """
    WITH base AS ({base}),
    t AS (SELECT * FROM base WHERE o_orderdate < TIMESTAMP '2001-01-01'),
    s AS (SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate,
            CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority
        FROM base WHERE o_orderdate >= TIMESTAMP '2000-07-01')
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)
    UNION ALL SELECT * FROM s
"""


def _order_states(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    target = base.where(F.col("o_orderdate") < _at("2001-01-01 00:00:00"))
    source = base.where(F.col("o_orderdate") >= _at("2000-07-01 00:00:00")).withColumns(
        {
            "o_orderstatus": F.lit("F"),
            "o_totalprice": F.col("o_totalprice") + 1,
            "o_orderpriority": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        }
    )
    return target, source


@register("merge_upsert", _MERGE_ORDERS.format(base=f"SELECT {ORDER_COLUMNS} FROM orders"))
def merge_upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_upsert(*_order_states(load(spark, sf_dir, "orders")), ["o_orderkey"])


@register("merge_in_key_range", _MERGE_ORDERS.format(base=f"SELECT {ORDER_COLUMNS} FROM orders"))
def merge_in_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _order_states(load(spark, sf_dir, "orders"))
    return change_in_key_range(target, source, "o_orderkey", lambda t: merge_upsert(t, source, ["o_orderkey"]))


# One key in a hundred, over the whole range, and some that are new.
SCATTERED = f"""
    WITH s AS (
        SELECT * REPLACE ('F' AS o_orderstatus, o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderkey % 100 = 7
        UNION ALL
        SELECT * REPLACE (o_orderkey + 10000000000 AS o_orderkey) FROM orders WHERE o_orderkey % 500 = 3)
    SELECT {ORDER_COLUMNS} FROM orders o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = o.o_orderkey)
    UNION ALL SELECT {ORDER_COLUMNS} FROM s
"""


def scattered_changes(orders: DataFrame) -> DataFrame:
    changed = orders.where("o_orderkey % 100 = 7").withColumns(
        {"o_orderstatus": F.lit("F"), "o_totalprice": F.col("o_totalprice") + 1}
    )
    new = orders.where("o_orderkey % 500 = 3").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000_000)
    return changed.unionByName(new)


@register("merge_random_keys", SCATTERED)
def merge_random_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    source, keys = scattered_changes(orders), ["o_orderkey"]
    return change_touched_rows(orders, source, keys, lambda t: merge_upsert(t, source, keys), least_rows=0)


@register("upsert_random_composite_keys", """
    WITH s AS (SELECT * REPLACE (l_quantity * 2 AS l_quantity) FROM lineitem WHERE l_orderkey % 50 = 11 AND l_linenumber < 3)
    SELECT * FROM lineitem l WHERE NOT EXISTS (
        SELECT 1 FROM s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber)
    UNION ALL SELECT * FROM s
    """)
def upsert_random_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, keys = load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    source = lines.where("l_orderkey % 50 = 11 AND l_linenumber < 3").withColumn("l_quantity", F.col("l_quantity") * 2)
    return change_touched_rows(lines, source, keys, lambda t: delete_insert(t, source, keys), least_rows=0)


@register(
    "merge_null_keys",
    _MERGE_ORDERS.format(
        base="SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS o_orderkey, "
        "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
    ),
)
def merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    orders = load(spark, sf_dir, "orders").withColumn("o_orderkey", F.when(~urgent, F.col("o_orderkey")))
    return merge_upsert(*_order_states(orders), ["o_orderkey"])


@register(
    "merge_listed_columns",
    """
    WITH t AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    s AS (SELECT c_custkey, c_acctbal * 2 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_acctbal < 5000)
    SELECT t.c_custkey, t.c_name, t.c_nationkey,
        CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal, t.c_mktsegment
    FROM t LEFT JOIN s ON s.c_custkey = t.c_custkey
    UNION ALL
    SELECT c_custkey, NULL, NULL, c_acctbal, c_mktsegment FROM s
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c_custkey = s.c_custkey)
    """,
)
def merge_listed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    source = customer.where("c_acctbal < 5000").selectExpr("c_custkey", "c_acctbal * 2 AS c_acctbal", "'NEW' AS c_mktsegment")
    return merge_upsert(customer.where("c_mktsegment <> 'MACHINERY'"), source, ["c_custkey"], ["c_acctbal"])


@register(
    "merge_many_targets",
    """
    WITH s AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
    SELECT l.* REPLACE (CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE l_linestatus END AS l_linestatus)
    FROM lineitem l LEFT JOIN s ON s.o_orderkey = l.l_orderkey
    UNION ALL BY NAME
    SELECT o_orderkey AS l_orderkey, o_orderstatus AS l_linestatus FROM s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.o_orderkey)
    """,
)
def merge_many_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _at("2000-01-01 00:00:00"))
    source = recent.selectExpr("o_orderkey AS l_orderkey", "o_orderstatus AS l_linestatus")
    return merge_upsert(load(spark, sf_dir, "lineitem"), source, ["l_orderkey"])


# --- delete and insert ---------------------------------------------------------

_LINES = """
    WITH t AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'),
    s AS (SELECT * REPLACE ('X' AS l_returnflag) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-07-01'),
    kept AS (SELECT * FROM t WHERE NOT EXISTS (
        SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber))
"""


def _line_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf_dir, "lineitem")
    source = lines.where(F.col("l_shipdate") >= _at("1999-07-01 00:00:00")).withColumn("l_returnflag", F.lit("X"))
    return lines.where(F.col("l_shipdate") < _at("2000-01-01 00:00:00")), source


@register("delete_insert_composite", _LINES + "SELECT * FROM kept UNION ALL SELECT * FROM s")
def delete_insert_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_insert(*_line_states(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@register(
    "delete_insert_columns",
    _LINES + "SELECT * FROM kept UNION ALL BY NAME SELECT l_orderkey, l_linenumber, l_returnflag FROM s",
)
def delete_insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return delete_insert(*_line_states(spark, sf_dir), keys, insert_columns=[*keys, "l_returnflag"])


@register(
    "delete_insert_metrics",
    _LINES
    + """
    SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM kept) AS deleted,
        (SELECT count(*) FROM s) AS inserted,
        (SELECT count(*) FROM kept) + (SELECT count(*) FROM s) AS total_in_target
    """,
)
def delete_insert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_metrics(*_line_states(spark, sf_dir), ["l_orderkey", "l_linenumber"])


# --- latest row and incremental upsert -----------------------------------------

_LATEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1"


@register("latest_per_key", f"SELECT * FROM events {_LATEST}")
def latest_per_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(load(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"])


# The state was loaded before the last day, without the users whose last event was an error.
_STATE = f"""
    WITH t AS (SELECT * FROM (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-30' {_LATEST}) WHERE event_type <> 'error')
"""
_STEP = (
    _STATE
    + f""",
    s AS (SELECT * FROM (SELECT * FROM events {_LATEST}) WHERE ts > (SELECT max(ts) FROM t)),
    kept AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id))
"""
)


def user_state(events: DataFrame) -> DataFrame:
    """The latest event of each user as it was loaded before the last day."""
    earlier = events.where(F.col("ts") < _at("2024-01-30 00:00:00"))
    return latest_per_key(earlier, ["user_id"], "ts", ["event_id"]).where("event_type <> 'error'")


def user_state_upsert(spark: SparkSession, sf_dir: str):
    """Bring the latest event of each user up to date."""
    events = load(spark, sf_dir, "events")
    source = latest_per_key(events, ["user_id"], "ts", ["event_id"])
    return incremental_upsert(source, user_state(events), ["user_id"], "ts")


@register("incremental_upsert", _STEP + "SELECT * FROM kept UNION ALL SELECT * FROM s")
def incremental_upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_state_upsert(spark, sf_dir).rows


@register(
    "upsert_metrics",
    _STEP
    + """
    SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM kept) AS deleted,
        (SELECT count(*) FROM s) AS inserted,
        (SELECT count(*) FROM kept) + (SELECT count(*) FROM s) AS total_in_target
    """,
)
def upsert_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_state_upsert(spark, sf_dir).metrics


@register(
    "latest_then_replace",
    _STATE
    + f""",
    s AS (SELECT * FROM events WHERE event_type IN ('purchase', 'signup') AND ts >= TIMESTAMP '2024-01-29'),
    staged AS (SELECT * FROM s {_LATEST})
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM staged WHERE staged.user_id = t.user_id)
    UNION ALL SELECT * FROM staged
    """,
)
def latest_then_replace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    source = events.where(
        F.col("event_type").isin("purchase", "signup") & (F.col("ts") >= _at("2024-01-29 00:00:00"))
    )
    return latest_then_replace(user_state(events), source, ["user_id"], "ts", ["event_id"])


@register(
    "incremental_extract",
    "SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-15')",
)
def incremental_extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    loaded = events.where((F.col("event_type") == "purchase") & (F.col("ts") < _at("2024-01-15 00:00:00")))
    return incremental_extract(events, loaded, "ts")


@register("incremental_first_load", "SELECT * FROM events")
def incremental_first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return incremental_extract(events, events.where(F.lit(False)), "ts")


@register("count_unstamped", "SELECT count(*) AS unstamped FROM events WHERE event_type = 'error'")
def count_unstamped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_type") != "error", F.col("ts"))
    return count_unstamped(load(spark, sf_dir, "events").withColumn("ts", stamp), "ts")
