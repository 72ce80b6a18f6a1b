"""Scans, projections, counts, and changes of catalog tables.

A query that changes a table makes one of its own, in the shared scratch folder,
and returns the rows the table ends with.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.columns import add_audit_columns, add_column, normalize_timestamps
from ..operators.latest import latest_per_key
from ..operators.rowlevel import delete_where, update_where
from ..operators.validation import compare_counts, sample_rows, schema_rows
from ..session import scratch_path
from ..sources import tables
from ..sources.detect import read_csv_detected, read_json_detected, read_parquet_union
from ..sources.files import read_csv_inferred, read_table_files
from ..sources.tables import Layout
from .registry import load, register
from .rowlevel import ORDER_COLUMNS, SCATTERED, scattered_changes, user_state

PARQUET_INPUT = "org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat"


def _fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


# --- scans ---------------------------------------------------------------------


@register("scan_dispatch", "SELECT * FROM orders")
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table_files(spark, f"{sf_dir}/orders", PARQUET_INPUT)


@register("scan_csv", "SELECT * FROM part")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    folder = scratch_path(spark) + "/"
    part.write.csv(folder, header=True)
    return read_table_files(spark, folder, "org.apache.hadoop.mapred.TextInputFormat", part.schema)


@register("scan_json", "SELECT * FROM customer")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    folder = scratch_path(spark) + "/"
    customer.write.json(folder)
    found = read_table_files(spark, folder, "org.openx.data.jsonserde.JsonInputFormat")
    return found.select(F.col("c_custkey"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


@register("scan_csv_inferred", "SELECT * FROM orders")
def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    load(spark, sf_dir, "orders").write.csv(folder, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    found = read_csv_inferred(spark, folder)
    return found.select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority",
    )


# Parts of a table by key, and how each is written.
_PART_DIALECTS = (
    {"sep": ","}, {"sep": ";"}, {"sep": "\t", "quoteAll": True}, {"sep": "|", "quote": "'", "escape": "'"},
)


@register("scan_csv_detected", "SELECT p_partkey, p_name || ', \"' || p_brand || '\"; it''s' AS p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def scan_csv_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder, four dialects, cells that hold delimiters and quotation marks."""
    text = F.concat("p_name", F.lit(', "'), "p_brand", F.lit("\"; it's"))
    part, folder = load(spark, sf_dir, "part").withColumn("p_name", text), scratch_path(spark) + "/"
    for k, dialect in enumerate(_PART_DIALECTS):
        rows = part.where(F.col("p_partkey") % len(_PART_DIALECTS) == k)
        rows.write.options(header=True, **{"escape": '"', **dialect}).csv(f"{folder}{k}")
    return read_table_files(spark, folder, "org.apache.hadoop.mapred.TextInputFormat")


@register(
    "scan_csv_headless",
    """SELECT o_orderkey AS column0, o_orderstatus AS column1, o_totalprice AS column2, o_orderdate AS column3,
    CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS column4, CAST(o_orderdate AS DATE) AS column5,
    o_totalprice > 100000 AS column6 FROM orders""",
)
def scan_csv_headless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No header, and cells of every type that is found, empty ones too."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), F.to_date("o_orderdate"), F.col("o_totalprice") > 100000,
    )
    folder = scratch_path(spark) + "/"
    orders.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(folder, sep="|")
    return read_csv_detected(spark, folder)


@register(
    "scan_json_detected",
    """SELECT o_orderkey, o_totalprice, o_orderstatus,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS note,
    o_custkey AS buyer_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS buyer_rank FROM orders""",
)
def scan_json_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows an object a line, half an array a file, with different nested members."""
    orders, folder = load(spark, sf_dir, "orders"), scratch_path(spark) + "/"
    even, odd = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    flat = even.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("note"),
        F.struct(F.col("o_custkey").alias("id")).alias("buyer"),
    )
    flat.write.json(folder + "lines")
    row = F.struct(
        "o_orderkey", "o_totalprice", "o_orderstatus",
        F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("rank")).alias("buyer"),
    )
    # A partition is a file: every array has the rows of a few thousand keys.
    key = F.expr("o_orderkey div 4000").alias("part")
    arrays = odd.groupBy(key).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.write.partitionBy("part").format("text").save(folder + "arrays")
    found = read_json_detected(spark, folder, "part-*")
    return found.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "note",
        F.col("buyer.id").alias("buyer_id"), F.col("buyer.rank").alias("buyer_rank"),
    )


@register(
    "scan_parquet_union",
    """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, NULL AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, c_name, c_nationkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1""",
)
def scan_parquet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads: an int that became a bigint, a column that went and one that came."""
    customer, folder = load(spark, sf_dir, "customer"), scratch_path(spark)
    customer.where("c_custkey % 2 = 0").drop("c_mktsegment").write.parquet(f"{folder}/1")
    later = customer.where("c_custkey % 2 = 1").drop("c_acctbal")
    later.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).write.parquet(f"{folder}/2")
    return read_parquet_union(spark, [f"{folder}/1", f"{folder}/2"])


# --- projections ---------------------------------------------------------------


@register(
    "audit_columns",
    "SELECT *, TIMESTAMP '2024-01-31 12:00:00' AS processed_at, 'transformed' AS processing_status FROM customer",
)
def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return add_audit_columns(load(spark, sf_dir, "customer"), "transformed", as_of)


@register("project_subset", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def project_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@register(
    "normalize_timestamps",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, 'timestamp' AS type_name FROM orders",
)
def normalize_timestamps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_timestamps(load(spark, sf_dir, "orders")).select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.typeof("o_orderdate").alias("type_name"),
    )


@register("add_column", "SELECT *, CAST(NULL AS VARCHAR) AS source_system FROM supplier")
def add_column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_column(load(spark, sf_dir, "supplier"), "source_system", "string", "where the row came from")


# --- counts and samples --------------------------------------------------------


@register(
    "compare_counts",
    """
    SELECT (SELECT count(*) FROM orders) AS source_count,
        (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS target_count,
        (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS matches
    """,
)
def compare_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return compare_counts(orders, orders.where("o_orderstatus <> 'P'"))


@register("sample_ordered", "SELECT * FROM part ORDER BY p_retailprice NULLS LAST, p_partkey NULLS LAST LIMIT 10")
def sample_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(load(spark, sf_dir, "part"), "p_retailprice", "p_partkey")


# --- catalog tables ------------------------------------------------------------


def _made(df: DataFrame, prefix: str, layout: Layout = Layout()) -> str:
    """A table of these rows under a new name."""
    name = _fresh(prefix)
    tables.create_from(df, name, scratch_path(df.sparkSession), layout)
    return name


@register(
    "table_create_like",
    "SELECT (SELECT count(*) FROM lineitem) AS source_count, CAST(0 AS BIGINT) AS target_count, false AS matches",
)
def table_create_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, name = load(spark, sf_dir, "lineitem"), _fresh("like")
    tables.create_like(lines, name, scratch_path(spark))
    return compare_counts(lines, spark.table(name))


@register("table_create_if_absent", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def table_create_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    name = _made(orders.where("o_orderstatus = 'F'"), "absent")
    tables.create_from(orders, name)
    return spark.table(name)


@register("table_append", "SELECT * FROM orders")
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, name = load(spark, sf_dir, "orders"), _fresh("append")
    tables.create_table(spark, name, orders.schema, scratch_path(spark))
    tables.append(orders.where("o_orderstatus = 'O'"), name)
    tables.append(orders.where("o_orderstatus <> 'O'").select(*reversed(orders.columns)), name)
    return spark.table(name)


@register("table_overwrite", "SELECT * FROM part WHERE p_size > 25")
def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    name = _made(part, "overwrite")
    tables.overwrite(part.where("p_size > 25"), name)
    return spark.table(name)


@register("table_replace", "SELECT c_custkey, c_name FROM customer")
def table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _made(load(spark, sf_dir, "customer"), "replace")
    tables.replace(spark.table(name).select("c_custkey", "c_name"), name)
    return spark.table(name)


@register("table_rewrite", "SELECT * FROM orders WHERE o_totalprice >= 100000")
def table_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _made(load(spark, sf_dir, "orders"), "rewrite")
    tables.rewrite(spark, name, lambda orders: delete_where(orders, F.col("o_totalprice") < 100000))
    return spark.table(name)


@register("table_add_column", "SELECT *, CAST(NULL AS VARCHAR) AS source_system FROM supplier")
def table_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _made(load(spark, sf_dir, "supplier"), "widen")
    tables.add_table_column(spark, name, "source_system", "string", "where the row came from")
    return spark.table(name)


@register(
    "table_copy",
    "SELECT count(*) AS source_count, count(*) AS target_count, true AS matches FROM lineitem",
)
def table_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    source = _made(lines, "source")
    target = _made(lines.limit(0), "target")
    return tables.copy_table(spark, source, target)


def _loaded(spark: SparkSession, sf_dir: str, keys: str | None) -> DataFrame:
    orders, name = load(spark, sf_dir, "orders"), _fresh("load")
    first = orders.where("o_orderdate < timestamp_ntz '2001-01-01 00:00:00'")
    second = orders.where("o_orderdate >= timestamp_ntz '2000-07-01 00:00:00'").withColumn("o_orderstatus", F.lit("F"))
    tables.load_table(first, name, keys, location=scratch_path(spark))
    tables.load_table(second, name, keys)
    return spark.table(name)


_TWO_LOADS = f"""
    WITH t AS (SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
    s AS (SELECT * REPLACE ('F' AS o_orderstatus) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-07-01')
"""


@register(
    "table_load_merge",
    _TWO_LOADS
    + "SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM s",
)
def table_load_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "o_orderkey")


@register("table_load_append", _TWO_LOADS + "SELECT * FROM t UNION ALL SELECT * FROM s")
def table_load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "NONE")


@register(
    "table_incremental_upsert",
    """
    WITH latest AS (
        SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    t AS (SELECT * FROM (
            SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-30'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        WHERE event_type <> 'error'),
    s AS (SELECT * FROM latest WHERE ts > (SELECT max(ts) FROM t))
    SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id)
    UNION ALL SELECT * FROM s
    """,
)
def table_incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    name = _made(user_state(events), "state")
    source = latest_per_key(events, ["user_id"], "ts", ["event_id"])
    tables.incremental_upsert_table(source, name, ["user_id"], "ts")
    return spark.table(name)


# --- partitioned and bucketed tables ---------------------------------------------

_BY_STATUS = Layout(partition_by=("o_orderstatus", "o_orderpriority"), properties={"purpose": "test"})


@register("merge_partitioned", SCATTERED)
def merge_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows change their partition here: the merge sets the status that the folders are named by."""
    orders = load(spark, sf_dir, "orders")
    name = _made(orders, "partitioned", _BY_STATUS)
    tables.load_table(scattered_changes(orders), name, "o_orderkey")
    return spark.table(name)


@register("append_partitioned", "SELECT * FROM orders")
def append_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    name = _made(orders.where("o_orderstatus = 'O'"), "partitioned", _BY_STATUS)
    tables.load_table(orders.where("o_orderstatus <> 'O'"), name)
    return spark.table(name)


@register(
    "update_partitioned",
    "SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM orders",
)
def update_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on the partition columns: two folders of all are read and written."""
    name = _made(load(spark, sf_dir, "orders"), "partitioned", _BY_STATUS)
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    tables.rewrite(spark, name, lambda t: update_where(t, low, {"o_orderstatus": "F"}), touching=low)
    return spark.table(name)


@register("delete_partitioned", "SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000")
def delete_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders of one status become empty and are dropped."""
    name = _made(load(spark, sf_dir, "orders"), "partitioned", _BY_STATUS)
    for which in (F.col("o_orderstatus") == "P", F.col("o_totalprice") < 50000):
        tables.rewrite(spark, name, lambda t, which=which: delete_where(t, which), touching=which)
    return spark.table(name)


@register("overwrite_partitioned", "SELECT * FROM orders WHERE o_orderpriority < '3'")
def overwrite_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _made(load(spark, sf_dir, "orders"), "partitioned", _BY_STATUS)
    tables.overwrite(spark.table(name).where("o_orderpriority < '3'"), name)
    return spark.table(name)


@register("merge_bucketed", SCATTERED)
def merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is joined bucket by bucket; only the source is shuffled."""
    orders = load(spark, sf_dir, "orders")
    name = _made(orders, "bucketed", Layout(bucket_by=("o_orderkey",), buckets=16, codec="zstd"))
    tables.load_table(scattered_changes(orders), name, "o_orderkey")
    return spark.table(name)


@register(
    "upsert_bucketed_composite",
    """
    WITH s AS (SELECT * REPLACE (l_quantity * 2 AS l_quantity) FROM lineitem WHERE l_returnflag = 'R')
    SELECT * FROM lineitem l WHERE NOT EXISTS (
        SELECT 1 FROM s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber)
    UNION ALL SELECT * FROM s
    """,
)
def upsert_bucketed_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, keys = load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    name = _made(lines, "bucketed", Layout(bucket_by=keys, buckets=8))
    tables.upsert_table(lines.where("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") * 2), name, keys)
    return spark.table(name)


# --- loads whose schema changes --------------------------------------------------


@register(
    "load_evolving",
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name,
        CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 5000000000 ELSE s_nationkey END AS s_nationkey, s_acctbal,
        CASE WHEN s_suppkey % 3 = 0 THEN 'seen' END AS remark
    FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AND s_suppkey % 2 = 0
    UNION ALL
    SELECT s_suppkey, upper(s_name), s_nationkey + 5000000000, NULL, 'seen' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1
    """,
)
def load_evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that brings a new column and a wider type, and lacks a column."""
    supplier = load(spark, sf_dir, "supplier")
    name = _made(supplier.where("s_suppkey % 2 = 0"), "evolving")
    later = supplier.where("s_suppkey % 3 = 0").select(
        "s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_nationkey") + 5_000_000_000).alias("s_nationkey"), F.lit("seen").alias("remark")
    )
    tables.load_table(later, name, "s_suppkey", evolve=True)
    return spark.table(name)


@register(
    "table_extents",
    """
    SELECT (SELECT count(*) FROM orders) AS rows, min(o_orderkey) AS low_key, max(o_orderkey) AS high_key,
        min(o_orderdate) AS low_date, max(o_orderdate) AS high_date FROM orders
    """,
)
def table_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and high marks from the footers of the table's files."""
    name = _made(load(spark, sf_dir, "orders"), "extents")
    found = tables.table_extents(spark, name, ["o_orderkey", "o_orderdate"])
    (low, high), (first, last) = found["o_orderkey"], found["o_orderdate"]
    return spark.range(1).select(
        F.lit(found["rows"]).alias("rows"), low.alias("low_key"), high.alias("high_key"), first.alias("low_date"), last.alias("high_date")
    )


# --- the rest of the reference's table operations ----------------------------------


@register(
    "schema_as_rows",
    """
    SELECT row_number() OVER ()::INT AS position, column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
        WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS data_type, true AS nullable, CAST(NULL AS VARCHAR) AS comment
    FROM (DESCRIBE orders)
    UNION ALL SELECT 7, 'source_system', 'string', true, 'where the row came from'
    """,
)
def schema_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _made(load(spark, sf_dir, "orders"), "described")
    tables.add_table_column(spark, name, "source_system", "string", "where the row came from")
    return schema_rows(spark.table(name))


@register("named_frame", "SELECT c_mktsegment, count(*) AS customers, max(c_acctbal) AS most FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def named_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame under a name that SQL text uses."""
    customer = load(spark, sf_dir, "customer").where("c_acctbal > 0")
    return spark.sql("SELECT c_mktsegment, count(*) AS customers, max(c_acctbal) AS most FROM {rich} GROUP BY c_mktsegment", rich=customer)


@register(
    "declared_rows",
    """SELECT n_nationkey, n_name, n_regionkey, r.label FROM nation
    JOIN (VALUES (0, 'first'), (1, 'second'), (3, CAST(NULL AS VARCHAR))) r(k, label) ON n_regionkey = r.k""",
)
def declared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a declared schema, put into a table and joined."""
    name = _fresh("declared")
    tables.create_table(spark, name, "region_key int, label string", scratch_path(spark))
    tables.append(spark.createDataFrame([(0, "first"), (1, "second"), (3, None)], "region_key int, label string"), name)
    nation = load(spark, sf_dir, "nation")
    return nation.join(spark.table(name), F.col("n_regionkey") == F.col("region_key")).drop("region_key")


@register("first_rows", "SELECT count(*) AS n, 5 AS shown FROM (SELECT * FROM part LIMIT 5)")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = load(spark, sf_dir, "part").limit(5)
    return shown.agg(F.count(F.lit(1)).alias("n")).withColumn("shown", F.lit(5))


@register(
    "table_properties",
    "SELECT count(*) AS n, 'zstd' AS codec, 'ann' AS owner, 'daily' AS cadence FROM lineitem",
)
def table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec and properties stay through a change of the table."""
    name = _made(load(spark, sf_dir, "lineitem"), "properties", Layout(codec="zstd", properties={"owner.name": "ann"}))
    tables.set_properties(spark, name, {"cadence": "daily"})
    tables.rewrite(spark, name, lambda t: update_where(t, F.col("l_tax") > 0, {"l_tax": 0}))
    layout = tables.table_layout(spark, name)
    return spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(layout.codec).alias("codec"), F.lit(layout.properties["owner.name"]).alias("owner"), F.lit(layout.properties["cadence"]).alias("cadence")
    )


def _unchanged_by_a_failure(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    name = _made(load(spark, sf_dir, "orders"), "failing", layout)
    last = F.raise_error(F.lit("a task that fails")).cast("double")
    total = F.when(F.col("o_orderkey") % 977 == 5, last).otherwise(F.col("o_totalprice") * 2)
    try:
        tables.rewrite(spark, name, lambda t: t.withColumn("o_totalprice", total))
    except PySparkException:
        return spark.table(name)
    raise AssertionError("the change did not fail")


@register("failed_change", "SELECT * FROM orders")
def failed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task fails midway; the table is as it was."""
    return _unchanged_by_a_failure(spark, sf_dir, Layout())


@register("failed_change_partitioned", "SELECT * FROM orders")
def failed_change_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unchanged_by_a_failure(spark, sf_dir, _BY_STATUS)
