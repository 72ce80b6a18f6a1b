"""Quality checks over events and orders, scores over documents, names over customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import (
    allowed_values,
    check_state,
    column_exists,
    evaluate_checks,
    evaluate_state,
    merge_states,
    not_null,
    parses_as_timestamp,
    quality_points,
    resolve_assets,
    run_checks,
    score_checks,
)
from .registry import load, register

_EVENT_CHECKS = (
    not_null("user_id"),
    allowed_values("event_type", ["click", "view", "purchase", "signup"]),
    column_exists("age"),
    column_exists("value"),
    not_null("age"),
    parses_as_timestamp("ts"),
    parses_as_timestamp("props"),
)


def _flat(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {"types": F.array_join("types", ","), "applicableFields": F.array_join("applicableFields", ",")}
    )


@register(
    "dq_checks",
    """
    SELECT 'Completeness' AS types, 'user_id not null' AS description, 'user_id' AS "applicableFields",
        CASE WHEN count(*) FILTER (user_id IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM events
    UNION ALL SELECT 'Validity', 'event_type in allowed values', 'event_type', CASE WHEN count(*) FILTER
        (event_type NOT IN ('click', 'view', 'purchase', 'signup')) = 0 THEN 'PASS' ELSE 'FAIL' END FROM events
    UNION ALL SELECT 'Validity', 'age column exists', 'age', 'FAIL'
    UNION ALL SELECT 'Validity', 'value column exists', 'value', 'PASS'
    UNION ALL SELECT 'Completeness', 'age not null', 'age', 'FAIL'
    UNION ALL SELECT 'Validity', 'ts parses as timestamp', 'ts', CASE WHEN count(*) FILTER
        (ts IS NOT NULL AND TRY_CAST(ts AS TIMESTAMP) IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END FROM events
    UNION ALL SELECT 'Validity', 'props parses as timestamp', 'props', CASE WHEN count(*) FILTER
        (props IS NOT NULL AND TRY_CAST(props AS TIMESTAMP) IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END FROM events
    """,
)
def dq_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(run_checks(load(spark, sf_dir, "events"), _EVENT_CHECKS))


# Each order priority is an asset. Status is missing in one of them.
_ORDER_CHECKS = (not_null("o_orderstatus"), allowed_values("o_orderstatus", ["F", "O", "P"]), column_exists("age"))

_ORDER_STATUSES = """
    WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS st FROM orders),
    c AS (SELECT o_orderpriority,
        CASE WHEN count(*) FILTER (st IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS filled,
        CASE WHEN count(*) FILTER (st NOT IN ('F', 'O', 'P')) = 0 THEN 'PASS' ELSE 'FAIL' END AS allowed
        FROM o GROUP BY o_orderpriority)
"""


def _orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    return load(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(~low, F.col("o_orderstatus")))


@register(
    "dq_checks_by_asset",
    _ORDER_STATUSES
    + """
    SELECT o_orderpriority, 'Completeness' AS types, 'o_orderstatus not null' AS description,
        'o_orderstatus' AS "applicableFields", filled AS status FROM c
    UNION ALL SELECT o_orderpriority, 'Validity', 'o_orderstatus in allowed values', 'o_orderstatus', allowed FROM c
    UNION ALL SELECT o_orderpriority, 'Validity', 'age column exists', 'age', 'FAIL' FROM c
    """,
)
def dq_checks_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(run_checks(_orders_with_gaps(spark, sf_dir), _ORDER_CHECKS, ["o_orderpriority"]))


@register(
    "dq_points",
    _ORDER_STATUSES
    + """
    , n AS (SELECT *, (filled = 'PASS')::INT + (allowed = 'PASS')::INT AS passed FROM c)
    SELECT o_orderpriority AS "entityIdentifier", 'ASSET' AS "entityType", 'checks' AS "formName",
        TIMESTAMP '2024-01-31 00:00:00' AS "timestamp", 'quality' AS "typeIdentifier", '7' AS "typeRevision",
        '{"evaluations":['
        || '{"types":["Completeness"],"description":"o_orderstatus not null","status":"' || filled
        || '","applicableFields":["o_orderstatus"]},'
        || '{"types":["Validity"],"description":"o_orderstatus in allowed values","status":"' || allowed
        || '","applicableFields":["o_orderstatus"]},'
        || '{"types":["Validity"],"description":"age column exists","status":"FAIL","applicableFields":["age"]}'
        || '],"passingPercentage":' || trunc(passed::DOUBLE / 3 * 100)::INT || ',"evaluationsCount":3}' AS content
    FROM n
    """,
)
def dq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluated = evaluate_checks(_orders_with_gaps(spark, sf_dir), _ORDER_CHECKS, ["o_orderpriority"])
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return quality_points(evaluated, "o_orderpriority", "checks", "quality", "7", as_of)


@register(
    "dq_score",
    """
    SELECT source, count(*) AS "evaluationsCount",
        trunc(count(*) FILTER (quality = 1)::DOUBLE / count(*) * 100)::INT AS "passingPercentage"
    FROM documents JOIN labels USING (doc_id) GROUP BY source
    """,
)
def dq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    passed = F.when(F.col("toxic") == 1, "pass").otherwise("PASS")
    results = labelled.select("source", F.when(F.col("quality") == 1, passed).otherwise("FAIL").alias("status"))
    return score_checks(results, ["source"])


_NAMES = """
    WITH a AS (SELECT c_custkey AS identifier, upper(c_mktsegment) || '_' || c_nationkey AS name, c_mktsegment AS project
        FROM customer WHERE c_acctbal >= 0 {project}),
    f AS (SELECT lower(name) AS name, min(identifier) AS identifier FROM a GROUP BY lower(name))
    SELECT c.c_custkey, f.identifier AS asset_id
    FROM customer c LEFT JOIN f ON f.name = lower(c.c_mktsegment) || '_' || (c.c_nationkey + 5)
"""


def _names(spark: SparkSession, sf_dir: str, project: str | None) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    assets = customer.where("c_acctbal >= 0").selectExpr(
        "c_custkey AS identifier", "upper(c_mktsegment) || '_' || c_nationkey AS name", "c_mktsegment AS project"
    )
    names = customer.selectExpr("c_custkey", "initcap(c_mktsegment) || '_' || (c_nationkey + 5) AS name")
    return resolve_assets(names, assets, project=project).select("c_custkey", "asset_id")


@register("dq_resolve_asset", _NAMES.format(project=""))
def dq_resolve_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, None)


@register("dq_resolve_asset_in_project", _NAMES.format(project="AND c_mktsegment = 'BUILDING'"))
def dq_resolve_asset_in_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, "BUILDING")


_HALVES = """
    WITH counted AS (
        SELECT event_type, count(*) AS rows, count(*) FILTER (value > 100) AS large,
            count(*) FILTER (props IS NOT NULL AND TRY_CAST(props AS TIMESTAMP) IS NULL) AS no_stamp FROM events GROUP BY event_type)
"""


@register(
    "dq_state_merged",
    _HALVES
    + """
    SELECT event_type, 0 AS "check", rows, 0 AS failing, 0 AS absent FROM counted
    UNION ALL SELECT event_type, 1, rows, no_stamp, 0 FROM counted
    UNION ALL SELECT event_type, 2, rows, 0, 2 FROM counted
    """,
)
def dq_state_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of early events plus that of late ones."""
    events = load(spark, sf_dir, "events")
    checks = (not_null("user_id"), parses_as_timestamp("props"), column_exists("age"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return merge_states(*(check_state(events.where(part), checks, ["event_type"]) for part in (early, ~early)))


@register(
    "dq_checks_incremental",
    _HALVES
    + """
    SELECT event_type, 'user_id not null' AS description, 'PASS' AS status FROM counted
    UNION ALL SELECT event_type, 'props parses as timestamp', CASE WHEN no_stamp = 0 THEN 'PASS' ELSE 'FAIL' END FROM counted
    UNION ALL SELECT event_type, 'age column exists', 'FAIL' FROM counted
    """,
)
def dq_checks_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    checks = (not_null("user_id"), parses_as_timestamp("props"), column_exists("age"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    state = merge_states(*(check_state(events.where(part), checks, ["event_type"]) for part in (early, ~early)))
    return evaluate_state(state, checks).select("event_type", F.inline("evaluations")).select("event_type", "description", "status")
