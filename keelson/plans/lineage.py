"""Lineage queries over raw events whose text is put together from ``events``.

Each row of ``events`` becomes one raw event. Its type and the number in its
``props`` choose the shape: OpenLineage or generic, plain or inside a body, whole
or broken, with every combination of facets and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import derived_run_id
from ..functions.json import as_map
from ..operators.lineage import (
    LineageConfig,
    accepted_runs,
    classify_events,
    dataset_name,
    dataset_namespace,
    expand_runs,
    extract_schema_fields,
    extract_sql,
    lineage_documents,
    lineage_edges,
    lineage_results,
    parse_datasets,
    route_events,
    source_identifier,
    unwrap_events,
)
from .registry import load, register

CONFIG = LineageConfig(
    region="region-1", account_id="900", catalog="lake", database="main", default_schema="base", project_id="demo"
)

# One expression for both engines: k is the number in props.
_INPUT_NAME = """CASE WHEN k < 25 THEN 'u' || user_id WHEN k < 50 THEN 'sales.u' || user_id
    WHEN k < 75 THEN 'db.sales.u' || user_id ELSE 'cat.db.sales.u' || user_id END"""
_INPUTS = f"""CASE WHEN k = 95 THEN '' WHEN k = 96 THEN '"inputs":null,' WHEN k = 97 THEN '"inputs":[],'
    WHEN k = 94 THEN '"inputs":[{{}}],' WHEN k = 93 THEN '"inputs":["text"],' ELSE
    '"inputs":[{{"namespace":"n","name":"' || {_INPUT_NAME} || '"}},'
    || CASE WHEN k < 10 THEN '{{}}' WHEN k < 20 THEN '{{"namespace":"n"}}' WHEN k = 20 THEN '{{"name":null}}'
        ELSE '{{"name":"ref.' || event_type || '"}}' END || '],' END"""
_OUTPUTS = """CASE WHEN k = 92 THEN '"outputs":[{}]' WHEN k = 91 THEN '"outputs":[]'
    WHEN k = 90 THEN '"outputs":[{"name":"mart.t","facets":null}]'
    WHEN k >= 80 THEN '"outputs":[{"name":"mart.t","facets":{"schema":{"fields":[]}}}]'
    WHEN k >= 70 THEN '"outputs":[{"name":"t"},{"name":"second"}]'
    ELSE '"outputs":[{"name":"mart.' || event_type || '","facets":{"schema":{"fields":['
        || '{"name":"user_' || user_id || '","type":"long"},{"name":"value","type":"double"}]}}}]' END"""
_FACETS = """CASE WHEN k < 12 THEN ',"facets":{"sql":{"query":"select ' || user_id || '"},"dbt":{"raw_sql":"no"}}'
    WHEN k = 12 THEN ',"facets":{"sql":null}' WHEN k = 13 THEN ',"facets":{"sql":{}}'
    WHEN k = 14 THEN ',"facets":{"dbt":null}' WHEN k = 15 THEN ',"facets":null'
    WHEN k < 30 THEN ',"facets":{"dbt":{"compiled_sql":"compiled ' || user_id || '","raw_sql":"raw"}}'
    WHEN k < 45 THEN ',"facets":{"dbt":{"compiled_sql":"","raw_sql":"raw ' || user_id || '"}}'
    WHEN k < 50 THEN ',"facets":{"dbt":{"compiled_sql":null,"raw_sql":"raw ' || user_id || '"}}'
    WHEN k < 55 THEN ',"facets":{}' ELSE '' END"""
_RUN = """CASE WHEN k = 60 THEN '"run":null' WHEN k = 61 THEN '' WHEN k < 65 THEN '"run":{"runId":""}'
    WHEN k < 70 THEN '"run":{}' ELSE '"run":{"runId":"run-' || event_id || '"}' END"""
_TYPE = """CASE WHEN event_type = 'signup' THEN '"FAIL"' WHEN k = 50 THEN 'null'
    WHEN event_type = 'click' THEN '"START"' ELSE '"COMPLETE"' END"""
# k = 61 leaves the run out: the event is generic then, and rejected.
_OPENLINEAGE = f"""'{{"eventType":' || {_TYPE} || ',' || {_RUN} || CASE WHEN k = 61 THEN '' ELSE ',' END
    || '"job":{{"name":"job ' || user_id || '"' || {_FACETS} || '}},' || {_INPUTS} || {_OUTPUTS} || '}}'"""


def _table(account: str, table: str) -> str:
    return f"""'{{"account_id":"{account}","catalog":"c","database":"d","schema":"s","table":"' || {table} || '"}}'"""


_GENERIC = f"""'{{"source_tables":' || CASE WHEN k < 5 THEN '[]' WHEN k < 8 THEN '[{{"catalog":"c"}}]'
    ELSE '[' || {_table("901", "event_id")} || ',' || {_table("902", "'users'")} || ']' END
    || ',"target_table":' || CASE WHEN k = 8 THEN '{{}}' ELSE {_table("903", "event_type")} END
    || CASE WHEN k = 9 THEN ',"job_name":""' WHEN k = 10 THEN '' ELSE ',"job_name":"load ' || user_id || '"' END
    || CASE WHEN k < 30 THEN ',"run_id":"g-' || event_id || '","job_type_override":"SPARK"'
        WHEN k < 40 THEN ',"run_id":"","sql_query":"insert ' || user_id || '","job_type_override":""' ELSE '' END
    || CASE WHEN k < 50 THEN ',"metadata":{{"schema":[{{"name":"x"}}]}}'
        WHEN k < 60 THEN ',"metadata":{{"owner":"o"}}' ELSE '' END || '}}'"""
_PAYLOAD = f"CASE WHEN event_type = 'error' THEN {_GENERIC} ELSE {_OPENLINEAGE} END"
_RAW = """CASE WHEN event_type = 'purchase' THEN '{"body":"' || replace(payload, '"', chr(92) || '"') || '"}'
    WHEN event_type = 'signup' AND k >= 50 THEN '{"body":' || payload || '}'
    WHEN event_type = 'error' AND k >= 97 THEN '{"body":null}'
    WHEN event_type = 'error' AND k >= 94 THEN payload || ' and more'
    WHEN event_type = 'error' AND k >= 90 THEN '{' || payload
    WHEN event_type = 'error' AND k >= 85 THEN '"' || replace(payload, '"', chr(92) || '"') || '"'
    WHEN event_type = 'error' AND k >= 83 THEN '[1]' ELSE payload END"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and ``raw``, one for each row of ``events``.

    The rows are dealt out first: a row takes a few bytes of a file and some twenty readings
    of JSON, so that splits by bytes would leave the work to a few tasks.
    """
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props").hint("rebalance")
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    texts = events.selectExpr("event_id", "event_type", "k", f"{_PAYLOAD} AS payload")
    return texts.selectExpr("event_id", f"{_RAW} AS raw")


# The same steps for the other engine, from the same text.
_UNWRAP_SQL = f"""
    WITH numbered AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    texts AS (SELECT event_id, event_type, k, {_PAYLOAD} AS payload FROM numbered),
    raws AS (SELECT event_id, {_RAW} AS raw FROM texts),
    outers AS (SELECT event_id, TRY_CAST(raw AS JSON) AS o FROM raws),
    payloads AS (SELECT event_id, CASE
            WHEN json_exists(o, '$.body') THEN CASE WHEN json_type(o, '$.body') = 'VARCHAR'
                THEN TRY_CAST(json_extract_string(o, '$.body') AS JSON) ELSE json_extract(o, '$.body') END
            WHEN json_type(o) = 'VARCHAR' THEN TRY_CAST(json_extract_string(o, '$') AS JSON)
            ELSE o END AS p FROM outers),
    events_read AS (SELECT event_id, p, coalesce(json_exists(p, '$.eventType') AND json_exists(p, '$.run')
            AND json_exists(p, '$.job'), false) AS ol FROM payloads)
"""
_DATASETS_SQL = (
    _UNWRAP_SQL
    + """,
    input_items AS (SELECT event_id, unnest(json_extract(p, '$.inputs[*]')) AS d,
            generate_subscripts(json_extract(p, '$.inputs[*]'), 1) AS n
        FROM events_read WHERE ol AND json_type(p, '$.inputs') = 'ARRAY'),
    input_names AS (SELECT event_id, n, d, json_type(d) AS kind,
            string_split(coalesce(json_extract_string(d, '$.name'), ''), '.') AS parts,
            json_type(d) <> 'OBJECT' OR coalesce(json_type(d, '$.name') <> 'VARCHAR', false) AS bad FROM input_items),
    inputs AS (SELECT event_id, n, bad, CAST(d AS VARCHAR) = '{}' AS empty,
            '900' AS account_id, 'lake' AS catalog, 'main' AS database,
            CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE 'base' END AS "schema", parts[-1] AS "table" FROM input_names)
"""
)
_ROUTE_SQL = (
    _DATASETS_SQL
    + """,
    input_counts AS (SELECT event_id, bool_or(bad) AS bad, count(*) FILTER (NOT bad AND NOT empty) AS found
        FROM inputs GROUP BY event_id),
    shapes AS (SELECT e.*, coalesce(i.bad, false) AS bad_input, coalesce(i.found, 0) AS found,
            json_type(p) AS kind,
            coalesce(json_array_length(p, '$.inputs'), 0) > 0 AS has_inputs,
            coalesce(json_array_length(p, '$.outputs'), 0) > 0 AS has_outputs,
            json_extract(p, '$.outputs[0]') AS out0,
            coalesce(json_array_length(p, '$.source_tables'), 0) > 0
                AND coalesce(CAST(json_extract(p, '$.target_table') AS VARCHAR) <> '{}', false)
                AND coalesce(json_extract_string(p, '$.job_name') <> '', false) AS has_fields,
            coalesce(json_exists(p, '$.source_tables[0].account_id'), false) AS has_accounts
        FROM events_read e LEFT JOIN input_counts i USING (event_id)),
    outcomes AS (SELECT *, CASE
            WHEN kind IS NULL OR kind <> 'OBJECT' THEN 'failed'
            WHEN NOT ol THEN CASE WHEN NOT has_fields THEN 'rejected' WHEN NOT has_accounts THEN 'failed' ELSE 'posted' END
            WHEN json_type(p, '$.run') <> 'OBJECT' OR json_type(p, '$.job') <> 'OBJECT' THEN 'failed'
            WHEN coalesce(json_extract_string(p, '$.eventType'), 'None') NOT IN ('START', 'COMPLETE') THEN 'not_processed'
            WHEN NOT has_inputs OR NOT has_outputs THEN 'no_lineage'
            WHEN bad_input OR json_type(out0, '$.facets') = 'NULL' OR json_type(p, '$.job.facets') = 'NULL'
                OR json_type(p, '$.job.facets.sql') = 'NULL'
                OR (NOT json_exists(p, '$.job.facets.sql') AND json_type(p, '$.job.facets.dbt') = 'NULL') THEN 'failed'
            WHEN found = 0 OR CAST(out0 AS VARCHAR) = '{}' THEN 'not_parsed'
            ELSE 'posted' END AS outcome,
        FROM shapes),
    sql_texts AS (SELECT event_id, CASE
            WHEN NOT ol THEN json_extract_string(p, '$.sql_query')
            WHEN json_exists(p, '$.job.facets.sql') THEN json_extract_string(p, '$.job.facets.sql.query')
            ELSE coalesce(nullif(json_extract_string(p, '$.job.facets.dbt.compiled_sql'), ''),
                nullif(json_extract_string(p, '$.job.facets.dbt.raw_sql'), '')) END AS sql_query FROM events_read),
    routed AS (SELECT event_id, p, ol, outcome, sql_query,
            CASE outcome WHEN 'failed' THEN 500 WHEN 'rejected' THEN 400 ELSE 200 END AS status,
            CASE outcome WHEN 'not_processed' THEN 'Event type ' || coalesce(json_extract_string(p, '$.eventType'), 'None')
                || ' acknowledged but not processed'
                WHEN 'no_lineage' THEN 'Event acknowledged but no lineage to post (no inputs/outputs)'
                WHEN 'not_parsed' THEN 'Event acknowledged but could not parse table references'
                WHEN 'rejected' THEN 'Missing required fields: source_tables, target_table, job_name'
                WHEN 'failed' THEN 'The event could not be read' END AS message,
            CASE WHEN outcome NOT IN ('failed', 'rejected') THEN CASE WHEN ol THEN json_extract_string(p, '$.run.runId')
                ELSE json_extract_string(p, '$.run_id') END END AS run_id,
            CASE WHEN outcome NOT IN ('failed', 'rejected') THEN CASE WHEN ol THEN json_extract_string(p, '$.job.name')
                ELSE json_extract_string(p, '$.job_name') END END AS job_name,
            CASE WHEN ol THEN 'DBT' ELSE coalesce(nullif(json_extract_string(p, '$.job_type_override'), ''), 'DBT') END AS job_type,
            CASE WHEN NOT ol THEN json_extract(p, '$.metadata.schema')
                WHEN json_array_length(out0, '$.facets.schema.fields') > 0
                THEN json_extract(out0, '$.facets.schema.fields') END AS fields,
            string_split(json_extract_string(out0, '$.name'), '.') AS out_parts
        FROM outcomes JOIN sql_texts USING (event_id))
"""
)
_RUNS_SQL = (
    _ROUTE_SQL
    + """,
    runs AS (SELECT *,  coalesce(nullif(run_id, ''), 'made-' || event_id) AS final_run,
            CASE WHEN ol THEN '900' ELSE json_extract_string(p, '$.target_table.account_id') END AS t_account,
            CASE WHEN ol THEN 'lake/main/' || CASE WHEN len(out_parts) >= 2 THEN out_parts[-2] ELSE 'base' END || '/' || out_parts[-1]
                ELSE 'c/d/s/' || json_extract_string(p, '$.target_table.table') END AS t_name
        FROM routed WHERE outcome = 'posted'),
    source_items AS (
        SELECT event_id, n, account_id, catalog || '/' || database || '/' || "schema" || '/' || "table" AS s_name
        FROM inputs JOIN runs USING (event_id) WHERE NOT empty
        UNION ALL
        SELECT event_id, n, json_extract_string(s, '$.account_id'), 'c/d/s/' || json_extract_string(s, '$.table')
        FROM (SELECT event_id, unnest(json_extract(p, '$.source_tables[*]')) AS s,
                generate_subscripts(json_extract(p, '$.source_tables[*]'), 1) AS n FROM runs WHERE NOT ol)),
    sources AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY n) - 1 AS position,
            s_name, 'arn:aws:glue:region-1:' || account_id || ':table/' || s_name AS uri,
            'arn:aws:glue:region-1:' || first_value(account_id) OVER (PARTITION BY event_id ORDER BY n) || ':table' AS namespace
        FROM source_items)
"""
)


def _unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap_events(raw_events(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_events(_unwrapped(spark, sf_dir), CONFIG)
    return accepted_runs(routed, F.concat(F.lit("made-"), F.col("event_id").cast("string")))


@register("ol_classify", _UNWRAP_SQL + "SELECT event_id, p IS NOT NULL AS readable, ol AS is_openlineage FROM events_read")
def ol_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_events(_unwrapped(spark, sf_dir)).select(
        "event_id", F.col("payload").isNotNull().alias("readable"), "is_openlineage"
    )


@register(
    "ol_route",
    _ROUTE_SQL + "SELECT event_id, ol AS is_openlineage, status, outcome, message, run_id, job_name FROM routed",
)
def ol_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_events(_unwrapped(spark, sf_dir), CONFIG).select(
        "event_id", "is_openlineage", "status", "outcome", "message", "run_id", "job_name"
    )


@register(
    "ol_dataset_names",
    _DATASETS_SQL
    + """SELECT event_id, n - 1 AS position, CASE WHEN bad THEN 'bad' WHEN empty THEN 'empty' ELSE 'ok' END AS state,
        CASE WHEN NOT bad AND NOT empty THEN "schema" END AS schema_name,
        CASE WHEN NOT bad AND NOT empty THEN "table" END AS table_name FROM inputs""",
)
def ol_dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_datasets(F.from_json("payload", "inputs array<string>").getField("inputs"), CONFIG)
    events = classify_events(_unwrapped(spark, sf_dir)).where("is_openlineage")
    inputs = events.select("event_id", F.posexplode(parsed).alias("position", "d"))
    ok = F.col("d.state") == "ok"
    return inputs.select(
        "event_id",
        "position",
        "d.state",
        F.when(ok, F.col("d.schema")).alias("schema_name"),
        F.when(ok, F.col("d.table")).alias("table_name"),
    )


@register("ol_sql_facet", _ROUTE_SQL + "SELECT event_id, sql_query FROM sql_texts JOIN events_read USING (event_id) WHERE ol")
def ol_sql_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = classify_events(_unwrapped(spark, sf_dir)).where("is_openlineage")
    facets = as_map(F.get_json_object("payload", "$.job.facets"))
    return events.select("event_id", extract_sql(facets).alias("sql_query"))


@register(
    "ol_schema_fields",
    _UNWRAP_SQL
    + """, fields AS (SELECT event_id, unnest(json_extract(p, '$.outputs[0].facets.schema.fields[*]')) AS f,
            generate_subscripts(json_extract(p, '$.outputs[0].facets.schema.fields[*]'), 1) - 1 AS position
        FROM events_read WHERE ol)
    SELECT event_id, position, json_extract_string(f, '$.name') AS name, json_extract_string(f, '$.type') AS type FROM fields""",
)
def ol_schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = classify_events(_unwrapped(spark, sf_dir)).where("is_openlineage")
    facets = F.get_json_object("payload", "$.outputs[0].facets")
    fields = F.from_json(extract_schema_fields(facets), "array<struct<name: string, type: string>>")
    return events.select("event_id", F.posexplode(fields).alias("position", "f")).select("event_id", "position", "f.*")


@register(
    "lineage_identifiers",
    _RUNS_SQL + "SELECT event_id, position, namespace, s_name AS name, uri FROM sources",
)
def lineage_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumn("namespace", dataset_namespace(CONFIG))
    sources = runs.select("event_id", "namespace", F.posexplode("sources").alias("position", "source"))
    source = F.col("source")
    return sources.select(
        "event_id",
        "position",
        "namespace",
        dataset_name(source).alias("name"),
        source_identifier(source, CONFIG).alias("uri"),
    )


@register(
    "lineage_runs",
    _RUNS_SQL
    + """SELECT event_id, final_run AS run_id, t.event_type, job_name, job_type, sql_query
    FROM runs, (VALUES ('START'), ('COMPLETE')) t(event_type)""",
)
def lineage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = expand_runs(_runs(spark, sf_dir))
    return expanded.select("event_id", "run_id", "event_type", "job_name", "job_type", "sql_query")


@register(
    "lineage_edges",
    _RUNS_SQL
    + """SELECT event_id, final_run AS run_id, job_name, position, uri AS source,
        'arn:aws:glue:region-1:' || t_account || ':table/' || t_name AS target
    FROM sources JOIN runs USING (event_id)""",
)
def lineage_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_edges(_runs(spark, sf_dir), CONFIG, "event_id")


@register(
    "lineage_results",
    _RUNS_SQL
    + """SELECT event_id, true AS success, final_run AS "runId", job_name AS "jobName", job_type AS "jobIntegration",
        'iceberg' AS "dataSourceType", (SELECT count(*) FROM sources s WHERE s.event_id = runs.event_id) AS "sourceCount",
        string_split(t_name, '/')[-2] || '.' || string_split(t_name, '/')[-1] AS target
    FROM runs""",
)
def lineage_results_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_results(_runs(spark, sf_dir), CONFIG, "event_id")


# The start of each kind of facet.
_SOURCE_FACET = """'{"_producer":"dbt-demo","_schemaURL":"https://openlineage.io/spec/facets/1-0-0/DataSourceDatasetFacet.json"'"""
_TYPE_FACET = """'{"_producer":"dbt-demo","_schemaURL":"https://openlineage.io/spec/facets/2-0-3/JobTypeJobFacet.json"'"""
_SQL_FACET = """'{"_producer":"dbt-demo","_schemaURL":"https://openlineage.io/spec/facets/1-0-1/SQLJobFacet.json"'"""
_SCHEMA_FACET = """'{"_producer":"dbt-demo","_schemaURL":"https://openlineage.io/spec/facets/1-1-1/SchemaDatasetFacet.json"'"""


@register(
    "lineage_documents",
    _RUNS_SQL
    + f""",
    inputs_json AS (SELECT event_id, min(namespace) AS namespace, string_agg('{{"namespace":"' || namespace || '","name":"' || s_name
            || '","facets":{{"dataSource":' || {_SOURCE_FACET} || ',"name":"iceberg","uri":"'
            || uri || '"}}}}}}', ',' ORDER BY position) AS ins FROM sources GROUP BY event_id)
    SELECT event_id, t.event_type, '{{"eventType":"' || t.event_type || '","eventTime":"2024-02-01T10:20:30.000400Z",'
        || '"producer":"dbt-demo","schemaURL":"https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent",'
        || '"run":{{"runId":"' || final_run || '","facets":{{}}}},"job":{{"namespace":"dbt-demo","name":"' || job_name
        || '","facets":{{"jobType":' || {_TYPE_FACET} || ',"integration":"' || job_type
        || '","jobType":"JOB","processingType":"BATCH"}}'
        || CASE WHEN sql_query <> '' THEN ',"sql":' || {_SQL_FACET} || ',"query":"' || sql_query || '"}}' ELSE '' END
        || '}}}},"inputs":[' || ins || '],"outputs":[{{"namespace":"' || namespace || '","name":"' || t_name
        || '","facets":{{"dataSource":' || {_SOURCE_FACET} || ',"name":"iceberg","uri":"arn:aws:glue:region-1:'
        || t_account || ':table/' || t_name || '"}}'
        || CASE WHEN fields IS NOT NULL THEN ',"schema":' || {_SCHEMA_FACET} || ',"fields":'
            || CAST(fields AS VARCHAR) || '}}' ELSE '' END || '}}}}]}}' AS document
    FROM runs JOIN inputs_json USING (event_id), (VALUES ('START'), ('COMPLETE')) t(event_type)
    """,
)
def lineage_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.timestamp_micros(F.lit(1706782830000400))
    documents = lineage_documents(expand_runs(_runs(spark, sf_dir)), CONFIG, as_of)
    return documents.select("event_id", "event_type", "document")


@register(
    "lineage_derived_run_ids",
    """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
        || '-' || substr(h, 21, 12) AS run_id
    FROM (SELECT event_id, md5('["' || event_id || '","' || event_type || '"]') AS h FROM events)""",
)
def lineage_derived_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("event_id", derived_run_id(F.col("event_id"), F.col("event_type")).alias("run_id"))
