"""Raw lineage events to routed events, runs, documents, results and edges.

Every step is a projection of single rows, so the same functions take a batch or
a streaming frame. A row that cannot be processed carries status 500 and leaves
the others alone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import first_filled, iso_utc
from ..functions.json import as_map, is_filled, is_object, whole
from .columns import compute_once, instant
from .joins import quoted

# Texts and addresses that the events must carry as they are.
MESSAGE_NOT_PROCESSED = "Event type %s acknowledged but not processed"
MESSAGE_NO_LINEAGE = "Event acknowledged but no lineage to post (no inputs/outputs)"
MESSAGE_NOT_PARSED = "Event acknowledged but could not parse table references"
MESSAGE_REJECTED = "Missing required fields: source_tables, target_table, job_name"
EVENT_SCHEMA = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
DATA_SOURCE_FACET = "https://openlineage.io/spec/facets/1-0-0/DataSourceDatasetFacet.json"
SCHEMA_FACET = "https://openlineage.io/spec/facets/1-1-1/SchemaDatasetFacet.json"
JOB_TYPE_FACET = "https://openlineage.io/spec/facets/2-0-3/JobTypeJobFacet.json"
SQL_FACET = "https://openlineage.io/spec/facets/1-0-1/SQLJobFacet.json"
EVENT_TYPES = ("START", "COMPLETE")
TABLE_PARTS = ("account_id", "catalog", "database", "schema", "table")

_MESSAGE_FAILED = "The event could not be read"


@dataclass(frozen=True)
class LineageConfig:
    """Where the tables live and how jobs are labelled."""

    region: str
    account_id: str
    catalog: str
    database: str
    default_schema: str
    project_id: str
    data_source_type: str = "iceberg"
    job_integration: str = "DBT"
    identifier_prefix: str = "arn:aws:glue"

    @property
    def producer(self) -> str:
        return f"dbt-{self.project_id}"


def unwrap_events(events: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``payload``, JSON text: the event inside a ``body`` or inside a JSON string, else itself.

    Null where a text is not one whole JSON value.
    """
    names = events.columns
    # One step each, so that no text is read again for the next.
    read = compute_once(events, {"__text": whole(F.col(raw))})
    text = F.col("__text")
    # A key called body shows in the text, unless it is written with escapes.
    may_have_body = text.contains("body") | text.contains("\\u")
    inner = F.when(
        may_have_body & F.array_contains(F.json_object_keys(text), "body"),
        F.coalesce(F.get_json_object(text, "$.body"), F.lit("null")),
    ).when(F.ltrim(text).startswith('"'), F.coalesce(F.get_json_object(text, "$"), F.lit("")))
    read = compute_once(read, {"__inner": inner})
    inner = F.col("__inner")
    read = compute_once(read, {"payload": F.when(inner.isNotNull(), whole(inner)).otherwise(text)})
    return read.select(*map(quoted, names), "payload")


def classify_events(unwrapped: DataFrame) -> DataFrame:
    """Add ``is_openlineage``: all three marker keys are there, whatever their values."""
    return unwrapped.withColumn("is_openlineage", _has_markers(F.json_object_keys("payload")))


def _has_markers(keys: Column) -> Column:
    present = F.lit(True)
    for key in ("eventType", "run", "job"):
        present = present & F.array_contains(keys, key)
    return F.coalesce(present, F.lit(False))


def parse_datasets(datasets: Column, config: LineageConfig) -> Column:
    """An array of dataset texts as structs of ``state`` (``ok``, ``empty``, ``bad``) and table parts.

    The last two parts of the name are schema and table; one part goes to the
    default schema. An empty dataset has no table; one whose name is null, or that
    is no object, is bad.
    """

    def read(dataset: Column) -> Column:
        return F.struct(dataset.alias("text"), as_map(dataset).alias("seen"))

    def judge(item: Column) -> Column:
        seen = item.getField("seen")
        name = F.try_element_at(seen, F.lit("name"))
        state = (
            F.when(seen.isNull(), F.when(is_filled(item.getField("text")), "bad").otherwise("empty"))
            .when(F.size(seen) == 0, "empty")
            .when(name.isNull() & F.map_contains_key(seen, "name"), "bad")
            .otherwise("ok")
        )
        return F.struct(state.alias("state"), F.coalesce(name, F.lit("")).alias("name"))

    def place(item: Column) -> Column:
        name = item.getField("name")
        schema = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
        return F.struct(
            item.getField("state").alias("state"),
            F.lit(config.account_id).alias("account_id"),
            F.lit(config.catalog).alias("catalog"),
            F.lit(config.database).alias("database"),
            F.when(F.contains(name, F.lit(".")), schema).otherwise(config.default_schema).alias("schema"),
            F.substring_index(name, ".", -1).alias("table"),
        )

    return F.transform(F.transform(F.transform(datasets, read), judge), place)


def declared_tables(tables: Column) -> Column:
    """Table texts of generic requests, in the shape of ``parse_datasets``; all parts are needed."""
    shape = ", ".join(f"{part} string" for part in TABLE_PARTS)

    def judge(parts: Column) -> Column:
        complete = F.lit(True)
        for part in TABLE_PARTS:
            complete = complete & parts.getField(part).isNotNull()
        return F.struct(
            F.when(complete, "ok").otherwise("bad").alias("state"),
            *(parts.getField(part).alias(part) for part in TABLE_PARTS),
        )

    return F.transform(F.transform(tables, lambda t: F.from_json(t, shape)), judge)


def extract_sql(facets: Column) -> Column:
    """Query text from the map of job facets: of ``sql`` if it is there, else compiled or raw dbt text."""
    sql = F.get_json_object(F.try_element_at(facets, F.lit("sql")), "$.query")
    dbt = F.from_json(F.try_element_at(facets, F.lit("dbt")), "compiled_sql string, raw_sql string")
    # The lambda names the parsed facet, so that it is parsed once.
    from_dbt = F.transform(F.array(dbt), lambda d: first_filled(d.getField("compiled_sql"), d.getField("raw_sql")))
    return F.when(F.map_contains_key(facets, "sql"), sql).otherwise(F.get(from_dbt, F.lit(0)))


def sql_facet_is_broken(facets: Column) -> Column:
    """Whether the facet that ``extract_sql`` reads is there but is no object."""

    def broken(name: str) -> Column:
        return F.map_contains_key(facets, name) & ~is_object(F.try_element_at(facets, F.lit(name)))

    return F.coalesce(broken("sql") | (~F.map_contains_key(facets, "sql") & broken("dbt")), F.lit(False))


def extract_schema_fields(output_facets: Column) -> Column:
    """The schema fields among the facets of an output, as JSON text; null if absent or empty."""
    fields = F.get_json_object(output_facets, "$.schema.fields")
    return F.get(F.filter(F.array(fields), is_filled), F.lit(0))


# What is read of an event of either kind. Texts keep what still has to be judged.
_EVENT = """eventType string, run struct<runId: string>, job map<string, string>,
    inputs array<string>, outputs array<string>,
    source_tables array<string>, target_table string, job_name string,
    sql_query string, run_id string, job_type_override string, metadata map<string, string>"""


def route_events(unwrapped: DataFrame, config: LineageConfig) -> DataFrame:
    """Parse and route every event; ``payload`` is replaced by the columns it gives.

    Adds ``is_openlineage``, ``status``, ``outcome``, ``message``, ``run_id``,
    ``job_name``, ``job_type``, ``sql_query``, ``sources``, ``target``,
    ``has_schema`` and ``schema_fields`` (JSON text). The parsed columns are null
    unless the outcome is ``posted``, except that run id and job name are kept
    wherever read.
    """
    p, ol, keys = F.col("payload"), F.col("is_openlineage"), F.col("__keys")
    seen, to, facets = F.col("__seen"), F.col("__to"), F.col("__facets")
    kept = [c for c in unwrapped.columns if c != "payload"]

    read = unwrapped.withColumns({"__keys": F.json_object_keys(p), "__seen": F.from_json(p, _EVENT)})
    # Only the first output of an event is a target; a request names its target itself.
    read = read.withColumn("is_openlineage", _has_markers(keys)).withColumns(
        {
            "__in": F.when(ol, F.col("__seen.inputs")).otherwise(F.col("__seen.source_tables")),
            "__to": F.when(ol, F.get("__seen.outputs", F.lit(0))).otherwise(F.col("__seen.target_table")),
            "__facets": as_map(F.try_element_at("__seen.job", F.lit("facets"))),
        }
    )
    only = F.array(to)
    read = read.withColumns(
        {
            "__sources": F.when(ol, parse_datasets(F.col("__in"), config)).otherwise(declared_tables(F.col("__in"))),
            "__target": F.get(F.when(ol, parse_datasets(only, config)).otherwise(declared_tables(only)), F.lit(0)),
            "__out_facets": F.when(ol, F.get_json_object(to, "$.facets")),
        }
    )
    sources, target, out_facets = F.col("__sources"), F.col("__target"), F.col("__out_facets")

    in_text = F.when(ol, F.get_json_object(p, "$.inputs")).otherwise(F.get_json_object(p, "$.source_tables"))
    in_filled = F.coalesce(F.size("__in") > 0, is_filled(in_text))
    out_filled = F.when(
        ol, F.coalesce(F.size("__seen.outputs") > 0, is_filled(F.get_json_object(p, "$.outputs")))
    ).otherwise(is_filled(to))
    job_is_broken = F.map_contains_key("__seen.job", "facets") & facets.isNull()
    output_is_broken = F.when(out_facets.isNotNull(), ~is_object(out_facets)).otherwise(
        F.array_contains(F.json_object_keys(to), "facets")
    )
    broken = (
        sources.isNull()
        | F.exists(sources, lambda s: s.getField("state") == "bad")
        | (target.getField("state") == "bad")
        | (ol & F.col("__seen.outputs").isNull())
        | (ol & (F.coalesce(job_is_broken, F.lit(False)) | F.coalesce(output_is_broken, F.lit(False)) | sql_facet_is_broken(facets)))
    )
    found = F.filter(sources, lambda s: s.getField("state") == "ok")
    incomplete = ~in_filled | ~out_filled
    outcome = (
        F.when(keys.isNull(), "failed")
        .when(ol & (F.col("__seen.run").isNull() | F.col("__seen.job").isNull()), "failed")
        .when(ol & ~F.coalesce(F.col("__seen.eventType"), F.lit("None")).isin(*EVENT_TYPES), "not_processed")
        .when(ol & incomplete, "no_lineage")
        .when(incomplete | (~ol & first_filled(F.col("__seen.job_name")).isNull()), "rejected")
        .when(broken, "failed")
        .when((F.size(found) == 0) | (target.getField("state") == "empty"), "not_parsed")
        .otherwise("posted")
    )
    # A request may declare a schema that is null; an event's schema has to hold fields.
    fields = F.when(ol, extract_schema_fields(out_facets)).otherwise(
        F.try_element_at("__seen.metadata", F.lit("schema"))
    )
    # The fields stay a plain column: Spark drops it where it is not asked for.
    routed = compute_once(read, {"outcome": outcome, "__found": found}).withColumn("__fields", fields)
    posted, is_known = F.col("outcome") == "posted", ~F.col("outcome").isin("failed", "rejected")
    message = (
        F.when(
            F.col("outcome") == "not_processed",
            F.format_string(MESSAGE_NOT_PROCESSED, F.coalesce(F.col("__seen.eventType"), F.lit("None"))),
        )
        .when(F.col("outcome") == "no_lineage", MESSAGE_NO_LINEAGE)
        .when(F.col("outcome") == "not_parsed", MESSAGE_NOT_PARSED)
        .when(F.col("outcome") == "rejected", MESSAGE_REJECTED)
        .when(F.col("outcome") == "failed", _MESSAGE_FAILED)
    )
    job_name = F.when(ol, F.try_element_at("__seen.job", F.lit("name"))).otherwise(F.col("__seen.job_name"))
    override = F.when(~ol, first_filled(F.col("__seen.job_type_override")))
    has_schema = F.when(ol, F.col("__fields").isNotNull()).otherwise(F.map_contains_key("__seen.metadata", "schema"))

    def table(parsed: Column) -> Column:
        return F.struct(*(parsed.getField(part).alias(part) for part in TABLE_PARTS))

    return routed.select(
        *kept,
        "is_openlineage",
        F.when(F.col("outcome") == "failed", 500)
        .when(F.col("outcome") == "rejected", 400)
        .otherwise(200)
        .alias("status"),
        "outcome",
        message.alias("message"),
        F.when(is_known, F.when(ol, F.col("__seen.run.runId")).otherwise(F.col("__seen.run_id"))).alias("run_id"),
        F.when(is_known, job_name).alias("job_name"),
        F.when(posted, F.coalesce(override, F.lit(config.job_integration))).alias("job_type"),
        F.when(posted, F.when(ol, extract_sql(facets)).otherwise(F.col("__seen.sql_query"))).alias("sql_query"),
        F.when(posted, F.transform("__found", table)).alias("sources"),
        F.when(posted, table(target)).alias("target"),
        (posted & F.coalesce(has_schema, F.lit(False))).alias("has_schema"),
        F.when(posted, F.col("__fields")).alias("schema_fields"),
    )


def accepted_runs(routed: DataFrame, new_run_id: Column | None = None) -> DataFrame:
    """The posted events, each with a run id; a missing or empty one is made.

    The default is a random UUID. Where documents, results and edges are written
    by separate queries, pass ``derived_run_id`` of the columns that identify an
    event, so that every query and every retry sees the same id.
    """
    made = F.uuid() if new_run_id is None else new_run_id
    return routed.where(F.col("outcome") == "posted").withColumn("run_id", F.coalesce(first_filled(F.col("run_id")), made))


def expand_runs(runs: DataFrame) -> DataFrame:
    """Two rows per run, ``START`` and ``COMPLETE``, with one run id."""
    return runs.withColumn("event_type", F.explode(F.array(*map(F.lit, EVENT_TYPES))))


def source_identifier(table: Column, config: LineageConfig) -> Column:
    """``prefix:region:account:table/catalog/database/schema/table``."""
    return F.concat(
        F.lit(f"{config.identifier_prefix}:{config.region}:"),
        table.getField("account_id"),
        F.lit(":table/"),
        dataset_name(table),
    )


def dataset_name(table: Column) -> Column:
    """``catalog/database/schema/table``."""
    return F.concat_ws("/", *(table.getField(part) for part in TABLE_PARTS[1:]))


def dataset_namespace(config: LineageConfig) -> Column:
    """The namespace of all datasets of an event: that of the first source's account."""
    account = F.get("sources", F.lit(0)).getField("account_id")
    return F.concat(F.lit(f"{config.identifier_prefix}:{config.region}:"), account, F.lit(":table"))


def lineage_documents(
    expanded: DataFrame, config: LineageConfig, as_of: Column | dt.datetime | None = None
) -> DataFrame:
    """Add ``document``, the JSON text of each event. Facets that are null are left out."""
    producer = F.lit(config.producer)

    def facet(url: str, *fields: Column) -> Column:
        return F.struct(producer.alias("_producer"), F.lit(url).alias("_schemaURL"), *fields)

    def data_source(table: Column) -> Column:
        return facet(
            DATA_SOURCE_FACET,
            F.lit(config.data_source_type.lower()).alias("name"),
            source_identifier(table, config).alias("uri"),
        )

    def dataset(table: Column, *facets: Column) -> Column:
        return F.struct(
            dataset_namespace(config).alias("namespace"),
            dataset_name(table).alias("name"),
            F.struct(data_source(table).alias("dataSource"), *facets).alias("facets"),
        )

    sql, target = F.col("sql_query"), F.col("target")
    job_facets = F.struct(
        facet(
            JOB_TYPE_FACET,
            F.col("job_type").alias("integration"),
            F.lit("JOB").alias("jobType"),
            F.lit("BATCH").alias("processingType"),
        ).alias("jobType"),
        F.when(first_filled(sql).isNotNull(), facet(SQL_FACET, sql.alias("query"))).alias("sql"),
    )
    declared = F.coalesce("schema_fields", F.lit("null"))
    # The fields are put in as the JSON value they are, or as a string if they are none.
    fields = F.coalesce(F.try_parse_json(declared), declared.cast("variant"))
    schema = F.when(F.col("has_schema"), facet(SCHEMA_FACET, fields.alias("fields")))
    event = F.struct(
        F.col("event_type").alias("eventType"),
        iso_utc(instant(as_of)).alias("eventTime"),
        producer.alias("producer"),
        F.lit(EVENT_SCHEMA).alias("schemaURL"),
        F.struct(
            F.col("run_id").alias("runId"), F.create_map().cast("map<string,string>").alias("facets")
        ).alias("run"),
        F.struct(producer.alias("namespace"), F.col("job_name").alias("name"), job_facets.alias("facets")).alias("job"),
        F.transform("sources", lambda s: dataset(s)).alias("inputs"),
        F.array(dataset(target, schema.alias("schema"))).alias("outputs"),
    )
    return expanded.withColumn("document", F.to_json(event))


def lineage_results(runs: DataFrame, config: LineageConfig, *keep: str) -> DataFrame:
    """One row per run: what was posted. ``keep`` names columns to carry along."""
    return runs.select(
        *keep,
        F.lit(True).alias("success"),
        F.col("run_id").alias("runId"),
        F.col("job_name").alias("jobName"),
        F.col("job_type").alias("jobIntegration"),
        F.lit(config.data_source_type).alias("dataSourceType"),
        F.size("sources").alias("sourceCount"),
        F.concat_ws(".", "target.schema", "target.table").alias("target"),
    )


def lineage_edges(runs: DataFrame, config: LineageConfig, *keep: str) -> DataFrame:
    """One row per run and source: the source and target identifiers, job and run."""
    exploded = runs.select(*keep, "run_id", "job_name", "target", F.posexplode("sources").alias("position", "source"))
    return exploded.select(
        *keep,
        "run_id",
        "job_name",
        "position",
        source_identifier(F.col("source"), config).alias("source"),
        source_identifier(F.col("target"), config).alias("target"),
    )
