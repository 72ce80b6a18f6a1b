"""Lineage events: unwrapping, routing, documents, one row per trap."""

import json
import re

import pytest
from pyspark.sql import functions as F

from keelson.functions.expressions import derived_run_id, iso_utc
from keelson.functions.json import whole
from keelson.operators.lineage import (
    LineageConfig,
    accepted_runs,
    classify_events,
    expand_runs,
    lineage_documents,
    lineage_edges,
    lineage_results,
    route_events,
    unwrap_events,
)
from keelson.plans.lineage import raw_events

CONFIG = LineageConfig("eu", "100", "cat", "db", "base", "proj", data_source_type="ICEBERG")


def event(**changes):
    body = {
        "eventType": "COMPLETE",
        "run": {"runId": "r-1"},
        "job": {"name": "model"},
        "inputs": [{"namespace": "n", "name": "raw.orders"}],
        "outputs": [{"namespace": "n", "name": "mart.sales"}],
    }
    body.update(changes)
    return {k: v for k, v in body.items() if v != "absent"}


def place(**changes):
    return {"account_id": "1", "catalog": "c", "database": "d", "schema": "s", "table": "t", **changes}


def request(**changes):
    body = {"source_tables": [place()], "target_table": place(account_id="2", table="out"), "job_name": "load"}
    body.update(changes)
    return {k: v for k, v in body.items() if v != "absent"}


def routed(spark, *raws):
    texts = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raws)]
    df = spark.createDataFrame(texts, "id int, raw string")
    return route_events(unwrap_events(df), CONFIG)


def outcomes(spark, *raws):
    return [(r["status"], r["outcome"]) for r in routed(spark, *raws).orderBy("id").collect()]


POSTED, FAILED, NOTHING = (200, "posted"), (500, "failed"), (200, "no_lineage")
UNPARSED, SKIPPED, REJECTED = (200, "not_parsed"), (200, "not_processed"), (400, "rejected")


@pytest.mark.parametrize(
    ("name", "cases"),
    [
        (
            "wrapping",
            [
                (event(), POSTED),
                ({"body": json.dumps(event())}, POSTED),
                ({"body": event()}, POSTED),
                (json.dumps(json.dumps(event())), POSTED),
                ({"body": None}, FAILED),
                ({"body": "{broken"}, FAILED),
                ({"body": 5}, FAILED),
                ({"body": "[1]"}, FAILED),
                (json.dumps(event()) + " tail", FAILED),
                ({"body": json.dumps(event()) + "}"}, FAILED),
                ("{", FAILED),
                ("", FAILED),
                ("5", FAILED),
                ("[]", FAILED),
                ('"text"', FAILED),
                (None, FAILED),
                ("{}", REJECTED),
            ],
        ),
        (
            "event type, run and job",
            [
                (event(eventType="START"), POSTED),
                (event(eventType="FAIL"), SKIPPED),
                (event(eventType=None), SKIPPED),
                (event(eventType="absent"), REJECTED),
                (event(run=None), FAILED),
                (event(run="x"), FAILED),
                (event(run="absent"), REJECTED),
                (event(job=None), FAILED),
                (event(job=[]), FAILED),
                (event(run=None, eventType="FAIL"), FAILED),
                (event(run={}), POSTED),
                (event(job={}), POSTED),
            ],
        ),
        (
            "inputs and outputs",
            [
                (event(inputs="absent"), NOTHING),
                (event(inputs=None), NOTHING),
                (event(inputs=[]), NOTHING),
                (event(outputs=[]), NOTHING),
                (event(outputs={}), NOTHING),
                (event(inputs=0, outputs=[]), NOTHING),
                (event(inputs="text"), FAILED),
                (event(inputs={"name": "x"}), FAILED),
                (event(outputs={"name": "x"}), FAILED),
                (event(inputs=[{}]), UNPARSED),
                (event(inputs=[None]), UNPARSED),
                (event(inputs=[{}, None, "", {"name": "x"}]), POSTED),
                (event(inputs=["text"]), FAILED),
                (event(inputs=[{"name": None}]), FAILED),
                (event(inputs=[{"namespace": "n"}]), POSTED),
                (event(inputs=[{"name": ""}]), POSTED),
                (event(outputs=[{}]), UNPARSED),
                (event(outputs=[None]), UNPARSED),
                (event(outputs=[{}, {"name": "x"}]), UNPARSED),
                (event(outputs=["x"]), FAILED),
                (event(outputs=[{"name": None}]), FAILED),
            ],
        ),
        (
            "facets",
            [
                (event(job={"facets": None}), FAILED),
                (event(job={"facets": {"sql": None}}), FAILED),
                (event(job={"facets": {"sql": {}}}), POSTED),
                (event(job={"facets": {"dbt": None}}), FAILED),
                (event(job={"facets": {"sql": {}, "dbt": None}}), POSTED),
                (event(job={"facets": {"sql": None}}, outputs=[]), NOTHING),
                (event(outputs=[{"name": "t", "facets": None}]), FAILED),
                (event(outputs=[{"name": "t", "facets": {"schema": None}}]), POSTED),
                (event(outputs=[{"name": "t", "facets": {"schema": {}}}]), POSTED),
            ],
        ),
        (
            "requests",
            [
                (request(), POSTED),
                (request(source_tables=[]), REJECTED),
                (request(source_tables="absent"), REJECTED),
                (request(target_table={}), REJECTED),
                (request(target_table=None), REJECTED),
                (request(job_name=""), REJECTED),
                (request(job_name="absent"), REJECTED),
                (request(source_tables=[{"schema": "s", "table": "t"}]), FAILED),
                (request(source_tables=[place(), {}]), FAILED),
                (request(source_tables="text"), FAILED),
                (request(target_table={"table": "t"}), FAILED),
                (request(target_table="text"), FAILED),
            ],
        ),
    ],
)
def test_routes(spark, name, cases):
    got = outcomes(spark, *(raw for raw, _ in cases))
    wrong = [(raw, g, want) for (raw, want), g in zip(cases, got) if g != want]
    assert not wrong


def test_messages(spark):
    messages = [
        r["message"]
        for r in routed(spark, event(eventType="FAIL"), event(inputs=[]), event(inputs=[{}]), request(job_name=""), event())
        .orderBy("id")
        .collect()
    ]
    assert messages == [
        "Event type FAIL acknowledged but not processed",
        "Event acknowledged but no lineage to post (no inputs/outputs)",
        "Event acknowledged but could not parse table references",
        "Missing required fields: source_tables, target_table, job_name",
        None,
    ]


def test_classification_is_by_presence(spark):
    raws = [{"eventType": None, "run": None, "job": None}, {"eventType": 1, "run": 2}, [1]]
    df = spark.createDataFrame([(json.dumps(r),) for r in raws], "raw string")
    assert [r["is_openlineage"] for r in classify_events(unwrap_events(df)).collect()] == [True, False, False]


def test_dataset_names(spark):
    names = ["one", "s.t", "d.s.t", "c.d.s.t", "", ".", "s.", "a..t"]
    row = routed(spark, event(inputs=[{"name": n} for n in names])).first()
    assert [(s["schema"], s["table"]) for s in row["sources"]] == [
        ("base", "one"),
        ("s", "t"),
        ("s", "t"),
        ("s", "t"),
        ("base", ""),
        ("", ""),
        ("s", ""),
        ("", "t"),
    ]
    assert {(s["account_id"], s["catalog"], s["database"]) for s in row["sources"]} == {("100", "cat", "db")}


def test_sql_text(spark):
    facets = [
        {"sql": {"query": "q"}, "dbt": {"raw_sql": "r"}},
        {"sql": {}, "dbt": {"raw_sql": "r"}},
        {"dbt": {"compiled_sql": "c", "raw_sql": "r"}},
        {"dbt": {"compiled_sql": "", "raw_sql": "r"}},
        {"dbt": {"compiled_sql": None, "raw_sql": "r"}},
        {"dbt": {}},
        {},
    ]
    events = [event(job={"name": "j", "facets": f}) for f in facets]
    got = [r["sql_query"] for r in routed(spark, *events, event()).orderBy("id").collect()]
    assert got == ["q", None, "c", "r", "r", None, None, None]


def documents(spark, *raws):
    runs = accepted_runs(routed(spark, *raws), F.concat(F.lit("made-"), F.col("id").cast("string")))
    as_of = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    made = lineage_documents(expand_runs(runs), CONFIG, as_of).orderBy("id", F.desc("event_type"))
    return [json.loads(r["document"]) for r in made.collect()]


def facet(url, **rest):
    return {"_producer": "dbt-proj", "_schemaURL": f"https://openlineage.io/spec/facets/{url}.json", **rest}


def test_whole_document(spark):
    fields = [{"name": "id", "type": "long", "tags": [1, 2.50, None, {"x": "ü"}]}]
    start, complete = documents(
        spark,
        event(
            job={"name": "model", "facets": {"sql": {"query": 'select "a"'}}},
            inputs=[{"name": "raw.orders"}, {"name": "users"}],
            outputs=[{"name": "mart.sales", "facets": {"schema": {"fields": fields}}}, {"name": "other"}],
        ),
    )
    namespace, prefix = "arn:aws:glue:eu:100:table", "arn:aws:glue:eu:100:table/"

    def dataset(name, **facets):
        source = facet("1-0-0/DataSourceDatasetFacet", name="iceberg", uri=prefix + name)
        return {"namespace": namespace, "name": name, "facets": {"dataSource": source, **facets}}

    assert start == {
        "eventType": "START",
        "eventTime": "2023-11-14T22:13:20Z",
        "producer": "dbt-proj",
        "schemaURL": "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent",
        "run": {"runId": "r-1", "facets": {}},
        "job": {
            "namespace": "dbt-proj",
            "name": "model",
            "facets": {
                "jobType": facet("2-0-3/JobTypeJobFacet", integration="DBT", jobType="JOB", processingType="BATCH"),
                "sql": facet("1-0-1/SQLJobFacet", query='select "a"'),
            },
        },
        "inputs": [dataset("cat/db/raw/orders"), dataset("cat/db/base/users")],
        "outputs": [dataset("cat/db/mart/sales", schema=facet("1-1-1/SchemaDatasetFacet", fields=fields))],
    }
    assert complete == {**start, "eventType": "COMPLETE"}


def test_request_document_uses_the_first_source_account(spark):
    start, _ = documents(
        spark,
        request(
            source_tables=[place(), place(account_id="7", table="u")],
            sql_query="insert",
            job_type_override="SPARK",
            run_id="",
            metadata={"schema": None},
        ),
    )
    assert {d["namespace"] for d in start["inputs"] + start["outputs"]} == {"arn:aws:glue:eu:1:table"}
    assert [d["facets"]["dataSource"]["uri"] for d in start["inputs"] + start["outputs"]] == [
        "arn:aws:glue:eu:1:table/c/d/s/t",
        "arn:aws:glue:eu:7:table/c/d/s/u",
        "arn:aws:glue:eu:2:table/c/d/s/out",
    ]
    assert start["run"]["runId"] == "made-0"
    assert start["job"]["facets"]["jobType"]["integration"] == "SPARK"
    assert start["job"]["facets"]["sql"]["query"] == "insert"
    assert start["outputs"][0]["facets"]["schema"]["fields"] is None


def test_no_optional_facets(spark):
    start, _ = documents(spark, request(metadata={"owner": "o"}, sql_query="", job_type_override=""))
    assert list(start["job"]["facets"]) == ["jobType"]
    assert start["job"]["facets"]["jobType"]["integration"] == "DBT"
    assert list(start["outputs"][0]["facets"]) == ["dataSource"]


def test_results_and_edges(spark, rows):
    raws = [event(inputs=[{"name": "a"}, {"name": "b"}]), request(run_id="g"), event(eventType="FAIL")]
    runs = accepted_runs(routed(spark, *raws))
    assert rows(lineage_results(runs, CONFIG, "id")) == [
        (0, True, "r-1", "model", "DBT", "ICEBERG", 2, "mart.sales"),
        (1, True, "g", "load", "DBT", "ICEBERG", 1, "s.out"),
    ]
    edges = rows(lineage_edges(runs, CONFIG), "run_id", "position", "source", "target")
    assert edges == [
        ("g", 0, "arn:aws:glue:eu:1:table/c/d/s/t", "arn:aws:glue:eu:2:table/c/d/s/out"),
        ("r-1", 0, "arn:aws:glue:eu:100:table/cat/db/base/a", "arn:aws:glue:eu:100:table/cat/db/mart/sales"),
        ("r-1", 1, "arn:aws:glue:eu:100:table/cat/db/base/b", "arn:aws:glue:eu:100:table/cat/db/mart/sales"),
    ]


def test_both_events_share_a_made_run_id(spark):
    runs = accepted_runs(routed(spark, *[event(run={}) for _ in range(6)]))
    got = expand_runs(runs).groupBy("id").agg(F.collect_set("run_id").alias("ids"), F.collect_set("event_type").alias("types"))
    collected = got.collect()
    assert all(len(r["ids"]) == 1 and sorted(r["types"]) == ["COMPLETE", "START"] for r in collected)
    assert len({r["ids"][0] for r in collected}) == 6
    assert all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r["ids"][0]) for r in collected)


def test_derived_run_ids(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", "bc")], "x string, y string")
    ids = [r[0] for r in df.select(derived_run_id(F.col("x"), F.col("y"))).collect()]
    assert ids[0] == ids[3] and len(set(ids)) == 3
    assert all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i) for i in ids)


def test_time_text_drops_a_zero_fraction(spark):
    df = spark.createDataFrame([(0,), (1,), (1_500_000,), (-1,)], "m bigint")
    got = [r[0] for r in df.select(iso_utc(F.timestamp_micros("m"))).collect()]
    assert got == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.000001Z", "1970-01-01T00:00:01.500000Z", "1969-12-31T23:59:59.999999Z"]


def test_routing_is_one_stage(spark):
    plan = routed(spark, event())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_filter_does_not_parse_again(spark):
    runs = accepted_runs(routed(spark, event()))
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(eventType") == 1


def test_a_text_is_whole_if_it_is_one_json_value(spark):
    good = ["1", "-0.5e3", "true", "null", '"a"', "[]", "{}", ' {"a": [1, {"b": "}]"}]} ', '[1,"b"]']
    bad = ["", " ", "1 2", "1,2", '1,"b"', '1,"b":2', "1]", "1}", "1] x", "1} x", '{"a":1} and more', '{{"a":1}', "{'a':1}", "[1", "x", '"a" "b"', "1,", ",1"]
    texts = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad] + [(None, False)], "t string, good boolean")
    wrong = texts.where(whole(F.col("t")).isNotNull() != F.col("good")).collect()
    assert wrong == []


def test_events_are_dealt_out_and_their_texts_read_once(spark, tmp_path):
    """Before, a small file was one task's work, and a body was taken out of its event up to five times."""
    rows = spark.range(400000).selectExpr(
        "id as event_id", "id as user_id", "'click' as event_type", """concat('{"k":', id % 100, ', "x":"', sha2(string(id), 256), '"}') as props"""
    )
    rows.coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/events.parquet")
    assert raw_events(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    unwrapped = unwrap_events(spark.createDataFrame([(1, "{}")], "event_id long, raw string"))
    plan = unwrapped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("$.body") == 1
