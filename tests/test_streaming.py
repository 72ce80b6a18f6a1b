"""The lineage operators on a stream of files."""

import json

import pytest

from keelson.operators.lineage import LineageConfig
from keelson.operators.quality import check_state, not_null
from keelson.sources import tables
from keelson.streaming.lineage import document_stream, read_event_stream, write_documents
from keelson.streaming.tables import applied_batch, apply_once, check_stream, stream_state, upsert_stream
from test_lineage import event, request

CONFIG = LineageConfig("eu", "100", "cat", "db", "base", "proj")


def test_stream_of_event_files(spark, tmp_path):
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps(event(run={})), "{broken", json.dumps(request(run_id="g"))]))
    documents = document_stream(read_event_stream(spark, inbox), CONFIG)
    assert documents.isStreaming
    write_documents(documents, out, state).awaitTermination()
    first = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted((d["job"]["name"], d["eventType"]) for d in first) == [
        ("load", "COMPLETE"),
        ("load", "START"),
        ("model", "COMPLETE"),
        ("model", "START"),
    ]
    assert len({d["run"]["runId"] for d in first}) == 2

    (tmp_path / "in" / "b.txt").write_text(json.dumps(event(eventType="FAIL")) + "\n" + json.dumps(event()))
    write_documents(documents, out, state).awaitTermination()
    assert spark.read.text(out).count() == 6


# --- streams into tables ---------------------------------------------------------

ROWS = "id int, v string, stamp int"


def put(spark, folder, *rows):
    spark.createDataFrame(list(rows), ROWS).coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_brings_a_table_up_to_date(spark, tmp_path, table, rows):
    inbox, name = str(tmp_path / "in"), table()
    put(spark, inbox, (1, "old", 1), (1, "new", 2), (2, "x", 1))
    run = lambda: upsert_stream(spark.readStream.schema(ROWS).parquet(inbox), name, ["id"], "stamp", ["v"], str(tmp_path / "c")).awaitTermination()
    run()
    assert rows(spark.table(name)) == [(1, "new", 2), (2, "x", 1)] and applied_batch(spark, name, "upsert") == 0
    put(spark, inbox, (2, "later", 3), (3, "y", 1))
    run()
    assert rows(spark.table(name)) == [(1, "new", 2), (2, "later", 3), (3, "y", 1)] and applied_batch(spark, name, "upsert") == 1
    before = tables.table_location(spark, name)
    run()  # nothing new
    assert tables.table_location(spark, name) == before


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, table, rows):
    """A lost checkpoint numbers the same batch again."""
    inbox, name = str(tmp_path / "in"), table()
    put(spark, inbox, (1, "a", 1))
    source = lambda: spark.readStream.schema(ROWS).parquet(inbox)
    upsert_stream(source(), name, ["id"], "stamp", ["v"], str(tmp_path / "c1")).awaitTermination()
    before = tables.table_location(spark, name)
    upsert_stream(source(), name, ["id"], "stamp", ["v"], str(tmp_path / "c2")).awaitTermination()
    assert tables.table_location(spark, name) == before and rows(spark.table(name)) == [(1, "a", 1)]
    calls = []
    assert not apply_once(spark, name, "upsert", 0, lambda: calls.append(1)) and apply_once(spark, name, "upsert", 1, lambda: calls.append(2))
    assert calls == [2] and applied_batch(spark, name, "upsert") == 1 and applied_batch(spark, name, "other") == -1


def test_a_failure_after_the_change_repeats_it(spark, tmp_path, table, rows, monkeypatch):
    inbox, name = str(tmp_path / "in"), table()
    put(spark, inbox, (1, "a", 1))
    stream = lambda: upsert_stream(spark.readStream.schema(ROWS).parquet(inbox), name, ["id"], "stamp", ["v"], str(tmp_path / "c"))
    stream().awaitTermination()
    put(spark, inbox, (1, "b", 2), (2, "c", 1))
    with monkeypatch.context() as broken:
        broken.setattr(tables, "set_properties", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            stream().awaitTermination()
    assert applied_batch(spark, name, "upsert") == 0 and spark.table(name).count() == 2
    stream().awaitTermination()
    assert rows(spark.table(name)) == [(1, "b", 2), (2, "c", 1)] and applied_batch(spark, name, "upsert") == 1


def test_check_states_of_a_stream(spark, tmp_path, table, rows):
    inbox, name = str(tmp_path / "in"), table()
    checks = (not_null("v"), not_null("id"))
    for batch in ([(1, "a", 1), (1, None, 2)], [(2, None, 1), (None, "x", 1)]):
        put(spark, inbox, *batch)
        check_stream(spark.readStream.schema(ROWS).parquet(inbox), checks, ["id"], name, str(tmp_path / "c")).awaitTermination()
    whole = spark.read.schema(ROWS).parquet(inbox)
    assert rows(stream_state(spark, name)) == rows(check_state(whole, checks, ["id"]))


def test_a_run_leaves_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    twice = json.dumps(event(run={"runId": "r1"}))
    (tmp_path / "in" / "a.txt").write_text("\n".join([twice, twice, json.dumps(request(run_id="g"))]))
    documents = document_stream(read_event_stream(spark, inbox), CONFIG, once_within="1 hour")
    write_documents(documents, out, state).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("\n".join([twice, json.dumps(event(run={"runId": "r2"}))]))
    write_documents(documents, out, state).awaitTermination()
    found = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted((d["run"]["runId"], d["eventType"]) for d in found) == [(r, t) for r in ("g", "r1", "r2") for t in ("COMPLETE", "START")]
