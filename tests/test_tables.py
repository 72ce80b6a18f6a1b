"""Catalog tables: creation, loads, all-or-nothing rewrites."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.operators.rowlevel import delete_where, merge_upsert, update_where
from keelson.session import scratch_path
from keelson.sources import tables

SCHEMA = "id int, name string, stamp int"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_create_if_absent(spark, table, rows):
    name = table()
    assert tables.create_from(frame(spark, (1, "a", 1)), name)
    assert not tables.create_from(frame(spark, (2, "b", 2)), name)
    assert rows(spark.table(name)) == [(1, "a", 1)]
    tables.create_like(frame(spark, (2, "b", 2)), name)
    tables.create_table(spark, name, "other int")
    assert rows(spark.table(name)) == [(1, "a", 1)]


def test_create_like_and_declared(spark, table):
    like, declared = table(), table()
    tables.create_like(frame(spark, (1, "a", 1)), like)
    tables.create_table(spark, declared, "id bigint COMMENT 'the key', at timestamp")
    assert spark.table(like).count() == 0 and spark.table(like).columns == ["id", "name", "stamp"]
    assert [f.dataType.simpleString() for f in spark.table(declared).schema] == ["bigint", "timestamp"]
    assert spark.table(declared).schema["id"].metadata["comment"] == "the key"


def test_append_goes_by_name(spark, table, rows):
    name = table()
    tables.create_from(frame(spark, (1, "a", 1)), name)
    tables.append(frame(spark, (2, "b", 2)).select("stamp", "name", "id"), name)
    tables.append(frame(spark, (3, "c", 3)).select("id"), name, allow_missing=True)
    assert rows(spark.table(name)) == [(1, "a", 1), (2, "b", 2), (3, None, None)]
    with pytest.raises(ValueError):
        tables.append(frame(spark).select("id"), name)


def test_overwrite_keeps_columns_and_replace_changes_them(spark, table, rows):
    name = table()
    tables.replace(frame(spark, (1, "a", 1)), name)
    first = tables.table_location(spark, name)
    assert tables.overwrite(frame(spark, (5, "e", 5)), name) == first
    assert rows(spark.table(name)) == [(5, "e", 5)]
    tables.replace(spark.table(name).select("id", F.upper("name").alias("big")), name)
    assert rows(spark.table(name)) == [(5, "E")]
    tables.replace(spark.table(name).where("id > 5"), name)
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["id", "big"]


def test_rewrite_reads_the_table_it_changes(spark, table, rows):
    name = table()
    tables.create_from(frame(spark, (1, "a", 1), (2, "b", 2), (3, None, 3)), name)
    tables.rewrite(spark, name, lambda t: delete_where(t, F.col("id") == 2))
    tables.rewrite(spark, name, lambda t: update_where(t, F.col("name") == "a", {"stamp": F.col("stamp") + t.count()}))
    assert rows(spark.table(name)) == [(1, "a", 3), (3, None, 3)]


def test_a_failed_write_leaves_the_table_as_it_was(spark, table, rows):
    name = table()
    tables.create_from(frame(spark, (1, "a", 1)), name)
    location = tables.table_location(spark, name)
    twice = frame(spark, (1, "x", 2), (1, "y", 2))
    with pytest.raises(PySparkException):
        tables.rewrite(spark, name, lambda t: merge_upsert(t, twice, ["id"]))
    with pytest.raises(PySparkException):
        tables.replace(spark.table(name).select(F.raise_error(F.lit("stop")).cast("int").alias("other")), name)
    assert rows(spark.table(name)) == [(1, "a", 1)]
    assert tables.table_location(spark, name) == location


def test_added_column_reads_null(spark, table, rows):
    name = table()
    tables.create_from(frame(spark, (1, "a", 1)), name)
    tables.add_table_column(spark, name, "source_system", "string", "it's new")
    assert rows(spark.table(name)) == [(1, "a", 1, None)]
    assert spark.table(name).schema["source_system"].metadata["comment"] == "it's new"
    tables.rewrite(spark, name, lambda t: update_where(t, F.lit(True), {"source_system": "crm"}))
    assert rows(spark.table(name)) == [(1, "a", 1, "crm")]


def test_keys_of_text_or_list():
    assert tables.parse_keys("none") == tables.parse_keys(None) == tables.parse_keys([]) == []
    assert tables.parse_keys(" id , day ") == tables.parse_keys(["id", "day"]) == ["id", "day"]


@pytest.mark.parametrize(
    ("keys", "mode", "expected"),
    [
        ("id", None, [(1, "new", 2), (2, "b", 1), (3, "c", 2)]),
        ("id", "append", [(1, "a", 1), (1, "new", 2), (2, "b", 1), (3, "c", 2)]),
        ("NONE", "merge", [(1, "a", 1), (1, "new", 2), (2, "b", 1), (3, "c", 2)]),
        (None, None, [(1, "a", 1), (1, "new", 2), (2, "b", 1), (3, "c", 2)]),
    ],
)
def test_load_modes(spark, table, rows, keys, mode, expected):
    name = table()
    assert tables.load_table(frame(spark, (1, "a", 1), (2, "b", 1)), name, keys, mode) == 2
    assert tables.load_table(frame(spark, (1, "new", 2), (3, "c", 2)), name, keys, mode) == len(expected)
    assert rows(spark.table(name)) == expected


def test_copy_counts_both_tables(spark, table, rows):
    source, target = table(), table()
    tables.create_from(frame(spark, (1, "a", 1), (2, "b", 2)), source)
    tables.create_from(frame(spark, (9, "z", 9)), target)
    assert rows(tables.copy_table(spark, source, target)) == [(2, 2, True)]
    assert rows(spark.table(target)) == rows(spark.table(source))


def test_upsert_table_counts(spark, table, rows):
    name = table()
    tables.create_from(frame(spark, (1, "a", 1), (1, "aa", 1), (2, "b", 1), (None, "n", 1)), name)
    source = frame(spark, (1, "x", 2), (3, "c", 2), (3, "cc", 2))
    assert tables.upsert_table(source, name, ["id"]) == {"deleted": 2, "inserted": 3, "total_in_target": 5}
    location = tables.table_location(spark, name)
    assert tables.upsert_table(frame(spark), name, ["id"]) == {"deleted": 0, "inserted": 0, "total_in_target": 5}
    assert tables.table_location(spark, name) == location


def test_incremental_upsert_table(spark, table, rows):
    name = table()
    source = frame(spark, (1, "a", 1), (2, "b", None))
    result = tables.incremental_upsert_table(source, name, ["id"], "stamp")
    assert result == {"deleted": 0, "inserted": 2, "total_in_target": 2}
    later = frame(spark, (1, "a2", 2), (3, "c", 3), (4, "equal", 1))
    result = tables.incremental_upsert_table(later, name, ["id"], "stamp")
    assert result == {"deleted": 1, "inserted": 2, "total_in_target": 3}
    assert tables.incremental_upsert_table(later, name, ["id"], "stamp")["inserted"] == 0
    assert rows(spark.table(name)) == [(1, "a2", 2), (2, "b", None), (3, "c", 3)]


def test_old_folders_can_be_removed(spark, table, rows):
    name, other = table(), table()
    tables.create_from(frame(spark, (1, "a", 1), (2, "b", 2)), name)
    tables.create_from(frame(spark, (3, "c", 3)), other, scratch_path(spark))
    previous = tables.rewrite(spark, name, lambda t: delete_where(t, F.col("id") == 2))
    assert spark.read.parquet(previous).count() == 2
    tables.remove_previous(spark, name, previous)
    with pytest.raises(PySparkException):
        spark.read.parquet(previous).count()
    for wrong in (tables.table_location(spark, name), tables.table_location(spark, other), "file:/tmp"):
        with pytest.raises(ValueError):
            tables.remove_previous(spark, name, wrong)
    assert rows(spark.table(name)) == [(1, "a", 1)] and spark.table(other).count() == 1


def test_a_staged_source_is_removed(spark, table):
    name = table()
    shared = spark.conf.get("spark.checkpoint.dir", None) or scratch_path(spark).rsplit("/", 1)[0]
    tables.create_from(frame(spark, (1, "a", 1)), name)
    before = set(os.listdir(shared))
    tables.upsert_table(frame(spark, (1, "x", 2)), name, ["id"])
    tables.load_table(frame(spark, (1, "y", 3)), name, "id")
    with pytest.raises(PySparkException):
        tables.load_table(frame(spark, (1, "p", 3), (1, "q", 3)), name, "id")
    assert set(os.listdir(shared)) == before
    assert spark.table(name).first()["name"] == "y"


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "bigint", "double"])
def test_merge_load_matches_keys_of_another_type(spark, table, rows, kind):
    name = table()
    tables.load_table(spark.createDataFrame([(9, "a"), (10, "a"), (50, "a")], "k int, v string"), name)
    new = spark.createDataFrame([(9, "b"), (10, "b"), (60, "b")], "k int, v string")
    tables.load_table(new.select(F.col("k").cast(kind).alias("k"), "v"), name, "k")
    assert sorted(rows(spark.table(name))) == [(9, "b"), (10, "b"), (50, "a"), (60, "b")]


def test_merge_load_matches_dates_by_timestamp(spark, table, rows):
    name = table()
    tables.load_table(spark.sql("SELECT DATE '2024-01-02' AS k, 1 AS v UNION ALL SELECT DATE '2024-01-10', 1"), name)
    tables.load_table(spark.sql("SELECT TIMESTAMP_NTZ '2024-01-10 00:00:00' AS k, 2 AS v"), name, "k")
    assert sorted(v for _, v in rows(spark.table(name))) == [1, 2]
