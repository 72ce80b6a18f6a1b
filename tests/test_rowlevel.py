"""Row-level operators on hand-made rows: null keys, duplicates, marks, ties."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.operators.columns import add_audit_columns, add_column, conform, normalize_timestamps
from keelson.operators.latest import latest_per_key
from keelson.operators.rowlevel import (
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
from keelson.operators.validation import compare_counts, sample_rows, schema_rows


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "c", 12), (None, "d", 13)], "k int, v string, w int")


def test_null_keys_never_match(spark, target, rows):
    source = spark.createDataFrame([(None,), (2,)], "k int")
    assert rows(delete_matching(target, source, ["k"]), "v") == [("a",), ("b",), ("d",)]
    assert rows(keep_matching(target, source, ["k"]), "v") == [("c",)]


def test_key_types_may_differ(spark, target, rows):
    source = spark.createDataFrame([(2,), (3_000_000_000,)], "k bigint")
    assert rows(delete_matching(target, source, ["k"]), "v") == [("a",), ("b",), ("d",)]
    as_double = spark.createDataFrame([(2.0,), (1.5,)], "k double")
    assert rows(keep_matching(target, as_double, ["k"]), "v") == [("c",)]


def test_composite_keys_need_every_part(spark, rows):
    target = spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, "x", 3)], "a int, b string, v int")
    source = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "a int, b string")
    assert rows(delete_matching(target, source, ["a", "b"]), "v") == [(2,), (3,)]


def test_delete_insert_keeps_source_duplicates(spark, target, rows):
    source = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, "n", 2)], "k int, v string, w int")
    result = delete_insert(target, source, ["k"])
    assert rows(result, "k", "v") == sorted([(2, "c"), (None, "d"), (1, "x"), (1, "x"), (None, "n")], key=repr)
    assert rows(upsert_metrics(target, source, ["k"])) == [(2, 3, 5)]


def test_delete_insert_of_some_columns(spark, target, rows):
    source = spark.createDataFrame([(2, "x", 1, "other")], "k int, v string, w int, z string")
    result = delete_insert(target, source, ["k"], insert_columns=["k", "v"])
    assert (2, "x", None) in rows(result) and result.columns == target.columns


def test_metrics_of_empty_sides(target, rows):
    assert rows(upsert_metrics(target, target.limit(0), ["k"])) == [(0, 0, 4)]
    assert rows(upsert_metrics(target.limit(0), target, ["k"])) == [(0, 4, 4)]


def test_merge_overwrites_with_nulls_and_keeps_other_columns(spark, target, rows):
    source = spark.createDataFrame([(2, None), (5, "new"), (None, "n")], "k int, v string")
    expected = [(1, "a", 10), (1, "b", 11), (2, None, 12), (None, "d", 13), (5, "new", None), (None, "n", None)]
    assert rows(merge_upsert(target, source, ["k"])) == sorted(expected, key=repr)


def test_merge_updates_every_matched_target_row(spark, target, rows):
    source = spark.createDataFrame([(1, "x", 0)], "k int, v string, w int")
    assert [r for r in rows(merge_upsert(target, source, ["k"])) if r[0] == 1] == [(1, "x", 0), (1, "x", 0)]


def test_merge_of_listed_columns(spark, target, rows):
    source = spark.createDataFrame([(2, "x", 0), (7, "y", 1)], "k int, v string, w int")
    result = rows(merge_upsert(target, source, ["k"], update_columns=["w"]))
    assert (2, "c", 0) in result and (7, "y", 1) in result


def test_merge_fails_on_ambiguous_source_only(spark, target, rows):
    twice = spark.createDataFrame([(1, "x", 0), (1, "y", 0)], "k int, v string, w int")
    with pytest.raises(PySparkException, match="several source rows match one target row"):
        merge_upsert(target, twice, ["k"]).count()
    new_twice = spark.createDataFrame([(9, "x", 0), (9, "y", 0), (None, "p", 0), (None, "q", 0)], "k int, v string, w int")
    assert merge_upsert(target, new_twice, ["k"]).count() == 8


def test_merge_of_keys_only(spark, target, rows):
    source = spark.createDataFrame([(2,), (8,)], "k int")
    result = rows(merge_upsert(target, source, ["k"]))
    assert (2, "c", 12) in result and (8, None, None) in result and len(result) == 5


def test_unknown_and_missing_columns_are_errors(spark, target):
    with pytest.raises(ValueError, match="not in the target"):
        merge_upsert(target, target.withColumn("z", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="missing from the source"):
        delete_insert(target, target.drop("w"), ["k"])
    with pytest.raises(ValueError, match="update columns"):
        merge_upsert(target, target.drop("w"), ["k"], update_columns=["w"])
    with pytest.raises(ValueError, match="not in the frame"):
        update_where(target, F.col("k") == 1, {"zz": 1})


def test_delete_and_update_treat_null_as_not_true(spark, target, rows):
    assert rows(delete_where(target, F.col("k") == 1), "v") == [("c",), ("d",)]
    updated = update_where(target, F.col("k") < 2, {"w": F.col("w") + 1, "v": "z"})
    assert rows(updated, "v", "w") == [("c", 12), ("d", 13), ("z", 11), ("z", 12)]
    assert updated.schema["w"].dataType == target.schema["w"].dataType


def test_update_sees_old_values(spark, rows):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows(update_where(df, F.lit(True), {"a": F.col("b"), "b": F.col("a")})) == [(2, 1)]


def test_insert_partial_goes_by_name(spark, target, rows):
    rows_in = spark.createDataFrame([("x", 9)], "v string, k bigint")
    assert (9, "x", None) in rows(insert_partial(target, rows_in))
    assert conform(rows_in, target.schema, allow_missing=True).schema["k"].dataType.simpleString() == "int"


def test_latest_needs_and_uses_tie_breakers(spark, rows):
    df = spark.createDataFrame(
        [(1, 5, 1, "a"), (1, 5, 2, "b"), (1, None, 9, "c"), (2, None, 1, "d"), (None, 1, 1, "e"), (None, 2, 1, "f")],
        "k int, o int, t int, v string",
    )
    assert rows(latest_per_key(df, ["k"], "o", ["t"]), "v") == [("b",), ("d",), ("f",)]
    with pytest.raises(ValueError):
        latest_per_key(df, ["k"], "o", [])


def test_latest_then_replace(spark, target, rows):
    source = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (None, "p", 1), (None, "q", 2)], "k int, v string, w int")
    result = latest_then_replace(target, source, ["k"], "w", ["v"])
    assert rows(result, "v") == [("a",), ("b",), ("d",), ("new",), ("q",)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "string", "decimal(10,3)", "double"])
def test_high_mark_is_strict_and_exact(spark, kind):
    values = {
        "int": "(1), (2), (3), (NULL)",
        "string": "('a'), ('b''c'), ('d'), (NULL)",
        "date": "(date '2024-01-01'), (date '2024-01-02'), (date '2024-01-03'), (NULL)",
        "decimal(10,3)": "(1.001), (1.002), (1.003), (NULL)",
        "double": "(0.1D), (0.30000000000000004D), (0.4D), (NULL)",
    }.get(kind, "('2024-01-01 00:00:00.000001'), ('2024-10-27 00:30:00.000002'), ('2024-10-27 00:30:00.000003'), (NULL)")
    df = spark.sql(f"SELECT CAST(c AS {kind}) AS c FROM VALUES {values} AS t(c)")
    ordered = [r[0] for r in df.where("c IS NOT NULL").orderBy("c").collect()]
    target = df.where(F.col("c").isNotNull()).orderBy("c").limit(2)
    extract = incremental_extract(df, target, "c")
    assert [r[0] for r in extract.collect()] == ordered[2:]
    assert extract.schema == df.schema


def test_first_load_takes_null_stamps_and_later_loads_do_not(spark, rows):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "k int, s int")
    assert incremental_extract(df, df.where("s IS NULL"), "s").count() == 3
    assert rows(incremental_extract(df, df.where("k = 1"), "s")) == [(3, 2)]
    assert rows(count_unstamped(df, "s")) == [(1,)]


def test_incremental_upsert_without_news_changes_nothing(spark, target, rows):
    result = incremental_upsert(target.where("w <= 12"), target, ["k"], "w")
    assert rows(result.rows) == rows(target) and rows(result.metrics) == [(0, 0, 4)]


def test_incremental_upsert_counts(spark, target, rows):
    source = spark.createDataFrame([(1, "x", 20), (3, "y", 21), (2, "late", 5), (4, "equal", 13)], "k int, v string, w int")
    result = incremental_upsert(source, target, ["k"], "w")
    assert rows(result.rows, "v") == [("c",), ("d",), ("x",), ("y",)]
    assert rows(result.metrics) == [(2, 2, 4)]


def test_column_operators(spark, rows):
    df = spark.sql("SELECT 1 AS id, timestamp_ntz '2024-01-02 03:04:05.000006' AS a, timestamp '2024-01-02 00:00:00' AS b, 'x' AS c")
    normal = normalize_timestamps(df)
    assert [f.dataType.simpleString() for f in normal.schema] == ["int", "timestamp", "timestamp", "string"]
    assert rows(normal.select(F.date_format("a", "yyyy-MM-dd HH:mm:ss.SSSSSS"))) == [("2024-01-02 03:04:05.000006",)]
    audited = add_audit_columns(df, "done", F.lit("2024-01-01").cast("timestamp"))
    assert audited.columns == [*df.columns, "processed_at", "processing_status"]
    assert add_audit_columns(df, "done").schema["processed_at"].dataType.simpleString() == "timestamp"
    wider = add_column(df, "extra", "string", "a note")
    assert wider.schema["extra"].metadata["comment"] == "a note" and wider.first()["extra"] is None
    with pytest.raises(ValueError):
        add_column(df, "ID", "int")


def test_validation_operators(spark, target, rows):
    assert rows(compare_counts(target, target.limit(1))) == [(4, 1, False)]
    assert rows(compare_counts(target.limit(0), target.limit(0))) == [(0, 0, True)]
    assert [r["k"] for r in sample_rows(target, "k", "v", n=4).collect()] == [1, 1, 2, None]
    assert rows(schema_rows(target), "name", "data_type") == [("k", "int"), ("v", "string"), ("w", "int")]
