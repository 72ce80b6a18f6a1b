"""Partitioned and bucketed tables, table properties, and the filter of source keys."""

import glob
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.operators.joins import spread_join
from keelson.operators.keyfilter import change_touched_rows, key_filter
from keelson.operators.rowlevel import delete_insert, delete_where, merge_upsert, update_where
from keelson.sources import tables
from keelson.sources.tables import Layout

SCHEMA = "id bigint, part string, day date, v string"
BY_PART = Layout(partition_by=("part", "day"))


@pytest.fixture
def start(spark):
    """Rows of four parts, one of them null, on two days."""
    return spark.range(40).selectExpr(
        "id", "if(id % 4 = 3, null, concat('a/b =', id % 4)) AS part",
        "date'2024-01-01' + cast(id % 2 AS int) AS day", "'old' AS v",
    )


def files(spark, name):
    """Modification times of the table's files, by path."""
    folder = tables.table_location(spark, name).removeprefix("file:")
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def source(spark, *rows):
    return spark.createDataFrame([(i, p, __import__("datetime").date(2024, 1, d), v) for i, p, d, v in rows], SCHEMA)


def test_a_merge_rewrites_only_touched_partitions(spark, table, rows, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    before = files(spark, name)
    # 0 is updated in place, 1 moves to another part, 99 is new; "" names the null partition.
    tables.load_table(source(spark, (0, "a/b =0", 1, "new"), (1, "a/b =0", 1, "new"), (99, "", 3, "new")), name, "id")
    expected = {r.id: (r.part, str(r.day), r.v) for r in start.collect()}
    expected |= {0: ("a/b =0", "2024-01-01", "new"), 1: ("a/b =0", "2024-01-01", "new"), 99: (None, "2024-01-03", "new")}
    assert {r.id: (r.part, str(r.day), r.v) for r in spark.table(name).collect()} == expected
    after = files(spark, name)
    kept = {p for p in before if "%3D2" in p or "HIVE_DEFAULT" in p}
    assert kept and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in set(before) - kept)


def test_an_upsert_into_a_partitioned_table(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    counts = tables.upsert_table(source(spark, (0, "a/b =0", 1, "x"), (0, "a/b =0", 1, "y"), (50, "z", 1, "x")), name, ["id"])
    assert counts == {"deleted": 1, "inserted": 3, "total_in_target": 42}


def test_keys_that_hold_the_partition_columns(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    new = source(spark, (0, "a/b =0", 1, "new"), (0, "a/b =1", 2, "other"), (3, None, 2, "null key"))
    tables.load_table(new, name, "id,part,day")
    found = spark.table(name)
    assert found.count() == 42 and found.where("v = 'new'").count() == 1 and found.where("id = 3").count() == 2


def test_a_partition_that_empties_is_dropped(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    before = files(spark, name)
    gone = F.col("part").isNull()
    tables.rewrite(spark, name, lambda t: delete_where(t, gone), touching=gone)
    assert spark.table(name).count() == 30
    assert not any("HIVE_DEFAULT" in r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
    after = files(spark, name)
    assert after == {p: t for p, t in before.items() if "HIVE_DEFAULT" not in p}
    tables.append(source(spark, (3, None, 2, "again")), name)
    assert spark.table(name).where(gone).count() == 1


def test_an_update_may_move_rows_to_other_partitions(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    which = F.col("id") == 0
    tables.rewrite(spark, name, lambda t: update_where(t, which, {"part": "a/b =1", "day": "2024-01-02"}), touching=which)
    found = spark.table(name)
    assert found.count() == 40 and found.where("part = 'a/b =1'").count() == 11


def test_overwrite_replace_and_rewrite_of_a_partitioned_table(spark, table, rows, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    tables.rewrite(spark, name, lambda t: t.where("id < 30"))
    assert spark.table(name).count() == 30
    tables.overwrite(start.where("id = 1"), name)
    assert rows(spark.table(name), "id") == [(1,)] and spark.sql(f"SHOW PARTITIONS {name}").count() == 1
    tables.replace(start.withColumn("more", F.lit(1)).select("more", "v", "day", "part", "id"), name)
    assert set(spark.table(name).columns) == {"id", "more", "part", "day", "v"} and spark.table(name).count() == 40
    assert tables.table_layout(spark, name).partition_by == ("part", "day")
    with pytest.raises(ValueError, match="laid out"):
        tables.replace(start.select("id", "v"), name)
    tables.overwrite(spark.table(name).limit(0), name)
    assert spark.table(name).count() == 0


def test_a_failed_change_leaves_a_partitioned_table_as_it_was(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    before = files(spark, name)
    broken = F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("v"))
    with pytest.raises(PySparkException):
        tables.rewrite(spark, name, lambda t: t.withColumn("v", broken))
    assert files(spark, name) == before and spark.table(name).where("v = 'old'").count() == 40


def test_a_merge_that_matches_twice_fails_and_changes_nothing(spark, table, start):
    name = table()
    tables.create_from(start, name, layout=BY_PART)
    with pytest.raises(PySparkException):
        tables.load_table(source(spark, (0, "a/b =0", 1, "x"), (0, "a/b =0", 1, "y")), name, "id")
    assert spark.table(name).where("v = 'old'").count() == 40


def test_a_bucketed_table_is_joined_without_moving_it(spark, table, start):
    name = table()
    layout = Layout(bucket_by=("id",), buckets=4, codec="zstd", properties={"owner.team": "o'brien"})
    tables.create_from(start, name, layout=layout)
    assert tables.table_layout(spark, name).properties["owner.team"] == "o'brien"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for operator in (merge_upsert, delete_insert):
            new = source(spark, (0, "p", 1, "new"), (77, "p", 1, "new"))
            plan = operator(spark.table(name), new, ["id"], aligned=True)._jdf.queryExecution().executedPlan().toString()
            scans = [i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line]
            assert scans
            for i in scans:  # up from the scan to the join, no row of the table is exchanged
                depth = len(plan.splitlines()[i]) - len(plan.splitlines()[i].lstrip(" :+-"))
                for line in reversed(plan.splitlines()[:i]):
                    indent = len(line) - len(line.lstrip(" :+-"))
                    if indent < depth:
                        depth = indent
                        assert "Exchange" not in line
                        if "Join" in line:
                            break
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = tables.table_location(spark, name)
    tables.load_table(source(spark, (0, "p", 1, "new"), (77, "p", 1, "new")), name, "id")
    assert spark.table(name).count() == 41 and spark.table(name).where("v = 'new'").count() == 2
    now = tables.table_layout(spark, name)
    assert now.bucket_by == ("id",) and now.buckets == 4 and now.codec == "zstd"
    assert all("zstd" in p for p in files(spark, name))
    assert spark.table(name).where("id = 77").count() == 1  # bucket pruning still finds the row
    assert tables.upsert_table(source(spark, (77, "p", 1, "x")), name, ["id"]) == {"deleted": 1, "inserted": 1, "total_in_target": 41}
    tables.remove_previous(spark, name, first)


def test_a_layout_is_whole(spark):
    with pytest.raises(ValueError):
        Layout(bucket_by=("id",))


# --- the filter of source keys --------------------------------------------------


def test_untouched_rows_go_round_the_join(spark):
    """One row in a hundred is touched, uniformly: hardly more are shuffled."""
    target = spark.range(200_000, numPartitions=8).select(F.xxhash64("id").alias("k"), F.col("id").alias("v"))
    new = spark.range(0, 200_000, 100, 4).select(F.xxhash64("id").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    new = new.union(spark.range(5).select(F.col("id").alias("k"), F.lit(-1).cast("bigint")))
    may_match = key_filter(target, new, ["k"], 2005)
    near = target.where(may_match)
    assert near.join(new, "k").count() == 2000 and near.count() < 2000 + 200_000 * 0.03
    merged = change_touched_rows(target, new, ["k"], lambda t: merge_upsert(t, new, ["k"]), least_rows=0)
    assert merged.count() == 200_005 and merged.where("v = -1").count() == 2005


@pytest.mark.parametrize("operator", [merge_upsert, delete_insert])
def test_the_filter_changes_no_result(spark, rows, operator):
    rng = random.Random(1)
    some = lambda n, values: [(rng.choice(values), rng.choice([1.5, -0.0, float("nan"), None, 2.0]), f"{i}") for i in range(n)]
    schema = "a string, b double, v string"
    target = spark.createDataFrame(some(300, ["x", "y", "", None, "zz"]), schema)
    new = spark.createDataFrame(some(60, ["x", None, "new"]), "a string, b float, v string").dropDuplicates(["a", "b"])
    change = lambda t: operator(t, new, ["a", "b"])
    plain = operator(target, new, ["a", "b"])
    filtered = change_touched_rows(target, new, ["a", "b"], change, least_rows=0)
    text = F.struct("a", F.col("b").cast("string"), "v").cast("string")  # NaN is not itself in Python
    assert rows(filtered.select(text)) == rows(plain.select(text))
    assert rows(change_touched_rows(target, new.limit(0), ["a", "b"], lambda t: operator(t, new.limit(0), ["a", "b"]), least_rows=0).select(text)) == rows(target.select(text))


def test_a_full_filter_is_left_out(spark):
    keys = spark.range(10_000)
    assert key_filter(keys, keys, ["id"], 10_000, max_bytes=128) is None
    assert key_filter(keys, keys, ["id"], 10_000) is not None


def test_text_under_a_collation_is_joined_by_its_equality(spark, rows):
    target = spark.sql("SELECT * FROM VALUES ('a' COLLATE UTF8_LCASE, 1), ('B' COLLATE UTF8_LCASE, 2) AS t(k, v)")
    new = spark.sql("SELECT * FROM VALUES ('A' COLLATE UTF8_LCASE, 9) AS t(k, v)")
    assert key_filter(target, new, ["k"], 1) is None
    assert rows(merge_upsert(target, new, ["k"]), "v") == [(2,), (9,)]


def test_hot_floating_keys_are_split_and_equal_ones_meet(spark):
    nan = float("nan")
    left = spark.createDataFrame([(0.0,), (-0.0,), (nan,), (1.5,), (None,)], "k double")
    right = spark.createDataFrame([(-0.0, "zero"), (nan, "nan")], "k float, name string")
    found = spread_join(left, right, ["k"], "left")
    assert sorted((repr(r.k), r.name) for r in found.collect()) == sorted(
        [("0.0", "zero"), ("-0.0", "zero"), ("nan", "nan"), ("1.5", None), ("None", None)]
    )
