"""Plans and skew: what has to hold when the tables are large."""

import pytest
from pyspark.sql import functions as F

from keelson.operators.joins import spread_join
from keelson.operators.latest import latest_per_key
from keelson.operators.rowlevel import change_in_key_range, delete_insert, delete_matching, delete_where, incremental_extract, keep_matching, merge_upsert, upsert_metrics
from keelson.operators.quality import resolve_assets

SMALL_TASKS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
}


@pytest.fixture
def small_tasks(spark):
    before = {k: spark.conf.get(k) for k in SMALL_TASKS}
    for k, v in SMALL_TASKS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def hot(spark):
    """A target with 60,000 rows, half of them under one key."""
    ids = spark.range(0, 60_000, 1, 16)
    return ids.select(F.when(F.col("id") < 30_000, F.lit(7)).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))


@pytest.fixture
def source(spark):
    """A source with one hot key of its own that the target has not."""
    ids = spark.range(0, 20_000, 1, 16)
    return ids.select(F.when(F.col("id") < 8_000, F.lit(-1)).otherwise(F.col("id") + 40_000).alias("k"), F.lit("new").alias("v"))


@pytest.mark.parametrize("name", ["delete", "keep", "delete_insert", "merge"])
def test_a_hot_target_key_is_split(small_tasks, hot, source, name):
    run = {
        "delete": lambda: delete_matching(hot, source, ["k"]),
        "keep": lambda: keep_matching(hot, source, ["k"]),
        "delete_insert": lambda: delete_insert(hot, source, ["k"]),
        "merge": lambda: merge_upsert(hot, source, ["k"]),
    }[name]
    assert "SortMergeJoin(skew=true)" in final_plan(run())


def test_hot_null_keys_are_split(small_tasks, hot, source):
    nulls = hot.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    result = merge_upsert(nulls, source, ["k"])
    assert "SortMergeJoin(skew=true)" in final_plan(result)
    assert result.count() == 68_000 and result.where("k IS NULL").count() == 30_000


def test_results_under_skew_are_whole(small_tasks, hot, source):
    assert delete_matching(hot, source, ["k"]).count() == 60_000 - 12_000
    assert keep_matching(hot, source, ["k"]).count() == 12_000
    assert delete_insert(hot, source, ["k"]).count() == 48_000 + 20_000
    merged = merge_upsert(hot, source, ["k"])
    assert merged.count() == 60_000 + 8_000
    assert merged.where("v = 'new'").count() == 20_000


def test_a_hot_name_is_split(small_tasks, spark, hot):
    names = hot.select(F.col("k").cast("string").alias("name"), "v")
    assets = spark.range(0, 60_000, 1, 16).select(F.col("id").cast("string").alias("name"), F.col("id").alias("identifier"))
    found = resolve_assets(names, assets)
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.count() == 60_000 and found.where("asset_id IS NULL").count() == 0


def test_a_hot_key_is_cut_before_the_shuffle(spark, hot):
    latest = latest_per_key(hot, ["k"], "v", ["k"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert latest.count() == 30_001


def test_metrics_count_a_hot_key_before_the_shuffle(small_tasks, hot, source):
    plan = final_plan(upsert_metrics(hot, source, ["k"]))
    assert "partial_count" in plan and "Window" not in plan
    assert tuple(upsert_metrics(hot, source, ["k"]).first()) == (12_000, 20_000, 68_000)


def test_metrics_of_a_small_source_move_only_matches(spark, hot, source):
    plan = upsert_metrics(hot, source.limit(10), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    counting, join = plan.index("count(1) AS __count"), plan.index("Join LeftSemi")
    assert counting < join  # the plan is printed from the top: the join feeds the counting
    large = upsert_metrics(hot, source, ["k"])
    assert tuple(large.first()) == (12_000, 20_000, 68_000)


def test_a_small_source_moves_no_target_rows(spark, hot, source):
    few = source.limit(10)
    for df in (delete_insert(hot, few, ["k"]), keep_matching(hot, few, ["k"])):
        plan = final_plan(df)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_the_high_mark_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(1000).select("id", F.timestamp_seconds(F.col("id")).alias("at"), F.lit("x").alias("pad")).write.parquet(path)
    events = spark.read.parquet(path)
    extract = incremental_extract(events, events.where("id <= 500"), "at").select("id")
    plan = extract._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(at," in plan and "pad" not in plan
    assert extract.count() == 499


def test_rows_outside_the_key_range_are_not_shuffled(spark, small_tasks, tmp_path, rows):
    target_path, source_path = str(tmp_path / "t"), str(tmp_path / "s")
    some = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") != 3, F.col("id")).alias("k"), F.lit("old").alias("v"))
    some.write.parquet(target_path)
    spark.range(990, 1010).select(F.col("id").alias("k"), F.lit("new").alias("v")).write.parquet(source_path)
    target, source = spark.read.parquet(target_path), spark.read.parquet(source_path)
    for change in (lambda t: delete_insert(t, source, ["k"]), lambda t: merge_upsert(t, source, ["k"])):
        ranged = change_in_key_range(target, source, "k", change)
        assert rows(ranged) == rows(change(target))
        plan = ranged._jdf.queryExecution().executedPlan().toString()
        assert "Or(Or(LessThan(k,990),GreaterThan(k,1009)),IsNull(k))" in plan
        assert "GreaterThanOrEqual(k,990), LessThanOrEqual(k,1009)" in plan
    nothing = source.where("k IS NULL")
    assert change_in_key_range(target, nothing, "k", lambda t: delete_insert(t, nothing, ["k"])).count() == 1000


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(12,2)", "smallint", "double", "binary"])
def test_key_ranges_of_every_type(spark, rows, kind):
    def keyed(low, high, v):
        n = F.col("id")
        by_kind = {"string": F.concat(F.lit("k'"), n.cast("string")), "binary": n.cast("string").cast("binary")}
        day = F.date_add(F.lit("2024-10-20").cast("date"), n.cast("int"))
        key = by_kind.get(kind, day if "date" in kind or "time" in kind else n)
        return spark.range(low, high).select(key.cast(kind).alias("k"), F.lit(v).alias("v"))

    target, source = keyed(0, 20, "old"), keyed(15, 25, "new")
    change = lambda t: delete_insert(t, source, ["k"])
    result = change_in_key_range(target, source, "k", change)
    assert rows(result) == rows(change(target)) and result.count() == 25


def test_a_delete_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.when(F.col("id") > 2, F.col("id")).alias("id"), F.lit("x").alias("pad")).write.parquet(path)
    kept = delete_where(spark.read.parquet(path), F.col("id") < 50)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Or(GreaterThanOrEqual(id,50),IsNull(id))" in plan
    assert kept.count() == 53


def test_metrics_read_only_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("x").alias("pad")).write.parquet(path)
    t = spark.read.parquet(path)
    plan = upsert_metrics(t, t, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "pad" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("kinds", [("bigint", "decimal(20,0)"), ("string", "bigint"), ("bigint", "int")])
def test_keys_of_differing_types_join_as_plainly(spark, kinds):
    left = spark.range(60).select((F.col("id") % 20).cast(kinds[0]).alias("k"), "id")
    right = spark.range(0, 40, 3).select(F.col("id").cast(kinds[1]).alias("k"))
    for how in ("left_semi", "left_anti"):
        spread = spread_join(left, right, ["k"], how)
        assert sorted(r.id for r in spread.collect()) == sorted(r.id for r in left.join(right, ["k"], how).collect())
        assert "xxhash64" in spread._jdf.queryExecution().toString()
