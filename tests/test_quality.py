"""Quality checks, scores, points and asset names."""

import json

from pyspark.sql import functions as F

from keelson.functions.expressions import truncated_percentage
from keelson.operators.quality import (
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

CHECKS = [
    not_null("customer_id"),
    allowed_values("status", ["new", "done"]),
    column_exists("age"),
    parses_as_timestamp("at"),
    parses_as_timestamp("day", "dd/MM/yyyy"),
]


def customers(spark, *rows):
    return spark.createDataFrame(list(rows), "customer_id int, status string, at string, day string")


def test_checks(spark):
    df = customers(spark, (1, "new", "2024-01-01 10:00:00", "31/12/2023"), (2, None, None, None), (3, "odd", "soon", "31/12/2023"))
    results = {r["description"]: r for r in run_checks(df, CHECKS).collect()}
    assert [r["status"] for r in results.values()] == ["PASS", "FAIL", "FAIL", "FAIL", "PASS"]
    assert results["customer_id not null"]["types"] == ["Completeness"]
    assert results["status in allowed values"]["applicableFields"] == ["status"]


def test_checks_on_no_rows(spark):
    statuses = [r["status"] for r in run_checks(customers(spark), CHECKS).collect()]
    assert statuses == ["PASS", "PASS", "FAIL", "PASS", "PASS"]
    assert evaluate_checks(customers(spark), CHECKS, ["status"]).count() == 0


def test_one_pass_for_all_checks(spark):
    plan = run_checks(customers(spark, (1, "new", None, None)), CHECKS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_percentage_is_truncated_in_doubles(spark):
    pairs = spark.createDataFrame([(p, n) for n in range(0, 101) for p in range(0, n + 1)], "p bigint, n bigint")
    got = pairs.select("p", "n", truncated_percentage(F.col("p"), F.col("n")).alias("x")).collect()
    assert all(r["x"] == (int(r["p"] / r["n"] * 100) if r["n"] else None) for r in got)
    assert {(r["p"], r["n"]): r["x"] for r in got}[(29, 100)] == 28


def test_score(spark, rows):
    results = spark.createDataFrame(
        [("a", "PASS"), ("a", "FAIL"), ("a", "FAIL"), ("a", "FAIL"), ("b", "pass"), ("b", "Pass"), ("c", None)],
        "asset string, status string",
    )
    columns = ("evaluationsCount", "passingPercentage")
    assert rows(score_checks(results, ["asset"]), "asset", *columns) == [("a", 4, 25), ("b", 2, 100), ("c", 1, 0)]
    assert rows(score_checks(results.limit(0)), *columns) == [(0, None)]


def test_points(spark):
    df = customers(spark, (1, "new", None, None), (2, "odd", None, None))
    evaluated = evaluate_checks(df, CHECKS[:3], ["status"])
    as_of = F.timestamp_micros(F.lit(0))
    points = quality_points(evaluated, "status", "results", "quality", "3", as_of).orderBy("entityIdentifier").collect()
    assert [p["entityIdentifier"] for p in points] == ["new", "odd"]
    assert {(p["entityType"], p["formName"], p["typeIdentifier"], p["typeRevision"]) for p in points} == {
        ("ASSET", "results", "quality", "3")
    }
    content = json.loads(points[0]["content"])
    assert list(content) == ["evaluations", "passingPercentage", "evaluationsCount"]
    assert content["passingPercentage"] == 66 and content["evaluationsCount"] == 3
    assert content["evaluations"][0] == {
        "types": ["Completeness"],
        "description": "customer_id not null",
        "status": "PASS",
        "applicableFields": ["customer_id"],
    }


def test_point_without_evaluations(spark):
    evaluated = evaluate_checks(customers(spark), [])
    content = quality_points(evaluated.withColumn("asset", F.lit("x")), "asset", "f", "t", "1").first()["content"]
    assert json.loads(content) == {"evaluations": [], "evaluationsCount": 0}


def test_asset_names(spark, rows):
    names = spark.createDataFrame([("Orders",), ("orders",), ("ORDER",), (None,), ("",)], "name string")
    assets = spark.createDataFrame(
        [("id2", "ORDERS", "p"), ("id1", "orders", "q"), ("id3", "orders2", "p"), ("id4", None, "p")],
        "identifier string, name string, project string",
    )
    found = rows(resolve_assets(names, assets))
    assert found == sorted([("Orders", "id1"), ("orders", "id1"), ("ORDER", None), (None, None), ("", "id4")], key=repr)
    in_project = rows(resolve_assets(names, assets, project="p"))
    assert ("orders", "id2") in in_project
    ordered = rows(resolve_assets(names, assets, order_by=["project"]))
    assert ("orders", "id2") in ordered


def test_states_of_parts_add_up(spark, rows):
    checks = (not_null("id"), allowed_values("kind", ["a", "b"]), column_exists("more"), column_exists("id"), not_null("more"))
    old = spark.createDataFrame([("p", 1, "a"), ("p", None, "b"), ("q", 2, "a")], "asset string, id int, kind string")
    new = spark.createDataFrame([("q", 3, "z", 1), ("r", 4, None, None)], "asset string, id int, kind string, more int")
    whole = old.unionByName(new.drop("more"))
    merged = merge_states(check_state(old, checks, ["asset"]), check_state(new, checks, ["asset"]))
    of = lambda df: {(r.asset, r.check): (r["rows"], r.failing, r.absent) for r in df.collect()}
    assert of(merged)["q", 1] == (2, 1, 0) and of(merged)["p", 0] == (2, 1, 0) and of(merged)["q", 2] == (2, 0, 1) and of(merged)["r", 4] == (1, 1, 0)
    without = checks[:2] + checks[3:4]
    merged = merge_states(*(check_state(part, without, ["asset"]) for part in (old, new.drop("more"), old.limit(0))))
    assert rows(evaluate_state(merged, without)) == rows(evaluate_checks(whole, without, ["asset"]))
    assert rows(merged) == rows(check_state(whole, without, ["asset"]))


def test_the_state_of_no_rows(spark, rows):
    checks = (not_null("id"), column_exists("more"))
    none = spark.createDataFrame([], "asset string, id int")
    assert check_state(none, checks, ["asset"]).count() == 0
    assert rows(evaluate_state(check_state(none, checks), checks)) == rows(evaluate_checks(none, checks))
