"""Counts and ranges from Parquet footers, against reading the columns."""

import pytest
from pyspark.sql import functions as F

from keelson.sources import footers, tables
from keelson.sources.tables import Layout


def values(spark, extents, column):
    low, high = extents[column]
    return tuple(spark.range(1).select(low, high).first())


@pytest.fixture
def stamped(spark):
    return spark.range(0, 1000, 1, 4).selectExpr(
        "id", "timestamp_micros(id * 86400000001 - 9000000000000000) AS at", "cast(timestamp_micros(id * 1000003) AS timestamp_ntz) AS local",
        "date'1969-12-01' + cast(id AS int) AS day", "cast(id AS smallint) AS small", "if(id > 9, id, null) AS some", "cast(null AS int) AS none",
        "cast(id AS string) AS text", "cast(id AS double) AS ratio",
    )


COLUMNS = ["id", "at", "local", "day", "small", "some"]


def test_footers_answer_as_the_columns_do(spark, table, stamped, monkeypatch):
    name = table()
    tables.create_from(stamped, name)
    expected = stamped.agg(*(f(c) for c in COLUMNS for f in (F.min, F.max))).first()
    monkeypatch.setattr(tables, "column_extents", None)  # no column is read
    found = tables.table_extents(spark, name, COLUMNS)
    assert found["rows"] == 1000
    assert [v for c in COLUMNS for v in values(spark, found, c)] == list(expected)
    for c in COLUMNS:
        assert spark.table(name).where(F.col(c) > tables.table_high_mark(spark, name, c)).count() == 0
        assert spark.table(name).where(F.col(c) == tables.table_high_mark(spark, name, c)).count() == 1


def test_the_plan_reads_footers_only(spark, table, stamped):
    name = table()
    tables.create_from(stamped, name)
    with footers._footer_settings(spark):
        frame = footers._from_footers(spark, tables.table_location(spark, name), ["at"])
        plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(at), MAX(at)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_a_column_without_values(spark, table, stamped):
    name = table()
    tables.create_from(stamped, name)
    assert tables.table_extents(spark, name, ["none"]) == {"rows": 1000, "none": (None, None)}
    assert tables.table_high_mark(spark, name, "none") is None


@pytest.mark.parametrize("columns", [["text"], ["ratio"], ["id", "text"]])
def test_other_types_are_read(spark, table, stamped, columns):
    name = table()
    tables.create_from(stamped, name)
    assert footers.file_extents(spark.table(name), tables.table_location(spark, name), columns) is None
    found = tables.table_extents(spark, name, columns)
    assert found["rows"] == 1000 and values(spark, found, columns[-1]) == tuple(stamped.agg(F.min(columns[-1]), F.max(columns[-1])).first())


def test_tables_whose_files_differ_are_read(spark, table, stamped):
    """Added columns, partitions, nested columns, and an empty table."""
    name, parted, nested, empty = (table() for _ in range(4))
    tables.create_from(stamped.select("id", "day"), name)
    tables.add_table_column(spark, name, "later", "bigint")
    tables.append(spark.sql("SELECT 5000L AS id, date'2030-01-01' AS day, 7L AS later"), name)
    found = tables.table_extents(spark, name, ["id", "later"])
    assert found["rows"] == 1001 and values(spark, found, "id") == (0, 5000) and values(spark, found, "later") == (7, 7)
    tables.create_from(stamped.selectExpr("id", "id % 3 AS part"), parted, layout=Layout(partition_by=("part",)))
    assert values(spark, tables.table_extents(spark, parted, ["part"]), "part") == (0, 2)
    tables.create_from(stamped.selectExpr("struct(id AS x, -id AS y) AS s", "id"), nested)
    assert values(spark, tables.table_extents(spark, nested, ["id"]), "id") == (0, 999)
    tables.create_like(stamped, empty)
    assert tables.table_extents(spark, empty, ["id"]) == {"rows": 0, "id": (None, None)}
    assert tables.table_high_mark(spark, empty, "at") is None


def test_an_incremental_upsert_takes_its_mark_from_footers(spark, table, stamped, rows):
    name = table()
    tables.incremental_upsert_table(stamped.where("id < 500"), name, ["id"], "local")
    assert tables.incremental_upsert_table(stamped, name, ["id"], "local") == {"deleted": 0, "inserted": 500, "total_in_target": 1000}
    assert rows(spark.table(name)) == rows(stamped)
