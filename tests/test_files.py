"""Scans of files by the input format that a catalog names."""

import pytest

from keelson.sources.files import file_format, read_csv_inferred, read_table_files


def test_format_dispatch():
    assert file_format("org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat") == "parquet"
    assert file_format("org.apache.hadoop.mapred.TextInputFormat") == "csv"
    assert file_format("some.CSVFormat") == "csv"
    assert file_format("JsonText") == "csv"  # the text test comes first
    assert file_format("some.JSON") == "json"
    with pytest.raises(ValueError, match="Unsupported format: avro"):
        file_format("avro")


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_only_files_of_the_format_under_the_location(spark, tmp_path, rows, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    folder = str(tmp_path / "data")
    if kind == "csv":
        df.coalesce(1).write.csv(folder, header=True)
    else:
        df.coalesce(1).write.format(kind).save(folder)
    (tmp_path / "data" / "notes.md").write_text("not data")
    assert rows(read_table_files(spark, folder + "/", kind).selectExpr("cast(id AS bigint) id", "name")) == [(1, "a"), (2, None)]
    assert rows(read_table_files(spark, folder + "/part", kind, "id bigint, name string")) == [(1, "a"), (2, None)]


def test_csv_inference(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "customer_id,big,ratio,name,day,at\n1,3000000000,0.5,A,2023-01-15,2023-01-15 10:11:12\n2,1,2,,2023-01-16,\n"
    )
    df = read_csv_inferred(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "bigint", "double", "string", "date", "timestamp"]
    assert df.where("at = timestamp '2023-01-15 10:11:12'").count() == 1
    declared = read_csv_inferred(spark, str(path), "customer_id bigint, big bigint, ratio double, name string, day date, at timestamp")
    assert declared.schema["customer_id"].dataType.simpleString() == "bigint" and declared.count() == 2


def test_csv_header_must_fit_the_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    for read in (lambda s: read_csv_inferred(spark, str(tmp_path), s), lambda s: read_table_files(spark, f"{tmp_path}/", "csv", s)):
        with pytest.raises(Exception):
            read("a int, b int").collect()
        assert read("b int, a int").collect() == [(1, 2)]


@pytest.mark.parametrize("row", ["bad,3", "4,5,6"])
def test_csv_rows_must_fit_the_schema(spark, tmp_path, row):
    (tmp_path / "x.csv").write_text(f"a,b\n1,2\n{row}\n")
    with pytest.raises(Exception):
        read_csv_inferred(spark, str(tmp_path), "a int, b int").collect()
