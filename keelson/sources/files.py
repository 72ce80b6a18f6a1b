"""Scans of Parquet, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from .detect import read_csv_detected, read_json_detected

_CSV_TIMESTAMPS = "yyyy-MM-dd HH:mm:ss"
# Columns go by the names in the header, and a row that does not fit is an error.
_STRICT_CSV = {"enforceSchema": False, "mode": "FAILFAST"}

# Which part of an input format's name selects which reader, in order.
FORMATS = (("parquet", "parquet"), ("csv", "csv"), ("text", "csv"), ("json", "json"))


def file_format(input_format: str) -> str:
    """The reader for a catalog's input format name."""
    for part, reader in FORMATS:
        if part in input_format.lower():
            return reader
    raise ValueError(f"Unsupported format: {input_format}")


def read_table_files(
    spark: SparkSession,
    location: str,
    input_format: str,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The files of an external table: those that start with ``location`` and have the format's suffix.

    A location ending in ``/`` is a folder and is listed in parallel. Without a schema
    the form of CSV and JSON files is found from their first lines, as in
    ``read_csv_detected`` and ``read_json_detected``. With one, CSV has commas and a
    header; a header that differs from the schema is an error, and so is a row with a
    wrong field or number of fields.
    """
    reader_format = file_format(input_format)
    pattern = f"*.{reader_format}"
    if schema is None and reader_format != "parquet":
        detected = read_csv_detected if reader_format == "csv" else read_json_detected
        return detected(spark, location if location.endswith("/") else location + pattern, pattern)
    reader = spark.read.format(reader_format)
    if schema is not None:
        reader = reader.schema(schema)
    if reader_format == "csv":
        reader = reader.options(header=True, **_STRICT_CSV)
    if location.endswith("/"):
        return reader.option("pathGlobFilter", pattern).load(location)
    return reader.load(location + pattern)


def read_csv_inferred(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header and inferred types; a given schema saves the pass that infers."""
    reader = spark.read.options(header=True, timestampFormat=_CSV_TIMESTAMPS, **_STRICT_CSV)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)
