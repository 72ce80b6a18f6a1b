"""Counts and greatest values of a table from the footers of its Parquet files.

The footers hold the number of rows and the range of every column of a row group, so
that a high mark of a large table costs one small read a file, and no column is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import quoted

_SETTINGS = {
    # Only the newer Parquet reader answers aggregates from footers.
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_STAMPS = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


@contextmanager
def _footer_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plain_types(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema.fields]


def _from_footers(spark: SparkSession, location: str, columns: Sequence[str]) -> DataFrame | None:
    """One row: ``rows`` and, by place, the least and greatest value of each column as in the file.

    None where footers cannot answer: nested columns shift the places by which the reader
    finds a column's range; text and floating-point ranges are not exact. Timestamps
    are read as the whole numbers that the files hold.
    """
    found = spark.read.parquet(location).schema
    wanted = {f.name: f.dataType for f in found.fields if f.name in columns}
    if any(isinstance(f.dataType, _NESTED) for f in found.fields) or len(wanted) < len(set(columns)):
        return None
    if not all(isinstance(t, (*_WHOLE, *_STAMPS)) for t in wanted.values()):
        return None
    as_stored = T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, _STAMPS) else f.dataType) for f in found.fields]
    )
    files = spark.read.schema(as_stored).parquet(location)
    extents = [a(quoted(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, a in (("low", F.min), ("high", F.max))]
    return files.agg(F.count(F.lit(1)).alias("rows"), *extents)


def _value(value: object, data_type: T.DataType) -> Column | None:
    if value is None:
        return None
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(data_type, T.TimestampNTZType):
        # By way of a time that has no zone at its zero: whole days and the rest.
        days, micros = divmod(value, 86_400_000_000)
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(days)).cast("timestamp_ntz")
        return day + F.make_dt_interval(secs=F.lit(micros).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,6)"))
    return F.lit(value).cast(data_type)


def file_extents(table: DataFrame, location: str, columns: Sequence[str]) -> dict | None:
    """Row count and ranges of a table's Parquet files from their footers; None where these cannot answer.

    The answer is ``{"rows": n, column: (least, greatest)}``, with the values as literals,
    or None for a column without values. All files must hold the table's columns in its
    order, as all that Spark inserts do: the reader finds a range by the column's place.
    Files that were put into the folder by other means may not.
    """
    spark = table.sparkSession
    try:
        if _plain_types(spark.read.parquet(location).schema) != _plain_types(table.schema):
            return None
        with _footer_settings(spark):
            extents = _from_footers(spark, location, columns)
            row = extents.first() if extents is not None else None
    except PySparkException:  # files without ranges, or from before a column was added
        return None
    except Exception as error:  # the reader's own errors come unwrapped
        if "py4j" not in type(error).__module__:
            raise
        return None
    if row is None:
        return None
    types = {f.name: f.dataType for f in table.schema.fields}
    ranges = {c: tuple(_value(row[f"{k}_{i}"], types[c]) for k in ("low", "high")) for i, c in enumerate(columns)}
    return {"rows": row["rows"] or 0, **ranges}
