"""Column-level operators: audit columns, timestamp casts, schema changes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .joins import quoted


def instant(as_of: Column | dt.datetime | None) -> Column:
    """The given instant, or the start of the query where none is given."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters read instead of computing again.

    Spark moves a filter below the projection its columns come from and puts their
    whole expressions into it. A generator of one row is where that stops.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select(*map(quoted, df.columns), F.inline(F.array(row)))


def add_audit_columns(df: DataFrame, status: str, as_of: Column | dt.datetime | None = None) -> DataFrame:
    """All columns plus ``processed_at`` and ``processing_status``."""
    return df.withColumns({"processed_at": instant(as_of), "processing_status": F.lit(status)})


def normalize_timestamps(df: DataFrame) -> DataFrame:
    """Cast every timestamp column, with or without a zone, to ``TimestampType``."""
    zoned = (T.TimestampType, T.TimestampNTZType)
    return df.select(
        *(
            quoted(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, zoned) else quoted(f.name)
            for f in df.schema.fields
        )
    )


def add_column(df: DataFrame, name: str, data_type: T.DataType | str, comment: str | None = None) -> DataFrame:
    """Add a nullable column; the rows already there read null."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} already exists")
    df = df.withColumn(name, F.lit(None).cast(data_type))
    return df.withMetadata(name, {"comment": comment}) if comment else df


def conform(df: DataFrame, schema: T.StructType, allow_missing: bool = False) -> DataFrame:
    """``df`` with the columns of ``schema``, matched by name, in its order and types.

    A column that ``df`` lacks is null if ``allow_missing``, else an error; a
    column that ``schema`` lacks is always an error.
    """
    have = {c.lower() for c in df.columns}
    extra = have - {f.name.lower() for f in schema.fields}
    if extra:
        raise ValueError(f"columns not in the target: {sorted(extra)}")
    missing = [f.name for f in schema.fields if f.name.lower() not in have]
    if missing and not allow_missing:
        raise ValueError(f"columns missing from the source: {missing}")
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        if f.name in missing:
            column = F.lit(None).cast(f.dataType)
        elif types[f.name.lower()] == f.dataType:
            column = quoted(f.name)
        else:
            column = quoted(f.name).cast(f.dataType)
        out.append(column.alias(f.name))
    return df.select(*out)
