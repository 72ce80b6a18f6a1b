"""Row counts, schemas and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import quoted


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both counts, and whether they match."""
    none = F.lit(0).cast("bigint")
    ours = source.agg(F.count(F.lit(1)).alias("source_count"), none.alias("target_count"))
    theirs = target.agg(none.alias("source_count"), F.count(F.lit(1)).alias("target_count"))
    counts = ours.unionByName(theirs).agg(
        F.sum("source_count").alias("source_count"), F.sum("target_count").alias("target_count")
    )
    return counts.withColumn("matches", F.col("source_count") == F.col("target_count"))


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullable, comment."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, data_type string, nullable boolean, comment string"
    )


def sample_rows(df: DataFrame, *order_cols: str, n: int = 10) -> DataFrame:
    """The first rows in the order of the given columns, nulls last."""
    return df.orderBy(*(quoted(c).asc_nulls_last() for c in order_cols)).limit(n)
