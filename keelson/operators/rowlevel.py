"""Row-level changes as functions from frames to a frame.

Nothing here writes a table; ``sources.tables`` does. All changes go by column
name, and the result has the columns and types of the target. Null keys match
nothing: such target rows stay and such source rows are inserted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import conform
from .joins import distinct_keys, quoted, spread_join, without_null_keys
from .latest import latest_per_key

_COUNT, _ROW = "__count", "__source_row"


class Upsert(NamedTuple):
    """New rows of the target, and one row of counts; both lazy."""

    rows: DataFrame
    metrics: DataFrame


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop the rows where the predicate is true; null counts as not true.

    Written so that a comparison with a literal reaches the scan, which can then
    skip row groups that hold only rows to drop.
    """
    return df.where(~predicate | predicate.isNull())


def update_where(df: DataFrame, predicate: Column, sets: Mapping[str, Any]) -> DataFrame:
    """Set columns where the predicate is true; every expression sees the old row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = set(sets) - set(types)
    if unknown:
        raise ValueError(f"columns not in the frame: {sorted(unknown)}")
    changed = {}
    for name, value in sets.items():
        value = value if isinstance(value, Column) else F.lit(value)
        changed[name] = F.when(predicate, value.cast(types[name])).otherwise(quoted(name))
    return df.withColumns(changed)


def delete_matching(target: DataFrame, source: DataFrame, keys: Sequence[str], *, aligned: bool = False) -> DataFrame:
    """Drop the target rows whose key occurs in the source.

    ``aligned`` says that the target lies bucketed by the keys. It is then joined in its
    place, and a hot key stays in its bucket.
    """
    return _joined(target, distinct_keys(source, keys), keys, "left_anti", aligned)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, aligned: bool) -> DataFrame:
    return left.join(right, list(keys), how) if aligned else spread_join(left, right, keys, how)


def keep_matching(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the target rows whose key occurs in the source."""
    return spread_join(target, distinct_keys(source, keys), keys, "left_semi")


def insert_partial(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows that name some of the target's columns; the other columns are null."""
    return target.unionByName(conform(rows, target.schema, allow_missing=True))


def delete_insert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    insert_columns: Sequence[str] | None = None,
    *,
    aligned: bool = False,
) -> DataFrame:
    """Drop target rows whose key is in the source, then add every source row.

    Source rows that share a key are all kept. With ``insert_columns`` only those
    columns are filled and the others are null. ``aligned`` as in ``delete_matching``.
    """
    survivors = delete_matching(target, source, keys, aligned=aligned)
    if insert_columns is None:
        return survivors.unionByName(conform(source, target.schema))
    return insert_partial(survivors, source.select(*map(quoted, insert_columns)))


def latest_then_replace(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order_col: str,
    tie_breakers: Sequence[str],
) -> DataFrame:
    """``delete_insert`` of the newest source row of each key."""
    staged = latest_per_key(source, keys, order_col, tie_breakers)
    # The staged rows hold the same keys as the source, which is cheaper to read.
    return delete_matching(target, source, keys).unionByName(conform(staged, target.schema))


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    *,
    aligned: bool = False,
) -> DataFrame:
    """Standard MERGE: update matched target rows, insert unmatched source rows.

    A matched row takes the source's values, nulls included, in
    ``update_columns``, by default all columns the source has; its other columns
    keep their values. An inserted row is null where the source lacks a column.
    If two source rows match one target row the query fails when it runs, in the
    same job, without a pass of its own. ``aligned`` as in ``delete_matching``.
    """
    names = {c.lower() for c in source.columns}
    schema = T.StructType([f for f in target.schema.fields if f.name.lower() in names])
    source = conform(source, schema)
    lowered = {k.lower() for k in keys}
    sets = [c for c in source.columns if c.lower() not in lowered]
    if update_columns is not None:
        unknown = set(update_columns) - set(source.columns)
        if unknown:
            raise ValueError(f"update columns not in the source: {sorted(unknown)}")
        sets = [c for c in sets if c in update_columns]

    # One row per source key: a repeated key is folded before the shuffle.
    row = F.struct(*map(quoted, sets)) if sets else F.lit(None)
    per_key = (
        without_null_keys(source, keys)
        .groupBy(*map(quoted, keys))
        .agg(F.count(F.lit(1)).alias(_COUNT), F.first(row).alias(_ROW))
    )
    ambiguous = F.raise_error(F.lit("several source rows match one target row")).cast("boolean")
    joined = _joined(target, per_key, keys, "left", aligned).where(
        F.when(F.col(_COUNT) > 1, ambiguous).otherwise(F.lit(True))
    )
    matched = F.col(_COUNT).isNotNull()
    updated = joined.select(
        *(
            F.when(matched, F.col(_ROW).getField(c)).otherwise(quoted(c)).alias(c) if c in sets else quoted(c)
            for c in target.columns
        )
    )
    # Only the target keys that the source touches go on to the anti join. Both sides
    # hold a key once, so no key is hot; a small source is broadcast below the distinct.
    touched = distinct_keys(target, keys).join(distinct_keys(source, keys), list(keys), "left_semi")
    inserted = delete_matching(source, touched, keys)
    return insert_partial(updated, inserted)


def upsert_metrics(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``deleted``, ``inserted`` and ``total_in_target`` of ``delete_insert``."""
    # Target rows are counted by key before they meet the source, so a hot key is one
    # row. Spark moves the semi join below the counting where it broadcasts the source.
    by_key = target.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(_COUNT))
    matched = by_key.join(distinct_keys(source, keys), list(keys), "left_semi")

    def counts(df: DataFrame, deleted: Column, inserted: Column, total: Column) -> DataFrame:
        return df.agg(deleted.alias("deleted"), inserted.alias("inserted"), total.alias("total_in_target"))

    none, rows, gone = F.lit(0).cast("bigint"), F.count(F.lit(1)), F.coalesce(F.sum(_COUNT), F.lit(0).cast("bigint"))
    parts = counts(matched, gone, none, -gone).unionByName(counts(source, none, rows, rows))
    parts = parts.unionByName(counts(target, none, none, rows))
    return counts(parts, F.sum("deleted"), F.sum("inserted"), F.sum("total_in_target"))


def _as_literals(df: DataFrame, column: str, *aggregates: Callable[[Column], Column]) -> list[Column] | None:
    """Aggregates of a column as literals of its type; None if the column has no value.

    Only these values come to the driver, and as literals they can be pushed to a
    scan. Going through text, or microseconds for zoned timestamps, keeps them exact
    and free of the driver's time zone.
    """
    data_type = df.select(quoted(column)).schema[0].dataType
    zoned = isinstance(data_type, T.TimestampType)

    def encoded(value: Column) -> Column:
        return F.unix_micros(value) if zoned else value.cast("string")

    values = df.agg(*(encoded(a(quoted(column))).alias(str(i)) for i, a in enumerate(aggregates))).first()
    if values[0] is None:
        return None
    return [F.timestamp_micros(F.lit(v)) if zoned else F.lit(v).cast(data_type) for v in values]


def high_mark(target: DataFrame, column: str) -> Column | None:
    """The greatest value of a column as a literal; None if there is none."""
    marks = _as_literals(target, column, F.max)
    return marks[0] if marks else None


def column_extents(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """The least and the greatest value of each column as literals; None twice if it has no value."""
    return {c: tuple(_as_literals(df, c, F.min, F.max) or (None, None)) for c in columns}


def change_in_key_range(
    target: DataFrame, source: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``change`` of the target rows that a source row can match, plus all the others.

    The others have no key or one outside the range of the source's keys; they take
    no part in the join and are not shuffled. Where the table's layout follows the
    key, as with recent orders, that is most of a large table. The source is read
    once for its range and must not change afterwards.
    """
    ordered = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    key_type = target.select(quoted(key)).schema[0].dataType
    if not isinstance(key_type, ordered):
        return change(target)
    # The range is taken in the target's type: as text, '10' comes before '9'.
    bounds = _as_literals(source.select(quoted(key).cast(key_type).alias(key)), key, F.min, F.max)
    if bounds is None:
        return change(target)
    low, high = bounds
    near = quoted(key).between(low, high)
    far = (quoted(key) < low) | (quoted(key) > high) | quoted(key).isNull()
    return target.where(far).unionByName(change(target.where(near)))


def incremental_extract(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Source rows strictly above the target's high mark; all rows if it has no mark.

    Rows equal to the mark, late rows and rows with a null stamp are left out once
    there is a mark; ``count_unstamped`` counts the last kind.
    """
    mark = high_mark(target, column)
    return source if mark is None else source.where(quoted(column) > mark)


def count_unstamped(source: DataFrame, column: str) -> DataFrame:
    """One row: how many source rows an incremental extract can never pick up."""
    return source.agg(F.count_if(quoted(column).isNull()).alias("unstamped"))


def incremental_upsert(source: DataFrame, target: DataFrame, keys: Sequence[str], column: str) -> Upsert:
    """``delete_insert`` of the rows above the high mark, with its counts.

    With nothing new the rows are the target's and both counts are 0.
    """
    new_rows = incremental_extract(source, target, column)
    return Upsert(delete_insert(target, new_rows, keys), upsert_metrics(target, new_rows, keys))
