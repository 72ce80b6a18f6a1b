"""Catalog tables: create, append, replace, load and row-level rewrites.

Stock Spark tables take no row-level statements and cannot be overwritten by a
query that reads them. So new contents go to a new folder next to the old one,
and become current when they are complete: ``publish``. A failure before that
leaves the table as it was. One writer at a time; old folders stay, for readers
that still use them, until ``remove_previous``.

A partitioned table is changed by partitions: only those that hold rows which the
change touches are read, changed and written, by Spark's dynamic overwrite. It moves
the new files into place when all tasks are done, so a failure of a task leaves the
table as it was; partitions that end up empty are dropped after that. A table that is
bucketed by the keys of a change is joined where it lies, without a shuffle of its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession, functions as F, types as T

from ..functions.schemas import as_schema, union_schemas
from ..operators.columns import conform
from ..operators.joins import quoted
from ..operators.keyfilter import change_touched_rows
from ..operators.rowlevel import change_in_key_range, column_extents, delete_insert, keep_matching, merge_upsert
from ..operators.validation import compare_counts
from ..session import scratch_path
from .footers import file_extents

_FORMAT = "parquet"
_CODEC = "snappy"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
_MOST_LISTED = 1000


@dataclass(frozen=True)
class Layout:
    """How a new table is stored.

    ``partition_by`` names the columns that become folders, ``bucket_by`` those by whose
    hash rows go to one of ``buckets`` files; changes by just these keys then need no
    shuffle of the table. ``codec`` compresses the files, ``properties`` go to the catalog.
    """

    partition_by: Sequence[str] = ()
    bucket_by: Sequence[str] = ()
    buckets: int = 0
    codec: str = _CODEC
    properties: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if bool(self.bucket_by) != (self.buckets > 0):
            raise ValueError("bucket_by and buckets go together")

    @property
    def is_plain(self) -> bool:
        return not self.partition_by and not self.bucket_by


def table_layout(spark: SparkSession, name: str) -> Layout:
    """How a table is stored."""
    of = _describe(spark, name)
    return Layout(
        tuple(of.get("partition_columns") or ()),
        tuple(of.get("bucket_columns") or ()),
        int(of.get("num_buckets") or 0),
        (of.get("storage_properties") or {}).get("compression", _CODEC),
        dict(of.get("table_properties") or {}),
    )


def table_name(name: str) -> str:
    """A one- to three-part name, quoted for SQL text."""
    return ".".join("`" + part.strip("`").replace("`", "``") + "`" for part in name.split("."))


def parse_keys(keys: str | Sequence[str] | None) -> list[str]:
    """Key columns from a list or comma-separated text; ``NONE`` in any case means none."""
    if keys is None:
        return []
    if isinstance(keys, str):
        keys = [] if keys.strip().upper() == "NONE" else keys.split(",")
    return [k.strip() for k in keys if k.strip()]


def table_location(spark: SparkSession, name: str) -> str:
    """Where the current files of a table are."""
    return _describe(spark, name)["location"]


def create_table(
    spark: SparkSession, name: str, schema: T.StructType | str, location: str | None = None, layout: Layout = Layout()
) -> None:
    """Create an empty table with the given columns if it is absent."""
    create_like(spark.createDataFrame([], schema), name, location, layout)


def create_like(df: DataFrame, name: str, location: str | None = None, layout: Layout = Layout()) -> None:
    """Create an empty table with the columns of ``df`` if it is absent."""
    if df.sparkSession.catalog.tableExists(name):
        return
    _create(df.limit(0), name, location or _new_location(df.sparkSession, name), layout)


def create_from(df: DataFrame, name: str, location: str | None = None, layout: Layout = Layout()) -> bool:
    """Create a table from a query if it is absent; whether it was created."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    _create(df, name, location or _new_location(df.sparkSession, name), layout)
    return True


def append(df: DataFrame, name: str, allow_missing: bool = False) -> None:
    """Add rows to a table, columns matched by name."""
    conform(df, df.sparkSession.table(name).schema, allow_missing).write.insertInto(name)


def overwrite(df: DataFrame, name: str) -> str:
    """Replace all rows of a table and keep its columns; the folder it had before."""
    return publish(conform(df, df.sparkSession.table(name).schema), name)


def replace(df: DataFrame, name: str) -> None:
    """Create the table from a query, or give it that query's columns and rows.

    The rows are complete before the catalog entry changes. If the columns differ the
    entry is dropped and made anew with the old layout and properties, and for that
    moment the name is absent.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        _create(df, name, _new_location(spark, name), Layout())
        return
    layout = table_layout(spark, name)
    if _same_columns(spark.table(name).schema, df.schema):
        publish(df, name)
        return
    lacking = {*layout.partition_by, *layout.bucket_by} - set(df.columns)
    if lacking:
        raise ValueError(f"{name} is laid out by columns that the new rows lack: {sorted(lacking)}")
    made = _beside(name)
    _create(df, made, _sibling(spark, name), layout)
    spark.sql(f"DROP TABLE {table_name(name)}")
    spark.sql(f"ALTER TABLE {table_name(made)} RENAME TO {table_name(name)}")


def publish(df: DataFrame, name: str) -> str:
    """Make ``df``, which may read the table, the table's contents; the folder it had before.

    A partitioned table keeps its folder.
    """
    spark = df.sparkSession
    layout, previous = table_layout(spark, name), table_location(spark, name)
    if layout.partition_by:
        _overwrite_partitions(df, name, layout, None)
        return previous
    location = _sibling(spark, name)
    if layout.bucket_by:
        # Only a table takes bucketed files; it lends its writer and leaves them behind.
        made = _beside(name)
        _laid_out(df, layout).option("path", location).saveAsTable(made)
        spark.sql(f"DROP TABLE {table_name(made)}")
    else:
        _write(df, location, layout.codec)
    spark.sql(f"ALTER TABLE {table_name(name)} SET LOCATION {_literal(location)}")
    spark.catalog.refreshTable(name)
    return previous


def _overwrite_partitions(df: DataFrame, name: str, layout: Layout, touched: list[T.Row] | None) -> None:
    """Make ``df`` the contents of the touched partitions, or of all; others stay untouched.

    ``df`` must have no rows of other partitions that exist.
    """
    spark, parts = df.sparkSession, layout.partition_by
    there = {tuple(r) for r in _partitions(spark.table(name), parts)}
    if touched is not None:
        there &= {tuple(r) for r in touched}
    filled = Observation()
    # Rebalancing gathers the rows of a small partition and splits a large one.
    rows = df.hint("rebalance", *parts).observe(filled, F.collect_set(F.struct(*map(quoted, parts))).alias("parts"))
    with _setting(spark, _OVERWRITE_MODE, "dynamic"):
        rows.write.mode("overwrite").insertInto(name)
    for values in there - {tuple(r) for r in filled.get["parts"]}:
        _drop_partition(spark, name, dict(zip(parts, values)))
    spark.catalog.refreshTable(name)


def _drop_partition(spark: SparkSession, name: str, values: Mapping[str, object]) -> None:
    """Delete a partition's files, then its entry: without files it is empty already."""
    spec = ", ".join(
        f"`{p}` = " + ("null" if v is None else _literal(str(v))) for p, v in values.items()
    )
    entry = spark.sql(f"DESCRIBE TABLE EXTENDED {table_name(name)} PARTITION ({spec}) AS JSON").first()[0]
    _delete(spark, json.loads(entry)["location"])
    spark.sql(f"ALTER TABLE {table_name(name)} DROP IF EXISTS PARTITION ({spec})")


def _partitions(df: DataFrame, parts: Sequence[str]) -> list[T.Row]:
    """The different values of the partition columns; as many as the table has folders."""
    return df.select(*map(quoted, parts)).distinct().collect()


def _within(parts: Sequence[str], touched: list[T.Row]) -> Column:
    """Whether a row lies in one of the partitions; folders are pruned by it."""
    if not touched:
        return F.lit(False)
    if len(touched) > _MOST_LISTED:  # a long list goes by the first column alone, then exactly
        first = quoted(parts[0])
        values = {r[0] for r in touched}
        coarse = first.isin([v for v in values if v is not None])
        return (coarse | first.isNull()) if None in values else coarse
    cases = [
        reduce(lambda a, b: a & b, (quoted(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, row))) for row in touched
    ]
    return reduce(lambda a, b: a | b, cases)


def remove_previous(spark: SparkSession, name: str, previous: str) -> None:
    """Delete the folder that a change of the table replaced, once no reader needs it.

    Refuses a folder that is the table's own, or does not lie next to it.
    """
    current = table_location(spark, name).rstrip("/")
    previous = previous.rstrip("/")
    if previous == current or previous.rsplit("/", 1)[0] != current.rsplit("/", 1)[0]:
        raise ValueError(f"{previous} is not a folder that {name} has left")
    _delete(spark, previous)


def rewrite(
    spark: SparkSession, name: str, change: Callable[[DataFrame], DataFrame], touching: Column | None = None
) -> str:
    """Apply a row-level operator to a table, all or nothing.

    For example ``rewrite(spark, "db.t", lambda t: delete_where(t, F.col("id") == 2))``.
    ``touching`` says which rows the change may alter. Of a partitioned table only the
    partitions that hold such rows, and those they move to, are then rewritten.
    """
    table = spark.table(name)
    parts = table_layout(spark, name).partition_by
    if not parts or touching is None:
        return publish(conform(change(table), table.schema), name)
    touched = _partitions(table.where(touching), parts)
    moved_to = _partitions(change(table.where(touching)), parts)
    _change_partitions(spark, name, touched + moved_to, change)
    return table_location(spark, name)


def _change_partitions(
    spark: SparkSession, name: str, touched: list[T.Row], change: Callable[[DataFrame], DataFrame]
) -> None:
    layout, table = table_layout(spark, name), spark.table(name)
    if len(set(touched)) > _MOST_LISTED:  # what the pruning condition lets through is rewritten too
        near = table.where(_within(layout.partition_by, touched))
        touched = touched + _partitions(near, layout.partition_by)
    near = table.where(_within(layout.partition_by, touched))
    _overwrite_partitions(conform(change(near), table.schema), name, layout, touched)


def _upsert(name: str, staged: DataFrame, keys: Sequence[str], operator: Callable[..., DataFrame]) -> None:
    """Change a table by the staged rows, reading and moving as little of it as its layout allows."""
    spark = staged.sparkSession
    layout, target = table_layout(spark, name), spark.table(name)
    aligned = bool(layout.bucket_by) and {k.lower() for k in layout.bucket_by} == {k.lower() for k in keys}

    def change(rows: DataFrame) -> DataFrame:
        if aligned:
            return operator(rows, staged, keys, aligned=True)
        return change_in_key_range(
            rows,
            staged,
            keys[0],
            lambda near: change_touched_rows(near, staged, keys, lambda t: operator(t, staged, keys)),
        )

    if not layout.partition_by:
        publish(conform(change(target), target.schema), name)
        return
    parts = layout.partition_by
    touched = _partitions(staged, parts)
    if not {p.lower() for p in parts} <= {k.lower() for k in keys}:  # a row may change its partition
        found = keep_matching(target.select(*map(quoted, dict.fromkeys([*keys, *parts]))), staged, keys)
        touched += _partitions(found, parts)
    _change_partitions(spark, name, touched, change)


def set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> None:
    """Set properties of a table's catalog entry; others stay."""
    if properties:
        pairs = ", ".join(f"{_literal(k)} = {_literal(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {table_name(name)} SET TBLPROPERTIES ({pairs})")


def add_table_column(spark: SparkSession, name: str, column: str, data_type: str, comment: str | None = None) -> None:
    """Add a nullable column to a table; the rows already there read null."""
    quoted_column = "`" + column.replace("`", "``") + "`"
    tail = f" COMMENT {_literal(comment)}" if comment else ""
    spark.sql(f"ALTER TABLE {table_name(name)} ADD COLUMN {quoted_column} {data_type}{tail}")


def widen_table(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Give a table the columns and wider types it needs to hold rows of ``schema``; whether it changed.

    New columns are nullable and read null in the rows already there; for them alone no
    row is written. Wider types rewrite the table. Types that do not widen are an error.
    """
    have = spark.table(name).schema
    want = union_schemas(have, schema)
    known = {f.name: f.dataType for f in have.fields}
    new = [f for f in want.fields if f.name not in known]
    if any(known.get(f.name, f.dataType) != f.dataType for f in want.fields):
        replace(as_schema(spark.table(name), want), name)
    else:
        for f in new:
            add_table_column(spark, name, f.name, f.dataType.simpleString(), f.metadata.get("comment"))
    return len(new) > 0 or _types(have) != _types(spark.table(name).schema)


def load_table(
    source: DataFrame,
    name: str,
    keys: str | Sequence[str] | None = None,
    mode: str | None = None,
    location: str | None = None,
    layout: Layout = Layout(),
    evolve: bool = False,
) -> int:
    """Load a frame into a table and return the table's row count.

    An absent table is created with the source's columns and the given layout, and
    filled. Else mode ``merge`` with keys merges and everything else appends. The default
    mode is ``merge`` with keys and ``append`` without. ``evolve`` first gives the table
    columns and wider types that the source brings; columns that the source lacks stay as
    they are in merged rows and are null in new ones.
    """
    spark = source.sparkSession
    keys = parse_keys(keys)
    mode = mode or ("merge" if keys else "append")
    if not create_from(source, name, location, layout):
        if evolve:
            widen_table(spark, name, source.schema)
        if mode == "merge" and keys:
            with _staged(_as_stored(source, name, partial=evolve)) as staged:
                _upsert(name, staged, keys, merge_upsert)
        else:
            append(as_schema(source, spark.table(name).schema) if evolve else source, name)
    return spark.table(name).count()


def copy_table(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Replace a table by a copy of another; one row with both counts."""
    replace(spark.table(source), target)
    return compare_counts(spark.table(source), spark.table(target))


def upsert_table(source: DataFrame, name: str, keys: Sequence[str]) -> dict[str, int]:
    """``delete_insert`` into a table, all or nothing; counts of rows deleted, inserted and held."""
    spark = source.sparkSession
    with _staged(_as_stored(source, name)) as staged:
        before, inserted = spark.table(name).count(), staged.count()
        if inserted:
            _upsert(name, staged, keys, delete_insert)
    total = spark.table(name).count()
    return {"deleted": before + inserted - total, "inserted": inserted, "total_in_target": total}


def incremental_upsert_table(
    source: DataFrame, name: str, keys: Sequence[str], column: str = "updated_at"
) -> dict[str, int]:
    """Upsert the source rows above the table's high mark; an absent table is created from all rows."""
    spark = source.sparkSession
    if create_from(source, name):
        total = spark.table(name).count()
        return {"deleted": 0, "inserted": total, "total_in_target": total}
    mark = table_high_mark(spark, name, column)
    return upsert_table(source if mark is None else source.where(quoted(column) > mark), name, keys)


def table_extents(spark: SparkSession, name: str, columns: Sequence[str]) -> dict:
    """Row count and ranges of columns: ``{"rows": n, column: (least, greatest)}``, values as literals.

    The footers of the files answer where they can: whole numbers, dates and timestamps of
    a table without partitions or nested columns. Else the columns are read. A column
    without values has None twice.
    """
    table = spark.table(name)
    found = None
    if not table_layout(spark, name).partition_by:
        found = file_extents(table, table_location(spark, name), columns)
    return found if found is not None else {"rows": table.count(), **column_extents(table, columns)}


def table_high_mark(spark: SparkSession, name: str, column: str) -> Column | None:
    """The greatest value of a table's column as a literal; None if there is none."""
    return table_extents(spark, name, [column])[column][1]


@contextmanager
def _staged(source: DataFrame) -> Iterator[DataFrame]:
    """The source, written to the scratch folder until the change is done.

    A change reads its source several times, for the keys, the new rows and the
    counts. From here all of them see the same rows, also when tasks run again.
    """
    spark = source.sparkSession
    path = scratch_path(spark)
    try:
        _write(source, path)
        yield spark.read.schema(source.schema).parquet(path)
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _describe(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table_name(name)} AS JSON").first()[0])


def _as_stored(source: DataFrame, name: str, partial: bool = False) -> DataFrame:
    """The source with the table's columns, or with those it has if ``partial``.

    An empty text that names a partition reads back as null.
    """
    spark = source.sparkSession
    schema = spark.table(name).schema
    if partial:
        have = {c.lower() for c in [*source.columns, *table_layout(spark, name).partition_by]}
        schema = T.StructType([f for f in schema.fields if f.name.lower() in have])
        source = as_schema(source, schema) if set(map(str.lower, source.columns)) == have else source
    rows = conform(source, schema)
    texts = [p for p in table_layout(spark, name).partition_by if isinstance(schema[p].dataType, T.StringType)]
    return rows.withColumns({p: F.nullif(quoted(p), F.lit("")) for p in texts}) if texts else rows


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _beside(name: str) -> str:
    """A new name in the same database."""
    *database, last = name.split(".")
    return ".".join([*database, f"{last.strip('`')}_{uuid.uuid4().hex}"])


def _sibling(spark: SparkSession, name: str) -> str:
    parent = table_location(spark, name).rstrip("/").rsplit("/", 1)[0]
    return f"{parent}/{_folder(name)}"


def _new_location(spark: SparkSession, name: str) -> str:
    *database, _ = name.split(".")
    entry = spark.catalog.getDatabase(".".join(database) or spark.catalog.currentDatabase())
    return f"{entry.locationUri.rstrip('/')}/{_folder(name)}"


def _folder(name: str) -> str:
    return f"{name.split('.')[-1].strip('`')}-{uuid.uuid4().hex}"


def _write(df: DataFrame, location: str, codec: str = _CODEC) -> None:
    df.write.format(_FORMAT).option("compression", codec).mode("errorifexists").save(location)


def _laid_out(df: DataFrame, layout: Layout) -> DataFrameWriter:
    writer = df.write.format(_FORMAT).option("compression", layout.codec)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    if layout.bucket_by:
        writer = writer.bucketBy(layout.buckets, *layout.bucket_by)
    return writer


def _create(df: DataFrame, name: str, location: str, layout: Layout) -> None:
    spark = df.sparkSession
    if layout.is_plain and layout.codec == _CODEC:
        _write(df, location)
        _register(spark, name, location, df.schema)
    else:
        rows = df.hint("rebalance", *layout.partition_by) if layout.partition_by else df
        _laid_out(rows, layout).option("path", location).saveAsTable(name)
    set_properties(spark, name, layout.properties)


def _register(spark: SparkSession, name: str, location: str, schema: T.StructType) -> None:
    spark.catalog.createTable(name, path=location, source=_FORMAT, schema=schema)


def _types(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema.fields]


def _same_columns(one: T.StructType, other: T.StructType) -> bool:
    return _types(one) == _types(other)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
