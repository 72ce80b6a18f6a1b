"""Streams into tables, and lineage documents that leave once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import latest_per_key
from ..operators.quality import Check, check_state, merge_states
from ..sources import tables

_BATCH = "stream.{}.batch"


def applied_batch(spark: SparkSession, name: str, stream: str) -> int:
    """The number of the last batch of a stream that a table holds; -1 for none."""
    if not spark.catalog.tableExists(name):
        return -1
    return int(tables.table_layout(spark, name).properties.get(_BATCH.format(stream), -1))


def apply_once(
    spark: SparkSession, name: str, stream: str, batch: int, change: Callable[[], object]
) -> bool:
    """Run ``change`` of a table unless the table already holds the batch; whether it ran.

    The batch's number is kept among the table's properties, after the change. A failure
    between the two runs the change again, so it must give the same table when it is
    repeated, as upserts do.
    """
    if batch <= applied_batch(spark, name, stream):
        return False
    change()
    tables.set_properties(spark, name, {_BATCH.format(stream): str(batch)})
    return True


def upsert_stream(
    source: DataFrame,
    name: str,
    keys: Sequence[str],
    order_col: str,
    tie_breakers: Sequence[str],
    checkpoint: str,
    stream: str = "upsert",
) -> StreamingQuery:
    """Bring a table up to date with what a stream holds now, then stop.

    Of a batch's rows of one key the newest counts; it replaces the table's row. Batches
    come in order and each is applied once, also after a restart. An absent table is
    created by the first batch.
    """

    def upsert(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        newest = latest_per_key(rows, keys, order_col, tie_breakers)

        def change() -> None:
            if not tables.create_from(newest, name):
                tables.upsert_table(newest, name, keys)

        apply_once(spark, name, stream, batch, change)

    return _run(source, upsert, name, checkpoint)


def check_stream(
    source: DataFrame, checks: Sequence[Check], by: Sequence[str], name: str, checkpoint: str, stream: str = "checks"
) -> StreamingQuery:
    """Add what a stream holds now to a table of check states, then stop.

    The table has the state of every batch under its number, so a batch that runs again
    replaces its own rows. ``stream_state`` adds them up.
    """

    def add(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        state = check_state(rows, checks, by).withColumn("batch", F.lit(batch).cast("bigint"))

        def change() -> None:
            if not tables.create_from(state, name):
                tables.upsert_table(state, name, ["batch"])

        apply_once(spark, name, stream, batch, change)

    return _run(source, add, name, checkpoint)


def stream_state(spark: SparkSession, name: str) -> DataFrame:
    """The state of all batches of ``check_stream``."""
    return merge_states(spark.table(name).drop("batch"))


def once_per_run(documents: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """The first ``START`` and the first ``COMPLETE`` of every run.

    Repeats that arrive within ``delay`` are dropped; the state holds the runs of that time
    and no more. ``arrived`` is a timestamp column, such as the time of an event's file.
    """
    return documents.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["run_id", "event_type"])


def _run(source: DataFrame, apply: Callable[[DataFrame, int], None], name: str, checkpoint: str) -> StreamingQuery:
    session = source.sparkSession

    def run(rows: DataFrame, batch: int) -> None:
        apply(rows, batch)
        session.catalog.refreshTable(name)  # a stream has a session of its own

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
