"""The lineage operators on a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import LineageConfig, accepted_runs, expand_runs, lineage_documents, route_events, unwrap_events
from ..functions.expressions import derived_run_id
from .tables import once_per_run


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files that arrive in a folder; ``arrived`` is the file's time."""
    return spark.readStream.text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("arrived")
    )


def document_stream(events: DataFrame, config: LineageConfig, once_within: str | None = None) -> DataFrame:
    """Routed runs as START and COMPLETE documents.

    A missing run id comes from the event's text, so a micro-batch that runs again
    gives the same documents. With ``once_within`` a run's START and COMPLETE leave once,
    however often events of the run arrive within that time; else no state is kept.
    """
    routed = route_events(unwrap_events(events), config)
    runs = accepted_runs(routed, derived_run_id(F.col("raw")))
    expanded = expand_runs(runs)
    if once_within is not None:
        expanded = once_per_run(expanded, "arrived", once_within)
    return lineage_documents(expanded, config).select("run_id", "job_name", "event_type", "document")


def write_documents(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the documents that are there now to a folder of JSON texts, then stop."""
    return (
        documents.select(F.col("document").alias("value"))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
