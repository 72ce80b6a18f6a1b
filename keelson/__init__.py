"""Upserts, quality scores and lineage events as PySpark DataFrame operators."""

from .operators.columns import add_audit_columns, add_column, conform, normalize_timestamps
from .operators.keyfilter import change_touched_rows
from .operators.latest import latest_per_key
from .operators.lineage import (
    LineageConfig,
    accepted_runs,
    classify_events,
    expand_runs,
    lineage_documents,
    lineage_edges,
    lineage_results,
    route_events,
    source_identifier,
    unwrap_events,
)
from .operators.quality import (
    allowed_values,
    column_exists,
    evaluate_checks,
    not_null,
    parses_as_timestamp,
    quality_points,
    resolve_assets,
    run_checks,
    score_checks,
)
from .operators.rowlevel import (
    change_in_key_range,
    count_unstamped,
    delete_insert,
    delete_matching,
    delete_where,
    high_mark,
    incremental_extract,
    incremental_upsert,
    insert_partial,
    keep_matching,
    latest_then_replace,
    merge_upsert,
    update_where,
    upsert_metrics,
)
from .operators.validation import compare_counts, sample_rows, schema_rows
from .session import build_session
from .sources.files import read_csv_inferred, read_table_files
from .sources.tables import (
    Layout,
    add_table_column,
    append,
    copy_table,
    create_from,
    create_like,
    create_table,
    incremental_upsert_table,
    load_table,
    overwrite,
    publish,
    remove_previous,
    replace,
    rewrite,
    upsert_table,
)

__all__ = [
    "Layout",
    "LineageConfig",
    "accepted_runs",
    "add_audit_columns",
    "add_column",
    "add_table_column",
    "allowed_values",
    "append",
    "build_session",
    "change_in_key_range",
    "change_touched_rows",
    "classify_events",
    "column_exists",
    "compare_counts",
    "conform",
    "copy_table",
    "count_unstamped",
    "create_from",
    "create_like",
    "create_table",
    "delete_insert",
    "delete_matching",
    "delete_where",
    "evaluate_checks",
    "expand_runs",
    "high_mark",
    "incremental_extract",
    "incremental_upsert",
    "incremental_upsert_table",
    "insert_partial",
    "keep_matching",
    "latest_per_key",
    "latest_then_replace",
    "lineage_documents",
    "lineage_edges",
    "lineage_results",
    "load_table",
    "merge_upsert",
    "normalize_timestamps",
    "not_null",
    "overwrite",
    "parses_as_timestamp",
    "publish",
    "quality_points",
    "read_csv_inferred",
    "read_table_files",
    "remove_previous",
    "replace",
    "resolve_assets",
    "rewrite",
    "route_events",
    "run_checks",
    "sample_rows",
    "schema_rows",
    "score_checks",
    "source_identifier",
    "unwrap_events",
    "update_where",
    "upsert_metrics",
    "upsert_table",
]
