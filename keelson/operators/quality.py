"""Data-quality checks, their scores, and the points that report them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import truncated_percentage
from .columns import instant
from .joins import quoted, spread_join

_EVALUATIONS = (
    "array<struct<types: array<string>, description: string, status: string, applicableFields: array<string>>>"
)
_NAME, _ID, _STATES = "__lower_name", "__asset_id", "__states"
_COUNTERS = ("check", "rows", "failing", "absent")


class Check(NamedTuple):
    """A check: ``failing`` marks the rows that break it; None asks only for the column."""

    types: tuple[str, ...]
    description: str
    column: str
    failing: Callable[[Column], Column] | None


def not_null(column: str) -> Check:
    return Check(("Completeness",), f"{column} not null", column, lambda c: c.isNull())


def allowed_values(column: str, values: Sequence) -> Check:
    """Values outside the set fail; nulls are left to ``not_null``."""
    return Check(("Validity",), f"{column} in allowed values", column, lambda c: ~c.isin(list(values)))


def column_exists(column: str) -> Check:
    return Check(("Validity",), f"{column} column exists", column, None)


def parses_as_timestamp(column: str, pattern: str | None = None) -> Check:
    """Values that are set but are no timestamp fail."""

    def failing(c: Column) -> Column:
        value = c.cast("string")
        parsed = F.try_to_timestamp(value, F.lit(pattern)) if pattern else F.try_to_timestamp(value)
        return value.isNotNull() & parsed.isNull()

    return Check(("Validity",), f"{column} parses as timestamp", column, failing)


def evaluate_checks(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """One row per asset with an ``evaluations`` array, from one pass over the rows.

    ``by`` holds the columns that name the asset; without them the frame is one
    asset. Only counters are shuffled, and the array is as long as ``checks``. A
    check whose column does not exist fails.
    """
    present = {c.lower() for c in df.columns}
    counters, evaluations = [F.lit(0).alias("__none")], []
    for i, check in enumerate(checks):
        if check.column.lower() not in present:
            status = F.lit("FAIL")
        elif check.failing is None:
            status = F.lit("PASS")
        else:
            counters.append(F.count_if(check.failing(quoted(check.column))).alias(f"__failing_{i}"))
            status = F.when(F.col(f"__failing_{i}") == 0, "PASS").otherwise("FAIL")
        evaluations.append(
            F.struct(
                F.array(*map(F.lit, check.types)).alias("types"),
                F.lit(check.description).alias("description"),
                status.alias("status"),
                F.array(F.lit(check.column)).alias("applicableFields"),
            )
        )
    grouped = df.groupBy(*map(quoted, by)).agg(*counters)
    return grouped.select(*map(quoted, by), F.array(*evaluations).cast(_EVALUATIONS).alias("evaluations"))


def check_state(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """The counters behind the checks, from one pass: one row per asset and check.

    Columns: those of ``by``, ``check`` (its place), ``rows``, ``failing`` and ``absent``,
    the rows that lack the check's column. States of parts of a table add up to the state
    of the whole (``merge_states``), so that an increment costs its own rows only.
    Without ``by`` no rows still give an asset.
    """
    present = {c.lower() for c in df.columns}
    rows, none = F.count(F.lit(1)), F.lit(0).cast("bigint")
    counters = []
    for i, check in enumerate(checks):
        there = check.column.lower() in present
        failing = F.count_if(check.failing(quoted(check.column))) if there and check.failing else none
        missing = F.lit(int(not there)).cast("bigint")
        counters.append(F.struct(F.lit(i).alias("check"), rows.alias("rows"), failing.alias("failing"), missing.alias("absent")))
    states = df.groupBy(*map(quoted, by)).agg(F.array(*counters).alias(_STATES))
    return states.select(*map(quoted, by), F.inline(_STATES))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows from the states of parts that share no row."""
    by = [c for c in states[0].columns if c not in _COUNTERS]
    united = states[0]
    for state in states[1:]:
        united = united.unionByName(state)
    return united.groupBy(*map(quoted, by), "check").agg(*(F.sum(c).cast("bigint").alias(c) for c in _COUNTERS[1:]))


def evaluate_state(state: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``evaluate_checks`` from a state: one row per asset with its ``evaluations``.

    A check fails if any row broke it or any part lacked its column.
    """
    by = [c for c in state.columns if c not in _COUNTERS]
    held = F.map_from_entries(F.collect_list(F.struct("check", (F.col("failing") + F.col("absent")).alias("n"))))
    grouped = state.groupBy(*map(quoted, by)).agg(held.alias(_STATES))
    evaluations = [
        F.struct(
            F.array(*map(F.lit, check.types)).alias("types"),
            F.lit(check.description).alias("description"),
            F.when(F.try_element_at(_STATES, F.lit(i)) == 0, "PASS").otherwise("FAIL").alias("status"),
            F.array(F.lit(check.column)).alias("applicableFields"),
        )
        for i, check in enumerate(checks)
    ]
    return grouped.select(*map(quoted, by), F.array(*evaluations).cast(_EVALUATIONS).alias("evaluations"))


def run_checks(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """One row per asset and check: types, description, status, applicable fields."""
    return evaluate_checks(df, checks, by).select(*map(quoted, by), F.inline("evaluations"))


def score_checks(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``evaluationsCount`` and ``passingPercentage`` of each asset's results.

    Passing is ``PASS`` in any case. No evaluations give a null percentage.
    """
    passed = F.count_if(F.upper(F.col("status")) == "PASS")
    scored = results.groupBy(*map(quoted, by)).agg(F.count(F.lit(1)).alias("evaluationsCount"), passed.alias("__passed"))
    return scored.withColumn(
        "passingPercentage", truncated_percentage(F.col("__passed"), F.col("evaluationsCount"))
    ).drop("__passed")


def quality_points(
    evaluated: DataFrame,
    entity: str,
    form_name: str,
    type_identifier: str,
    type_revision: str,
    as_of: Column | dt.datetime | None = None,
) -> DataFrame:
    """One time-series point per row of ``evaluate_checks``, with JSON content.

    The row already holds its evaluations, so nothing is grouped or collected.
    """
    count = F.size("evaluations")
    passed = F.size(F.filter("evaluations", lambda e: F.upper(e.getField("status")) == "PASS"))
    content = F.struct(
        F.col("evaluations"),
        truncated_percentage(passed, count).alias("passingPercentage"),
        count.alias("evaluationsCount"),
    )
    # The names of a point's fields and of the members of its content.
    return evaluated.select(
        quoted(entity).alias("entityIdentifier"),
        F.lit("ASSET").alias("entityType"),
        F.lit(form_name).alias("formName"),
        instant(as_of).alias("timestamp"),
        F.to_json(content).alias("content"),
        F.lit(type_identifier).alias("typeIdentifier"),
        F.lit(type_revision).alias("typeRevision"),
    )


def resolve_assets(
    names: DataFrame,
    assets: DataFrame,
    name: str = "name",
    asset_name: str = "name",
    asset_id: str = "identifier",
    order_by: Sequence[str] = ("identifier",),
    project: str | None = None,
    asset_project: str = "project",
) -> DataFrame:
    """``names`` plus ``asset_id``: the first asset of that name in any case, else null.

    ``order_by`` says which of several matches is first. Each name's assets are cut
    to one before the shuffle; whether the list is broadcast is left to its size.
    """
    if project is not None:
        assets = assets.where(quoted(asset_project) == project)
    first = assets.groupBy(F.lower(F.coalesce(quoted(asset_name), F.lit(""))).alias(_NAME)).agg(
        F.min_by(quoted(asset_id), F.struct(*map(quoted, order_by))).alias(_ID)
    )
    found = spread_join(names.withColumn(_NAME, F.lower(quoted(name))), first, [_NAME], "left")
    return found.drop(_NAME).withColumnRenamed(_ID, "asset_id")
