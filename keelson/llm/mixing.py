"""Mixing sources to target weights on a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, picked, spread_join, stored
from .registry import load, register

# The weight schedule of a source over training time 0 to 1: straight from its first value
# to its second. Sources take them in turn, by code point.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
WEIGHTS = (1, 2, 3)


def demand_position(share: Column, start: Column, end: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` (0 to 1).

    The schedule w(t) = start + (end - start) t has the integral start t + (end - start) t^2 / 2,
    and (start + end) / 2 at t = 1. The inverse is written so that it also holds for
    start = end and loses no digits near zero.
    """
    wanted = share * (start + end)  # twice the integral
    root = F.sqrt(start * start + (end - start) * wanted)
    return F.when(wanted > 0, F.least(F.lit(1.0), wanted / (start + root))).otherwise(F.lit(0.0))


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3, schedules: Sequence[tuple] = SCHEDULES
) -> DataFrame:
    """``sources`` has one row per source: ``source``, ``source_size``. Adds each target.

    Sources are ordered by code point, null last, and take the weights in turn. The
    targets share all sizes by weight; a target stops at ``repeats`` times its source's
    size and the excess is shared again by weight until none is above. At the end each
    open target is its weight times one level, and a source is capped exactly if its cap
    over its weight is below that level. So one pass in the order of cap over weight finds
    it: a source is capped if what is left for it and all later ones would exceed its cap.
    Windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    start, end = (F.array(*(F.lit(float(s[i])) for s in schedules)) for i in (0, 1))
    ranked = (
        sources.withColumn("turn", turn)
        .withColumn("weight", F.array(*map(F.lit, weights))[(F.col("turn") % len(weights)).cast("int")].cast("bigint"))
        .withColumn("start", start[(F.col("turn") % len(schedules)).cast("int")])
        .withColumn("end", end[(F.col("turn") % len(schedules)).cast("int")])
        .withColumn("cap", F.col("source_size") * repeats)
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    judged = ranked.withColumn("capped", F.col("cap") * open_weight <= left * F.col("weight"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    opened = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    total = F.sum("source_size").over(everything)
    shared = (total - spent).cast("double") * F.col("weight").cast("double") / opened.cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared)
    return judged.withColumn("target", target).select("source", "source_size", "target", "start", "end")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    repeats: int = 3,
    schedules: Sequence[tuple] = SCHEDULES,
    slices: int = 1024,
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken``, ``position`` and ``passes``, range-sorted by position.

    ``size`` is the number of words. Within a source, documents are ordered by the MD5 of
    their id, then by size; the words of the source so form one line, on which a document
    lies from ``upto - size`` to ``upto``. The mix walks that line until the target is
    reached, again from the start where the target is above the source's size. ``taken``
    is how many words of the document it passes: whole passes, and for the last document
    of the last pass the part that is needed, so that the source's taken words are its
    target to the nearest word. No document exceeds ``repeats`` times its size.

    ``position`` is the training time, 0 to 1, of the document's first pass: the source's
    weight schedule is integrated, and the cumulative demand inverted at the document's
    middle. A document that is not taken has none. ``passes`` is an array of at most
    ``repeats`` structs ``pass`` (from 0), ``taken`` and ``position``: each pass goes on where
    the one before it ended, ``source_size`` words further in the source's demand.
    ``scheduled`` makes a row of each.

    Null texts have size 0; documents of size 0 take nothing. A null source is a source
    of its own. Null ids come last in their source. Rows that are equal in id and size are
    interchangeable. Extra columns are not read. An empty table gives no rows.

    The line of a source is cut into ``slices`` by hash, each summed on its own, so that
    no task gets a whole source.
    """
    sized = picked(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    )
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    spot = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    part = F.coalesce((spot * slices / F.lit(1 << 32)).cast("int"), F.lit(slices))
    sized = stored(sized.withColumn("spot", order).withColumn("part", part))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    # One row per source, its slices as an array of at most ``slices`` + 1 entries in order.
    lines = parts.groupBy("source").agg(
        F.sum("part_size").alias("source_size"), F.array_sort(F.collect_list(F.struct("part", "part_size"))).alias("line")
    )
    targets = source_targets(lines.select("source", "source_size"), weights, repeats, schedules)
    starts = F.transform(
        F.sequence(F.lit(1), F.size("line")),
        lambda i: F.struct(
            F.col("line")[i - 1]["part"].alias("part"),
            F.aggregate(F.slice("line", 1, i - 1), F.lit(0).cast("bigint"), lambda a, x: a + x["part_size"]).alias("before"),
        ),
    )
    offsets = lines.select("source", F.explode(starts).alias("p")).select("source", "p.part", "p.before")
    known = stored(
        offsets.join(targets, offsets["source"].eqNullSafe(targets["source"]))
        .select(F.struct(offsets["source"]).alias("key"), "part", "before", "source_size", "target", "start", "end")
    )
    # Inside a slice of one source: documents in order, summed.
    inside = Window.partitionBy("key", "part").orderBy(F.col("spot").asc_nulls_last(), "size")
    walked = sized.withColumn("key", F.struct("source")).withColumn(
        "within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    placed = walked.join(known, ["key", "part"]).withColumn("upto", F.col("before") + F.col("within"))
    goal = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - F.col("whole") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    placed = placed.withColumn("whole", whole.cast("bigint")).withColumn("rest", rest)
    taken = (F.col("whole") * F.col("size") + last).cast("bigint")

    def one(k: Column) -> Column:
        middle = (k * F.col("source_size") + F.col("upto") - F.col("size") / 2) / F.greatest(goal, F.lit(1))
        position = demand_position(F.least(middle, F.lit(1.0)), F.col("start"), F.col("end"))
        own = F.when(k < F.col("whole"), F.col("size")).otherwise(last).cast("bigint")
        return F.struct(k.alias("pass"), own.alias("taken"), position.alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.col("whole").cast("int")), one), lambda p: p["taken"] > 0)
    out = placed.withColumn("taken", taken).withColumn("passes", passes).withColumn("position", F.get("passes", F.lit(0))["position"])
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "passes")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def scheduled(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` in training order: one for each pass over a document.

    ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``pass``, ``taken`` (in this pass)
    and ``position``, range-sorted by position. Documents that are not taken have no row.
    """
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", F.explode("passes").alias("p"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "p.pass", "p.taken", "p.position")
    return rows.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS spot
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 1 + turn % 3 AS weight, source_size * 3 AS cap,
    [1.0, 1.5, 0.5][1 + turn % 3]::DOUBLE AS w0, [1.0, 0.5, 1.5][1 + turn % 3]::DOUBLE AS w1
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sums)),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
    total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM ranked),
judged AS (SELECT *, cap * open_weight <= remaining * weight AS capped FROM levels),
targets AS (
  SELECT source, source_size, w0, w1, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE * weight::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM judged),
walked AS (
  SELECT s.*, t.source_size, t.target, w0, w1, round(t.target)::BIGINT AS goal,
    sum(size) OVER (PARTITION BY s.source ORDER BY spot, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN greatest(0, least(size, goal % source_size - (upto - size))) ELSE 0 END AS rest
  FROM walked),
-- each pass: words taken, and the time at which the source's demand reaches the document's middle
opened AS (
  SELECT *, CASE WHEN k < whole THEN size ELSE rest END AS own,
    least((k * source_size + upto - size / 2) / greatest(goal, 1), 1.0::DOUBLE) * (w0 + w1) AS wanted
  FROM (SELECT *, unnest(range(0, whole::BIGINT + 1)) AS k FROM counted)),
timed AS (
  SELECT *, floor(CASE WHEN wanted > 0 THEN least(1.0::DOUBLE, wanted / (w0 + sqrt(w0 * w0 + (w1 - w0) * wanted))) ELSE 0 END * 1e9)::BIGINT AS moment FROM opened)
SELECT doc_id, size, source_size, target, coalesce(sum(own) FILTER (own > 0), 0)::BIGINT AS taken,
  min(moment) FILTER (k = 0 AND own > 0) AS position_e9,
  coalesce(string_agg(k || ':' || own || ':' || moment, ',' ORDER BY k) FILTER (own > 0), '') AS passes
FROM timed GROUP BY doc_id, spot, size, source, source_size, target, upto, goal
"""


@register("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by document: its words taken, and when each pass over it comes in training.

    ``passes`` lists pass, words and position; positions are in billionths of the training.
    """
    mixed = mix(load(spark, sf_dir, "documents"))
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda a, p: a + p["taken"])
    at = lambda position: F.floor(position * 1e9).cast("bigint")
    passes = F.transform("passes", lambda p: F.concat_ws(":", p["pass"], p["taken"], at(p["position"])))
    return mixed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        at(F.col("position")).alias("position_e9"), F.array_join(passes, ",").alias("passes"),
    )
