"""Filter interaction audit: what each filter removes in every order of applying them.

Every document is reduced to a mask of the filters that it fails, and the documents of a
part are counted by mask, so that the rest of the work depends on the number of parts
and filters alone. A recursive query then extends prefixes of filter letters by the
letters not used yet; it joins the masks, carries the bits applied so far, and each of
its levels gives the figures of that step for every prefix of that length.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import picked, quoted, spread_join, stored, words
from .registry import load, register

MIN_WORDS = 50
DISTINCT_SHARE = 65
CAPITAL_SHARE = 5
MARKS = "[#$%&*|]"
CAPITALS = "[^A-Z]"
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D under which a text fails; a null text counts as empty.

    A: few words; B: few of them different; C: many capitals; D: one of ``MARKS``. A text
    without words fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < DISTINCT_SHARE * F.size(found),
        "C": 100 * F.length(F.regexp_replace(text, CAPITALS, "")) > CAPITAL_SHARE * F.length(text),
        "D": text.rlike(MARKS),
    }


def with_mask(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source", name: str = "mask"
) -> DataFrame:
    """``id``, ``part`` and the bit mask of failed filters: A is bit 0, E is bit 4.

    E fails where the same text stands under any smaller id. A row whose id is null has
    no smaller id and is smaller than none. Of rows that share the smallest id of a text
    all pass E. A null part is the empty string. The texts are read once; what is joined
    afterwards are their hashes, and a text that many rows share is split over tasks.
    """
    bits = [fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("t")).values())]
    base = picked(docs, i=id, t=text, p=part).select(
        "i",
        F.coalesce(F.col("p").cast("string"), F.lit("")).alias("p"),
        F.sha2(F.coalesce("t", F.lit("")), 256).alias("key"),
        sum(bits[1:], bits[0]).alias("m"),
    )
    base = stored(base)
    first = base.where("i IS NOT NULL").groupBy("key").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    several = first.where("n > 1").drop("n")
    marked = spread_join(base, several, ["key"], "left")
    repeated = F.coalesce(F.col("i") > F.col("first"), F.lit(False)).cast("int") * (1 << len(bits))
    return marked.select(F.col("i").alias(id), F.col("p").alias(part), (F.col("m") + repeated).alias(name))


def mask_cells(
    masks: DataFrame, labels: DataFrame, *, id: str = "doc_id", part: str = "source", good: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """Counts by part and mask: ``part``, ``mask``, ``n``, ``good``, ``toxic``.

    A document is good or toxic if any label row of its id says 1; without a label, or
    with a null one, it is neither.
    """
    flag = lambda c: F.coalesce(F.max((quoted(c) == 1).cast("int")), F.lit(0))
    known = labels.where(quoted(id).isNotNull()).groupBy(quoted(id).alias("i"))
    known = known.agg(flag(good).alias("g"), flag(toxic).alias("t")).where("g + t > 0")
    rows = spread_join(picked(masks, i=id, part=part, mask="mask"), known, ["i"], "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), count("g").alias("good"), count("t").alias("toxic")
    )


def prefix_steps(spark: SparkSession, letters: str) -> DataFrame:
    """Every prefix of every order of ``letters``, by mask: what the last letter does to it.

    Columns: ``prefix``, ``step``, ``letter``, ``mask`` and, as 0 or 1, ``kept``,
    ``removed``, ``redundant`` and ``only``. The rows number 325 times 32 for five
    letters, whatever the input.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"needs 1 to {MOST_FILTERS} different letters")
    pairs = F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << k).alias("bit")) for k, c in enumerate(letters)))
    table = spark.range(0, 1, 1, 1).select(F.inline(pairs))
    cells = spark.range(0, 1 << len(letters), 1, 1).select(F.col("id").cast("int").alias("mask"))
    return spark.sql(
        """
        WITH RECURSIVE walk (prefix, step, letter, mask, applied, kept, removed, redundant, only) AS (
          SELECT '', 0, '', mask, 0, 1, 0, 0, 0 FROM {cells}
          UNION ALL
          SELECT concat(w.prefix, l.letter), w.step + 1, l.letter, w.mask, w.applied | l.bit,
                 IF(w.mask & (w.applied | l.bit) = 0, 1, 0),
                 IF(w.mask & w.applied = 0 AND w.mask & l.bit <> 0, 1, 0),
                 IF(w.mask & w.applied <> 0 AND w.mask & l.bit <> 0, 1, 0),
                 IF(w.mask = l.bit, 1, 0)
          FROM walk w JOIN {letters} l ON w.applied & l.bit = 0
        )
        SELECT prefix, step, letter, mask, kept, removed, redundant, only FROM walk WHERE step > 0
        """,
        cells=cells,
        letters=table,
    )


def order_steps(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The figures of every step of every order of the filters, for every part.

    ``cells`` has ``part``, ``mask``, ``n``, ``good`` and ``toxic``. One row per part,
    ``filter_order`` and ``step``, zeros included: ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``, the removed ones of
    the step's filter summed over all orders. No parts give no rows.
    """
    spark = cells.sparkSession
    steps = F.broadcast(prefix_steps(spark, letters))  # its size depends on the letters alone
    total = lambda c: F.sum(c).cast("bigint")
    by_prefix = (
        cells.join(steps, "mask")
        .groupBy("part", "prefix", "step", "letter")
        .agg(
            total(F.col("n") * F.col("kept")).alias("kept"),
            total(F.col("n") * F.col("removed")).alias("removed"),
            total(F.col("n") * F.col("redundant")).alias("redundant"),
            total(F.col("n") * F.col("only")).alias("unique_fails"),
            total(F.col("good") * F.col("removed")).alias("good_lost"),
            total(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
        )
    )
    # As many orders begin with a prefix as the letters after it can be arranged.
    orders_of = F.element_at(
        F.array(*(F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1))), F.col("step")
    )
    share = F.sum(F.col("removed") * orders_of).over(Window.partitionBy("part", "letter"))
    by_prefix = by_prefix.withColumn("shapley", share.cast("bigint"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    orders = spark.range(0, 1, 1, 1).select(F.explode(orders).alias("filter_order")).select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.length("filter_order"))).alias("k")
    ).select("filter_order", F.expr("left(filter_order, k)").alias("prefix"))
    return by_prefix.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """The audit of ``docs``; ``names`` may rename ``id``, ``text`` and ``part``."""
    names = dict(names or {})
    masks = with_mask(docs, **names)
    id, part = names.get("id", "doc_id"), names.get("part", "source")
    labels = labels if id == "doc_id" else labels.withColumnRenamed("doc_id", id)
    return order_steps(mask_cells(masks, labels, id=id, part=part))


_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), masked AS (
  SELECT t.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN t.doc_id > f.first THEN 16 ELSE 0 END) AS mask
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN known k ON k.doc_id = t.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT o.filter_order, s.step, l.letter, l.bit,
         (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE instr(substr(o.filter_order, 1, s.step - 1), p.letter) > 0)::INT AS before
  FROM orders o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
  JOIN letters l ON l.letter = substr(o.filter_order, s.step, 1)
), figures AS (
  SELECT c.part, s.filter_order, s.step, s.letter,
         sum(CASE WHEN c.mask & (s.before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN c.mask & s.before <> 0 AND c.mask & s.bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN c.mask & s.before = 0 AND c.mask & s.bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells c, steps s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM figures
"""


@register("op12_filter_audit", _SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    return filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
