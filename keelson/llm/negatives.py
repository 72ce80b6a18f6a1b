"""Hard-negative mining by Fagin's threshold algorithm over integer inner products.

Candidates are dealt into stripes of bounded size. Within a stripe every dimension keeps
its candidates sorted by value. An anchor reads each list from the end that its sign
favours, scores what it meets by random access, and stops once no candidate that it has
not met can enter any of its windows. What stripes report is merged by Spark: first the
positives of every anchor, then, within the windows that these set, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import picked, stored
from .registry import load, register

SCALE = 256.0
STRIPE = 16_384
DEPTH = 64
POSITIVES = 5
NEGATIVES = 10
LEAST, MOST = 30, 90
_LONG = 2**63 - 1
_EXACT = 2.0**53
_HITS = "anchor_id bigint, slot int, row_id bigint, score bigint"


def integer_vectors(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows that take part: ``id``, ``label`` and ``vector`` of ``floor(256 * x)``.

    Left out are rows with a null id, label or vector and vectors with a null or
    non-finite component. Of rows that share an id the one with the least label, then
    the least vector, counts. Components beyond the range of long stay at its limits.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = picked(df, id=id, label=label, v=vector).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(finite).select(
        F.col("id").cast("bigint"), "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector")
    )
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return one.select("id", "r.label", "r.vector")


class Lists:
    """The candidates of one stripe that have one number of dimensions, sorted by each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.largest = int(np.abs(self.vectors.astype(np.float64)).max(initial=0)) + 1
        self.floats = self.vectors.astype(np.float64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.vectors, self.order.T, axis=0).T

    def scores(self, rows: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
        """Exact inner products, at the limits of long where they lie beyond."""
        if small:  # every partial sum is a whole number below 2^53, so doubles are exact
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        sums = self.vectors[rows].astype(object) @ anchor.astype(object)
        return np.array([_within(s) for s in sums], dtype=np.int64)

    def search(self, anchor_id: int, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], same: bool, k: int):
        """The ``k`` best rows of each window of scores: pairs of lists, ids and scores.

        Rows of the anchor's label are taken if ``same``, else those of other labels; the
        anchor itself never is. Higher scores come first, then smaller ids.
        """
        n, dims = self.vectors.shape
        small = float(self.largest) * (float(np.abs(anchor.astype(np.float64)).max(initial=0)) + 1) * max(dims, 1) < _EXACT
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        weights = [int(x) for x in anchor]
        seen = np.zeros(n, dtype=bool)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        depth, width = 0, DEPTH
        while True:
            end = min(n, depth + width)
            new = np.zeros(n, dtype=bool)
            if len(up) or len(down):  # sorted access, from the end that the sign favours
                new[self.order[up, n - end : n - depth].ravel()] = True
                new[self.order[down, depth:end].ravel()] = True
                new &= ~seen
            else:  # every score is zero, and no list tells rows apart
                new[:], end = True, n
            seen |= new
            rows = np.flatnonzero(new)
            rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != anchor_id)]
            scores = self.scores(rows, anchor, small)
            for w, (low, high) in enumerate(windows):
                fits = (scores >= low) & (scores <= high)
                ids, held = np.append(best[w][0], self.ids[rows[fits]]), np.append(best[w][1], scores[fits])
                first = np.lexsort((ids, ~held))[:k]  # ~ turns the order round without overflow
                best[w] = ids[first], held[first]
            if end == n:
                return best
            # No row below the lists' present depth can score more than this.
            above = sum(weights[d] * int(self.values[d, n - end]) for d in up)
            above = _within(above + sum(weights[d] * int(self.values[d, end - 1]) for d in down))
            if all(
                low > high or above < low or (len(held) == k and above < held[-1])
                for (low, high), (_, held) in zip(windows, best)
            ):
                return best
            depth, width = end, 2 * width


def _within(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, int(score)))


def _matrix(column: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    return np.array(column.take(pa.array(rows)).to_pylist(), dtype=np.int64).reshape(len(rows), dims)


def _searcher(same: bool, k: int):
    """A ``mapInArrow`` function over rows sorted by stripe, the candidates of each first.

    It holds the lists of one stripe at a time; anchors stream past them in batches.
    """

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, parts, lists = None, {}, {}
        for batch in stream:
            stripes, kinds = batch.column("stripe").to_numpy(), batch.column("kind").to_numpy()
            dims = np.array(batch.column("dims"))
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            out: list[tuple[int, int, int, int]] = []
            for s in np.unique(stripes):
                if s != stripe:
                    stripe, parts, lists = s, {}, {}
                here = np.flatnonzero((stripes == s) & (kinds == 0))
                for d in np.unique(dims[here]):
                    rows = here[dims[here] == d]
                    parts.setdefault(int(d), []).append((ids[rows], labels[rows], _matrix(batch.column("vector"), rows, d)))
                for row in np.flatnonzero((stripes == s) & (kinds == 1)):
                    d = int(dims[row])
                    if d in parts:  # all candidates of the stripe have come
                        lists[d] = Lists(*(np.concatenate(c) for c in zip(*parts.pop(d))))
                    if d not in lists:
                        continue
                    anchor = np.array(batch.column("vector")[row].as_py(), dtype=np.int64)
                    windows = [(w["low"], w["high"]) for w in batch.column("windows")[row].as_py()]
                    found = lists[d].search(int(ids[row]), anchor, int(labels[row]), windows, same, k)
                    for slot, (names, scores) in enumerate(found):
                        out += [(int(ids[row]), slot, int(i), int(x)) for i, x in zip(names, scores)]
            if out:
                a, w, r, x = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(w, pa.int32()), pa.array(r, pa.int64()), pa.array(x, pa.int64())],
                    names=["anchor_id", "slot", "row_id", "score"],
                )

    return run


def best_rows(candidates: DataFrame, anchors: DataFrame, stripes: int, *, same: bool, k: int) -> DataFrame:
    """The ``k`` best candidates of every window of every anchor.

    ``candidates`` has ``id``, ``label`` and ``vector``; ``anchors`` also ``windows``, an
    array of structs ``low`` and ``high``. Returns ``anchor_id``, ``slot`` (the window's
    place), ``rank``, ``row_id`` and ``score``. Every candidate lies in one stripe, every
    anchor visits all; a stripe reports at most ``k`` rows a window, which bounds what is
    merged. Vectors of different lengths have no score.
    """
    held = candidates.select(
        F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int").alias("stripe"),
        F.lit(0).alias("kind"),
        "id",
        F.col("label").cast("bigint"),
        "vector",
        F.lit(None).cast("array<struct<low: bigint, high: bigint>>").alias("windows"),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
        F.lit(1).alias("kind"),
        "id",
        F.col("label").cast("bigint"),
        "vector",
        "windows",
    )
    dealt = held.union(asked).withColumn("dims", F.size("vector"))
    dealt = dealt.repartition(3 * stripes, "stripe").sortWithinPartitions("stripe", "kind")
    hits = dealt.mapInArrow(_searcher(same, k), _HITS)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    stripe_rows: int = STRIPE,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``vectors`` has ``id``, a whole ``label`` and ``vector`` of whole numbers, one row per id;
    ``is_anchor`` is a condition on ``id``. An anchor's positives are its best rows of the
    same label, the negatives of a pair its best rows of other labels whose score lies
    between ``least`` and ``most`` hundredths of the positive's. Returns ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    Anchors without positives, and pairs without negatives, give no rows; a positive with
    a negative score has an empty window. Equal scores go by the smaller id.
    """
    candidates = stored(vectors.select("id", "label", "vector"))
    stripes = max(1, math.ceil(candidates.count() / stripe_rows))
    any_score = F.array(F.struct(F.lit(-_LONG - 1).alias("low"), F.lit(_LONG).alias("high")))
    anchors = candidates.where(is_anchor)
    near = best_rows(candidates, anchors.withColumn("windows", any_score), stripes, same=True, k=positives)
    near = stored(near.select("anchor_id", "rank", "row_id", "score"))

    score = F.col("score").cast("decimal(28,0)")
    pairs = near.select(
        F.col("anchor_id").alias("id"),
        F.struct(
            "rank",
            F.ceil(score * least / 100).cast("bigint").alias("low"),
            F.floor(score * most / 100).cast("bigint").alias("high"),
        ).alias("w"),
    )
    windows = pairs.groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    windows = windows.select("id", F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    far = best_rows(candidates, anchors.join(windows, "id"), stripes, same=False, k=negatives)
    return far.join(
        near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["anchor_id", "slot"],
    ).select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@register("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)
