"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hash_sample, picked, quoted, texts_as_bytes
from .registry import load, register

# Bytes by kind; each kind's share of a text is a feature.
_KINDS = (
    bytes(range(0x41, 0x5B)),  # A-Z
    bytes(range(0x61, 0x7B)),  # a-z
    bytes(range(0x30, 0x3A)),  # digits
    b" ",
    b"\n\r\t\x0b\x0c",
    b".,;:?'\"-()",
    b"!",
    b"|",
    b"#$%&*+/<=>@[\\]^_`{}~",
    bytes(range(0x80, 0x100)),
)
_KIND_OF = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _kind in enumerate(_KINDS):
    _KIND_OF[np.frombuffer(_kind, dtype=np.uint8)] = _i
FEATURES = len(_KINDS) + 1 + 12


def features(text: bytes) -> list[float]:
    """What is measured of a text: shares of byte kinds, lengths and repetition."""
    out = np.zeros(FEATURES)
    words = text.split()
    if not words:
        return out.tolist()
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND_OF, weights=seen, minlength=len(_KINDS) + 1)
    out[: len(kinds)] = np.sqrt(kinds / len(text))
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    pairs = max(1, n - 1)
    out[len(kinds) :] = (
        math.log1p(n) / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        math.sqrt(sum(map(eq, words, words[1:])) / pairs),  # a word twice in a row
        len(counts) / n,
        len(counts) / math.sqrt(n) / 10,
        max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / pairs if n > 1 else 1.0,
        len(set(lines)) / len(lines),
        math.log1p(len(lines)) / 10,
        math.log1p(n / len(lines)) / 10,
        sum(w[-1:] in b".,;:?" for w in words) / n,
    )
    return out.tolist()


@dataclass(frozen=True)
class Ranking:
    """A learned score; ``cut`` is the raw score at the chosen quantile."""

    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    cut: float
    scale: float
    at_cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score, ``at_cut`` at the cut."""
        z = (self.raw(x) - self.cut) / self.scale + math.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_pairs(x: np.ndarray, labels: np.ndarray, at_cut: float = 0.7, per_row: int = 8, penalty: float = 0.01) -> Ranking:
    """Learn weights so that preferred rows score higher.

    Every row of label 1 is preferred to every row of label 0; each row enters
    ``per_row`` such pairs at least, chosen evenly. The logistic loss of the score
    differences (Bradley-Terry), with a small quadratic penalty, is minimised by Newton
    steps. The threshold is the quantile of the scores at which as many rows lie below as
    have label 0. With one label only, all weights are zero and the cut is on its side.
    """
    centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    spread = x.std(axis=0) + 1e-6 if len(x) else np.ones(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        cut = 1.0 if len(bad) else -1.0
        return Ranking(np.zeros(FEATURES), centre, spread, cut, 1.0, at_cut)
    z = (x - centre) / spread
    n = max(len(good), len(bad))
    step = np.arange(n * per_row)
    a, b = good[step % len(good)], bad[(step + step // n * 7) % len(bad)]
    d = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / len(d) + penalty * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        move = np.linalg.solve(curvature, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    raw = np.sort(z @ w)
    cut = (raw[len(bad) - 1] + raw[len(bad)]) / 2
    return Ranking(w, centre, spread, float(cut), float(raw.std() / 3 + 1e-9), at_cut)


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000, at_cut: float = 0.7) -> Ranking:
    """A ranking from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Other labels and nulls are left out. At most ``rows`` labels are used, those with the
    smallest hash; they are broadcast, and the features of their documents, a fixed number
    each, come to the driver. An id that several documents share counts for each of them.
    """
    chosen = hash_sample(labels.where("quality in (0, 1) and doc_id is not null").distinct(), ["doc_id", "quality"], rows)
    measured = docs.join(F.broadcast(chosen), "doc_id").select("quality", _measured(F.col("text")).alias("x")).limit(2 * rows)
    got = measured.collect()
    x = np.array([r.x for r in got], dtype=float).reshape(len(got), FEATURES)
    order = np.lexsort(x.T)  # rows arrive in any order; sums should not depend on it
    return fit_pairs(x[order], np.array([r.quality for r in got], dtype=int)[order], at_cut)


def _measured(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts_as_bytes(column)], pa.list_(pa.float64()))

    return of(text)


def scored(text: Column, ranking: Ranking) -> Column:
    """The score of each text; a null text counts as empty."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts_as_bytes(column)], dtype=float).reshape(len(column), FEATURES)
        return pa.array(ranking.score(x), pa.float64())

    return of(text)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for null ids."""
    crc = F.crc32(quoted(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_cut: float = 0.7, rows: int = 4000
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Documents whose crc32 of the id leaves 2 when divided by 4 are held out: their labels
    are not learned. ``predicted`` is 1 if the score is at least ``at_cut``. Only the text
    is an input of the score. Null and blank texts have all features zero and get a score
    too. Null ids are scored and never learned from. Equal texts get equal scores. Extra
    columns are not read. An empty table gives no rows; without labels every document
    is predicted 1.
    """
    own = picked(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out("doc_id", 4, 2))
    ranking = learn(own.where("not held_out"), labels.select("doc_id", "quality"), rows, at_cut)
    return own.withColumn("score", scored(F.col("text"), ranking)).select(
        "doc_id", "held_out", "score", (F.col("score") >= at_cut).cast("int").alias("predicted")
    )


@register("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
