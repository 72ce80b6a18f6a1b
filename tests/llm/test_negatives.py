"""Hard negatives against a search of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm.negatives import Lists, hard_negatives, integer_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, id string, rank int"
LIMIT = 2**63


def plain(vectors, is_anchor, positives=5, negatives=10, least=30, most=90):
    """Every row scored against every anchor; ``vectors`` maps an id to label and integers."""
    out = []
    for a, (label, v) in vectors.items():
        if not is_anchor(a):
            continue
        scored = {True: [], False: []}
        for b, (other, w) in vectors.items():
            if b != a and len(w) == len(v):
                score = max(-LIMIT, min(LIMIT - 1, sum(x * y for x, y in zip(v, w))))
                scored[other == label].append((-score, b))
        for p, positive in sorted(scored[True])[:positives]:
            fits = [(s, b) for s, b in sorted(scored[False]) if least * -p <= 100 * -s <= most * -p]
            out += [(a, positive, k, b, -p, -s) for k, (s, b) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def integers(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-LIMIT, min(LIMIT - 1, math.floor(256 * float(np.float32(x))))) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    return kept


def odd_rows():
    rng = random.Random(3)
    near = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in near[i % 6]], i % 4) for i in range(400)]
    rows += [(i, rows[i % 7][1], i % 3) for i in range(400, 460)]  # ties
    rows += [
        (500, [0.0] * 8, 1), (501, None, 1), (502, [1.0] * 8, None), (503, [float("nan")] * 8, 1),
        (504, [float("inf")] + [0.0] * 7, 1), (505, [None] + [0.0] * 7, 1), (600, [], 1), (601, [], 1), (602, [], 2),
        (700, [1.0, 2.0, 3.0], 1), (701, [1.0, 2.0, 2.5], 1), (702, [0.5, 1.0, 1.5], 2), (None, [1.0] * 8, 1),
        (20, rows[20][1], rows[20][2]), (20, rows[21][1], 3), (800, [3e38] * 8, 1), (801, [2e38] * 8, 1), (802, [1e38] * 8, 2),
        (803, [-3e38] * 8, 2), (804, [1e14] * 8, 1),
    ]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1.0, "x", 1) for r in rows], SCHEMA).repartition(4)
    found = hard_negatives(integer_vectors(df), F.col("id") % 20 == 0, stripe_rows=50)
    expected = plain(integers(rows), lambda i: i % 20 == 0)
    assert len(expected) > 300
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_one_stripe_and_many_agree(spark):
    vectors = integer_vectors(spark.createDataFrame([(*r, 1.0, "x", 1) for r in odd_rows()], SCHEMA))
    one, many = (hard_negatives(vectors, F.col("id") % 50 == 0, stripe_rows=n, positives=3, negatives=4, least=0, most=100) for n in (10**6, 20))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_nothing_to_search(spark):
    empty = integer_vectors(spark.createDataFrame([], SCHEMA))
    assert hard_negatives(empty, F.col("id") % 2 == 0).count() == 0
    alone = integer_vectors(spark.createDataFrame([(0, [1.0], 1, 1.0, "x", 1)], SCHEMA))
    assert hard_negatives(alone, F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_search_stops_without_losing_rows(seed):
    rng = np.random.default_rng(seed)
    n, dims = 3000, (2, 5, 16)[seed % 3]
    vectors = rng.integers(-40, 40, (n, dims)) * (rng.random((n, dims)) < 0.6)
    ids, labels = rng.permutation(n) * 3, rng.integers(0, 3, n)
    lists = Lists(ids, labels, vectors)
    anchor = vectors[0]
    scores = vectors @ anchor
    top = int(scores.max())
    windows = [(-(10**9), 10**9), (0, top // 2), (top // 3, top // 3), (5, 4)]
    for same in (True, False):
        found = lists.search(int(ids[0]), anchor, int(labels[0]), windows, same, 7)
        for (low, high), (names, held) in zip(windows, found):
            fits = [(-s, i) for s, i, x in zip(scores, ids, labels) if (x == labels[0]) == same and i != ids[0] and low <= s <= high]
            assert list(zip(-held, names)) == sorted(fits)[:7]


def test_search_reads_part_of_the_lists(monkeypatch):
    """Where one dimension decides, few rows are scored."""
    n = 20_000
    vectors = np.stack([np.arange(n), np.zeros(n, dtype=np.int64)], axis=1)
    lists = Lists(np.arange(n), np.zeros(n, dtype=np.int64), vectors)
    scored = []
    plain_scores = lists.scores
    monkeypatch.setattr(lists, "scores", lambda rows, *rest: scored.append(len(rows)) or plain_scores(rows, *rest))
    ((names, _),) = lists.search(-1, np.array([3, 0]), 0, [(-(10**12), 10**12)], True, 5)
    assert list(names) == [n - 1, n - 2, n - 3, n - 4, n - 5] and sum(scored) < n // 100
