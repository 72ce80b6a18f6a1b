"""The filter audit against a plain version."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from keelson.llm.filters import filter_audit, mask_cells, order_steps, prefix_steps, with_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int, text string, source string"


def plain_masks(rows):
    """The mask of every row of (id, text), by rules A to E."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        found = WORD.findall(t)
        fails = [
            len(found) < 50,
            100 * len(set(found)) < 65 * len(found),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search(r"[#$%&*|]", t) is not None,
            i is not None and i > first[t],
        ]
        out.append(sum(f << k for k, f in enumerate(fails)))
    return out


def plain_audit(rows, labels):
    """Every order applied to every row, filter after filter."""
    masks = plain_masks([r[:2] for r in rows])
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {r[2] or "" for r in rows}
    out, removed_by = {}, Counter()
    for part in parts:
        here = [(m, r[0]) for m, r in zip(masks, rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                fails = [x for x in here if x[0] & bit]
                removed_by[part, letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(fails) - len(gone), sum(x[0] == bit for x in here),
                    sum(x[1] in good for x in gone if x[1] is not None), sum(x[1] in toxic for x in gone if x[1] is not None),
                ]
    return {k: [*v, removed_by[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def _found(df):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in df.collect()}


@pytest.fixture(scope="module")
def odd(corpus):
    """The odd rows, with each of the filters failed alone and together somewhere."""
    rows = [r[:2] + r[3:4] for r in corpus]
    long = " ".join(f"word{i}" for i in range(60))
    rows += [(100, long, "s9"), (101, long + " $", "s9"), (102, long.upper(), "s9"), (103, "a " * 80, ""), (104, long, None)]
    return rows + [(105, long.upper() + " #" * 90, "s9"), (100, long, "s9"), (99, long, "s9"), (None, long, "s9")]


def test_odd_rows(spark, odd):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 2)] + [(3, 1, None), (3, 0, 1), (5, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id bigint, text string, source string, quality string, mask int")
    marked = spark.createDataFrame([(*x, "clash", "clash") for x in labels], LABELS)
    found = filter_audit(docs.repartition(3), marked)
    assert found.columns[:3] == ["part", "filter_order", "step"]
    assert _found(found) == plain_audit(odd, [x for x in labels if x[0] is not None])


def test_masks_of_rows_without_an_id(spark):
    rows = [(None, "same"), (None, "same"), (4, "same"), (2, "same"), (2, "same"), (None, None), (1, "")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, source string")
    found = sorted(((r.doc_id, r.mask) for r in with_mask(docs).collect()), key=repr)
    assert found == sorted(((r[0], m) for r, m in zip(rows, plain_masks(rows))), key=repr)


def test_every_prefix_and_mask_once(spark):
    found = prefix_steps(spark, "ABC")
    assert found.count() == found.select("prefix", "mask").distinct().count() == (3 + 6 + 6) * 8
    with pytest.raises(ValueError):
        prefix_steps(spark, "AA")


def test_two_filters(spark):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 2, 2, 0, 1), ("q", 0, 1, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    found = _found(order_steps(cells, "XY"))
    assert found["p", "XY", 1] == [2, 5, 0, 0, 1, 0, 5] and found["p", "XY", 2] == [0, 2, 5, 2, 0, 1, 9]
    assert found["q", "YX", 2] == [1, 0, 0, 0, 0, 0, 0]


def test_a_text_of_a_third_of_all_rows_and_empty_tables(spark, no_docs):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copied").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source")
    )
    no_labels = spark.createDataFrame([], LABELS)
    cells = mask_cells(with_mask(docs), no_labels).collect()
    assert {r["mask"]: r.n for r in cells} == {1: 2001, 17: 999}
    assert filter_audit(no_docs, no_labels).count() == 0
