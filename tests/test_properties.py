"""Properties of upserts, and a brute-force merge, on random small frames."""

from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from keelson.operators.rowlevel import delete_insert, merge_upsert, upsert_metrics

SCHEMA = "k int, v int"
KEYS = st.one_of(st.none(), st.integers(0, 6))
FRAME = st.lists(st.tuples(KEYS, st.one_of(st.none(), st.integers(0, 3))), max_size=10)
UNIQUE = st.lists(st.tuples(KEYS, st.integers(0, 3)), max_size=8, unique_by=lambda r: r[0])
RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@RELAXED
@given(target=FRAME, source=FRAME)
def test_delete_insert(spark, target, source):
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
    touched = {k for k, _ in source if k is not None}
    expected = Counter(r for r in target if r[0] not in touched) + Counter(source)
    assert bag(delete_insert(t, s, ["k"])) == expected
    deleted = sum(k in touched for k, _ in target)
    metrics = upsert_metrics(t, s, ["k"]).first()
    assert tuple(metrics) == (deleted, len(source), len(target) - deleted + len(source))


@RELAXED
@given(target=FRAME, source=UNIQUE)
def test_merge_against_brute_force(spark, target, source):
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
    new = {k: v for k, v in source if k is not None}
    held = {k for k, _ in target if k is not None}
    expected = Counter((k, new.get(k, v)) for k, v in target)
    expected += Counter(r for r in source if r[0] is None or r[0] not in held)
    assert bag(merge_upsert(t, s, ["k"])) == expected


@RELAXED
@given(target=UNIQUE, source=UNIQUE)
def test_upserts_agree_and_repeat(spark, target, source):
    target, source = ([r for r in rows if r[0] is not None] for rows in (target, source))
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
    once = delete_insert(t, s, ["k"])
    assert bag(once) == bag(merge_upsert(t, s, ["k"])) == bag(delete_insert(once, s, ["k"]))
    assert {k for k, _ in source} <= {k for k, _ in bag(once)}
