"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, picked, spread_join, stored
from .registry import load, register

TABLES, HASHES, PROBES, NEAREST = 6, 2, 4, 3
SEED = 20240601
CELL = 256  # rows of one side of a block of candidate pairs


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def probes(unit: np.ndarray, tables: int = TABLES, probed: int = PROBES) -> np.ndarray:
    """The buckets of each unit vector: ``tables`` times ``probed`` codes.

    A hash rotates a vector by three rounds of random signs and a Hadamard transform, and
    names the corner of the cross-polytope that is nearest, of 2 d. A table joins
    ``HASHES`` of them. Besides the nearest corners it probes the next ones, those with
    the least loss first. Codes of one table are in ascending order.
    """
    n, d = unit.shape
    width = max(4, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    rng = np.random.default_rng([SEED, d])
    out = np.empty((n, tables, probed), dtype=np.int64)
    for table in range(tables):
        corners, losses = [], []
        for _ in range(HASHES):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            size = np.abs(y)
            top = np.argpartition(-size, NEAREST, axis=1)[:, :NEAREST]
            best = np.take_along_axis(size, top, axis=1)
            order = np.argsort(-best, axis=1, kind="stable")
            top, best = np.take_along_axis(top, order, axis=1), np.take_along_axis(best, order, axis=1)
            corners.append(2 * top + (np.take_along_axis(y, top, axis=1) < 0))
            losses.append((best[:, :1] - best) ** 2)
        code, loss = corners[0], losses[0]
        for corner, lost in zip(corners[1:], losses[1:]):
            code = (code[:, :, None] * (2 * width) + corner[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :probed]
        codes = np.take_along_axis(code, chosen, axis=1)
        out[:, table] = np.sort(codes * tables + table, axis=1)
    return out.reshape(n, -1) * 65536 + d % 65536


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _with_codes(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = batch.column("embedding").to_pylist()
        codes: list = [None] * len(rows)
        for d in {len(r) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r) == d]
            for i, own in zip(at, probes(_units([rows[i] for i in at])).tolist()):
                codes[i] = own
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "embedding", "first", "copies")), pa.array(codes, pa.list_(pa.int64()))],
            ["key", "embedding", "first", "copies", "codes"],
        )


def _earliest(a: np.ndarray, b: np.ndarray, code: int) -> np.ndarray:
    """Whether ``code`` is the first bucket that each pair of probe lists shares."""
    a, b = (v.reshape(len(v), TABLES, -1) for v in (a, b))
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)  # of a's probes: also in b
    flat = same.reshape(len(a), -1)
    return a.reshape(len(a), -1)[np.arange(len(a)), flat.argmax(axis=1)] == code


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the edges, those that connect the same nodes without a cycle."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root.setdefault(up, up)
            v = up
        return v

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            left.append(x)
            right.append(y)
    return left, right


def _verify(rows: dict[str, list], least: float, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The links of one block: both keys and both numbers of copies, each pair in one block only."""
    keys, copies = np.array(rows["key"]), np.array(rows["copies"])
    codes, unit = np.array(rows["codes"]), _units(rows["embedding"])
    side = np.array(rows["side"])
    low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if across:  # two chunks, of which one may be empty
        i, j = np.nonzero(unit[low] @ unit[high].T >= least)
        i, j = low[i], high[j]
    else:
        i, j = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    first = _earliest(codes[i], codes[j], rows["code"][0]) if len(i) else np.zeros(0, dtype=bool)
    i, j = i[first], j[first]
    return keys[i], keys[j], copies[i], copies[j]


def _blocks(least: float):
    """Verify the candidate pairs of each block; rows come sorted by block.

    Gives ``key``, ``n`` (linked rows) and ``other`` null, or an edge ``key``, ``other``.
    A block is at most two chunks, so one is held at a time.
    """
    columns = ("key", "embedding", "copies", "codes", "side", "code")

    def flush(rows: dict[str, list], block: tuple | None) -> Iterator[pa.RecordBatch]:
        if block is None or len(rows["key"]) < 2:
            return
        a, b, ca, cb = _verify(rows, least, block[1] != block[2])
        if not len(a):
            return
        keys, at = np.unique(np.r_[a, b], return_inverse=True)
        n = np.bincount(at, weights=np.r_[cb, ca]).astype(np.int64)
        left, right = _forest(a, b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.tolist() + left, pa.int64()),
                pa.array(n.tolist() + [0] * len(left), pa.int64()),
                pa.array([None] * len(keys) + right, pa.int64()),
            ],
            ["key", "n", "other"],
        )

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in columns}
        block = None
        for batch in stream:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("code", "low", "high"))))
            lists = {c: batch.column(c).to_pylist() for c in columns}
            start = 0
            for k in range(1, len(names) + 1):
                if k < len(names) and names[k] == names[start]:
                    continue
                if names[start] != block:
                    yield from flush(rows, block)
                    rows, block = {c: [] for c in columns}, names[start]
                for c in columns:
                    rows[c] += lists[c][start:k]
                start = k
        yield from flush(rows, block)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are taken once, with the number of their copies. Each goes to the
    buckets of its multiprobe codes, and the pairs of a bucket are verified by cosine in
    double precision; every link has at least ``least``. A bucket with many vectors is cut
    into chunks by hash, and each pair of chunks is a block of its own, so no task gets a
    whole bucket and pairs leave a block only as counts and a spanning forest. A pair that
    meets in several buckets counts in the first that its two lists share.

    Null vectors, and those that are empty, zero, or hold a null or non-finite component,
    link with nothing; vectors of different lengths do not link. Rows that share an id are
    vectors of their own. A null id is kept as a row, counts as a link and names no
    component unless all ids of it are null; its ``kept`` is false. Other columns are not
    read. An empty table gives no rows.
    """
    own = picked(vectors, vec_id=id_col, embedding=vector_col)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    own = own.withColumn("sound", sound)
    once = own.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    once = stored(once.withColumn("key", F.monotonically_increasing_id()))
    kind = once.schema["embedding"].dataType.simpleString()
    coded = stored(once.mapInArrow(_with_codes, f"key bigint, embedding {kind}, first bigint, copies bigint, codes array<bigint>"))

    entries = coded.select("key", F.explode("codes").alias("code"))
    busy = entries.groupBy("code").agg(F.count("*").alias("held")).where("held > 1")
    placed = spread_join(entries, busy, ["code"], "inner")
    chunks = F.ceil(F.col("held") / CELL)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))
    )
    placed = placed.select(
        "key", "code", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).cast("int").alias("side")
    )
    blocks = placed.join(coded.select("key", "embedding", "copies", "codes"), "key")
    blocks = blocks.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high", "key")
    links = stored(blocks.mapInArrow(_blocks(least), "key bigint, n bigint, other bigint"))

    counts = links.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    groups = groups.withColumnsRenamed({"node": "key", "component": "root"})
    known = coded.select("key", "embedding", "first", "copies").join(counts, "key", "left").join(groups, "key", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "key")))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = spread_join(known, smallest, ["root"], "left").select(
        "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    vector = F.when(F.col("sound"), F.col("embedding"))
    found = own.select("vec_id", vector.alias("embedding")).join(stored(known), "embedding", "left")
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@register("op9_embedding_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))
