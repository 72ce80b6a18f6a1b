"""Helpers that the operators share: column picking, stored frames, samples, components."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keelson.operators.joins import quoted, spread_join
from keelson.session import scratch_path

# One word: a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: ``picked(docs, doc_id="id")``."""
    return df.select(*(quoted(source).alias(name) for name, source in columns.items()))


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared scratch folder and read back.

    It cuts the lineage, survives lost executors and is computed once. The shuffle files
    behind it are then of no use; Spark removes them when the driver collects its garbage,
    which is asked for here so that they do not pile up over the steps of a job.
    """
    path = scratch_path(df.sparkSession)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    for _ in range(2):  # the first round only finds what the second can free
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def hash_sample(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: those with the smallest hash of ``by``.

    The choice depends on the values only, so reruns agree. Only hashes are sorted.
    """
    key = F.xxhash64(*map(quoted, by))
    cut = df.select(key.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(key <= F.lit(cut)).limit(rows) if cut is not None else df.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """The connected components of an undirected graph: ``node``, ``component``.

    ``edges`` has bigint columns ``a`` and ``b``; the component is the smallest node
    that can be reached. Large-star and small-star steps alternate until the edges no
    longer change: each links neighbours to the smallest node near them, so that the
    rounds grow with the logarithm of the longest path. A node with many neighbours is
    split by ``spread_join``. Each round is stored.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _checksum(now)
    while True:
        both = now.union(now.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both, near, ["u"], "left").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, near, ["u"], "left")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        now = stored(small.where("u <> v").distinct())
        check = _checksum(now)
        if check == seen:
            break
        seen = check
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first())


def shared_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` inside tasks; it is broadcast once and read once a task.

    Only for values of bounded size.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    read = []

    def get() -> object:
        if not read:
            read.append(pickle.loads(sent.value))
        return read[0]

    return get


def batches(columns: Sequence[str], make) -> Callable:
    """A ``mapInArrow`` function that calls ``make`` with one list per column of a batch.

    Texts come as bytes. ``make`` returns an iterable of record batches.
    """

    def run(stream: Iterable[pa.RecordBatch]):
        for batch in stream:
            lists = []
            for name in columns:
                array = batch.column(name)
                lists.append(texts_as_bytes(array) if pa.types.is_string(array.type) else array.to_pylist())
            yield from make(*lists)

    return run


__all__ = ["WORD", "batches", "components", "hash_sample", "picked", "quoted", "scratch_path", "shared_value", "spread_join", "stored", "texts_as_bytes", "words"]
