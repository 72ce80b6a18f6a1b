"""Keeping target rows that a change cannot touch out of its join, by a Bloom filter.

A key range tells nothing where keys are random. A filter of the source's keys does: a
target row that it rejects matches no source row, so it needs no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .joins import key_hash, quoted, without_null_keys

MAX_BYTES = 8 << 20
LEAST_ROWS = 100_000
_BITS_PER_KEY = 10
_CHUNK = 10  # words of a chunk, as a power of 2
# Four positions of a key: 27 bits each, from both halves of two hashes.
_HALVES = (0, 32)
_MOST_BITS = 27


def key_filter(
    target: DataFrame, source: DataFrame, keys: Sequence[str], rows: int, max_bytes: int = MAX_BYTES
) -> Column | None:
    """A condition on rows of ``target``: true for all whose key is in ``source``, and for a few others.

    ``rows`` is the number of source rows. The filter has ten bits a row but no more than
    ``max_bytes``, whatever the source; it is built by Spark and comes to the tasks with
    the plan. Where it would be too full to reject half of the other rows, or the keys
    have a type whose equal values differ in their bytes, there is none. A null key
    is rejected. The source is read once more and must not change.
    """
    hashed = key_hash(target, source, keys)
    if hashed is None:
        return None
    most = min(_MOST_BITS, int(math.log2(max(max_bytes, 128) * 8)))
    bits = min(max(_CHUNK + 6, math.ceil(math.log2(max(rows, 1) * _BITS_PER_KEY))), most)
    if (1 - math.exp(-4 * rows / 2**bits)) ** 4 > 0.5:
        return None
    words = _words(without_null_keys(source, keys).select(hashed.alias("h")), bits)
    found = _meets(words.scalar(), hashed, bits)
    for key in keys:
        found = found & quoted(key).isNotNull()
    return F.coalesce(found, F.lit(False))


def _positions(hashed: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return [
        F.shiftrightunsigned(h, half).bitwiseAND(mask) for h in (hashed, F.xxhash64(hashed)) for half in _HALVES
    ]


def _bit(position: Column) -> Column:
    inside = position.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), inside)


def _word(position: Column) -> Column:
    return F.shiftrightunsigned(position, 6).cast("int")


def _words(hashes: DataFrame, bits: int) -> DataFrame:
    """One row with an array of longs: the filter. It is put together from chunks."""
    position = hashes.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("p"))
    used = position.select(_word(F.col("p")).alias("w"), _bit(F.col("p")).alias("b"))
    empty = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = used.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    chunks = words.groupBy(F.shiftright("w", _CHUNK).alias("c")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("words"))
    chunks = chunks.select("c", F.transform("words", lambda w: w["b"]).alias("words"))
    whole = chunks.agg(F.sort_array(F.collect_list(F.struct("c", "words"))).alias("chunks"))
    return whole.select(F.flatten(F.transform("chunks", lambda c: c["words"])))


def _meets(words: Column, hashed: Column, bits: int) -> Column:
    found = F.lit(True)
    for position in _positions(hashed, bits):
        found = found & (F.get(words, _word(position)).bitwiseAND(_bit(position)) != 0)
    return found


def change_touched_rows(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    change: Callable[[DataFrame], DataFrame],
    max_bytes: int = MAX_BYTES,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``change`` of the target rows whose key may be in the source, plus all the others.

    ``change`` must leave rows without a source row alone and add the same rows whether
    it sees them or not, as merges and ``delete_insert`` do. The others are read by a
    second scan and go round the join without a shuffle. A source of fewer than
    ``least_rows`` rows gets no filter: Spark broadcasts it, and no target row moves.
    """
    rows = source.count()
    may_match = key_filter(target, source, keys, rows, max_bytes) if rows >= least_rows else None
    if may_match is None:
        return change(target)
    return target.where(~may_match).unionByName(change(target.where(may_match)))
