"""Equi joins that stay balanced when a key of the left side is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

_BUCKET = "__key_bucket"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EXACT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)
_FLOATING = (T.FloatType, T.DoubleType)  # XXH64 gives 0.0 and -0.0 one hash, and all NaN one


def quoted(name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all set; no other row can match in an equi join."""
    present = F.lit(True)
    for key in keys:
        present = present & quoted(key).isNotNull()
    return df.where(present)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The different keys of ``df``, combined before the shuffle, null keys left out."""
    return without_null_keys(df, keys).select(*map(quoted, keys)).distinct()


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key once.

    ``how`` is ``left``, ``left_semi`` or ``left_anti``. Adaptive execution can split a
    hot key of the left side over many tasks, but only where both inputs of the
    join come straight out of a shuffle. An aggregated right side does not: it is
    already partitioned by the keys. Joining on a hash of the keys as well asks
    for another shuffle of that one-row-per-key side and makes the split possible.
    A right side that turns out small is still broadcast by Spark's own size check.
    """
    bucket = key_hash(left, right, keys)
    if bucket is None:
        return left.join(right, list(keys), how)
    joined = left.withColumn(_BUCKET, bucket).join(
        right.withColumn(_BUCKET, bucket), [*keys, _BUCKET], how
    )
    return joined.drop(_BUCKET)


def key_hash(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column | None:
    """A hash of the keys that is equal on both sides for equal keys.

    None where types do not allow one: text under a collation has equal values of
    different bytes.
    """
    parts = []
    for key in keys:
        # Where types differ, both sides are cast to the type that Spark compares them in.
        one, two = left.select(quoted(key)), right.select(quoted(key))
        try:
            common = one.union(two).schema[0].dataType
        except AnalysisException:
            return None
        by_bytes = isinstance(common, T.StringType) and common.collation == "UTF8_BINARY"
        if not by_bytes and not isinstance(common, (*_INTEGRAL, *_EXACT, *_FLOATING, T.DecimalType)):
            return None
        parts.append(quoted(key).cast(common))
    return F.xxhash64(*parts)
