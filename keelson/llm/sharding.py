"""Sharding: groups of equal texts cut into contiguous shards of the least largest size.

Groups are put in order: first those larger than an even share, each of which fills a
shard of its own, then the others by the hash of their text. A binary search finds the
smallest capacity for which filling shard after shard greedily needs no more shards than
there are, and the cuts are made there. The driver sees no group: it knows the running
size at the ends of hash ranges, works with what these leave open as an interval, and
asks for finer ranges only where the interval matters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import picked, spread_join, stored
from .registry import load, register

SHARDS = 40
OVERHEAD = 16
BUCKET_ROWS = 16_384
ZOOM = 2  # hash digits by which a range is split


class Ends:
    """Running sizes at the ends of hash ranges; a range of one group is closed.

    ``floor`` and ``ceil`` find the nearest end of a group at or below, and at or above, a
    running size. Inside an open range the answer is only known to lie between two
    values, which both give.
    """

    def __init__(self, prefixes: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ends, kind="stable")
        self.prefixes, self.ends, self.open = prefixes[order], ends[order].astype(np.int64), counts[order] > 1
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def floor(self, x: int, high: bool) -> int:
        j = int(np.searchsorted(self.ends, x, side="right"))  # ranges wholly at or below x
        if high and j < len(self.ends) and self.open[j]:
            return min(x, int(self.ends[j]) - 1)
        return int(self.ends[j - 1]) if j else 0

    def ceil(self, x: int, high: bool) -> int:
        if x <= 0:
            return 0
        j = int(np.searchsorted(self.ends, x, side="left"))
        if not high and self.open[j]:
            return x
        return int(self.ends[j])

    def fits(self, capacity: int, shards: int, high: bool) -> bool:
        """Whether greedy filling needs no more than ``shards``."""
        at = 0
        for _ in range(shards):
            at = self.floor(at + capacity, high)
            if at >= self.total:
                return True
        return False

    def capacity(self, shards: int, high: bool) -> int:
        """The smallest capacity that fits, by binary search."""
        low, top = -(-self.total // shards), self.total
        while low < top:
            middle = (low + top) // 2
            low, top = (low, middle) if self.fits(middle, shards, high) else (middle + 1, top)
        return low

    def cuts(self, capacity: int, shards: int, high: bool) -> list[int]:
        """Ends of the shards, none above ``capacity``.

        Greedy filling would leave what remains to the last shards. A cut is therefore
        drawn back to the even share as far as the shards after it can still take the
        rest: ``least`` holds how far a shard must reach for that.
        """
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.ceil(least[-1] - capacity, high))
        least.reverse()
        made, at = [], 0
        for k in range(1, shards):
            even = self.floor(self.total * k // shards, high)
            at = max(min(self.floor(at + capacity, high), max(least[k - 1], even)), at)
            made.append(at)
        return made + [self.total]

    def between(self, low: int, high: int) -> range:
        """The places of the ranges that hold running sizes from ``low`` to ``high``."""
        first = int(np.searchsorted(self.ends, low, side="left"))
        last = int(np.searchsorted(self.ends, high, side="left"))
        return range(first, min(last + 1, len(self.ends)))


def minimax_cuts(ends: Ends, shards: int, refine: Callable[[list[str]], tuple]) -> list[int]:
    """The running sizes at which to cut, exact; ``refine`` splits ranges into finer ones.

    The capacity is bounded from both sides by reading open ranges in either way. Ranges
    in which a cut may fall are refined until both ways agree; their number depends on
    the number of shards, not on that of groups.
    """
    while True:
        low, high = ends.capacity(shards, True), ends.capacity(shards, False)
        wanted: set[int] = set()
        least, most = _reach(ends, low, shards, False), _reach(ends, high, shards, True)
        for a, b in zip(least, most):
            wanted.update(ends.between(a, b))
        if low == high:
            one, two = ends.cuts(low, shards, False), ends.cuts(low, shards, True)
            if one == two:
                return one
            for a, b in zip(one, two):
                wanted.update(ends.between(min(a, b), max(a, b)))
            for k in range(1, shards):
                even = ends.total * k // shards
                wanted.update(ends.between(even, even))
            back_low, back_high = ends.total, ends.total
            for _ in range(shards - 1):
                back_low, back_high = ends.ceil(back_low - low, False), ends.ceil(back_high - low, True)
                wanted.update(ends.between(max(back_low, 0), max(back_high, 0)))
        split = [i for i in wanted if ends.open[i]]
        kept = np.ones(len(ends.ends), dtype=bool)
        kept[split] = False
        prefixes, values, counts = refine([str(ends.prefixes[i]) for i in split])
        ends = Ends(
            np.concatenate([ends.prefixes[kept], prefixes]),
            np.concatenate([ends.ends[kept], values]),
            np.concatenate([np.where(ends.open[kept], 2, 1), counts]),
        )


def _reach(ends: Ends, capacity: int, shards: int, high: bool) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = ends.floor(at + capacity, high)
        out.append(at)
    return out


def _own_shards(largest: list[tuple[str, int]], total: int, shards: int) -> list[str]:
    """Keys of the groups that exceed an even share of what larger ones leave."""
    own = []
    for key, size in largest:
        left = shards - len(own)
        if left < 2 or size * left <= total:
            break
        own.append(key)
        total -= size
    return own


def _running(rows: DataFrame, within: list[str], bucket: str, order: list[str], size: str, name: str) -> DataFrame:
    """``rows`` with the running sum of ``size`` in ``order``, whose first digits are ``bucket``.

    Buckets are summed first and only their sums are put in one row of order, so that no
    task holds more than a bucket's rows or the list of buckets.
    """
    sums = rows.groupBy(*within, bucket).agg(F.sum(size).alias("__of"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__of").over(before), F.lit(0))).drop("__of")
    inside = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.join(sums, [*within, bucket])
    return summed.withColumn(name, (F.sum(size).over(inside) + F.col("__before")).cast("bigint")).drop("__before")


def _digits(rows: int, bucket_rows: int) -> int:
    """Hash digits that leave between one and sixteen times ``bucket_rows`` rows in a bucket, two at least."""
    return max(2, math.floor(math.log(max(rows, 1) / bucket_rows, 16)))


def text_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    id: str = "doc_id",
    text: str = "text",
    overhead: int = OVERHEAD,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """A shard and a place in it for every row of ``docs``.

    Columns: ``id``, ``size`` (UTF-8 bytes and ``overhead``), ``text_crc32``, ``shard``
    from 0 and ``slot``, gapless from 0 in each shard. Rows of equal text share a shard;
    a null text counts as empty. The largest shard is as small as the order of groups
    allows. Slots follow a hash of id and text, so a shard comes shuffled, but always in
    the same way; repeated rows and null ids each get a slot. Shards stay empty only
    where there are fewer groups than shards or large groups leave too few for the rest.
    No rows give no rows. Groups come together only as sums, and a group that holds many
    rows is split over tasks.
    """
    if shards < 1:
        raise ValueError("needs at least one shard")
    content = F.coalesce(F.col("t").cast("string"), F.lit(""))
    rows = stored(
        picked(docs, i=id, t=text).select(
            "i",
            F.sha2(content, 256).alias("key"),
            (F.octet_length(content).cast("bigint") + overhead).alias("size"),
            F.crc32(content).alias("crc"),
        )
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    of_all = groups.agg(F.count("*").alias("groups"), F.sum("size").alias("size"), F.sum("n").alias("rows")).first()
    largest = groups.orderBy(F.desc("size"), "key").limit(shards).select("key", "size").collect()
    own = _own_shards([tuple(r) for r in largest], int(of_all["size"] or 0), shards)

    digits = _digits(of_all["groups"], bucket_rows)
    rest = groups.where(~F.col("key").isin(own)) if own else groups
    rest = rest.withColumn("bucket", F.substring("key", 1, digits))
    rest = stored(_running(rest, [], "bucket", ["key"], "size", "upto").select("key", "upto"))

    def ranges(prefixes: list[str] | None, length: int) -> tuple:
        inside = rest if prefixes is None else rest.where(F.substring("key", 1, length - ZOOM).isin(prefixes))
        found = inside.groupBy(F.substring("key", 1, length).alias("p")).agg(F.max("upto").alias("e"), F.count("*").alias("c"))
        found = found.toPandas()
        return found["p"].to_numpy(dtype=object), found["e"].to_numpy(dtype=np.int64), found["c"].to_numpy(dtype=np.int64)

    def refine(prefixes: list[str]) -> tuple:
        by_length: dict[int, list[str]] = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        parts = [ranges(of, length + ZOOM) for length, of in by_length.items()]
        return tuple(np.concatenate(c) for c in zip(*parts))

    cuts = minimax_cuts(Ends(*ranges(None, digits)), shards - len(own), refine)
    place = sum(((F.col("upto") > cut).cast("int") for cut in cuts[:-1]), F.lit(len(own)))
    of_group = rest.select("key", place.cast("int").alias("shard"))
    if own:
        numbers = F.array(*map(F.lit, own))
        of_group = of_group.union(
            groups.where(F.col("key").isin(own)).select("key", (F.array_position(numbers, F.col("key")) - 1).cast("int"))
        )
    dealt = spread_join(rows, of_group, ["key"], "left")
    return _slotted(dealt, _digits(of_all["rows"] or 0, bucket_rows * shards), id)


def _slotted(dealt: DataFrame, digits: int, id: str) -> DataFrame:
    """Number the rows of every shard; equal rows are counted, numbered once and spread again."""
    turn = F.sha2(F.concat_ws(":", F.coalesce(F.col("i").cast("string"), F.lit("")), F.col("key")), 256)
    rows = dealt.withColumn("turn", turn).withColumn("bucket", F.substring("turn", 1, digits))
    rows = rows.groupBy("shard", "bucket", "turn", "i", "size", "crc").agg(F.count("*").alias("n"))
    rows = _running(stored(rows), ["shard"], "bucket", ["turn", "i"], "n", "upto")
    return rows.select(
        F.col("i").alias(id),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("slot"),
    )


_SQL = r"""
WITH RECURSIVE crc_table AS (
  -- the table of CRC-32 by its rule
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text, sha256(coalesce(text, '')) AS key FROM documents
), sums AS (
  SELECT key, strlen(text) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, crc_table
), numbered AS (
  SELECT d.doc_id, s.key, s.size, s.text_crc32, sha256(concat(d.doc_id, ':', s.key)) AS turn
  FROM documents d JOIN sums s ON s.key = sha256(coalesce(d.text, ''))
), groups AS (
  SELECT key, sum(size)::BIGINT AS size FROM numbered GROUP BY key
), by_size AS (
  SELECT key, size, row_number() OVER big AS r, sum(size) OVER () - sum(size) OVER big + size AS remains
  FROM groups WINDOW big AS (ORDER BY size DESC, key)
), own AS (
  -- groups above an even share of what larger ones leave
  SELECT key, (r - 1)::INT AS shard FROM by_size
  WHERE r < (SELECT coalesce(min(r), 40) FROM by_size WHERE r >= 40 OR size * (41 - r) <= remains)
), rest AS (
  SELECT key, (sum(size) OVER (ORDER BY key))::BIGINT AS upto FROM groups WHERE key NOT IN (SELECT key FROM own)
), ends AS (
  SELECT 0::BIGINT AS e UNION ALL SELECT upto FROM rest
), whole AS (
  SELECT max(e) AS total, 40 - (SELECT count(*) FROM own) AS shards FROM ends
), search(low, top, k, pos) AS (
  SELECT ((total + shards - 1) // shards)::BIGINT, total::BIGINT, 0::BIGINT, 0::BIGINT FROM whole
  UNION ALL
  SELECT CASE WHEN next < total AND k + 1 >= shards THEN middle + 1 ELSE low END,
         CASE WHEN next >= total THEN middle ELSE top END,
         CASE WHEN next >= total OR k + 1 >= shards THEN 0 ELSE k + 1 END,
         CASE WHEN next >= total OR k + 1 >= shards THEN 0 ELSE next END
  FROM (
    SELECT s.low, s.top, s.k, (s.low + s.top) // 2 AS middle, max(e.e) AS next
    FROM search s JOIN ends e ON e.e <= s.pos + (s.low + s.top) // 2
    WHERE s.low < s.top GROUP BY ALL
  ), whole
), best AS (
  SELECT min(low) AS capacity FROM search WHERE low >= top
), needed(k, pos) AS (
  SELECT shards, total::BIGINT FROM whole
  UNION ALL
  SELECT l.k - 1, min(e.e) FROM needed l, best b JOIN ends e ON e.e >= l.pos - b.capacity WHERE l.k > 1 GROUP BY l.k
), even AS (
  SELECT l.k, l.pos AS least, max(e.e) AS even
  FROM needed l, whole w JOIN ends e ON e.e <= w.total * l.k // w.shards GROUP BY ALL
), cuts(k, pos) AS (
  SELECT 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT k, greatest(pos, least(reach, greatest(least, even)))
  FROM (
    SELECT v.k, c.pos, v.least, v.even, max(e.e) AS reach
    FROM cuts c JOIN even v ON v.k = c.k + 1, best b, ends e
    WHERE e.e <= c.pos + b.capacity GROUP BY ALL
  ), whole WHERE k < shards
), placed AS (
  SELECT key, shard FROM own
  UNION ALL
  SELECT r.key, ((SELECT count(*) FROM own) + (SELECT count(*) FROM cuts c WHERE c.k > 0 AND c.pos < r.upto))::INT FROM rest r
)
SELECT n.doc_id, n.size::BIGINT AS size, n.text_crc32::BIGINT AS text_crc32, 'bytes' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY n.turn, n.doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM numbered n JOIN placed p ON p.key = n.key
"""


@register("op11_sharding", _SQL)
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of nearly equal sizes."""
    return text_shards(load(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
