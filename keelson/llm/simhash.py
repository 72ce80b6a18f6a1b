"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import components, picked, quoted, spread_join, stored, texts_as_bytes
from .registry import load, register

BITS = 64
SEED = 42
RADIUS = 2
CROWD = 64  # members of a table entry that are paired directly
LAST = 8  # bits of the narrowest segments


def simhash(hashes: np.ndarray) -> int:
    """Bit i of the result is set if it is set in over half of ``hashes`` (uint64)."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # on bytes: A-Z and ASCII blanks only
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)] if words else []
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: bytes, shingle: int) -> int:
    return simhash(shingle_hashes(text, shingle))  # zero without words


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes as another hash function would give them; unchanged for ``k`` = 0."""
    if k == 0:
        return hashes
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of each text as a bigint; zero for null and blank texts."""

    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle) for t in texts_as_bytes(column)], pa.int64())

    return of(text)


def _ball(width: int, radius: int) -> list[tuple[int, int]]:
    """The words of ``width`` bits with at most ``radius`` bits set, and how many are."""
    flips = ((sum(1 << bit for bit in bits), d) for d in range(radius + 1) for bits in combinations(range(width), d))
    return [(flip - (1 << 64) if flip >= 1 << 63 else flip, d) for flip, d in flips]


def _segment(fp: Column, low: Column, width: int) -> Column:
    shifted = F.call_function("shiftrightunsigned", fp, low)
    return shifted.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _entries(rows: DataFrame, width: int, radius: int, probing: bool) -> DataFrame:
    """The table entries of each row, or those that it probes, by both segments of its open bits.

    A row has ``fp``, ``key``, ``low`` (where its open bits begin; there are twice ``width``)
    and ``left`` (how many of them may differ). Of two words that differ in at most ``left``
    open bits one segment differs in at most half as many. So a row's table entries hold
    its own segments, and it probes the Hamming ball of that radius around each. The
    distance spent there is part of the key.
    """
    halves = F.explode(F.array(F.lit(0), F.lit(1))).alias("h")
    rows = rows.select("k", "fp", "key", "low", "left", F.expr("left div 2").cast("int").alias("most"), halves)
    own = _segment(F.col("fp"), F.col("low") + F.col("h") * width, width)
    if probing:
        balls = F.array(*(
            F.array(*(F.struct(F.lit(f).cast("bigint").alias("flip"), F.lit(d).alias("d")) for f, d in _ball(width, r)))
            for r in range(radius // 2 + 1)
        ))
        rows = rows.select("*", F.inline(F.element_at(balls, F.col("most") + 1)))
        own = own.bitwiseXOR(F.col("flip"))
    else:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("d"))
    place = F.col("low") + F.col("h") * width
    return rows.select(
        "k",
        "fp",
        F.xxhash64("key", place, own, "d").alias("key"),
        (F.col("low") + (1 - F.col("h")) * width).alias("low"),
        (F.col("left") - F.col("d")).alias("left"),
    )


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """All pairs ``a`` > ``b`` of different fingerprints that differ in at most ``radius`` bits.

    ``prints`` has a bigint column ``fp``, and may have an int column ``k``: fingerprints of
    different ``k`` are not compared, and the pairs name theirs. Fingerprints are put into tables by segment
    number and segment value, two segments of 32 bits at first. Each probes the small
    Hamming balls inside its segments, and the complete distance of every match is
    checked. An entry of more than ``crowd`` members would give all pairs of a large group
    of near copies; its members are bucketed on a second segment instead, half of the bits
    that the entry leaves open, and so on until eight bits are open.
    """
    if not 0 <= radius < BITS // 2:
        raise ValueError(f"the radius must be below {BITS // 2}")
    zero = F.lit(0)
    rows = prints.select((F.col("k") if "k" in prints.columns else zero).alias("k"), "fp").where("fp is not null").distinct()
    table = probes = stored(rows.select("k", "fp", F.col("k").cast("bigint").alias("key"), zero.alias("low"), F.lit(radius).alias("left")))
    pairs, width = None, BITS // 2
    while True:
        table, probes = _entries(table, width, radius, False), _entries(probes, width, radius, True)
        crowded = None
        if width > LAST:
            crowded = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
            crowded = stored(crowded)
        cold = table if crowded is None else spread_join(table, crowded, ["key"], "left_anti")
        # Merged, not broadcast: both sides grow with the fingerprints, the probes most.
        met = probes.select("k", "key", F.col("fp").alias("a")).hint("merge").join(cold.select("key", F.col("fp").alias("b")), "key")
        met = met.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        met = stored(met.select("k", "a", "b").distinct())
        pairs = met if pairs is None else pairs.union(met)
        if crowded is None or crowded.isEmpty():
            return pairs.distinct()
        table = stored(spread_join(table, crowded, ["key"], "left_semi"))
        probes = stored(spread_join(probes, crowded, ["key"], "left_semi"))
        width //= 2


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach.
    Documents of one fingerprint are linked. Null and blank texts have fingerprint zero.
    A null id is kept as a row and links others, but names no component unless every id
    of the component is null. Rows that share an id each get a row. Other columns are
    not read. An empty table gives no rows.
    """
    prints = stored(
        picked(docs, doc_id=id_col, text=text_col).select("doc_id", fingerprints(F.col("text"), shingle).alias("fp"))
    )
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(near_fingerprints(prints, radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = stored(firsts.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(rooted, smallest, ["root"], "left").select("fp", "component_id")
    return spread_join(prints, named, ["fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    radius: int = 3,
    prints: int = 4,
    similar: tuple[int, int] = (4, 5),
) -> DataFrame:
    """The rows of ``docs`` by text: ``doc_id``, ``text_key``, ``row_key``, ``component``.

    Texts whose word shingles have a Jaccard similarity of at least ``similar`` belong
    together, directly or by way of others, as far as a fingerprint finds them: one of
    ``prints`` independent SimHashes must differ in at most ``radius`` bits. Every pair so
    found is verified on the shingles. Texts that share all fingerprints are one class,
    and classes that share one are compared with the smallest of them, so that a large
    group gives no pairs of its own.

    ``text_key`` is the XXH64 of the text, ``row_key`` that of the row's other columns; rows
    equal in all three are one row here. Texts without words, null ones too, are one class.
    An empty table gives no rows.
    """

    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        hashes = (shingle_hashes(t, shingle) for t in texts_as_bytes(column))
        return pa.array([[simhash(mixed(h, k)) for k in range(prints)] for h in hashes], pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def shingles(column: pa.Array) -> pa.Array:
        sets = (np.unique(shingle_hashes(t, shingle)).view("<i8") for t in texts_as_bytes(column))
        return pa.array(list(sets), pa.list_(pa.int64()))

    text = quoted(text_col)
    others = [quoted(c) for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        quoted(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        (F.xxhash64(*others) if others else F.lit(0).cast("bigint")).alias("row_key"),
        of(text).alias("fps"),
    )
    rows = stored(rows.withColumn("class", F.xxhash64("fps")).distinct())
    classes = rows.groupBy("class").agg(F.first("fps").alias("fps"), F.min("text_key").alias("text_key"))
    classes = stored(classes)
    split = classes.select("class", F.posexplode("fps").alias("k", "fp"))
    heads = stored(split.groupBy("k", "fp").agg(F.min("class").alias("head"), F.count("*").alias("n")))
    same = split.join(heads.where("n > 1"), ["k", "fp"]).select(F.col("class").alias("x"), F.col("head").alias("y"))
    near = near_fingerprints(heads, radius)
    near = near.join(heads.select("k", F.col("fp").alias("a"), F.col("head").alias("x")), ["k", "a"])
    near = near.join(heads.select("k", F.col("fp").alias("b"), F.col("head").alias("y")), ["k", "b"])
    pairs = same.union(near.select("x", "y")).where("x <> y")
    pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())

    # The shingles of one text of each class that has a partner.
    chosen = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "class")
    asked = classes.join(chosen, "class", "left_semi").select("class", "text_key")
    texts = spread_join(docs.select(F.xxhash64(text).alias("text_key"), text.alias("t")), asked, ["text_key"], "inner")
    sets = texts.groupBy("class").agg(F.min("t").alias("t")).select("class", shingles(F.col("t")).alias("set"))
    sets = stored(sets)
    judged = pairs.join(sets.select(F.col("class").alias("x"), F.col("set").alias("a")), "x")
    judged = judged.join(sets.select(F.col("class").alias("y"), F.col("set").alias("b")), "y")
    both = F.size(F.array_intersect("a", "b"))
    alike = both * similar[1] >= (F.size("a") + F.size("b") - both) * similar[0]
    groups = components(judged.where(alike).select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = stored(groups.withColumnsRenamed({"node": "class", "component": "root"}))
    found = spread_join(rows, groups, ["class"], "left")
    return found.select("doc_id", "text_key", "row_key", F.coalesce("root", "class").alias("component"))


def first_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of ``near_copies`` one row of ``docs``, with all its columns.

    It is the one with the smallest id, nulls last, then the smallest hash of its text and
    of its other columns; of equal rows one stays.
    """
    found = near_copies(docs, id_col, text_col, **options)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "row_key")
    kept = stored(found.groupBy("component").agg(F.min(place).alias("p")).select("p.doc_id", "p.text_key", "p.row_key"))
    others = [quoted(c) for c in docs.columns if c not in (id_col, text_col)]
    row_key = F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    all_keys = F.struct(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_key"), row_key.alias("row_key"))
    marked = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), all_keys.alias("keys"))
    stays = marked.join(kept.select(F.struct("doc_id", "text_key", "row_key").alias("keys")), "keys", "left_semi")
    return stays.dropDuplicates(["keys"]).select("row.*")


@register("op10_simhash_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
