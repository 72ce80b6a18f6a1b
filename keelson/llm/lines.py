"""Line dedup by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, picked, quoted, spread_join, stored
from .registry import load, register

SIMILAR = (4, 5)  # Jaccard at least 4 / 5, kept as whole numbers so that comparisons are exact
SKETCH = 1 << 18  # counters of token rarity: a fixed size, whatever the input
BLANKS = " \t\n\x0b\f\r"
BOUNDS = [(i - 8) << 60 for i in range(1, 16)]  # of the upper 4 bits of signed hashes
BITS = 55  # of a token's hash; 8 bits above them hold the rarity


def token_hashes(line: Column) -> Column:
    """The different tokens of a line, as hashes of 64 bits.

    A text is split faster at one character than by a pattern; the empty pieces go at the end.
    """
    for blank in BLANKS[1:]:
        line = F.replace(line, F.lit(blank), F.lit(" "))
    pieces = F.split(F.coalesce(line, F.lit("")), " ")
    return F.array_remove(F.array_distinct(F.transform(pieces, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SKETCH - 1)).cast("int")


def _dense(values: DataFrame) -> DataFrame:
    """One row, ``listed``: ``value`` by ``slot`` as an array of ``SKETCH`` numbers, 0 where there is none."""
    every = values.sparkSession.range(SKETCH).select(F.col("id").cast("int").alias("slot")).join(values, "slot", "left")
    pairs = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("value", F.lit(0).cast("bigint")).alias("value")))).alias("a"))
    return pairs.select(F.col("a.value").alias("listed"))


def _rarity(lines: DataFrame) -> DataFrame:
    """One row, ``listed``: how many lines' tokens fall on each of ``SKETCH`` counters, as
    eighths of a power of two in the bits above those of a hash.

    A token is as frequent as its counter says, or rarer. The join is right for any order
    of tokens; the order only decides how many candidates there are.
    """
    # The outer generators of this module keep Spark from adding a filter on the size of
    # the array, which would compute the array once more.
    tokens = lines.select(F.explode_outer("tokens").alias("token"))
    counted = tokens.groupBy(_slot(F.col("token")).alias("slot")).agg(F.count("*").alias("n"))
    step = F.least(F.floor(F.log2(F.col("n").cast("double")) * 8), F.lit(255).cast("bigint"))
    return _dense(counted.select("slot", F.shiftleft(step, BITS).alias("value")))


def _marks(ids: DataFrame) -> DataFrame:
    """One row, ``listed``: a Bloom filter of the column ``id``, ``SKETCH`` words of 64 bits."""
    h = F.xxhash64("id")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58).cast("int"))
    return _dense(ids.groupBy(_slot(h).alias("slot")).agg(F.bit_or(bit).alias("value")))


def _marked(ids: DataFrame) -> Column:
    """Whether the row's ``id`` may be among ``ids``; true for all that are."""
    h = F.xxhash64("id")
    word = F.get(_marks(ids).scalar(), _slot(h))
    return F.call_function("shiftrightunsigned", word, F.shiftrightunsigned(h, 58).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _merged(hashes: Column) -> Column:
    """The hashes in order, with the 15 bounds between the bins of ``_histogram`` among them."""
    return F.sort_array(F.concat(hashes, F.array(*(F.lit(b).cast("bigint") for b in BOUNDS))))


def _histogram(merged: Column) -> Column:
    """Tokens by the upper 4 bits of their hash: 16 counts up to 15, packed into a bigint.

    The places of the bounds tell the counts. ``merged`` is a column, read for each of them.
    """
    below = [F.lit(0), *(F.array_position(merged, F.lit(bound).cast("bigint")) - i for i, bound in enumerate(BOUNDS, 1)), F.size(merged) - len(BOUNDS)]
    packed = F.lit(0).cast("bigint")
    for i in range(16):
        count = F.least(below[i + 1] - below[i], F.lit(15)).cast("bigint")
        packed = packed.bitwiseOR(F.shiftleft(count, 4 * i))
    return packed


def _apart(a: Column, b: Column) -> Column:
    """The sum of the differences of two histograms: at most the tokens that only one line has.

    Every other count is put into a byte of its own, so that eight are subtracted at once.
    """
    every = lambda byte: F.lit(int.from_bytes(bytes([byte]) * 8)).cast("bigint")

    def differences(a: Column, b: Column) -> Column:
        raised = a.bitwiseOR(every(16)) - b
        negative = F.shiftrightunsigned(raised, 4).bitwiseAND(every(1)).bitwiseXOR(every(1))
        return raised.bitwiseXOR(negative * 15).bitwiseAND(every(15)) + negative

    even = differences(a.bitwiseAND(every(15)), b.bitwiseAND(every(15)))
    odd = differences(*(F.shiftrightunsigned(c, 4).bitwiseAND(every(15)) for c in (a, b)))
    return (even + odd) % 255  # the sum of the bytes, at most 240


def _possible(similar: tuple[int, int], n: Column, pos: Column, histogram: Column, m: Column, m_pos: Column, m_histogram: Column) -> Column:
    """Length, positional and histogram filters; no pair of lines that is similar fails
    them at the first token that the prefixes share."""
    p, q = similar
    overlap = 1 + F.least(n - pos, m - m_pos)
    return (
        (F.least(n, m) * q >= F.greatest(n, m) * p)
        & (overlap * (p + q) >= (n + m) * p)
        & (_apart(histogram, m_histogram) * (p + q) <= (n + m) * (q - p))
    )


def _verified(pairs: DataFrame, tokens: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The ids ``x`` of those pairs ``x``, ``y`` whose token sets are similar."""
    p, q = similar
    with_x = pairs.join(tokens.withColumnsRenamed({"id": "x", "tokens": "x_tokens"}), "x")
    both = with_x.join(tokens.withColumnsRenamed({"id": "y", "tokens": "y_tokens"}), "y")
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return both.where(common * (p + q) >= (F.size("x_tokens") + F.size("y_tokens")) * p).select("x").distinct()


def repeated_lines(lines: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The ids of the different lines that are similar to an earlier one: column ``x``.

    ``lines`` has ``id``, ``tokens`` (its ``token_hashes``) and ``place``, the order of its
    first occurrence.
    Tokens are ordered by rarity. Two lines of n tokens with Jaccard p/q share a token
    among the first n - ceil(n p / q) + 1 of each, so these prefixes are the join key.
    First a semi-join, which stops at a line's first possible partner, finds the few
    lines that have one; a Bloom filter of them keeps most others out of the shuffle. Among
    those, each line is verified against the earliest line of each of its prefix tokens;
    this settles the members of large groups of near copies. Those without a match there,
    but with an earlier line at some token, are verified against all others. So pairs
    within a group are not written out, and none is left unchecked.
    """
    p, q = similar
    # The generator keeps the hashes in order apart from the counts. So the counts, used once,
    # are put in place as one value per task, and not written into each row as a column.
    measured = lines.where("id is not null").select("id", "tokens", F.explode(F.array(_merged(F.col("tokens")))).alias("merged"))
    measured = measured.select("id", "tokens", "merged", _rarity(lines).scalar().alias("counts"))
    # Without nulls, Spark sorts the plain numbers.
    rarity = lambda h: F.coalesce(F.get("counts", _slot(h)), F.lit(0).cast("bigint"))
    by_rarity = F.sort_array(F.transform("tokens", lambda h: rarity(h).bitwiseOR(F.shiftrightunsigned(h, 64 - BITS))))
    prefix = F.slice(by_rarity, 1, F.expr(f"size(tokens) - (size(tokens) * {p} + {q - 1}) div {q} + 1").cast("int"))
    entries = measured.select("id", F.size("tokens").alias("n"), _histogram(F.col("merged")).alias("histogram"), prefix.alias("prefix"))
    entries = entries.select("id", "n", "histogram", F.posexplode_outer("prefix").alias("pos", "token"))
    entries = entries.where("token is not null").select("token", "id", "n", (F.col("pos") + 1).alias("pos"), "histogram")

    def pair(left: str, right: str) -> Column:
        return _possible(similar, *(F.col(f"{side}.{c}") for side in (left, right) for c in ("n", "pos", "histogram")))

    a, b = entries.alias("a"), entries.alias("b")  # the same rows twice, shuffled once
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") != F.col("b.id")) & pair("a", "b"), "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    near = stored(met.groupBy("id").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram"), listed.alias("shared")))
    known = stored(lines.where(_marked(near)).select("id", "place", "tokens").join(near, "id"))
    tokens = known.select("id", "tokens")
    near = known.select("id", "place", "n", "histogram", F.col("shared.token").alias("shared"), F.explode("shared").alias("e"))
    near = near.select("id", "place", "n", "histogram", "shared", "e.pos", "e.token")

    heads = near.where("place is not null").groupBy("token").agg(F.min(F.struct("place", "id", "n", "pos", "histogram")).alias("h")).select("token", F.col("h.id").alias("y"), F.struct("h.*").alias("b"))
    own = near.select("token", F.col("id").alias("x"), F.struct("place", "n", "pos", "histogram").alias("a"))
    earlier = F.col("b.place") < F.col("a.place")
    first = spread_join(own, heads, ["token"], "inner").where(earlier).groupBy("x", "y").agg(F.max(pair("a", "b")).alias("possible"))
    first = stored(first)
    settled = stored(_verified(first.where("possible").select("x", "y"), tokens, similar))
    # A line that comes first for each of its tokens has no earlier partner.
    late = first.select("x").distinct().join(settled, "x", "left_anti")
    # Two lines share several tokens; only the first of them makes the pair.
    listed = near.select("token", "id", F.struct("place", "n", "pos", "histogram", "shared").alias("a"))
    rest = spread_join(listed.withColumnRenamed("id", "x"), late, ["x"], "left_semi")
    others = listed.select(F.col("token").alias("t"), F.col("id").alias("y"), F.col("a").alias("b"))
    once = F.array_intersect("a.shared", "b.shared")[0] == F.col("token")
    late = rest.join(others, (F.col("token") == F.col("t")) & earlier & pair("a", "b") & once).select("x", "y").distinct()
    return settled.union(_verified(late, tokens, similar))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and the columns ``n_lines``
    and ``n_removed`` (put after the others; a clashing column of ``docs`` is an error).

    Lines end at a line feed; their tokens are the different words, case and all. A line
    goes if an earlier line of the input, by document id and then line number, has a
    Jaccard similarity of at least ``similar``, whether or not that line goes itself.
    Lines without a word stay. A null text stays null and has no lines. Lines of a null
    id are neither earlier nor later than others and stay. Rows that share an id are told
    apart by their text; their lines of equal number are not earlier than one another.
    """
    clash = {c.lower() for c in docs.columns} & {"n_lines", "n_removed"}
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    own = picked(docs, doc_id=id_col, text=text_col)
    own = own.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("at").cast("decimal(10,0)")
    own = own.where(F.ltrim("line", F.lit(BLANKS)) != "").withColumn("place", place.cast("decimal(38,0)"))
    h, g = F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")
    lines = own.groupBy("line").agg(F.min("place").alias("place"), (F.count("*") > 1).alias("copied"))
    lines = lines.select(token_hashes(F.col("line")).alias("tokens"), "place", "copied", h, g, F.monotonically_increasing_id().alias("id"))
    lines = stored(lines, **{"parquet.dictionary.page.size": str(32 << 20)})  # hashes of words repeat: a quarter of the size

    gone = repeated_lines(lines, similar).select(F.col("x").alias("id"), F.lit(True).alias("gone"))
    marked = lines.select("id", "h", "g", F.col("place").alias("first"), "copied").join(gone, "id", "left")
    marked = stored(marked.where(F.col("copied") | F.col("gone")).select("h", "g", "first", "gone"))
    seen = own.select("doc_id", "text_key", "at", "place", h, g)
    out = spread_join(seen, marked, ["h", "g"], "inner").where((F.col("place") > F.col("first")) | (F.col("gone") & F.col("doc_id").isNotNull()))
    out = out.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("__gone"))
    keyed = docs.withColumn("__id", quoted(id_col)).withColumn("__key", F.xxhash64(quoted(text_col)))
    joined = keyed.join(out.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}), ["__id", "__key"], "left")
    split = F.split(quoted(text_col), "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), quoted(text_col)).otherwise(kept)
    counted = joined.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)).cast("bigint"))
    counted = counted.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"))
    return counted.withColumn(text_col, text).select(*map(quoted, docs.columns), "n_lines", "n_removed")


OP3_SQL = rf"""
WITH lines AS (
  SELECT row, doc_id, ln, line, list_distinct(regexp_extract_all(line, '{WORD}')) AS words
  FROM (SELECT row, doc_id, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line
        FROM (SELECT row_number() OVER () AS row, doc_id, string_split(text, chr(10)) AS ls FROM documents))),
sets AS (SELECT row_number() OVER () AS id, list_sort(words) AS s, min(struct_pack(d := doc_id, a := ln)) AS place
         FROM lines WHERE len(words) > 0 GROUP BY list_sort(words)),
tokens AS (SELECT id, len(s) AS n, unnest(s) AS token FROM sets),
ranked AS (
  SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY f, token) AS pos
  FROM (SELECT *, count(*) OVER (PARTITION BY token) AS f FROM tokens)),
prefixes AS (SELECT id, n, token FROM ranked WHERE pos <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefixes a JOIN prefixes b USING (token)
  WHERE a.id <> b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
alike AS (
  SELECT x, min(b.place) AS first FROM pairs JOIN sets a ON a.id = x JOIN sets b ON b.id = y
  WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (len(a.s) + len(b.s)) GROUP BY x),
firsts AS (SELECT s, CASE WHEN first < place THEN first ELSE place END AS first FROM sets LEFT JOIN alike ON x = id),
judged AS (
  SELECT l.row, ln, line, coalesce(f.first < struct_pack(d := doc_id, a := ln), FALSE) AS gone
  FROM lines l LEFT JOIN firsts f ON f.s = list_sort(l.words) AND len(l.words) > 0),
kept AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY row)
SELECT d.doc_id, n_lines, n_removed, sha256(k.text) AS kept_sha256
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d JOIN kept k USING (row)
"""


@register("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
