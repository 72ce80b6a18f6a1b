"""Secrets in texts, with weak candidates confirmed by linked parts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import picked, spread_join, stored
from .registry import load, register

# Fixed patterns of the base kinds: what a match is, and for assign its value in group 2.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a shorter run holds no longer match
HEX = r"[0-9a-f]{16,}"
# Weak candidates, each of one role of a credential.
USER = r"""([Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%-]+"
KINDS = ("assign", "access", "hex", "user", "opaque", "endpoint")
SCOPE = 200

_SPAN = "struct<kind:int,start:bigint,end:bigint>"


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches of ``pattern``: start and end in code points.

    The text is split at the matches, so the lengths of pieces and matches add up to
    positions. Matches whose ``value_group`` has fewer than ``least`` characters still use
    up their text, but are left out.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        keep = part["hit"].isNotNull() & (F.length(part["value"]) >= least)
        span = F.struct(F.lit(kind).alias("kind"), begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(parts, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(weak: Column, strong: Column) -> Column:
    """The spans of ``weak`` that overlap none of ``strong``."""
    return F.filter(weak, lambda w: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))


def _named(found: Column) -> Column:
    """``kind:start:end`` of each span, by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``weak`` spans; a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    mixed = F.filter(
        spans(t, OPAQUE, 4),
        lambda s: F.substring(t, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).rlike("[0-9]")
        & F.substring(t, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).rlike("[a-z]")
        & F.substring(t, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).rlike("[A-Z]"),
    )
    base = F.concat(spans(t, ASSIGN, 0, 2, ASSIGN_VALUE), spans(t, ACCESS, 1), spans(t, HEX, 2))
    weak = F.concat(spans(t, USER, 3), mixed, spans(t, ENDPOINT, 5))
    found = docs.withColumn("base", base).withColumn("weak", weak)
    return found.withColumn("weak", _apart(F.col("weak"), F.col("base")))


def _role(kind: str) -> Column:
    """The part of a credential that a span is: identifier, secret or endpoint."""
    return F.when(F.col(kind).isin(1, 3), "identifier").when(F.col(kind) == 5, "endpoint").otherwise("secret")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that are reported: ``text_key`` and their array ``confirmed``.

    ``found`` has ``text_key``, ``base`` and ``weak``. A weak span is reported if a span of
    a complementary role lies within ``scope`` characters of it in the same text: for a
    secret an identifier or an endpoint, for an identifier or an endpoint a secret. This is
    an interval join: both sides are dealt to bins of ``scope`` characters, equal texts
    are joined once, and a bin holds few spans because those of a kind do not overlap.
    """
    once = found.where(F.size("weak") > 0).select("text_key", "base", "weak").dropDuplicates(["text_key"])
    weak = once.select("text_key", F.explode("weak").alias("w")).select(
        "text_key", "w.kind", "w.start", "w.end", (F.lit("secret") == _role("w.kind")).alias("secret")
    )
    parts = once.select("text_key", F.explode(F.concat("base", "weak")).alias("p")).select(
        "text_key", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), (F.lit("secret") == _role("p.kind")).alias("p_secret")
    )

    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("bin")

    near = (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") >= F.col("start") - scope)
    left = weak.select("*", bins(F.col("start") - scope, F.col("end") + scope)).alias("l")
    right = parts.select("*", bins(F.col("p_start"), F.col("p_end"))).withColumnsRenamed({"text_key": "p_key", "bin": "p_bin"})
    met = left.join(
        right, (F.col("text_key") == F.col("p_key")) & (F.col("bin") == F.col("p_bin")) & near & (F.col("secret") != F.col("p_secret")), "left_semi"
    )
    return met.groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("confirmed"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans`` and ``n_linked``, the number of weak spans reported.

    A null text counts as empty; a text without secrets has the hash of the empty string
    and empty ``spans``. Null and repeated ids keep their rows. Equal texts get equal
    results. Extra columns are not read. An empty table gives no rows.
    """
    own = picked(docs, doc_id=id_col, text=text_col)
    found = candidates(own).withColumn("text_key", F.when(F.size("weak") > 0, F.md5(F.col("text").cast("binary"))))
    found = stored(found.select("doc_id", "text_key", "base", "weak"))
    named = spread_join(found, linked(found, scope), ["text_key"], "left")
    extra = F.coalesce("confirmed", F.array().cast(f"array<{_SPAN}>"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return named.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.concat("base", extra)).alias("spans"),
        F.size(extra).cast("bigint").alias("n_linked"),
    )


def _sql_spans(pattern: str, kind: int, least: int = 0) -> str:
    """DuckDB: the matches of a pattern with their positions."""
    p = pattern.replace("'", "''")
    kept = f"WHERE length(regexp_extract(hit, '{p}', 2)) >= {least}" if least else ""
    return f"""
      SELECT doc, {kind} AS kind, start, start + length(hit) AS stop FROM (
        SELECT doc, hit, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(list_resize(hits, len(gaps), NULL)) AS hit
              FROM (SELECT doc, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM texts))
        WINDOW w AS (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      ) {kept + (" AND" if kept else "WHERE")} hit IS NOT NULL"""


OP4_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({_sql_spans(ASSIGN, 0, ASSIGN_VALUE)} UNION ALL {_sql_spans(ACCESS, 1)} UNION ALL {_sql_spans(HEX, 2)}),
weak_all AS MATERIALIZED ({_sql_spans(USER, 3)} UNION ALL {_sql_spans(OPAQUE, 4)} UNION ALL {_sql_spans(ENDPOINT, 5)}),
weak AS (
  SELECT w.* FROM weak_all w JOIN texts USING (doc)
  WHERE (kind <> 4 OR (regexp_matches(substring(t, start::BIGINT + 1, (stop - start)::BIGINT), '[0-9]')
    AND regexp_matches(substring(t, start::BIGINT + 1, (stop - start)::BIGINT), '[a-z]') AND regexp_matches(substring(t, start::BIGINT + 1, (stop - start)::BIGINT), '[A-Z]')))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = w.doc AND b.start < w.stop AND w.start < b.stop)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
confirmed AS (
  SELECT w.* FROM weak w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.doc = w.doc AND p.start <= w.stop + {SCOPE} AND p.stop >= w.start - {SCOPE}
    AND (p.kind IN (0, 2, 4)) <> (w.kind IN (0, 2, 4)))),
told AS (
  SELECT doc, kind, start, kind < 3 AS is_base, ['assign', 'access', 'hex', 'user', 'opaque', 'endpoint'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS name
  FROM (SELECT * FROM base UNION ALL SELECT * FROM confirmed)),
summed AS (
  SELECT doc, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, count(*) FILTER (kind > 2) AS l,
    string_agg(name, ',' ORDER BY start, kind) FILTER (is_base) AS base_names, string_agg(name, ',' ORDER BY start, kind) AS names
  FROM told GROUP BY doc)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base_names, '')) AS base_sha256, coalesce(names, '') AS spans, coalesce(l, 0) AS n_linked
FROM texts LEFT JOIN summed USING (doc)
"""


@register("op4_secret_scan", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"))
