"""A corpus pipeline: classify, drop repeated lines and near copies, decontaminate, mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
it kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.llm.common import quoted, stored
from keelson.llm.decontamination import with_leaks
from keelson.llm.lines import drop_repeated_lines
from keelson.llm.mixing import mix
from keelson.llm.quality import learn, scored
from keelson.llm.registry import load
from keelson.llm.simhash import first_of_copies

QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``QUALITY``; the labels are those of the tables.

    It learns from all labels, those of held-out documents too. Null and empty texts have
    a score as well; equal texts have equal ones. Rows that share an id are judged apart.
    """
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    ranking = learn(docs.select("doc_id", "text"), labels, at_cut=QUALITY)
    return docs.where(scored(F.col("text"), ranking) >= QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; ``n_chars`` follows the text.

    Null texts stay null, with a null ``n_chars``; rows of a null id keep their lines, and
    of rows that share an id no line is earlier than the other's. ``docs`` must have no
    columns ``n_lines`` and ``n_removed``, nor ``__id``, ``__key`` and ``__gone``.
    """
    kept = drop_repeated_lines(docs).select(*map(quoted, docs.columns))
    return kept.withColumn("n_chars", F.length("text").cast("bigint"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: the smallest id, nulls last, then the smallest hash.

    Near copies share four fifths of their five-word shingles. All texts without words,
    null ones too, are one group; of equal rows one stays. Four fingerprints find nearly
    all pairs of a similarity of 0.95 and ever fewer below it.
    """
    return first_of_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; null and blank texts hold none.

    Rows are judged apart, whatever their ids. ``docs`` must have no column ``__leaks``.
    """
    found = with_leaks(docs, load(spark, sf_dir, "benchmark"), name="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when.

    Null texts have size 0 and take nothing, a null source is one of its own, null ids come
    last in it, and rows equal in id and size are interchangeable.
    """
    return mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

# The stages hold learned scores, XXH64 and a latent space, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is stored before the next stage reads it."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
