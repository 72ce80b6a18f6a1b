"""CSV and JSON files whose form is found from the first lines of each file.

Only the heads of files come to the driver: a bounded number of lines of each, read
by jobs that stop there; of JSON files one job tells the form of each. The files themselves are then read by Spark's own readers,
all files of one form together, and the results are put into one schema.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.schemas import as_schema, union_frames, union_schemas

HEAD_LINES = 200
LONGEST_LINE = 1 << 16
# The marks that are tried, the likelier ones first.
DELIMITERS = (",", "|", ";", "\t")
QUOTES = ('"', "'", "")
_READERS = 8

_TYPES = (
    (T.LongType(), re.compile(r"[+-]?\d{1,18}")),
    (T.DoubleType(), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")),
    (T.BooleanType(), re.compile(r"true|false", re.IGNORECASE)),
    (T.DateType(), re.compile(r"\d{4}-\d{2}-\d{2}")),
    (T.TimestampNTZType(), re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?")),
)


@dataclass(frozen=True)
class Dialect:
    """How a CSV file is written. Without a header columns are ``column0``, ``column1`` and so on."""

    delimiter: str
    quote: str
    header: bool
    names: tuple[str, ...]
    multi_line: bool = False

    def options(self) -> dict:
        return {
            "sep": self.delimiter,
            "quote": self.quote,
            "escape": self.quote or "\\",
            "header": self.header,
            "multiLine": self.multi_line,
            "mode": "FAILFAST",
        }


def list_files(spark: SparkSession, location: str, pattern: str) -> list[str]:
    """The paths of files that are not empty; a location ending in ``/`` is a folder."""
    reader = spark.read.format("binaryFile")
    if location.endswith("/"):
        found = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(location)
    else:
        found = reader.load(location)
    return sorted(r.path for r in found.where("length > 0").select("path").collect())


def file_heads(spark: SparkSession, paths: Sequence[str], lines: int) -> list[list[str]]:
    """The first lines of every file. A job per file stops after them, several run at a time."""

    def head(path: str) -> list[str]:
        rows = spark.read.text(path).select(F.substring("value", 1, LONGEST_LINE)).limit(lines).collect()
        return [r[0] for r in rows]

    with ThreadPoolExecutor(_READERS) as pool:
        return list(pool.map(head, paths))


def _type_of(cell: str) -> T.DataType:
    if cell == "":
        return T.NullType()
    for data_type, form in _TYPES:
        if form.fullmatch(cell):
            return data_type
    return T.StringType()


def _common(one: T.DataType, other: T.DataType) -> T.DataType:
    """The type of a column that holds cells of both types; text where none but text does."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    pair = {type(one), type(other)}
    if pair == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def _left_quotes(rows: list[list[str]]) -> int:
    """Cells that still begin with a quotation mark: signs of a wrong one, or of a wrong delimiter."""
    return sum(c[0] in "\"'" for row in rows for c in row if c)


def sniff_csv(lines: Sequence[str], more: bool = False) -> tuple[Dialect, list[T.DataType]]:
    """The dialect and column types that the first lines of a file show.

    Of the delimiters and quotes under which all records have the same number of cells,
    more than one, win those that leave the fewest quotation marks at the start of cells,
    then those with the most cells. The
    first record is a header if its cells are different texts that are no numbers, dates
    or truth values. ``more`` says that the file goes on, so the last record may be cut.
    """
    best, kept = None, None
    for d, delimiter in enumerate(DELIMITERS):
        for q, quote in enumerate(QUOTES):
            rules = {"quotechar": quote, "doublequote": True} if quote else {"quoting": csv.QUOTE_NONE}
            try:
                rows = list(csv.reader([line + "\n" for line in lines], delimiter=delimiter, strict=False, **rules))
            except csv.Error:
                continue
            rows = [r for r in rows if r]
            multi_line = bool(quote) and any("\n" in c for r in rows for c in r)
            if more and len(rows) > 1:
                rows = rows[:-1]
            widths = {len(r) for r in rows}
            if len(widths) != 1:
                continue
            width = widths.pop()
            rank = (width == 1, _left_quotes(rows), -width, multi_line, d, q)
            if best is None or rank < best:
                best, kept = rank, (delimiter, quote, rows, multi_line)
    if kept is None:
        raise ValueError("the lines fit none of the known CSV forms")
    delimiter, quote, rows, multi_line = kept
    first = rows[0]
    header = len(set(first)) == len(first) and all(isinstance(_type_of(c), T.StringType) for c in first)
    types: list[T.DataType] = [T.NullType()] * len(first)
    for row in rows[1:] if header else rows:
        types = [_common(t, _type_of(c)) for t, c in zip(types, row)]
    names = tuple(first) if header else tuple(f"column{i}" for i in range(len(first)))
    return Dialect(delimiter, quote, header, names, multi_line), types


def read_csv_detected(
    spark: SparkSession, location: str, pattern: str = "*.csv", head_lines: int = HEAD_LINES
) -> DataFrame:
    """CSV files, each in its own dialect, in one frame: columns by name, absent ones null.

    Types are those of the first lines of all files, so no file is read twice; a cell
    further on that does not fit is an error, for which a schema can be given to the plain
    reader. A column without a value in the heads is text. Cells in the heads that no
    common type holds make it text. Empty cells are null.
    """
    paths = list_files(spark, location, pattern)
    if not paths:
        raise ValueError(f"no {pattern} files with contents at {location}")
    forms: dict[Dialect, list[str]] = {}
    types: dict[str, T.DataType] = {}
    for path, lines in zip(paths, file_heads(spark, paths, head_lines)):
        dialect, found = sniff_csv(lines, more=len(lines) == head_lines)
        forms.setdefault(dialect, []).append(path)
        for name, data_type in zip(dialect.names, found):
            types[name] = _common(types.get(name, T.NullType()), data_type)
    settled = {n: T.StringType() if isinstance(t, T.NullType) else t for n, t in types.items()}
    frames = [
        spark.read.options(**dialect.options())
        .schema(T.StructType([T.StructField(n, settled[n]) for n in dialect.names]))
        .csv(files)
        for dialect, files in forms.items()
    ]
    return union_frames(*frames)


def json_forms(spark: SparkSession, paths: Sequence[str]) -> dict[bool, list[str]]:
    """Files with an object on every line (False), and files that are one value (True).

    A file is of the first kind if its first line that is not blank is a whole object. One
    job settles it for all files, however many: each split tells the number of its first
    such line and of its first whole object, and the first split with such a line decides.
    """
    numbered = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )
    is_object = (F.substring(F.ltrim("value"), 1, 1) == "{") & F.try_parse_json("value").isNotNull()
    splits = numbered.groupBy("path", "start").agg(
        F.min(F.when(F.trim("value") != "", F.col("n"))).alias("line"), F.min(F.when(is_object, F.col("n"))).alias("object")
    )
    decided = F.min_by(F.coalesce(F.col("line") == F.col("object"), F.lit(False)), "start")
    lined = {r.path: r.lined for r in splits.where("line is not null").groupBy("path").agg(decided.alias("lined")).collect()}
    forms: dict[bool, list[str]] = {}
    for path in paths:
        forms.setdefault(not lined.get(path, True), []).append(path)
    return forms


def read_json_detected(
    spark: SparkSession, location: str, pattern: str = "*.json", schema: T.StructType | str | None = None
) -> DataFrame:
    """JSON files with an object a line, or one array or object a file, in one frame.

    Without a schema Spark finds the types in a pass over the files; members and columns
    that some files lack are null, nested ones too, and where types differ beyond widening
    the column is text. A file that is one value is read by one task.
    """
    paths = list_files(spark, location, pattern)
    if not paths:
        raise ValueError(f"no {pattern} files with contents at {location}")
    forms = json_forms(spark, paths)
    read = {whole: spark.read.options(multiLine=whole, mode="FAILFAST") for whole in forms}
    if schema is None:
        found = [read[whole].json(files).schema for whole, files in forms.items()]
        schema = union_schemas(*found, on_clash=T.StringType())
    frames = [read[whole].schema(schema).json(files) for whole, files in forms.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(as_schema(frame, out.schema))
    return out


def read_parquet_union(spark: SparkSession, locations: Sequence[str]) -> DataFrame:
    """Parquet files of several loads, whose columns and types may differ, in one frame.

    Within a location Spark merges the columns itself; between locations types widen too.
    """
    return union_frames(*(spark.read.option("mergeSchema", True).parquet(at) for at in locations))
