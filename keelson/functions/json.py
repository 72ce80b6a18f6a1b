"""Judging JSON texts whose shape is not known."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# JSON texts that count as nothing, besides null.
EMPTY_TEXTS = ("", "{}", "[]", "false", "0", "0.0")


def whole(text: Column) -> Column:
    """The text if all of it is one JSON value, else null.

    The parser ignores what follows a value. So the text must be read both inside brackets,
    which refuses other text and closing braces, and as the one member inside braces, which
    refuses closing brackets and further values. Single quotes are refused too, by the
    first of the two.
    """
    in_brackets = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_braces = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    return F.when(in_brackets & in_braces, text)


def is_object(text: Column) -> Column:
    """Whether the text is a JSON object; never null."""
    return F.json_object_keys(text).isNotNull()


def is_filled(text: Column) -> Column:
    """Whether a value read as text is other than null, false, zero and the empty ones."""
    return F.coalesce(~text.isin(*EMPTY_TEXTS), F.lit(False))


def as_map(text: Column) -> Column:
    """The members of a JSON object as texts; null if the text is no object.

    A member that is null keeps its key, so presence and value can be told apart.
    """
    return F.from_json(text, "map<string, string>")
