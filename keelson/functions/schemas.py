"""One schema for files or loads whose schemas differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Each type can hold all values of those before it.
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


class SchemaClash(ValueError):
    """Two columns of one name whose types no type can hold without loss."""


def widened(one: T.DataType, other: T.DataType, path: str = "value", on_clash: T.DataType | None = None) -> T.DataType:
    """The narrowest type that holds the values of both types, nested ones member by member.

    Integers widen to larger ones, to decimals and, up to 32 bits, to double; float to
    double; decimals to more digits; dates to timestamps without a zone; the type of
    nothing but nulls to any. Anything else is an error that names the column, or where
    ``on_clash`` is given double for numbers and that type for the rest.
    """
    if one == other:
        return one
    if isinstance(one, T.NullType):
        return other
    if isinstance(other, T.NullType):
        return one
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        return union_schemas(one, other, path=path, on_clash=on_clash)
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        element = widened(one.elementType, other.elementType, f"{path}[]", on_clash)
        return T.ArrayType(element, one.containsNull or other.containsNull)
    if isinstance(one, T.MapType) and isinstance(other, T.MapType) and one.keyType == other.keyType:
        value = widened(one.valueType, other.valueType, f"{path}{{}}", on_clash)
        return T.MapType(one.keyType, value, one.valueContainsNull or other.valueContainsNull)
    for a, b in ((one, other), (other, one)):
        wide = _wider(a, b)
        if wide is not None:
            return wide
    if on_clash is not None:
        return T.DoubleType() if {type(one), type(other)} <= {*_INTEGERS, *_FLOATS} else on_clash
    raise SchemaClash(f"{path}: {one.simpleString()} and {other.simpleString()}")


def _wider(one: T.DataType, other: T.DataType) -> T.DataType | None:
    """A type for both where ``one`` is the narrower kind, else None."""
    kind = type(one)
    if kind in _INTEGERS:
        if type(other) in _INTEGERS:
            return other if _INTEGERS.index(kind) < _INTEGERS.index(type(other)) else None
        if isinstance(other, T.DecimalType):
            return _decimal(_DIGITS[kind], 0, other)
        if type(other) in _FLOATS and kind is not T.LongType:
            return T.DoubleType()
    if kind is T.FloatType and isinstance(other, T.DoubleType):
        return other
    if isinstance(one, T.DecimalType) and isinstance(other, T.DecimalType):
        return _decimal(one.precision - one.scale, one.scale, other)
    if isinstance(one, T.DateType) and isinstance(other, T.TimestampNTZType):
        return other
    return None


def _decimal(whole: int, scale: int, other: T.DecimalType) -> T.DecimalType | None:
    whole, scale = max(whole, other.precision - other.scale), max(scale, other.scale)
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None


def union_schemas(*schemas: T.StructType, path: str = "", on_clash: T.DataType | None = None) -> T.StructType:
    """All columns of the schemas, nullable, in order of appearance, each in its widened type.

    Names are compared without regard to case; the first spelling stays, with its metadata.
    """
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            known = fields.get(f.name.lower())
            where = f"{path}.{f.name}" if path else f.name
            if known is None:
                fields[f.name.lower()] = T.StructField(f.name, f.dataType, True, f.metadata)
            else:
                merged = widened(known.dataType, f.dataType, where, on_clash)
                fields[f.name.lower()] = T.StructField(known.name, merged, True, known.metadata)
    return T.StructType(list(fields.values()))


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of a wider schema: absent ones null, nested ones filled in."""
    return df.select(*_members(lambda name: F.col("`" + name.replace("`", "``") + "`"), df.schema, schema))


def _members(get: Callable[[str], Column], have: T.StructType, want: T.StructType) -> list[Column]:
    known = {f.name.lower(): f for f in have.fields}
    out = []
    for f in want.fields:
        old = known.get(f.name.lower())
        value = F.lit(None).cast(f.dataType) if old is None else _cast(get(old.name), old.dataType, f.dataType)
        out.append(value.alias(f.name, metadata=f.metadata) if f.metadata else value.alias(f.name))
    return out


def _cast(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return F.when(value.isNotNull(), F.struct(*_members(value.getField, have, want)))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda v: _cast(v, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return F.transform_values(value, lambda _, v: _cast(v, have.valueType, want.valueType))
    return value.cast(want)


def union_frames(*frames: DataFrame) -> DataFrame:
    """All rows of frames whose schemas differ, in the union of their schemas."""
    schema = union_schemas(*(f.schema for f in frames))
    out = as_schema(frames[0], schema)
    for frame in frames[1:]:
        out = out.union(as_schema(frame, schema))
    return out
