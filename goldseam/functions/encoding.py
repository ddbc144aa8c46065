"""Canonical text of cells and rows: equal text only for equal typed values."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from goldseam.functions.dtypes import as_variant, logical_dtype

FORMAT = "cells-v3"

#: Levels of a nested value that are written part by part; what lies deeper is told by its schema and JSON text.
LEVELS = 6

# One tag per logical type, so that equal text of different types differs.
TAGS = {
    "int64": "i",
    "float64": "f",
    "object": "s",
    "bool": "b",
    "decimal": "m",
    "date": "d",
    "datetime": "t",
    "datetime_tz": "z",
    "uuid": "u",
    "json": "j",
}


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _framed(tag: str, text: Column) -> Column:
    """For text that may hold anything: its length says where it ends."""
    return F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)


def _framed_once(tag: str, text: Column) -> Column:
    """As ``_framed``, for a large expression: it is written down and evaluated once."""
    return F.transform(F.array(text), lambda t: _framed(tag, t))[0]


def _closed(tag: str, text: Column) -> Column:
    """For numbers and times, whose text never holds a semicolon."""
    return F.concat(F.lit(tag), text, F.lit(";"))


_NOTHING = "VOID=null"


def _place(index: Column) -> Column:
    return F.lpad(index.cast("string"), 10, "0")


def _parts_text(mark: Column | str, count: Column, parts: Column) -> Column:
    """Parts (key, text) in their order, each with its length, so that no two lists read alike.

    ``parts`` holds the whole level below, so it stands in the expression once.
    """
    mark = F.lit(mark) if isinstance(mark, str) else mark
    written = F.transform(parts, lambda p: F.concat(_framed("", p["key"]), _framed("", p["text"])))
    return F.concat(mark, count.cast("string"), F.lit(":"), F.array_join(written, ""))


def _part(key: Column, text: Column) -> Column:
    return F.struct(key.alias("key"), text.alias("text"))


def _variant_sql(value: str, levels: int) -> str:
    """SQL text of ``_variant_text``, which is built much faster than columns of as many parts.

    Functions inside lambdas are not compiled, so a node's type and its list of parts are found once and bound.
    """
    s = f"s{levels}"
    plain = (
        f"concat(if(startswith({s}, 'DECIMAL'), 'DECIMAL', {s}), '=', if({s} = 'TIMESTAMP', "
        f"cast(unix_micros(try_variant_get({value}, '$', 'timestamp')) AS string), to_json({value})))"
    )
    if levels == 0:
        return f"transform(array(schema_of_variant({value})), {s} -> {plain})[0]"
    x, i, e, p = (f"{letter}{levels}" for letter in ("x", "i", "e", "p"))
    elements = (
        f"transform(try_variant_get({value}, '$', 'array<variant>'), ({x}, {i}) -> "
        f"named_struct('key', lpad(cast({i} AS string), 10, '0'), 'value', {x}))"
    )
    # variants have no order, and the keys of an object are unique
    members = (
        f"array_sort(map_entries(try_variant_get({value}, '$', 'map<string,variant>')), ({x}, {i}) -> "
        f"CASE WHEN {x}.key < {i}.key THEN -1 WHEN {x}.key > {i}.key THEN 1 ELSE 0 END)"
    )
    inner = f"if(startswith({s}, 'ARRAY'), {elements}, {members})"
    below = _variant_sql(f"{e}.value", levels - 1)
    written = (
        f"transform({p}, {e} -> concat(length({e}.key), ':', {e}.key, "
        f"transform(array({below}), t{levels} -> concat(length(t{levels}), ':', t{levels}))[0]))"
    )
    listed = (
        f"transform(array({inner}), {p} -> "
        f"concat(if(startswith({s}, 'ARRAY'), '[', '{{'), size({p}), ':', array_join({written}, '')))[0]"
    )
    return (
        f"transform(array(schema_of_variant({value})), {s} -> "
        f"if(startswith({s}, 'ARRAY') OR startswith({s}, 'OBJECT'), {listed}, {plain}))[0]"
    )


def _variant_text(value: Column, levels: int = LEVELS) -> Column:
    """Type and text of a variant: equal text only for equal typed values, on every level.

    A time is written as micros since the epoch, so the session time zone has no part in it. Arrays
    are written element by element, objects by key; each part is typed by itself, so arrays of mixed
    types differ wherever an element does. One list holds the parts of either kind, with keys or
    places, so the expression grows by the level and not by its square.
    """

    def written(bound: Column) -> Column:
        name = str(bound).removeprefix("Column<'").removesuffix("'>")
        # a name is taken for that of a lambda's argument inside a lambda only
        return F.expr(f"transform(array(0), none -> {_variant_sql(name, levels)})[0]")

    return F.transform(F.array(value), written)[0]


# The type that ``schema_of_variant`` gives a value of these Spark types.
_VARIANT_TYPES = {
    T.ByteType: "BIGINT", T.ShortType: "BIGINT", T.IntegerType: "BIGINT", T.LongType: "BIGINT",
    T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DecimalType: "DECIMAL",
    T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP_NTZ",
    T.StringType: "STRING", T.VarcharType: "STRING", T.CharType: "STRING", T.BinaryType: "BINARY",
}


def _plain_text(value: Column, kind: T.DataType) -> Column:
    """``_variant_text`` of a value whose type is known beforehand."""
    name = _VARIANT_TYPES[type(kind)]
    if name in ("BIGINT", "BOOLEAN"):
        text = value.cast("string")
    elif name == "TIMESTAMP":
        text = F.unix_micros(value).cast("string")
    else:
        text = F.to_json(value.cast("variant"))
    return F.concat(F.lit(f"{name}="), text)


def nested_text(value: Column, kind: T.DataType, levels: int = LEVELS) -> Column:
    """The text of a typed value inside a column, compiled from its type; null has one too.

    It is the text of the variant that the value is published as, so a table and its published version
    agree. Maps with keys that are no text, which variants do not have, are written with typed keys.
    """
    if isinstance(kind, T.VariantType):
        text = _variant_text(value, levels)
    elif type(kind) in _VARIANT_TYPES:
        text = _plain_text(value, kind)
    elif levels == 0 and isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = _variant_text(as_variant(value, kind), 0)
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(
            value, lambda x, i: _part(_place(i), nested_text(x, kind.elementType, levels - 1))
        )
        text = _parts_text("[", F.size(value), parts)
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = F.array(
            *[_part(F.lit(f.name), nested_text(value.getField(f.name), f.dataType, levels - 1)) for f in fields]
        ) if fields else F.array().cast("array<struct<key:string,text:string>>")
        text = F.when(value.isNotNull(), _parts_text("{", F.lit(len(fields)), parts))
    elif isinstance(kind, T.MapType):
        by_text = isinstance(kind.keyType, T.StringType)
        parts = F.transform(
            F.map_entries(value),
            lambda e: _part(
                e["key"] if by_text else nested_text(e["key"], kind.keyType, levels - 1),
                nested_text(e["value"], kind.valueType, levels - 1),
            ),
        )
        text = _parts_text("{" if by_text else "<", F.size(value), F.sort_array(parts))
    else:
        text = F.concat(F.lit(f"{kind.simpleString()}="), value.cast("string"))
    return F.coalesce(text, F.lit(_NOTHING))


def cell_text(field: T.StructField, value: Column | None = None) -> Column:
    """``N`` for null, otherwise a type tag and the text, with its length or an end mark."""
    value = quoted(field.name) if value is None else value
    kind = field.dataType
    tag = TAGS.get(logical_dtype(field), "s")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        text = F.when(~F.isnan(number), _closed(tag, number.cast("string")))
    elif isinstance(kind, T.TimestampType):
        # Micros since the epoch: independent of the session time zone.
        text = _closed(tag, F.unix_micros(value).cast("string"))
    elif isinstance(kind, T.VariantType):
        text = _framed_once(tag, _variant_text(value))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.when(value.isNotNull(), _framed_once(tag, nested_text(value, kind)))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = _framed(tag, value)
    else:
        text = _closed(tag, value.cast("string"))
    return F.coalesce(text, F.lit("N"))


def row_text(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    at: Callable[[str], Column] = quoted,
) -> Column:
    """All cells of a row, in the given column order; ``at`` says where a column is found."""
    fields = {f.name: f for f in df.schema.fields}
    return F.concat(*[cell_text(fields[name], at(name)) for name in (columns or df.columns)])


def schema_header(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """Names and logical types in order: the part of a fingerprint that is not in the rows."""
    fields = {f.name: f for f in df.schema.fields}
    described = [[name, logical_dtype(fields[name])] for name in (columns or df.columns)]
    return json.dumps([FORMAT, described], separators=(",", ":"), ensure_ascii=False)
