"""Logical type names: from Spark types, from database types, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from goldseam.constants import (
    BLOCKED_TARGET_SPELLINGS,
    DATABASE_TYPE_TO_DTYPE,
    DTYPE_TO_DATABASE_TYPE,
    EXTENDED_DTYPES,
    FREQUENT_FRAME_DTYPE,
)


class UnsupportedTypeError(ValueError):
    """A type with no declared logical meaning: refused, never widened."""


def logical_dtype(field: T.StructField) -> str:
    """Logical name of a Spark field; a ``logical`` entry in its metadata wins."""
    declared = field.metadata.get("logical") if field.metadata else None
    if declared:
        return declared
    kind = field.dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float64"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "object"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampNTZType):
        return "datetime"
    if isinstance(kind, T.TimestampType):
        return "datetime_tz"
    if isinstance(kind, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
        return "json"
    raise UnsupportedTypeError(f"No logical type for column {field.name!r}: {kind.simpleString()}.")


def canonical_spark_type(field: T.StructField) -> T.DataType:
    """The type a column is published with; an ``object`` column of variants keeps its types."""
    dtype = logical_dtype(field)
    if dtype == "decimal" or isinstance(field.dataType, T.VariantType):
        return field.dataType
    return {
        "int64": T.LongType(),
        "float64": T.DoubleType(),
        "object": T.StringType(),
        "bool": T.BooleanType(),
        "date": T.DateType(),
        "datetime": T.TimestampNTZType(),
        "datetime_tz": T.TimestampType(),
        "uuid": T.StringType(),
        "json": T.VariantType(),
    }[dtype]


def has_odd_keys(kind: T.DataType) -> bool:
    """Whether there is a map with keys that are no text, which variants do not have."""
    if isinstance(kind, T.MapType):
        return not isinstance(kind.keyType, T.StringType) or has_odd_keys(kind.valueType)
    if isinstance(kind, T.ArrayType):
        return has_odd_keys(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_odd_keys(f.dataType) for f in kind.fields)


def as_variant(value: Column, kind: T.DataType) -> Column:
    """A value as a variant, nested ones included."""
    if isinstance(kind, T.VariantType):
        return value
    if has_odd_keys(kind):
        return F.parse_json(F.to_json(value))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def as_published(value: Column, field: T.StructField) -> Column:
    """A column in its published type."""
    target = canonical_spark_type(field)
    return as_variant(value, field.dataType) if isinstance(target, T.VariantType) else value.cast(target)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    literal = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.try_element_at(literal, key)


def database_type_to_dtype(column: Column) -> Column:
    """Logical dtype of a database type name; null means refused."""
    return _lookup(column, DATABASE_TYPE_TO_DTYPE)


def dtype_to_database_type(column: Column) -> Column:
    """Published database type of a logical dtype; null means not publishable."""
    return _lookup(column, DTYPE_TO_DATABASE_TYPE)


def normalize_target(column: Column) -> Column:
    """Trimmed and lower-cased, but the blocked spellings keep their case and so stay unsupported."""
    trimmed = F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")
    return F.when(trimmed.isin(*BLOCKED_TARGET_SPELLINGS), trimmed).otherwise(F.lower(trimmed))


def normalize_target_name(target: str) -> str:
    trimmed = target.strip()
    return trimmed if trimmed in BLOCKED_TARGET_SPELLINGS else trimmed.lower()


def all_registrable(dtypes: Column) -> Column:
    """Whether a Gold schema may declare every one of an array of dtypes.

    Allowed are the logical types and whatever pandas knows as a dtype, zones included. Frequent spellings are
    told natively; only arrays with others reach the function that asks pandas.
    """

    def rare(dtype: Column) -> Column:
        return ~F.coalesce(dtype.isin(*EXTENDED_DTYPES) | dtype.rlike(FREQUENT_FRAME_DTYPE), F.lit(False))

    def known_to_pandas(lists):  # nested, so that it travels with the plan
        import warnings

        import pandas as pd

        def known(dtype):
            try:
                pd.api.types.pandas_dtype(dtype)
            except Exception:  # pandas and its time zones raise several kinds
                return False
            return dtype is not None

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            verdicts = {d: known(d) for listed in lists if listed is not None for d in listed}
        return pd.Series([listed is None or all(verdicts[d] for d in listed) for listed in lists], dtype=bool)

    unknown = F.filter(dtypes, rare)
    asked = F.pandas_udf(known_to_pandas, T.BooleanType())
    return asked(F.when(F.size(unknown) > 0, unknown))
