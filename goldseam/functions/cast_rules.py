"""Per-value proof that a cast keeps the value: a reason code, or null when it does.

One rule set per (kind of source value, target). Everything is native expressions, decimal text
too long for ``decimal(38,0)`` arithmetic included (see ``decimals``): one scan, no Python worker.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from goldseam import constants as C
from goldseam.functions.decimals import decimal_text_is_exact
from goldseam.functions.dtypes import as_variant, has_odd_keys

# What decimal(38,0) and bigint hold. Texts up to the second are decided by cheaper arithmetic with
# the same verdict; texts beyond the first by arithmetic on arrays.
MAX_NATIVE_TEXT = 38
MAX_BIGINT_TEXT = 18
_TWO_64 = float(2**64)
_TWO_32 = float(2**32)
_WIDE = T.DecimalType(38, 0)


def source_kind(data_type: T.DataType) -> str:
    """Which rules apply to a column of this Spark type."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.VariantType):
        return "variant"
    return "other"


def is_null(value: Column, kind: str) -> Column:
    """Null test in which NaN counts as null."""
    if kind == "float":
        return value.isNull() | F.isnan(value)
    if kind == "variant":
        as_double = F.try_variant_get(value, "$", "double")
        return (
            value.isNull()
            | F.is_variant_null(value)
            | (_variant_type(value).isin("DOUBLE", "FLOAT") & F.isnan(as_double))
        )
    return value.isNull()


def _variant_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _reject(code: str) -> Column:
    return F.lit(code)


def _accept() -> Column:
    return F.lit(None).cast("string")


def _non_finite_or_parse_error(text: Column) -> Column:
    return F.when(
        F.lower(text).isin(*C.NON_FINITE_TOKENS), _reject(C.NON_FINITE_NUMBER)
    ).otherwise(_reject(C.PARSE_ERROR))


def _is_infinite(value: Column) -> Column:
    as_double = value.cast("double")
    return (as_double == float("inf")) | (as_double == float("-inf"))


# --- int64 -------------------------------------------------------------------
def _int64_from_string(text: Column) -> Column:
    return F.when(
        text.rlike(C.INTEGER_TEXT),
        F.when(text.try_cast("bigint").isNull(), _reject(C.OUT_OF_RANGE)),
    ).otherwise(_non_finite_or_parse_error(text))


def _int64_from_float(value: Column) -> Column:
    # The range goes first: beyond it every double is whole, and rounding functions
    # that return bigint would saturate there.
    x = value.cast("double")
    in_range = (x >= F.lit(C.INT64_LOW)) & (x < F.lit(C.INT64_HIGH))
    return (
        F.when(_is_infinite(x), _reject(C.NON_FINITE_NUMBER))
        .when(~in_range, _reject(C.OUT_OF_RANGE))
        .when(F.rint(x) != x, _reject(C.FRACTIONAL_VALUE))
    )


# --- float64 -----------------------------------------------------------------
def _float64_from_integer(value: Column) -> Column:
    # The bound keeps the largest bigint out: its double saturates on the way back and
    # would look unchanged.
    as_double = value.cast("double")
    survives = (as_double < F.lit(C.INT64_HIGH)) & (
        as_double.try_cast("bigint") == value.cast("bigint")
    )
    return F.when(~survives, _reject(C.PRECISION_LOSS))


def is_exact_text(text: Column) -> Column:
    """Whether decimal text is exactly a binary64 value.

    Text that is long only by the zeros at the end of its fraction is decided without them.
    """
    trimmed = F.when(
        F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    ).otherwise(text)
    return (
        F.when(F.length(text) <= MAX_NATIVE_TEXT, _short_text_is_exact(text))
        .when(F.length(trimmed) <= MAX_NATIVE_TEXT, _short_text_is_exact(trimmed))
        .otherwise(decimal_text_is_exact(text))
    )


def _whole_double_as_decimal(x: Column) -> Column:
    """Exact integer value of a non-negative whole double below 2^127, as a decimal."""
    high = F.floor(x / F.lit(_TWO_64))
    rest = x - high.cast("double") * F.lit(_TWO_64)
    middle = F.floor(rest / F.lit(_TWO_32))
    low = rest - middle.cast("double") * F.lit(_TWO_32)
    return (
        high.cast(T.DecimalType(19, 0)) * F.lit(Decimal(2**64)).cast(T.DecimalType(20, 0))
        + middle.cast(T.DecimalType(10, 0)) * F.lit(Decimal(2**32)).cast(T.DecimalType(10, 0))
        + low.cast("bigint").cast(T.DecimalType(10, 0))
    ).cast(_WIDE)


def _short_text_is_exact(text: Column) -> Column:
    """Whether decimal text of at most 38 characters is exactly a binary64 value.

    With k digits after the point the text is N / 10^k. Let m be its nearest double times 2^k,
    which is an exact scaling. The text is exact iff m is whole and m * 5^k = N. Text of up to 18
    characters needs bigint arithmetic only.
    """
    point = F.instr(text, ".")
    k = F.when(point > 0, F.length(text) - point).otherwise(F.lit(0))
    digits = F.translate(text, "+-.", "")
    scaled = F.abs(text.try_cast("double")) * F.element_at(
        F.array(*[F.lit(float(2**i)) for i in range(MAX_NATIVE_TEXT)]), k + 1
    )
    narrow = F.array(*[F.lit(5**i) for i in range(MAX_BIGINT_TEXT)])
    wide = F.array(*[F.lit(Decimal(5**i)).cast(_WIDE) for i in range(MAX_NATIVE_TEXT)])
    by_bigint = F.try_multiply(
        scaled.try_cast("bigint"), F.element_at(narrow, k + 1)
    ) == digits.try_cast("bigint")
    by_decimal = F.try_multiply(
        _whole_double_as_decimal(scaled), F.element_at(wide, k + 1)
    ).cast(_WIDE) == digits.try_cast(_WIDE)
    equal = F.when(F.length(text) <= MAX_BIGINT_TEXT, by_bigint).otherwise(by_decimal)
    return (F.rint(scaled) == scaled) & F.coalesce(equal, F.lit(False))


def _float64_from_string(text: Column) -> Column:
    infinite = (F.length(text) > MAX_NATIVE_TEXT) & (
        F.abs(text.try_cast("double")) == F.lit(float("inf"))
    )
    return F.when(
        text.rlike(C.DECIMAL_TEXT),
        F.when(infinite, _reject(C.NON_FINITE_NUMBER)).when(
            ~is_exact_text(text), _reject(C.PRECISION_LOSS)
        ),
    ).otherwise(_non_finite_or_parse_error(text))


def _float64_from_float(value: Column) -> Column:
    return F.when(_is_infinite(value), _reject(C.NON_FINITE_NUMBER))


# --- bool --------------------------------------------------------------------
def bool_token(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(C.ASCII_WHITESPACE)))


def _bool_from_string(text: Column) -> Column:
    known = bool_token(text).isin(*C.TRUE_TOKENS, *C.FALSE_TOKENS)
    return F.when(~known, _reject(C.AMBIGUOUS_BOOLEAN))


def _bool_from_integer(value: Column) -> Column:
    return F.when(~value.isin(0, 1), _reject(C.AMBIGUOUS_BOOLEAN))


def _always(code: str):
    return lambda value: _reject(code)


def _never(value: Column) -> Column:
    return _accept()


_RULES = {
    ("string", "int64"): _int64_from_string,
    ("integer", "int64"): _never,
    ("float", "int64"): _int64_from_float,
    ("boolean", "int64"): _always(C.UNSUPPORTED_SOURCE_VALUE),
    ("other", "int64"): _always(C.UNSUPPORTED_SOURCE_VALUE),
    ("string", "float64"): _float64_from_string,
    ("integer", "float64"): _float64_from_integer,
    ("float", "float64"): _float64_from_float,
    ("boolean", "float64"): _always(C.UNSUPPORTED_SOURCE_VALUE),
    ("other", "float64"): _always(C.UNSUPPORTED_SOURCE_VALUE),
    ("string", "bool"): _bool_from_string,
    ("integer", "bool"): _bool_from_integer,
    ("float", "bool"): _always(C.AMBIGUOUS_BOOLEAN),
    ("boolean", "bool"): _never,
    ("other", "bool"): _always(C.UNSUPPORTED_SOURCE_VALUE),
}

_VARIANT_KINDS = (
    ("string", ("STRING",), "string"),
    ("integer", ("BIGINT",), "bigint"),
    ("float", ("DOUBLE", "FLOAT"), "double"),
    ("boolean", ("BOOLEAN",), "boolean"),
)


def reason(value: Column, data_type: T.DataType, target: str) -> Column:
    """Reason code of one value, or null when the cast keeps it (nulls included)."""
    null_code = C.NULL_TARGET_INCOMPATIBLE if target in C.NULL_REJECTING_TARGETS else None
    return F.when(
        is_null(value, source_kind(data_type)), F.lit(null_code).cast("string")
    ).otherwise(_non_null_reason(value, data_type, target))


def _non_null_reason(value: Column, data_type: T.DataType, target: str) -> Column:
    if target == "object":
        return F.when(~object_round_trips(value, data_type), _reject(C.ROUND_TRIP_MISMATCH))
    kind = source_kind(data_type)
    if kind != "variant":
        return _RULES[(kind, target)](value)
    by_type = _variant_type(value)
    chain = None
    for inner, names, spark_type in _VARIANT_KINDS:
        branch = _RULES[(inner, target)](F.try_variant_get(value, "$", spark_type))
        test = by_type.isin(*names)
        chain = F.when(test, branch) if chain is None else chain.when(test, branch)
    return chain.otherwise(_reject(C.UNSUPPORTED_SOURCE_VALUE))


def converted(value: Column, data_type: T.DataType, target: str) -> Column:
    """The cast value. Meaningful only where ``reason`` is null; null elsewhere."""
    kind = source_kind(data_type)
    spark_type = {"int64": "bigint", "float64": "double", "bool": "boolean"}.get(target)
    if target == "object":
        return value if kind == "string" else as_variant(value, data_type)
    if kind == "variant":
        by_type = _variant_type(value)
        chain = None
        for _, names, inner_type in _VARIANT_KINDS:
            plain = F.try_variant_get(value, "$", inner_type)
            branch = converted(plain, T.DataType.fromDDL(inner_type), target)
            test = by_type.isin(*names)
            chain = F.when(test, branch) if chain is None else chain.when(test, branch)
        return chain
    if target == "bool":
        if kind == "string":
            token = bool_token(value)
            return F.when(token.isin(*C.TRUE_TOKENS), F.lit(True)).when(
                token.isin(*C.FALSE_TOKENS), F.lit(False)
            )
        if kind == "integer":
            return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))
        return value.cast("boolean") if kind == "boolean" else F.lit(None).cast("boolean")
    if kind == "float":
        return F.when(~F.isnan(value), value.try_cast(spark_type))
    if kind in ("string", "integer"):
        return value.try_cast(spark_type)
    return F.lit(None).cast(spark_type)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def object_round_trips(value: Column, data_type: T.DataType) -> Column:
    """Whether widening to ``object`` can be undone without a change."""
    if source_kind(data_type) in ("string", "variant"):
        return F.lit(True)
    if has_odd_keys(data_type):
        return F.lit(False)  # such keys become text and cannot be told from text afterwards
    widened = as_variant(value, data_type)
    if _has_map(data_type):
        # Maps cannot be compared, so the JSON of both is, which parsing puts into one key order.
        back = F.try_variant_get(widened, "$", data_type.simpleString())
        return F.to_json(F.parse_json(F.to_json(back))).eqNullSafe(
            F.to_json(F.parse_json(F.to_json(value)))
        )
    return F.try_variant_get(widened, "$", data_type.simpleString()).eqNullSafe(value)


def cast_back_equals(
    original: Column, value: Column, data_type: T.DataType, target: str
) -> Column:
    """Recheck after a SAFE verdict: whether the cast value, taken back, is the original.

    The inverse is not the cast itself: decimal text must be exactly the double it became, which is
    shown without the cast, and a value that saturates on the way back does not count as unchanged.
    """
    kind = source_kind(data_type)
    if target == "object":
        return object_round_trips(original, data_type) & (
            F.lit(True) if kind == "string" else F.to_json(value).isNotNull()
        )
    if kind == "variant":
        by_type = _variant_type(original)
        chain = F.when(is_null(original, kind), value.isNull())
        for _, names, inner_type in _VARIANT_KINDS:
            plain = F.try_variant_get(original, "$", inner_type)
            back = cast_back_equals(plain, value, T.DataType.fromDDL(inner_type), target)
            chain = chain.when(by_type.isin(*names), back)
        return chain.otherwise(F.lit(False))
    if kind == "string" and target == "int64":
        unsigned = F.regexp_replace(original, r"^\+", "")
        return value.cast("string").eqNullSafe(
            F.when(unsigned == "-0", F.lit("0")).otherwise(unsigned)
        )
    if kind == "string" and target == "bool":
        token = bool_token(original)
        return F.when(value, token.isin(*C.TRUE_TOKENS)).otherwise(
            token.isin(*C.FALSE_TOKENS) | original.isNull()
        )
    if kind == "string":
        same = value.eqNullSafe(original.try_cast("double"))
        return F.when(original.isNull(), value.isNull()).otherwise(
            same & original.rlike(C.DECIMAL_TEXT) & is_exact_text(original)
        )
    if kind == "integer" and target == "bool":
        return value.cast("int").cast("bigint").eqNullSafe(original.cast("bigint"))
    if kind == "integer" and target == "float64":
        return F.when(original.isNull(), value.isNull()).otherwise(
            (value < F.lit(C.INT64_HIGH)) & value.try_cast("bigint").eqNullSafe(original.cast("bigint"))
        )
    if kind == "integer":
        return value.eqNullSafe(original.cast("bigint"))
    if kind == "float":
        return value.cast("double").eqNullSafe(
            F.when(~F.isnan(original), original.cast("double"))
        ) & (F.lit(True) if target != "int64" else F.coalesce(original < F.lit(C.INT64_HIGH), F.lit(True)))
    if kind == "boolean" and target == "bool":
        return value.eqNullSafe(original)
    return value.isNull() & original.isNull()


def value_type_name(value: Column, data_type: T.DataType) -> Column:
    """Type of one value, for diagnostics; nulls are ``void``."""
    kind = source_kind(data_type)
    name = (
        F.lower(_variant_type(value)) if kind == "variant" else F.lit(data_type.simpleString())
    )
    return F.when(value.isNull(), F.lit("void")).otherwise(name)
