"""Every cell of the cast matrix, and the traps around it."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from goldseam import constants as C
from goldseam.operators.cast import Cast, cast_values

P, R, N = C.PARSE_ERROR, C.OUT_OF_RANGE, C.NON_FINITE_NUMBER
NULL, U, A, L = (
    C.NULL_TARGET_INCOMPATIBLE, C.UNSUPPORTED_SOURCE_VALUE, C.AMBIGUOUS_BOOLEAN, C.PRECISION_LOSS
)
FR = C.FRACTIONAL_VALUE
INF, NAN = float("inf"), float("nan")

MATRIX = {
    ("string", "int64"): [
        ("-42", None), ("+7", None), ("0", None), ("-0", None), ("9223372036854775807", None),
        ("-9223372036854775808", None), ("9223372036854775808", R), ("-9223372036854775809", R),
        ("1" + "0" * 700, R), ("01", P), ("1.0", P), ("1e3", P), ("1,000", P), ("1_000", P),
        (" 1", P), ("1 ", P), ("1\n", P), ("\t1", P), ("", P), ("+", P), ("1d", P), ("١", P),
        ("nan", N), ("-Infinity", N), ("+INF", N), (" inf", P), (None, NULL),
    ],
    ("string", "float64"): [
        ("2.5", None), ("100.25", None), ("-0.125", None), ("7", None), ("0.0", None), ("-0", None),
        ("0.1", L), ("9007199254740993", L), ("9007199254740992", None), ("9007199254740994", None),
        ("18014398509481984.0", None), ("100000000000000000000000", L), ("10000000000000000000000", None),
        ("1e3", P), (".5", P), ("5.", P), ("1,000.5", P), (" 1.0", P), ("1.0\n", P), ("01.5", P), ("1f", P),
        ("NaN", N), ("infinity", N), ("1" + "0" * 400, N), (str(2**130), None), (str(2**130 + 1), L),
        ("1267650600228229401496703205376." + "0" * 20, None), ("0." + "0" * 60 + "1", L),
        (format(Decimal(2.0**-60), "f"), None), (None, None),
    ],
    ("string", "bool"): [
        ("true", None), ("FALSE", None), ("1", None), ("0", None), (" tRuE\t", None), ("\n0\r", None),
        ("\x0b1\x0c", None), ("yes", A), ("t", A), ("1.0", A), ("", A), (" 1", A), (None, NULL),
    ],
    ("bigint", "int64"): [(5, None), (-(2**63), None), (None, NULL)],
    ("bigint", "float64"): [
        (5, None), (2**53, None), (2**53 + 1, L), (2**53 + 2, None), (2**63 - 1, L),
        (-(2**63), None), (None, None),
    ],
    ("bigint", "bool"): [(0, None), (1, None), (2, A), (-1, A), (None, NULL)],
    ("double", "int64"): [
        (5.0, None), (-0.0, None), (1.2, FR), (INF, N), (-INF, N), (NAN, NULL), (None, NULL),
        (9.223372036854775808e18, R), (-9.223372036854775808e18, None), (1e300, R), (0.5, FR),
    ],
    ("double", "float64"): [(3.14, None), (INF, N), (NAN, None), (None, None)],
    ("double", "bool"): [(0.0, A), (1.0, A), (NAN, NULL)],
    ("boolean", "int64"): [(True, U), (False, U), (None, NULL)],
    ("boolean", "float64"): [(True, U), (None, None)],
    ("boolean", "bool"): [(True, None), (False, None), (None, NULL)],
    ("date", "int64"): [(datetime.date(2024, 1, 1), U), (None, NULL)],
    ("decimal(10,2)", "float64"): [(Decimal("1.50"), U), (None, None)],
    ("timestamp_ntz", "bool"): [(datetime.datetime(2024, 1, 1), U), (None, NULL)],
    ("string", "object"): [("text", None), (None, None)],
    ("double", "object"): [(1.5, None), (-0.0, None), (NAN, None), (INF, None)],
    ("date", "object"): [(datetime.date(2024, 1, 1), None), (None, None)],
    ("decimal(10,2)", "object"): [(Decimal("1.50"), None)],
    ("array<int>", "object"): [([1, 2], None), (None, None)],
}


@pytest.mark.parametrize("source,target", MATRIX, ids=lambda v: str(v))
def test_matrix(spark, source, target):
    cases = MATRIX[(source, target)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"k int, v {source}")
    got = {r.k: r.reason for r in cast_values(df, Cast("v", target), ["k"]).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(cases)}


def test_cast_values(spark):
    df = spark.createDataFrame([(0, "+7"), (1, "-0"), (2, "x")], "k int, v string")
    values = {r.k: r.value for r in cast_values(df, Cast("v", "int64"), ["k"]).collect()}
    assert values == {0: 7, 1: 0, 2: None}
    df = spark.createDataFrame([(0, " TRUE"), (1, "0"), (2, "t")], "k int, v string")
    values = {r.k: r.value for r in cast_values(df, Cast("v", "bool"), ["k"]).collect()}
    assert values == {0: True, 1: False, 2: None}


def test_mixed_values_in_a_variant_column(spark):
    texts = ["5", '"6"', "1.5e0", "true", "null", '"x"', '{"a":1}', "12345678901234567890123"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select(
        "k", F.parse_json("t").alias("v")
    )
    def reasons(target):
        return [r.reason for r in cast_values(df, Cast("v", target), ["k"]).orderBy("k").collect()]

    assert reasons("int64") == [None, None, FR, U, NULL, P, U, U]
    assert reasons("float64") == [None, None, None, U, None, P, U, U]
    assert reasons("bool") == [A, A, A, None, NULL, A, U, U]
    values = [r.value for r in cast_values(df, Cast("v", "int64"), ["k"]).orderBy("k").collect()]
    assert values[:2] == [5, 6]


def _random_decimals(n):
    rng = random.Random(7)
    out = []
    for _ in range(n):
        kind = rng.randrange(4)
        sign = rng.choice(["", "-", "+"])
        if kind == 0:
            value = Decimal(rng.getrandbits(53) / 2 ** rng.randrange(0, 70))
            text = format(value, "f")
        elif kind == 1:
            text = str(rng.getrandbits(rng.randrange(1, 130)))
        elif kind == 2:
            text = str(rng.getrandbits(53) << rng.randrange(0, 80))
        else:
            text = f"{rng.randrange(10**rng.randrange(1, 12))}.{rng.randrange(10**9):09d}"
        out.append(sign + text)
    return out


def test_float_exactness_agrees_with_exact_arithmetic(spark):
    texts = _random_decimals(3000)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    got = {r.k: r.reason for r in cast_values(df, Cast("v", "float64"), ["k"]).collect()}
    want = {i: None if Decimal(float(t)) == Decimal(t) else L for i, t in enumerate(texts)}
    assert got == want
    assert {None, L} == set(want.values())
