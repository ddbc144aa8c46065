import random
import re
import struct
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F, types as T

from goldseam.functions import cast_rules as rules
from goldseam.functions.decimals import decimal_text_is_exact
from goldseam.operators.cast import Cast, cast_decision, materialize_check

getcontext().prec = 2000


def plain(x: float) -> str:
    return format(Decimal(x), "f")


def texts():
    rng = random.Random(17)
    doubles = [2.0**-k for k in range(1075)] + [2.0**e for e in range(1024)]
    doubles += [float(2**53 - 1), float(2**53), 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, 0.1, 0.5]
    while len(doubles) < 9000:
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if x == x and abs(x) != float("inf"):
            doubles.append(x)
    while len(doubles) < 14_000:
        doubles.append(rng.getrandbits(rng.randrange(1, 54)) * 2.0 ** rng.randrange(-120, 120))
    out = []
    for x in doubles:
        exact = plain(x)
        out.append(exact)
        at = rng.randrange(len(exact))
        if exact[at].isdigit():
            out.append(exact[:at] + str(rng.randrange(10)) + exact[at + 1:])
        if "." in exact:
            out.append(exact + "0" * rng.randrange(1, 60))
            out.append(exact[:-1])
        else:
            out += [exact + "." + "0" * 40, exact + ".5"]
    out += ["0." + "0" * 1200, "-0." + "0" * 50, "0." + "0" * 400 + "1", "0." + "1" * 3000, "1" + "0" * 308, "+" + "3" * 60, "9" * 400, "-" + "1" * 310]
    return sorted({t for t in out if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)([.][0-9]+)?", t)})


@pytest.fixture(scope="module")
def judged(spark):
    listed = texts()
    assert len(listed) > 40_000
    df = spark.createDataFrame([(t,) for t in listed], "t string").repartition(4)
    got = df.select("t", decimal_text_is_exact(F.col("t")).alias("x"), rules.reason(F.col("t"), T.StringType(), "float64").alias("r"))
    return got.collect()


def test_every_text_as_exact_arithmetic_says(judged):
    wrong = []
    for row in judged:
        x = float(row.t)
        if abs(x) == float("inf"):
            want = "NON_FINITE_NUMBER"
        else:
            exact = Decimal(x) == Decimal(row.t)
            if row.x != exact:
                wrong.append((row.t[:60], len(row.t), row.x))
            want = None if exact else "PRECISION_LOSS"
        if row.r != want:
            wrong.append((row.t[:60], len(row.t), row.r, want))
    assert wrong == []
    assert {row.r for row in judged} == {None, "PRECISION_LOSS", "NON_FINITE_NUMBER"}


def test_one_scan_without_python(spark, tmp_path):
    spark.createDataFrame([(1, plain(0.1)), (2, "0." + "1" * 50)], "id int, t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cast = [Cast("t", "float64")]
    for checked in (cast_decision(df, cast, ["id"]), materialize_check(df, cast)):
        plan = checked._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan"):]
        assert physical.count("FileScan parquet") == 1 and "Python" not in physical and "ArrowEval" not in physical
    got = cast_decision(df, cast, ["id"]).first()
    assert (got.status, got.failed_count) == ("UNSAFE", 1)
    assert materialize_check(df, cast).first().changed_values == 1


def test_long_text_in_a_variant_is_proved_too(spark):
    rows = [(1, '"' + plain(0.1) + '"'), (2, '"0.' + "1" * 50 + '"'), (3, '"' + "9" * 400 + '"')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("v"))
    kind = df.schema["v"].dataType
    got = [r.r for r in df.select("id", rules.reason(F.col("v"), kind, "float64").alias("r")).orderBy("id").collect()]
    assert got == [None, "PRECISION_LOSS", "NON_FINITE_NUMBER"]


def test_very_long_texts_and_an_empty_table(spark):
    df = spark.createDataFrame(
        [("0.5" + "0" * 1_000_000,), ("0." + "3" * 1_000_000,), ("7" * 1_000_000,), (None,), ("",)], "t string"
    )
    got = [r.r for r in df.select(rules.reason(F.col("t"), T.StringType(), "float64").alias("r")).collect()]
    assert got == [None, "PRECISION_LOSS", "NON_FINITE_NUMBER", None, "PARSE_ERROR"]
    assert cast_decision(df.limit(0), [Cast("t", "float64")], ["t"]).first().status == "SAFE"
