"""Decimals of any size come back exactly, and a Gold schema may declare what pandas knows."""

import json
import warnings
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from goldseam.functions.dtypes import all_registrable
from goldseam.operators.fingerprint import decode_payloads, measure, restore_rows
from goldseam.sources.publish import _canonical


def payload(texts):
    cells = [None if t is None else {"__type__": "decimal", "value": t} for t in texts]
    body = {"format_version": 2, "column_order": ["v"], "dtypes": {"v": "decimal"}, "data": {"v": cells}}
    return json.dumps(body)


@pytest.mark.parametrize(
    ("texts", "kind"),
    [
        (["123456789012345678901234567890.5", "-0.25", None], "decimal(32,2)"),
        (["0.00000000000000000000000000000000000001", "0"], "decimal(38,38)"),
        (["1e20", "25E-3", "+7"], "decimal(24,3)"),
        (["-00012.50", ".5", "5."], "decimal(4,2)"),
        (["9" * 38], "decimal(38,0)"),
        (["9" * 39, "1.5"], "string"),
        (["9" * 30 + "." + "9" * 10, "1"], "string"),
        (["1e1000", "1"], "string"),
        (["NaN", "1.5"], "string"),
        (["Infinity"], "string"),
        ([None], "decimal(38,0)"),
    ],
)
def test_decimals_of_any_size(spark, texts, kind):
    stored = spark.createDataFrame([("p", payload(texts))], "payload_id string, payload string")
    rows = restore_rows(decode_payloads(stored), [("v", "decimal")])
    assert dict(rows.dtypes)["v"] == kind
    got = [r.v for r in rows.orderBy("row").collect()]
    if kind == "string":
        assert got == texts
    else:
        assert got == [None if t is None else Decimal(t) for t in texts]


def test_dtypes_as_pandas_knows_them(spark):
    names = (
        "int float double half single longdouble i8 f4 <i8 >f8 ? S10 U5 O bytes str string object category bool boolean "
        "int64 Int64 uint8 UInt16 float16 Float32 complex128 period[M] period[D] interval interval[int64] "
        "interval[float64,right] Sparse Sparse[int64] Sparse[float64,0] float128 datetime64 datetime64[ns] M8[us] m8[s] "
        "datetime64[s] datetime64[D] timedelta64[ns] timedelta64[ms] string[python] string[pyarrow] int64[pyarrow] "
        "void nothing Float16 Int128 int7 decimal128 period period[X] interval[text] datetime64[xx] 1 int64; a,b"
    ).split(" ")
    names += ["datetime64[ns, UTC]", "datetime64[ns, Europe/Berlin]", "datetime64[ns, Nowhere/Nope]", "datetime64[s,UTC]", " int64", "", "x y"]

    def known(name):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                pd.api.types.pandas_dtype(name)
            return True
        except Exception:
            return False

    extended = ["decimal", "date", "datetime", "datetime_tz", "uuid", "json"]
    rows = [([n], known(n)) for n in names] + [([n], True) for n in extended]
    rows += [(["int64", "i8", "uuid"], True), (["int64", "nothing"], False), (["int64", None], False), ([None], False)]
    df = spark.createDataFrame(rows, "dtypes array<string>, want boolean")
    wrong = df.where(~F.col("want").eqNullSafe(all_registrable(F.col("dtypes")))).collect()
    assert wrong == []
    assert sum(w for _, w in rows) > 40 and known("period[M]") and not known("datetime64[ns, Nowhere/Nope]")


def test_nested_table_and_its_published_version_agree(spark):
    df = spark.sql(
        "SELECT id, named_struct('b', array(id, null), 'a', map('y', date'2024-01-01', 'x', null)) AS s, "
        "array(named_struct('t', timestamp'2024-01-01 10:00:00', 'd', 1.50BD)) AS l, "
        "if(id = 1, null, array(array(double('NaN'), 1e0))) AS n, parse_json('{\"k\": [1, 1.5, \"a\", null, {}]}') AS v, "
        "named_struct('e', cast(array() as array<int>), 'x', binary('ab')) AS e FROM range(4)"
    )
    assert measure(df).first().data_fingerprint == measure(_canonical(df)).first().data_fingerprint
    other = df.withColumn("n", F.expr("if(id = 1, null, array(array(double('NaN'), 1e0, null)))"))
    assert measure(other).first().data_fingerprint != measure(df).first().data_fingerprint
