import pytest
from pyspark.sql import functions as F

from spark_rows import rows
from goldseam import constants as C
from goldseam.operators import cast as ops
from goldseam.operators.cast import Cast


def decide(df, target, key=("k",), column="v"):
    return ops.cast_decision(df, [Cast(column, target)], list(key)).first()


def test_null_counts_twice_where_the_target_rejects_it(spark):
    df = spark.createDataFrame([(0, 1), (1, None)], "k int, v bigint")
    d = decide(df, "int64")
    assert (d.status, d.total_count, d.null_count, d.converted_count, d.failed_count) == (
        "UNSAFE", 2, 1, 1, 1,
    )
    assert d.reason_codes == [C.NULL_TARGET_INCOMPATIBLE]


def test_null_counts_once_where_the_target_keeps_it(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "k int, v double")
    d = decide(df, "float64")
    assert (d.status, d.null_count, d.converted_count, d.failed_count) == ("SAFE", 2, 1, 0)


def test_empty_column_is_safe(spark):
    d = decide(spark.createDataFrame([], "k int, v string"), "int64")
    assert (d.status, d.total_count, d.reason_codes) == ("SAFE", 0, [])


def test_unsupported_source_outweighs_unsafe(spark):
    df = spark.createDataFrame([(0, '"x"'), (1, "true"), (2, "5")], "k int, t string").select(
        "k", F.parse_json("t").alias("v")
    )
    d = decide(df, "int64")
    assert d.status == "UNSUPPORTED"
    assert d.reason_codes == [C.PARSE_ERROR, C.UNSUPPORTED_SOURCE_VALUE]


def test_unknown_target(spark):
    df = spark.createDataFrame([(0, "1"), (1, None)], "k int, v string")
    for target in ("decimal", "Int64", " string ", "uuid"):
        d = decide(df, target)
        assert (d.status, d.converted_count, d.failed_count, d.diagnostic_count) == (
            "UNSUPPORTED", 0, 1, 1,
        )
        assert d.reason_codes == [C.UNSUPPORTED_TARGET_DTYPE]
    assert decide(df, " INT64 ").target_dtype == "int64"


def test_reasons_come_by_smallest_key_not_by_row_order(spark):
    df = spark.createDataFrame(
        [(9, "a", "x"), (3, "b", "inf"), (3, "a", "99999999999999999999")],
        "k int, l string, v string",
    ).repartition(3)
    d = decide(df, "int64", key=("k", "l"))
    assert d.reason_codes == [C.OUT_OF_RANGE, C.NON_FINITE_NUMBER, C.PARSE_ERROR]


def test_long_text_reaches_the_decision(spark):
    df = spark.createDataFrame([(0, str(2**130)), (1, str(2**130 + 1)), (2, "0.5")], "k int, v string")
    d = decide(df, "float64")
    assert (d.status, d.total_count, d.converted_count, d.reason_codes) == (
        "UNSAFE", 3, 2, [C.PRECISION_LOSS],
    )


def test_several_casts_and_groups_at_once(spark):
    df = spark.createDataFrame(
        [("a", 0, "1", "true"), ("a", 1, "x", "0"), ("b", 2, "3", "no")],
        "g string, k int, v string, w string",
    )
    found = ops.cast_decision(df, [Cast("v", "int64"), Cast("w", "bool")], ["k"], by=["g"])
    assert rows(found, "g", "column_name", "status") == [
        ("a", "v", "UNSAFE"), ("a", "w", "SAFE"), ("b", "v", "SAFE"), ("b", "w", "UNSAFE"),
    ]


def test_missing_column_is_refused(spark):
    with pytest.raises(ops.MissingColumnError):
        decide(spark.createDataFrame([(0, "1")], "k int, v string"), "int64", column="V")


def test_diagnostics_hold_no_values(spark):
    df = spark.createDataFrame([(0, "s3cret"), (1, "5"), (2, None)], "k int, v string")
    found = ops.cast_diagnostics(df, [Cast("v", "int64"), Cast("v", "decimal")], ["k"])
    got = rows(found, "k", "source_value_type", "reason_code")
    assert got == [
        (0, "string", C.PARSE_ERROR), (2, "void", C.NULL_TARGET_INCOMPATIBLE),
        (None, "object", C.UNSUPPORTED_TARGET_DTYPE),
    ]
    assert not any("s3cret" in r.message for r in found.collect())


def test_materialize_check_finds_changes(spark, monkeypatch):
    df = spark.createDataFrame([(0, "1"), (1, "2")], "k int, v string")
    ok = ops.materialize_check(df, [Cast("v", "int64")]).first()
    assert ok.verified and ok.changed_values == 0
    real = ops.rules.converted
    monkeypatch.setattr(ops.rules, "converted", lambda *a: real(*a) + 1)
    broken = ops.materialize_check(df, [Cast("v", "int64")]).first()
    assert not broken.verified and broken.changed_values == 2


def test_with_cast_changes_one_column_in_place(spark):
    df = spark.createDataFrame([("x", "1", 2.0)], "a string, v string, b double")
    out = ops.with_cast(df, Cast("v", "int64"))
    assert out.dtypes == [("a", "string"), ("v", "bigint"), ("b", "double")]
    assert out.first() == ("x", 1, 2.0)


def test_safe_means_casting_back_gives_the_original(spark):
    texts = [str(i * 7919 - 4000) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    assert decide(df, "int64").status == "SAFE"
    back = ops.with_cast(df, Cast("v", "int64")).orderBy("k").collect()
    assert [str(r.v) for r in back] == texts


def test_decision_field_names_are_checked(spark):
    good = "{" + ",".join(f'"{f}":1' for f in C.DECISION_FIELDS) + "}"
    df = spark.createDataFrame(
        [(0, good), (1, good[:-1] + ',"extra":1}'), (2, '{"status":1}'), (3, "[]")], "k int, d string"
    )
    assert rows(ops.decision_field_errors(df, "d"), "k", "field_error") == [
        (1, "UNKNOWN_FIELDS"), (2, "MISSING_FIELDS"), (3, "NOT_AN_OBJECT"),
    ]
