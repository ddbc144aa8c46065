"""Queries on cast proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam import constants as C
from goldseam.operators import cast as ops
from goldseam.operators.cast import Cast
from goldseam.queries import register
from goldseam.queries.fixtures import (
    BOOL_TEXT,
    DOUBLES,
    EVENT_TEXTS,
    INT_TEXT,
    PRICE_TEXT,
    SAFE_TEXTS,
    Fixture,
    table,
    with_sql,
)

_TOKENS = "('nan','-nan','+nan','inf','-inf','+inf','infinity','-infinity','+infinity')"


def int64_case(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 'NULL_TARGET_INCOMPATIBLE' "
        f"WHEN lower({column}) IN {_TOKENS} THEN 'NON_FINITE_NUMBER' "
        f"WHEN NOT regexp_full_match({column}, '[+-]?(0|[1-9][0-9]*)') THEN 'PARSE_ERROR' "
        f"WHEN TRY_CAST({column} AS BIGINT) IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END"
    )


def float64_case(column: str) -> str:
    """Exactness by integer arithmetic: all digits as HUGEINT, 5^k from an exact power."""
    whole = f"split_part(ltrim({column}, '+-'), '.', 1)"
    frac = f"rtrim(split_part(ltrim({column}, '+-'), '.', 2), '0')"
    n = f"TRY_CAST(concat({whole}, {frac}) AS HUGEINT)"
    p = f"CAST(power(5, length({frac})) AS HUGEINT)"
    exact = (
        f"CASE WHEN length({frac}) = 0 "
        f"THEN {n} < 9007199254740992 OR CAST(CAST({n} AS DOUBLE) AS HUGEINT) = {n} "
        f"ELSE {n} % {p} = 0 AND {n} // {p} < 9007199254740992 END"
    )
    return (
        f"CASE WHEN {column} IS NULL THEN 'OK' "
        f"WHEN lower({column}) IN {_TOKENS} THEN 'NON_FINITE_NUMBER' "
        f"WHEN NOT regexp_full_match({column}, '[+-]?(0|[1-9][0-9]*)([.][0-9]+)?') "
        f"THEN 'PARSE_ERROR' WHEN {exact} THEN 'OK' ELSE 'PRECISION_LOSS' END"
    )


def bool_token_sql(column: str) -> str:
    return f"lower(trim({column}, concat(' ', chr(9), chr(13), chr(10), chr(12), chr(11))))"


def bool_case(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 'NULL_TARGET_INCOMPATIBLE' "
        f"WHEN {bool_token_sql(column)} IN ('true','false','1','0') THEN 'OK' "
        f"ELSE 'AMBIGUOUS_BOOLEAN' END"
    )


def _ok(df):
    return df.withColumn("reason", F.coalesce("reason", F.lit("OK")))


@register(
    "cast_reasons_int64",
    with_sql(
        f"SELECT event_id, reason, CASE WHEN reason = 'OK' THEN TRY_CAST(v AS BIGINT) ELSE -1 END "
        f"AS value FROM (SELECT event_id, v, {int64_case('v')} AS reason FROM f)",
        f=INT_TEXT,
    ),
)
def cast_reasons_int64(spark, sf_dir):
    rows = ops.cast_values(INT_TEXT.frame(spark, sf_dir), Cast("v", "int64"), ["event_id"])
    value = F.when(F.col("reason").isNull(), F.col("value")).otherwise(F.lit(-1))
    return _ok(rows.select("event_id", "reason", value.cast("bigint").alias("value")))


_DOUBLE_CASE = (
    "CASE WHEN v IS NULL OR isnan(v) THEN 'NULL_TARGET_INCOMPATIBLE' "
    "WHEN isinf(v) THEN 'NON_FINITE_NUMBER' WHEN v <> trunc(v) THEN 'FRACTIONAL_VALUE' "
    "WHEN TRY_CAST(v AS BIGINT) IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END"
)


@register(
    "cast_reasons_int64_from_double",
    with_sql(f"SELECT o_orderkey, {_DOUBLE_CASE} AS reason FROM f", f=DOUBLES),
)
def cast_reasons_int64_from_double(spark, sf_dir):
    rows = ops.cast_values(DOUBLES.frame(spark, sf_dir), Cast("v", "int64"), ["o_orderkey"])
    return _ok(rows.select("o_orderkey", "reason"))


@register(
    "cast_reasons_float64",
    with_sql(f"SELECT o_orderkey, {float64_case('v')} AS reason FROM f", f=PRICE_TEXT),
)
def cast_reasons_float64(spark, sf_dir):
    rows = ops.cast_values(PRICE_TEXT.frame(spark, sf_dir), Cast("v", "float64"), ["o_orderkey"])
    return _ok(rows.select("o_orderkey", "reason"))


@register(
    "cast_reasons_bool",
    with_sql(
        f"SELECT event_id, {bool_case('v')} AS reason, "
        f"CASE WHEN {bool_token_sql('v')} IN ('true','1') THEN 'true' "
        f"WHEN {bool_token_sql('v')} IN ('false','0') THEN 'false' ELSE 'none' END AS value FROM f",
        f=BOOL_TEXT,
    ),
)
def cast_reasons_bool(spark, sf_dir):
    rows = ops.cast_values(BOOL_TEXT.frame(spark, sf_dir), Cast("v", "bool"), ["event_id"])
    return _ok(
        rows.select(
            "event_id", "reason", F.coalesce(F.col("value").cast("string"), F.lit("none")).alias("value")
        )
    )


_OBJECT_COLUMNS = ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")


def _decision_columns(df):
    return df.withColumn("reason_codes", F.array_join("reason_codes", ","))


@register(
    "cast_object_roundtrip",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'SAFE' AS status, count(*) AS total_count, "
        f"count(*) - count({c}) AS null_count, count({c}) AS converted_count FROM orders"
        for c in _OBJECT_COLUMNS
    ),
)
def cast_object_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    casts = [Cast(c, "object") for c in _OBJECT_COLUMNS]
    return ops.cast_decision(df, casts, ["o_orderkey"]).select(
        "column_name", "status", "total_count", "null_count", "converted_count"
    )


@register(
    "cast_null_rules",
    with_sql(
        "SELECT t.target_dtype, n.total_count, n.null_count, "
        "CASE WHEN t.target_dtype IN ('int64','bool') THEN n.null_count ELSE 0 END AS null_failures, "
        "CASE WHEN t.target_dtype IN ('int64','bool') AND n.null_count > 0 "
        "THEN 'NULL_TARGET_INCOMPATIBLE' ELSE 'KEPT' END AS reason_code "
        "FROM (SELECT count(*) AS total_count, count(*) FILTER (v IS NULL OR isnan(v)) AS null_count "
        "FROM f) n, (VALUES ('int64'),('float64'),('bool'),('object')) t(target_dtype)",
        f=DOUBLES,
    ),
)
def cast_null_rules(spark, sf_dir):
    rules = ops.null_rules(DOUBLES.frame(spark, sf_dir), "v", ["o_orderkey"])
    return rules.withColumn("reason_code", F.coalesce("reason_code", F.lit("KEPT")))


@register(
    "cast_unsupported_target",
    with_sql(
        "SELECT t.target_dtype, 'UNSUPPORTED' AS status, total_count, null_count, "
        "CAST(0 AS BIGINT) AS converted_count, total_count - null_count AS failed_count, "
        "CAST(1 AS BIGINT) AS diagnostic_count, 'UNSUPPORTED_TARGET_DTYPE' AS reason_codes "
        "FROM (SELECT count(*) AS total_count, count(*) - count(v) AS null_count FROM f), "
        "(VALUES ('decimal'),('Int64'),('string')) t(target_dtype)",
        f=INT_TEXT,
    ),
)
def cast_unsupported_target(spark, sf_dir):
    casts = [Cast("v", t) for t in ("decimal", " Int64 ", "STRING")]
    decisions = ops.cast_decision(INT_TEXT.frame(spark, sf_dir), casts, ["event_id"])
    return _decision_columns(decisions).select(
        "target_dtype", "status", "total_count", "null_count", "converted_count", "failed_count",
        "diagnostic_count", "reason_codes",
    )


_MESSAGES = (
    "CASE reason_code WHEN 'PARSE_ERROR' THEN 'Not readable as int64' "
    "WHEN 'OUT_OF_RANGE' THEN 'Beyond the range of int64' "
    "WHEN 'NON_FINITE_NUMBER' THEN 'Not finite, so not a int64' "
    "ELSE 'Null not allowed in int64' END"
)


@register(
    "cast_diagnostics",
    with_sql(
        f"SELECT event_id, 'v' AS column_name, "
        f"CASE WHEN v IS NULL THEN 'void' ELSE 'string' END AS source_value_type, "
        f"'int64' AS target_dtype, reason_code, {_MESSAGES} AS message "
        f"FROM (SELECT event_id, v, {int64_case('v')} AS reason_code FROM f) "
        f"WHERE reason_code <> 'OK'",
        f=INT_TEXT,
    ),
)
def cast_diagnostics(spark, sf_dir):
    found = ops.cast_diagnostics(INT_TEXT.frame(spark, sf_dir), [Cast("v", "int64")], ["event_id"])
    return found.withColumnRenamed("column", "column_name")


def decision_sql(reasons: str, nulls: str, key: str, source: str, by: str | None = None) -> str:
    """Decision counts of one cast from a table with its reason column."""
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    per_reason = (
        f"SELECT {group}reason, min({key}) AS k FROM r WHERE reason <> 'OK' GROUP BY {group}reason"
    )
    codes = (
        f"SELECT {group}string_agg(reason, ',' ORDER BY k) AS codes FROM ({per_reason}){tail}"
    )
    join = f"LEFT JOIN c USING ({by})" if by else "LEFT JOIN c ON true"
    return (
        f"WITH r AS (SELECT *, {reasons} AS reason, {nulls} AS is_null FROM ({source})), "
        f"c AS ({codes}), "
        f"n AS (SELECT {group}count(*) AS total_count, count(*) FILTER (is_null) AS null_count, "
        f"count(*) FILTER (reason = 'OK' AND NOT is_null) AS converted_count, "
        f"count(*) FILTER (reason <> 'OK') AS failed_count FROM r{tail}) "
        f"SELECT {group}total_count, null_count, converted_count, failed_count, "
        f"failed_count AS diagnostic_count, coalesce(codes, '') AS reason_codes, "
        f"CASE WHEN failed_count > 0 THEN 'UNSAFE' ELSE 'SAFE' END AS status FROM n {join}"
    )


_DECISIONS = (
    ("as_int", "int64", "object", int64_case("as_int"), "as_int IS NULL"),
    ("as_float", "float64", "object", float64_case("as_float"), "as_float IS NULL"),
    ("as_bool", "bool", "object", bool_case("as_bool"), "as_bool IS NULL"),
    ("value", "int64", "float64", _DOUBLE_CASE.replace("v ", "value ").replace("(v)", "(value)")
     .replace("(v AS", "(value AS"), "value IS NULL OR isnan(value)"),
)


@register(
    "cast_decision",
    " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{source}' AS source_dtype, '{target}' AS target_dtype, "
        f"'{C.POLICY_VERSION}' AS policy_version, * FROM "
        f"({decision_sql(case, nulls, 'event_id', EVENT_TEXTS.sql())})"
        for column, target, source, case, nulls in _DECISIONS
    ),
)
def cast_decision(spark, sf_dir):
    casts = [Cast(column, target) for column, target, *_ in _DECISIONS]
    return _decision_columns(
        ops.cast_decision(EVENT_TEXTS.frame(spark, sf_dir), casts, ["event_id"])
    )


@register(
    "cast_decision_by_dataset",
    f"SELECT CAST(user_id AS STRING) AS dataset, status, total_count, null_count, "
    f"converted_count, failed_count, reason_codes FROM "
    f"({decision_sql(int64_case('v'), 'v IS NULL', 'event_id', INT_TEXT.sql(), 'user_id')})",
)
def cast_decision_by_dataset(spark, sf_dir):
    df = INT_TEXT.frame(spark, sf_dir).withColumn("dataset", F.col("user_id").cast("string"))
    decisions = ops.cast_decision(df, [Cast("v", "int64")], ["event_id"], by=["dataset"])
    return _decision_columns(decisions).select(
        "dataset", "status", "total_count", "null_count", "converted_count", "failed_count",
        "reason_codes",
    )


# Stored decisions, one per order, broken in a different way for each value of o_orderkey % 12.
STORED_DECISIONS = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CASE WHEN k = 1 THEN '' ELSE 'amount' END AS column_name",
        "CASE WHEN k = 2 THEN 'MAYBE' WHEN k IN (3, 4, 5, 6, 7, 11) THEN 'UNSAFE' ELSE 'SAFE' END "
        "AS status",
        "'object' AS source_dtype",
        "'int64' AS target_dtype",
        "'phase3.1-policy-v1' AS policy_version",
        "CAST(o_custkey AS BIGINT) AS total_count",
        "CAST(CASE WHEN k = 8 THEN -1 ELSE 0 END AS BIGINT) AS null_count",
        "CAST(o_custkey AS BIGINT) AS converted_count",
        "CAST(CASE WHEN k = 9 THEN 3 ELSE 0 END AS BIGINT) AS failed_count",
        "CAST(CASE WHEN k IN (3, 6, 7, 10) THEN 2 WHEN k = 5 THEN 1 ELSE 0 END AS BIGINT) "
        "AS diagnostic_count",
        "split(CASE WHEN k IN (4, 5) THEN 'PARSE_ERROR,OUT_OF_RANGE' "
        "WHEN k = 6 THEN 'PARSE_ERROR,PARSE_ERROR' WHEN k = 7 THEN 'PARSE_ERROR,' "
        "WHEN k = 3 THEN 'PARSE_ERROR' ELSE 'none' END, ',') AS codes_or_none",
    ],
    inner=["o_orderkey % 12 AS k"],
)


def stored_decisions(spark, sf_dir):
    df = STORED_DECISIONS.frame(spark, sf_dir)
    return df.withColumn(
        "reason_codes", F.filter("codes_or_none", lambda c: c != "none")
    ).drop("codes_or_none")


@register(
    "decision_violations",
    with_sql(
        "SELECT dataset, violation FROM (SELECT dataset, CASE "
        "WHEN status NOT IN ('SAFE','UNSAFE','UNSUPPORTED','ERROR') THEN 'INVALID_STATUS' "
        "WHEN column_name = '' THEN 'EMPTY_COLUMN_NAME' "
        "WHEN null_count < 0 THEN 'NEGATIVE_NULL_COUNT' "
        "WHEN list_contains(codes, '') THEN 'INVALID_REASON_CODE' "
        "WHEN len(list_distinct(codes)) <> len(codes) THEN 'DUPLICATE_REASON_CODE' "
        "WHEN diagnostic_count < len(codes) THEN 'FEWER_DIAGNOSTICS_THAN_REASONS' "
        "WHEN status = 'SAFE' AND (failed_count <> 0 OR diagnostic_count <> 0 OR len(codes) > 0) "
        "THEN 'SAFE_WITH_FAILURES' "
        "WHEN status <> 'SAFE' AND diagnostic_count = 0 THEN 'NO_DIAGNOSTICS' END AS violation "
        "FROM (SELECT *, list_filter(codes_or_none, lambda c: c <> 'none') AS codes FROM d)) "
        "WHERE violation IS NOT NULL",
        d=STORED_DECISIONS,
    ),
)
def decision_violations(spark, sf_dir):
    return ops.decision_violations(stored_decisions(spark, sf_dir)).select("dataset", "violation")


_MATERIALIZED = (
    ("count_text", "int64"), ("amount_text", "float64"), ("flag_text", "bool"),
    ("maybe_count", "float64"), ("o_totalprice", "object"),
)


@register(
    "cast_materialize_check",
    with_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS target_dtype, count(*) AS total_count, "
            f"count(*) - count({c}) AS nulls_before, count(*) - count({c}) AS nulls_after, "
            f"CAST(0 AS BIGINT) AS changed_values, true AS verified FROM f"
            for c, t in _MATERIALIZED
        ),
        f=SAFE_TEXTS,
    ),
)
def cast_materialize_check(spark, sf_dir):
    casts = [Cast(c, t) for c, t in _MATERIALIZED]
    return ops.materialize_check(SAFE_TEXTS.frame(spark, sf_dir), casts)


def _failures(column: str, target: str, changed: str, lost: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, '{target}' AS target_dtype, count(*) AS total_count, "
        f"count(*) - count({column}) AS nulls_before, count(*) FILTER ({column} IS NULL OR {lost}) AS nulls_after, "
        f"count(*) FILTER ({changed}) AS changed_values, count(*) FILTER ({changed}) = 0 AS verified FROM f"
    )


@register(
    "cast_materialize_failures",
    with_sql(
        " UNION ALL ".join(
            (
                _failures("as_int", "int64", "event_id % 10 IN (0, 1, 2, 3, 4, 6)", "event_id % 10 IN (2, 3, 4)"),
                _failures("as_bool", "bool", "event_id % 8 IN (3, 5, 7)", "event_id % 8 IN (3, 5, 7)"),
                _failures("as_float", "float64", "event_id % 8 IN (1, 2, 3, 4, 7)", "false"),
            )
        ),
        f=EVENT_TEXTS,
    ),
)
def cast_materialize_failures(spark, sf_dir):
    """The recheck on columns that no proof would call safe: it finds every changed value itself."""
    casts = [Cast("as_int", "int64"), Cast("as_bool", "bool"), Cast("as_float", "float64")]
    return ops.materialize_check(EVENT_TEXTS.frame(spark, sf_dir), casts)


@register(
    "cast_materialize_long_texts",
    with_sql(
        "SELECT 'v' AS column_name, 'float64' AS target_dtype, count(*) AS total_count, count(*) - count(v) AS nulls_before, "
        "count(*) - count(v) AS nulls_after, count(*) FILTER (k = 1) AS changed_values, "
        "count(*) FILTER (k = 1) = 0 AS verified FROM f",
        f="SELECT o_orderkey % 4 AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey END AS v FROM orders",
    ),
)
def cast_materialize_long_texts(spark, sf_dir):
    """Texts of over 38 characters: with zeros at the end, inexact, and exact beyond decimal(38)."""
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5" + "0" * 60)))
        .when(k == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".5" + "0" * 60 + "1")))
        .when(k == 2, F.concat(F.lit("-"), F.lit(str(2**140)), F.lit("." + "0" * 9)))
    )
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("v"))
    return ops.materialize_check(df, [Cast("v", "float64")])


_NESTED = ("as_struct", "as_array", "as_map", "as_mixed")


@register(
    "cast_object_nested",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'SAFE' AS status, count(*) AS total_count, count(*) FILTER (o_orderkey % 5 = 0) "
        f"AS null_count, count(*) FILTER (o_orderkey % 5 <> 0) AS converted_count FROM orders"
        for c in _NESTED
    ),
)
def cast_object_nested(spark, sf_dir):
    """Structs, arrays and maps widen to variants that can be taken back."""
    part = F.struct(F.col("o_custkey").alias("a"), F.array("o_orderstatus").alias("b"))
    values = (
        part,
        F.array(part, part),
        F.create_map("o_orderstatus", F.col("o_totalprice")),
        F.array(F.create_map("o_orderpriority", part)),
    )
    kept = F.col("o_orderkey") % 5 != 0
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", *[F.when(kept, v).alias(n) for v, n in zip(values, _NESTED, strict=True)]
    )
    return ops.cast_decision(df, [Cast(c, "object") for c in _NESTED], ["o_orderkey"]).select(
        "column_name", "status", "total_count", "null_count", "converted_count"
    )


_DECISION_JSON = (
    "'\"column_name\":\"a\",\"status\":\"SAFE\",\"source_dtype\":\"object\",\"target_dtype\":\"int64\","
    "\"policy_version\":\"p\",\"total_count\":1,\"null_count\":0,\"converted_count\":1,\"failed_count\":0,"
    "\"diagnostic_count\":0'"
)
_STORED_JSON = Fixture(
    "orders",
    [
        "o_orderkey",
        f"CASE o_orderkey % 5 WHEN 0 THEN concat(chr(123), {_DECISION_JSON}, ',\"reason_codes\":[]', chr(125)) "
        f"WHEN 1 THEN concat(chr(123), {_DECISION_JSON}, chr(125)) "
        f"WHEN 2 THEN concat(chr(123), {_DECISION_JSON}, ',\"reason_codes\":[],\"note\":', CAST(o_custkey AS STRING), chr(125)) "
        "WHEN 3 THEN '[1]' ELSE NULL END AS decision",
    ],
)


@register(
    "decision_field_errors",
    with_sql(
        "SELECT o_orderkey, CASE WHEN decision IS NULL OR decision = '[1]' THEN 'NOT_AN_OBJECT' "
        "WHEN NOT contains(decision, 'reason_codes') THEN 'MISSING_FIELDS' ELSE 'UNKNOWN_FIELDS' END AS field_error FROM d "
        "WHERE decision IS NULL OR decision = '[1]' OR NOT contains(decision, 'reason_codes') OR contains(decision, 'note')",
        d=_STORED_JSON,
    ),
)
def decision_field_errors(spark, sf_dir):
    errors = ops.decision_field_errors(_STORED_JSON.frame(spark, sf_dir), "decision")
    return errors.select("o_orderkey", "field_error")


# Per user: a plan and a stored decision that is missing, unsafe, stale or current.
_STALE_EVENTS = Fixture(
    "events",
    ["concat('u_', CAST(user_id AS STRING)) AS dataset", "user_id", "event_id",
     "CAST(event_id AS STRING) AS v"],
)
_STALE_STORED = (
    "SELECT dataset, count(*) + CASE WHEN min(user_id) % 5 = 1 THEN 1 ELSE 0 END AS total_count, "
    "CASE WHEN min(user_id) % 5 = 2 THEN 'UNSAFE' ELSE 'SAFE' END AS status, "
    "CASE WHEN min(user_id) % 5 = 4 THEN 'RENAME_COLUMN v -> w' "
    "ELSE 'CAST_COLUMN v TO int64' END AS action, min(user_id) % 5 AS k"
)


@register(
    "stale_decision",
    with_sql(
        "SELECT dataset, action, CASE "
        "WHEN k = 4 AND total_count % 2 = 0 THEN 'UNEXPECTED_DECISION' WHEN k = 4 THEN 'NOT_A_CAST' "
        "WHEN k = 3 THEN 'NO_DECISION' WHEN k = 2 THEN 'NOT_SAFE' WHEN k = 1 THEN 'STALE' "
        "ELSE 'CURRENT' END AS outcome FROM s",
        e=_STALE_EVENTS,
        s=f"{_STALE_STORED} FROM e GROUP BY dataset",
    ),
)
def stale_decision(spark, sf_dir):
    events = _STALE_EVENTS.frame(spark, sf_dir)
    fresh = ops.cast_decision(events, [Cast("v", "int64")], ["event_id"], by=["dataset"])
    k = F.min("user_id") % 5
    kept = events.groupBy("dataset").agg(
        (F.count("*") + F.when(k == 1, 1).otherwise(0)).alias("total_count"),
        F.count("*").alias("converted_count"),
        k.alias("k"),
    )
    plans = kept.select(
        "dataset",
        F.when(F.col("k") == 4, "RENAME_COLUMN v -> w").otherwise("CAST_COLUMN v TO int64").alias("action"),
    )
    has_one = (F.col("k") != 3) & ((F.col("k") != 4) | (F.col("total_count") % 2 == 0))
    stored = kept.select(
        F.when(has_one, F.col("dataset")).otherwise(F.concat(F.lit("gone_"), "dataset")).alias("dataset"),
        F.lit("v").alias("column_name"),
        F.when(F.col("k") == 2, "UNSAFE").otherwise("SAFE").alias("status"),
        F.lit("object").alias("source_dtype"),
        F.lit("int64").alias("target_dtype"),
        F.lit(C.POLICY_VERSION).alias("policy_version"),
        "total_count",
        F.lit(0).cast("bigint").alias("null_count"),
        "converted_count",
        F.lit(0).cast("bigint").alias("failed_count"),
        F.lit(0).cast("bigint").alias("diagnostic_count"),
        F.array().cast("array<string>").alias("reason_codes"),
    )
    return ops.stale_decisions(plans, stored, fresh)
