"""Verified casts: per-row verdicts, diagnostics, decisions and rechecks.

Everything rests on one relation, ``verdicts``: a row per (input row, requested cast) with a
reason code, or null where the value survives. Decisions aggregate it on the map side first, so
what is shuffled is one row per task, cast and reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from goldseam import constants as C
from goldseam.functions import cast_rules as rules
from goldseam.functions.dtypes import logical_dtype, normalize_target_name
from goldseam.functions.encoding import quoted
from goldseam.session import exact_names


@dataclass(frozen=True)
class Cast:
    """A requested cast of one column."""

    column: str
    target: str

    @property
    def normalized(self) -> str:
        return normalize_target_name(self.target)

    @property
    def supported(self) -> bool:
        return self.normalized in C.CAST_TARGETS


class MissingColumnError(ValueError):
    """The plan names a column the data does not have."""


def _field(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise MissingColumnError(f"Cast source column not found: {name}.")


@exact_names
def verdicts(df: DataFrame, casts: Sequence[Cast], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and cast: ``keep`` columns, cast_id, reason, is_null, value_type."""
    native = []
    for cast_id, cast in enumerate(casts):
        data_type = _field(df, cast.column).dataType
        value = quoted(cast.column)
        reason = (
            rules.reason(value, data_type, cast.normalized)
            if cast.supported
            else F.lit(None).cast("string")
        )
        fields = {
            "reason": reason,
            "is_null": rules.is_null(value, rules.source_kind(data_type)),
            "value_type": rules.value_type_name(value, data_type),
        }
        native.append(
            F.struct(F.lit(cast_id).alias("cast_id"), *[c.alias(n) for n, c in fields.items()])
        )
    kept = [quoted(name) for name in keep]
    if len(native) == 1:
        tall = df.select(*kept, native[0].alias("v"))
    else:
        tall = df.select(*kept, F.explode(F.array(*native)).alias("v"))
    return tall.select(*kept, "v.*")


# The codes that a proof for each target can give.
REASONS = {
    "int64": (
        C.PARSE_ERROR, C.FRACTIONAL_VALUE, C.OUT_OF_RANGE, C.NON_FINITE_NUMBER,
        C.NULL_TARGET_INCOMPATIBLE, C.UNSUPPORTED_SOURCE_VALUE,
    ),
    "float64": (C.PARSE_ERROR, C.PRECISION_LOSS, C.NON_FINITE_NUMBER, C.UNSUPPORTED_SOURCE_VALUE),
    "bool": (C.AMBIGUOUS_BOOLEAN, C.NULL_TARGET_INCOMPATIBLE, C.UNSUPPORTED_SOURCE_VALUE),
    "object": (C.ROUND_TRIP_MISMATCH,),
}


def _counted_reasons(df: DataFrame, casts: Sequence[Cast], key: Sequence[str]) -> DataFrame:
    """(cast_id, reason, n, nulls, first_key) of all casts from one scan, as plain aggregates.

    A task sends one row, however many casts there are.
    """
    first = _first_key(key).alias("_key")
    verdict, null = {}, {}
    for i, cast in enumerate(casts):
        data_type = _field(df, cast.column).dataType
        value = quoted(cast.column)
        null[i] = rules.is_null(value, rules.source_kind(data_type))
        if cast.supported:
            verdict[i] = rules.reason(value, data_type, cast.normalized)

    def tallies(ids: Sequence[int]) -> list[Column]:
        listed = []
        for i in ids:
            for r, code in enumerate(REASONS[casts[i].normalized]):
                hit = F.col(f"_r{i}") == code
                listed.append(F.count_if(hit).alias(f"n{i}_{r}"))
                listed.append(F.min(F.when(hit, F.col("_key"))).alias(f"k{i}_{r}"))
        return listed

    scanned = df.select(
        first,
        *[v.alias(f"_r{i}") for i, v in verdict.items()],
        *[v.alias(f"_n{i}") for i, v in null.items()],
    ).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(f"_n{i}")).alias(f"nulls{i}") for i in null],
        *tallies(list(verdict)),
    )
    rows = []
    for i, cast in enumerate(casts):
        codes = REASONS[cast.normalized] if i in verdict else ()
        failed = sum((F.col(f"n{i}_{r}") for r in range(len(codes))), F.lit(0).cast("bigint"))
        nulls, none = F.col(f"nulls{i}"), F.lit(0).cast("bigint")
        rejected = C.NULL_TARGET_INCOMPATIBLE if C.NULL_TARGET_INCOMPATIBLE in codes else None
        rows.append((i, None, F.col("total") - failed, none if rejected else nulls, None))
        for r, code in enumerate(codes):
            own = nulls if code == rejected else none
            rows.append((i, code, F.col(f"n{i}_{r}"), own, F.col(f"k{i}_{r}")))
    key_type = df.select(first).schema["_key"].dataType
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("cast_id"),
                F.lit(code).cast("string").alias("reason"),
                n.alias("n"),
                nulls.alias("nulls"),
                (F.lit(None).cast(key_type) if at is None else at).alias("first_key"),
            )
            for i, code, n, nulls, at in rows
        ]
    )
    return scanned.select(F.inline(listed)).where("reason IS NULL OR n > 0")


def _first_key(keys: Sequence[str]) -> Column:
    return quoted(keys[0]) if len(keys) == 1 else F.struct(*[quoted(k) for k in keys])


@exact_names
def cast_decision(
    df: DataFrame, casts: Sequence[Cast], key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The aggregate result of each cast proof, one row per cast (and per ``by`` group).

    Reason codes come in first-seen order, which for keyed data means by the smallest key that
    has each of them. Without ``by`` an empty table still gives its (SAFE) decision rows.
    """
    groups = list(by)
    failing = F.col("reason").isNotNull()
    if groups:
        found = verdicts(df, casts, keep=[*groups, *[k for k in key if k not in groups]])
        per_reason = found.groupBy(*groups, "cast_id", "reason").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("is_null")).alias("nulls"),
            F.min(F.when(failing, _first_key(key))).alias("first_key"),
        )
    else:
        per_reason = _counted_reasons(df, casts, key)
    joined = per_reason.groupBy(*groups, "cast_id").agg(
        F.sum("n").alias("total"),
        F.sum("nulls").alias("nulls"),
        F.sum(F.when(failing, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(~failing, F.col("n") - F.col("nulls")).otherwise(0)).alias("passing"),
        F.bool_or(F.col("reason") == C.UNSUPPORTED_SOURCE_VALUE).alias("unsupported"),
        F.array_sort(
            F.collect_list(F.when(failing, F.struct("first_key", "reason")))
        ).alias("reasons"),
    )

    def of_cast(values: Sequence[str | bool]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cast_id") + 1)

    joined = joined.withColumns(
        {
            "column_name": of_cast([c.column for c in casts]),
            "source_dtype": of_cast([logical_dtype(_field(df, c.column)) for c in casts]),
            "target_dtype": of_cast([c.normalized for c in casts]),
            "supported": of_cast([c.supported for c in casts]),
        }
    )
    total, nulls, failing_count = F.col("total"), F.col("nulls"), F.col("failing")
    non_null = total - nulls
    whole_column = ~F.col("supported") | (
        (F.col("target_dtype") == "object") & (failing_count > 0)
    )
    reasons = F.transform("reasons", lambda r: r["reason"])
    return joined.select(
        *groups,
        "column_name",
        F.when(~F.col("supported") | F.coalesce("unsupported", F.lit(False)), "UNSUPPORTED")
        .when(failing_count > 0, "UNSAFE")
        .otherwise("SAFE")
        .alias("status"),
        "source_dtype",
        "target_dtype",
        F.lit(C.POLICY_VERSION).alias("policy_version"),
        total.alias("total_count"),
        nulls.alias("null_count"),
        F.when(whole_column, 0).otherwise(F.col("passing")).cast("bigint").alias("converted_count"),
        F.when(whole_column, non_null).otherwise(failing_count).alias("failed_count"),
        F.when(whole_column, 1).otherwise(failing_count).cast("bigint")
        .alias("diagnostic_count"),
        F.when(~F.col("supported"), F.array(F.lit(C.UNSUPPORTED_TARGET_DTYPE)))
        .otherwise(reasons)
        .alias("reason_codes"),
    )


def _message(reason: Column, target: Column) -> Column:
    """Redacted text: it never holds the value."""
    return (
        F.when(reason == C.PARSE_ERROR, F.concat(F.lit("Not readable as "), target))
        .when(reason == C.FRACTIONAL_VALUE, F.concat(F.lit("Fraction not allowed in "), target))
        .when(reason == C.OUT_OF_RANGE, F.concat(F.lit("Beyond the range of "), target))
        .when(reason == C.PRECISION_LOSS, F.concat(F.lit("Not exact in "), target))
        .when(reason == C.AMBIGUOUS_BOOLEAN, F.lit("Not a known boolean token"))
        .when(reason == C.NON_FINITE_NUMBER, F.concat(F.lit("Not finite, so not a "), target))
        .when(reason == C.NULL_TARGET_INCOMPATIBLE, F.concat(F.lit("Null not allowed in "), target))
        .when(reason == C.UNSUPPORTED_SOURCE_VALUE, F.concat(F.lit("No converter to "), target))
        .when(reason == C.UNSUPPORTED_TARGET_DTYPE, F.concat(F.lit("No such cast target: "), target))
        .otherwise(F.concat(F.lit("Did not come back unchanged from "), target))
    )


@exact_names
def cast_diagnostics(df: DataFrame, casts: Sequence[Cast], key: Sequence[str]) -> DataFrame:
    """Every failing row by key: column, value type, target, reason, redacted message.

    A cast to an unknown target gives one row with null keys, as the column as a whole fails.
    """
    known = [c for c in casts if c.supported]
    key_fields = [_field(df, name) for name in key]
    parts = []
    if known:
        names = F.array(*[F.lit(c.column) for c in known])
        targets = F.array(*[F.lit(c.normalized) for c in known])
        at = F.col("cast_id") + 1
        parts.append(
            verdicts(df, known, keep=key)
            .where(F.col("reason").isNotNull())
            .select(
                *[quoted(k) for k in key],
                F.element_at(names, at).alias("column"),
                F.col("value_type").alias("source_value_type"),
                F.element_at(targets, at).alias("target_dtype"),
                F.col("reason").alias("reason_code"),
            )
        )
    unknown = [c for c in casts if not c.supported]
    if unknown:
        schema = T.StructType(
            [T.StructField(f.name, f.dataType) for f in key_fields]
            + [
                T.StructField(n, T.StringType())
                for n in ("column", "source_value_type", "target_dtype", "reason_code")
            ]
        )
        parts.append(
            df.sparkSession.createDataFrame(
                [
                    (
                        *[None] * len(key),
                        c.column,
                        logical_dtype(_field(df, c.column)),
                        c.normalized,
                        C.UNSUPPORTED_TARGET_DTYPE,
                    )
                    for c in unknown
                ],
                schema,
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("message", _message(F.col("reason_code"), F.col("target_dtype")))


@exact_names
def with_cast(df: DataFrame, cast: Cast) -> DataFrame:
    """The column replaced by its cast value, at the same position. Only valid after SAFE."""
    field = _field(df, cast.column)
    value = rules.converted(quoted(cast.column), field.dataType, cast.normalized)
    metadata = {"logical": "object"} if cast.normalized == "object" else {}
    return df.select(
        *[
            value.alias(name, metadata=metadata) if name == cast.column else quoted(name)
            for name in df.columns
        ]
    )


@exact_names
def materialize_check(df: DataFrame, casts: Sequence[Cast]) -> DataFrame:
    """After SAFE, before the write: counts, null places and every value rechecked in one pass."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("total_count")]
    for i, cast in enumerate(casts):
        data_type = _field(df, cast.column).dataType
        kind = rules.source_kind(data_type)
        original = quoted(cast.column)
        value = rules.converted(original, data_type, cast.normalized)
        was_null = rules.is_null(original, kind)
        same = rules.cast_back_equals(original, value, data_type, cast.normalized)
        widened = cast.normalized == "object" and kind != "string"
        now_null = rules.is_null(value, "variant") if widened else value.isNull()
        aggregates += [
            F.count_if(was_null).alias(f"nulls_before_{i}"),
            F.count_if(now_null).alias(f"nulls_after_{i}"),
            F.count_if(was_null != now_null).alias(f"null_moves_{i}"),
            F.count_if(~was_null & ~F.coalesce(same, F.lit(False))).alias(f"changed_{i}"),
        ]
    measured = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(c.column).alias("column_name"),
                F.lit(c.normalized).alias("target_dtype"),
                "total_count",
                F.col(f"nulls_before_{i}").alias("nulls_before"),
                F.col(f"nulls_after_{i}").alias("nulls_after"),
                F.col(f"changed_{i}").alias("changed_values"),
                ((F.col(f"changed_{i}") == 0) & (F.col(f"null_moves_{i}") == 0)).alias("verified"),
            )
            for i, c in enumerate(casts)
        ]
    )
    return measured.select(F.explode(rows).alias("r")).select("r.*")


@exact_names
def null_rules(df: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """How each target treats the column's nulls (NaN included): kept, or rejected with a reason."""
    null = rules.is_null(quoted(column), rules.source_kind(_field(df, column).dataType))
    counted = df.agg(F.count(F.lit(1)).alias("total_count"), F.count_if(null).alias("null_count"))
    targets = F.array(*[F.lit(t) for t in C.CAST_TARGETS])
    rejects = F.col("target_dtype").isin(*C.NULL_REJECTING_TARGETS)
    return counted.select(F.explode(targets).alias("target_dtype"), "total_count", "null_count").select(
        "target_dtype",
        "total_count",
        "null_count",
        F.when(rejects, F.col("null_count")).otherwise(0).cast("bigint").alias("null_failures"),
        F.when(rejects & (F.col("null_count") > 0), F.lit(C.NULL_TARGET_INCOMPATIBLE))
        .alias("reason_code"),
    )


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decision rows that break a rule, with the first rule broken."""
    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    def negative(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) < 0)

    texts = ("column_name", "source_dtype", "target_dtype", "policy_version")
    counts = ("total_count", "null_count", "converted_count", "failed_count", "diagnostic_count")
    codes = F.col("reason_codes")
    distinct_codes = F.size(F.array_distinct(codes))
    safe = F.col("status") == "SAFE"
    chain = F.when(
        F.coalesce(~F.col("status").isin(*C.CONVERSION_STATUSES), F.lit(True)), "INVALID_STATUS"
    )
    for name in texts:
        chain = chain.when(blank(name), f"EMPTY_{name.upper()}")
    for name in counts:
        chain = chain.when(negative(name), f"NEGATIVE_{name.upper()}")
    chain = (
        chain.when(
            codes.isNull() | F.exists(codes, lambda c: c.isNull() | (c == "")),
            "INVALID_REASON_CODE",
        )
        .when(distinct_codes != F.size(codes), "DUPLICATE_REASON_CODE")
        .when(F.col("diagnostic_count") < F.size(codes), "FEWER_DIAGNOSTICS_THAN_REASONS")
        .when(
            safe
            & (
                (F.col("failed_count") != 0)
                | (F.col("diagnostic_count") != 0)
                | (F.size(codes) > 0)
            ),
            "SAFE_WITH_FAILURES",
        )
        .when(~safe & (F.col("diagnostic_count") == 0), "NO_DIAGNOSTICS")
    )
    return decisions.withColumn("violation", chain).where(F.col("violation").isNotNull())


def decision_field_errors(payloads: DataFrame, column: str) -> DataFrame:
    """Stored decision JSON whose field set is not exactly the declared one."""
    names = F.json_object_keys(F.col(column))
    required = F.array(*[F.lit(f) for f in sorted(C.DECISION_FIELDS)])
    return payloads.select(
        "*",
        F.when(names.isNull(), F.lit("NOT_AN_OBJECT"))
        .when(F.size(F.array_except(required, names)) > 0, F.lit("MISSING_FIELDS"))
        .when(F.size(F.array_except(names, required)) > 0, F.lit("UNKNOWN_FIELDS"))
        .alias("field_error"),
    ).where(F.col("field_error").isNotNull())


def stale_decisions(plans: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whether each plan's stored decision still equals a fresh proof.

    ``plans``: dataset, action (text); ``stored`` and ``fresh``: dataset plus the decision fields.
    The three are joined on the dataset, one row each.
    """
    fields = [f for f in C.DECISION_FIELDS]
    left = plans.join(
        stored.select("dataset", F.struct(*fields).alias("stored")), "dataset", "left"
    ).join(fresh.select("dataset", F.struct(*fields).alias("fresh")), "dataset", "left")
    is_cast = F.col("action").startswith("CAST_COLUMN")
    outcome = (
        F.when(~is_cast & F.col("stored").isNotNull(), "UNEXPECTED_DECISION")
        .when(~is_cast, "NOT_A_CAST")
        .when(F.col("stored").isNull(), "NO_DECISION")
        .when(F.col("stored.status") != "SAFE", "NOT_SAFE")
        .when(~F.col("stored").eqNullSafe(F.col("fresh")), "STALE")
        .otherwise("CURRENT")
    )
    return left.select("dataset", "action", outcome.alias("outcome"))


@exact_names
def cast_values(df: DataFrame, cast: Cast, key: Sequence[str]) -> DataFrame:
    """Key, reason (null when the cast keeps the value) and cast value of every row."""
    data_type = _field(df, cast.column).dataType
    value = quoted(cast.column)
    keys = [quoted(k) for k in key]
    result = rules.converted(value, data_type, cast.normalized).alias("value")
    native = rules.reason(value, data_type, cast.normalized).alias("reason")
    return df.select(*keys, native, result)
