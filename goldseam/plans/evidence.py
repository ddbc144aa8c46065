"""Everything a repair must prove about the data, from one scan.

Count and fingerprint of the source, the cast proof, and the fingerprint of the corrected output
are all plain aggregates, so they share one pass over the table and nothing but one row per task
is shuffled. Approval and execution each read the source once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F, types as T

from goldseam import constants as C
from goldseam.functions import cast_rules as rules
from goldseam.functions.actions import parse_action
from goldseam.functions.dtypes import logical_dtype
from goldseam.functions.encoding import quoted, schema_header
from goldseam.operators.cast import REASONS, Cast, cast_decision, with_cast
from goldseam.operators.fingerprint import (
    aggregated_with_sets,
    fingerprint_aggregates,
    fingerprint_digest,
    row_digest,
    set_digest,
)
from goldseam.operators.repair import RepairRefused, rename_column, reorder_columns
from goldseam.session import exact_names

@dataclass(frozen=True)
class Evidence:
    """What one scan showed. ``corrected`` is None where the action cannot be applied."""

    row_count: int
    source_fingerprint: str
    outcome: str
    decision: Row | None
    corrected: DataFrame | None
    output_row_count: int | None
    output_fingerprint: str | None
    # Only where the sets were asked for.
    source_set: str | None = None
    output_set: str | None = None


def typed_action(df: DataFrame, action: str) -> Row:
    row = df.sparkSession.createDataFrame([(action,)], "action string")
    return row.select(parse_action(F.col("action")).alias("a")).select("a.*").first()


def corrected_frame(df: DataFrame, plan: Row) -> tuple[DataFrame | None, Cast | None, str]:
    """The projection an action stands for, by schema alone; a cast still has to be proved."""
    if plan.error is not None:
        return None, None, plan.error
    if plan.drop_invalid:
        return None, None, "DROP_INVALID_FORBIDDEN"
    try:
        if plan.kind == "RENAME":
            return rename_column(df, plan.column, plan.target), None, "RENAMED"
        if plan.kind == "REORDER":
            return reorder_columns(df, plan.target_order), None, "REORDERED"
    except RepairRefused:
        return None, None, f"{plan.kind}_REFUSED"
    if plan.column not in df.columns:
        return None, None, "CAST_SOURCE_MISSING"
    cast = Cast(plan.column, plan.target)
    if not cast.supported:
        return None, cast, "CAST_UNSUPPORTED"
    return with_cast(df, cast), cast, "CAST_PENDING"


@exact_names
def gather(
    df: DataFrame, action: str, key: Sequence[str], refusal: str | None = None, sets: bool = False
) -> Evidence:
    """Prove one action on one table, in one scan. A refused action is measured, not proved.

    With ``sets`` the same scan also yields the set fingerprints, which withstand crafted rows.
    """
    plan = typed_action(df, action)
    corrected, cast, outcome = (
        (None, None, refusal) if refusal is not None else corrected_frame(df, plan)
    )
    # First every original column, next to the cast value; then the digests of both forms of the
    # row; then the aggregates. Each step uses the one before, so nothing is computed twice.
    places = {n: f"_b{i}" for i, n in enumerate(df.columns)}
    fields = [quoted(n).alias(place) for n, place in places.items()]
    if cast is not None and corrected is not None:
        data_type = df.schema[cast.column].dataType
        fields.append(rules.converted(quoted(cast.column), data_type, cast.normalized).alias("_v"))
    rows = df.select(*fields)
    parts = [row_digest(df, at=lambda n: F.col(places[n])).alias("_source")]
    aggregates = fingerprint_aggregates("_source", "s_")
    prints = [fingerprint_digest(schema_header(df), "s_").alias("source")]
    if corrected is not None:
        after = _places_after(corrected, plan, places)
        parts.append(row_digest(corrected, at=lambda n: F.col(after[n])).alias("_output"))
        aggregates += fingerprint_aggregates("_output", "o_")
        prints.append(fingerprint_digest(schema_header(corrected), "o_").alias("output"))
    if cast is not None and corrected is not None:
        proof, counts = _cast_aggregates(df, cast, F.col(places[cast.column]), key, places)
        parts += proof
        aggregates += counts
    digests = ["_source"] if corrected is None else ["_source", "_output"]
    found = rows.select(*parts)
    if sets:
        found = aggregated_with_sets(found, digests, aggregates)
        prints.append(set_digest(schema_header(df), "s_row_count", "_source_lanes").alias("source_set"))
        if corrected is not None:
            prints.append(set_digest(schema_header(corrected), "o_row_count", "_output_lanes").alias("output_set"))
    else:
        found = found.agg(*aggregates)
    row = found.select("*", *prints).first()
    decision = None
    if cast is not None:
        decision = _decision(df, cast, key, row if corrected is not None else None)
        outcome = f"CAST_{decision.status}"
        if decision.status == "SAFE" and (row.changed or row.moved):
            # The values that would be written are not the ones that were proved.
            outcome = "CAST_ERROR"
        if outcome != "CAST_SAFE":
            corrected = None
    return Evidence(
        row.s_row_count,
        row.source,
        outcome,
        decision,
        corrected,
        row.o_row_count if corrected is not None else None,
        row.output if corrected is not None else None,
        row.source_set if sets else None,
        row.output_set if sets and corrected is not None else None,
    )


def _places_after(corrected: DataFrame, plan: Row, places: dict[str, str]) -> dict[str, str]:
    if plan.kind == "RENAME":
        return {n: places[plan.column if n == plan.target else n] for n in corrected.columns}
    if plan.kind == "CAST":
        return {n: "_v" if n == plan.column else places[n] for n in corrected.columns}
    return {n: places[n] for n in corrected.columns}


def _cast_aggregates(df, cast, value, key, places):
    data_type = df.schema[cast.column].dataType
    null = rules.is_null(value, rules.source_kind(data_type))
    first = (
        F.col(places[key[0]]) if len(key) == 1 else F.struct(*[F.col(places[k]) for k in key])
    )
    widened = cast.normalized == "object" and not isinstance(data_type, T.StringType)
    gone = rules.is_null(F.col("_v"), "variant") if widened else F.col("_v").isNull()
    back = rules.cast_back_equals(value, F.col("_v"), data_type, cast.normalized)
    parts = [
        null.alias("_null"),
        (null != gone).alias("_moved"),
        (~null & ~F.coalesce(back, F.lit(False))).alias("_changed"),
    ]
    aggregates = [
        F.count_if(F.col("_null")).alias("nulls"),
        F.count_if(F.col("_moved")).alias("moved"),
        F.count_if(F.col("_changed")).alias("changed"),
    ]
    if cast.normalized != "object":
        parts += [rules.reason(value, data_type, cast.normalized).alias("_reason"), first.alias("_key")]
        for i, code in enumerate(REASONS[cast.normalized]):
            hit = F.col("_reason") == code
            aggregates.append(F.count_if(hit).alias(f"n_{i}"))
            aggregates.append(F.min(F.when(hit, F.col("_key"))).alias(f"k_{i}"))
    return parts, aggregates


def _decision(df: DataFrame, cast: Cast, key: Sequence[str], row: Row | None) -> Row:
    """The decision from the scan's aggregates, or a proof of its own where they cannot tell."""
    told = {} if row is None else row.asDict()
    if row is None or cast.normalized == "object":
        return cast_decision(df, [cast], key).first()
    codes = REASONS[cast.normalized]
    seen = sorted(
        (told[f"k_{i}"], code) for i, code in enumerate(codes) if told[f"n_{i}"]
    )
    failed = sum(told[f"n_{i}"] for i in range(len(codes)))
    rejected_nulls = told["nulls"] if cast.normalized in C.NULL_REJECTING_TARGETS else 0
    converted = told["s_row_count"] - told["nulls"] - (failed - rejected_nulls)
    names = [code for _, code in seen]
    status = (
        "UNSUPPORTED" if C.UNSUPPORTED_SOURCE_VALUE in names else "UNSAFE" if failed else "SAFE"
    )
    values = (
        cast.column, status, logical_dtype(df.schema[cast.column]), cast.normalized,
        C.POLICY_VERSION, told["s_row_count"], told["nulls"], converted, failed, failed, names,
    )
    return Row(**dict(zip(C.DECISION_FIELDS, values, strict=True)))
