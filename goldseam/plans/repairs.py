"""One repair, all or nothing, with its audit row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from goldseam import constants as C
from goldseam.functions.dtypes import logical_dtype
from goldseam.operators.cast import Cast
from goldseam.operators.repair import integrity_status, preservation_proof, risk_level
from goldseam.plans.evidence import Evidence, gather, typed_action

Columns = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class RepairResult:
    """What a repair gave: the data (unchanged when not applied) and its audit row."""

    data: DataFrame
    applied: bool
    outcome: str
    decision: Row | None
    manifest: DataFrame


def apply_repair(
    df: DataFrame,
    action: str,
    gold_columns: Columns,
    key: Sequence[str],
    *,
    mode: str = "sandbox",
    operator: str = "system",
    as_of: str,
    allowed_pairs: Sequence[tuple[str, str]] | None = None,
) -> RepairResult:
    """Run one repair action against the data.

    Counts, cast proof, recheck of the cast values and both fingerprints come from one scan; a
    reorder is compared with the original as well. Whatever fails leaves the data untouched and is
    reported with a stable outcome code. In live mode a cast must be on the allowlist.
    """
    plan = typed_action(df, action)
    refusal = _refusal(df, plan, gold_columns, mode, set(allowed_pairs or ()))
    found = gather(df, action, key, refusal)
    applied, outcome = found.corrected is not None, found.outcome
    if applied and plan.kind == "REORDER":
        proof = preservation_proof(df, found.corrected, plan.target_order).first().outcome
        applied, outcome = proof == "PRESERVED", outcome if proof == "PRESERVED" else proof
    data = found.corrected if applied else df
    matches = applied and list(data.columns) == [name for name, _ in gold_columns]
    if applied and not matches:
        outcome = f"{outcome}_WITH_SCHEMA_MISMATCH"
    manifest = healing_manifest(
        df, action, found, applied, matches, outcome, mode, operator, as_of, plan.kind
    )
    return RepairResult(data, applied, outcome, found.decision, manifest)


def _refusal(
    df: DataFrame, plan: Row, gold_columns: Columns, mode: str, allowed: set[tuple[str, str]]
) -> str | None:
    """Why the schemas alone forbid the action, or None."""
    if plan.error is not None:
        return plan.error
    seen = {f.name: logical_dtype(f) for f in df.schema.fields}
    if plan.kind == "CAST" and mode == "live" and plan.column in seen and not plan.drop_invalid:
        if (seen[plan.column], Cast(plan.column, plan.target).normalized) not in allowed:
            return "CAST_PAIR_NOT_ALLOWED"
    if plan.kind == "REORDER":
        gold_order = [name for name, _ in gold_columns]
        if list(plan.target_order) != gold_order:
            return "TARGET_NOT_GOLD_ORDER"
        if seen != dict(gold_columns) or list(df.columns) == gold_order:
            return "NOT_REORDER_ONLY"
    return None


def healing_manifest(
    df: DataFrame,
    action: str,
    found: Evidence,
    applied: bool,
    matches: bool,
    outcome: str,
    mode: str,
    operator: str,
    as_of: str,
    kind: str | None,
) -> DataFrame:
    """The audit row of one execution, with the fingerprint of the data it left."""
    versions = dict(C.COMPONENT_VERSIONS)
    if found.decision is not None:
        versions["type_repair"] = found.decision.policy_version
    if kind == "REORDER":
        versions["column_order"] = C.REORDER_POLICY_VERSION
    decision = tuple(found.decision) if found.decision is not None else None
    row = df.sparkSession.createDataFrame(
        [
            (
                as_of, action, applied, matches, outcome, mode, operator, versions, found.row_count,
                found.output_row_count if applied else found.row_count, decision,
                found.output_fingerprint if applied else found.source_fingerprint,
            )
        ],
        "as_of string, action string, applied boolean, matches_gold_order boolean, outcome string, "
        "execution_mode string, operator string, component_versions map<string,string>, "
        "original_row_count bigint, final_row_count bigint, decision struct<column_name:string,"
        "status:string,source_dtype:string,target_dtype:string,policy_version:string,"
        "total_count:bigint,null_count:bigint,converted_count:bigint,failed_count:bigint,"
        "diagnostic_count:bigint,reason_codes:array<string>>, corrected_output_fingerprint string",
    )
    before, after = F.col("original_row_count"), F.col("final_row_count")
    return row.select(
        F.col("as_of").cast("timestamp_ntz").alias("recorded_at"),
        "action",
        "applied",
        "matches_gold_order",
        "outcome",
        "execution_mode",
        "operator",
        "component_versions",
        "original_row_count",
        "final_row_count",
        integrity_status(before, after).alias("integrity_status"),
        risk_level(F.col("applied"), before, after).alias("risk_level"),
        F.to_json("decision").alias("conversion_outcome"),
        "corrected_output_fingerprint",
    )
