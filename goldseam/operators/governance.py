"""Rules over plans and tickets: proposing, deciding, selecting, routing, gating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from goldseam import constants as C
from goldseam.functions.actions import (
    cast_text,
    is_identifier,
    parse_action,
    rename_text,
    reorder_text,
    version_name,
)
from goldseam.functions.dtypes import (
    database_type_to_dtype,
    dtype_to_database_type,
    normalize_target,
)
from goldseam.operators.delta import wide_delta
from goldseam.operators.joining import left_join_known


# --- types ------------------------------------------------------------------------
def type_map_in(columns: DataFrame) -> DataFrame:
    """``columns`` (database_type) with the logical dtype; refused where there is none."""
    dtype = database_type_to_dtype(F.col("database_type"))
    return columns.withColumn("dtype", dtype).withColumn("refused", F.col("dtype").isNull())


def unpublishable(gold: DataFrame) -> DataFrame:
    """Gold columns whose dtype has no published type."""
    return gold.where(dtype_to_database_type(F.col("dtype")).isNull())


def target_normalize(plans: DataFrame) -> DataFrame:
    """``plans`` (target) with the normalized target and whether a cast to it exists."""
    return plans.withColumn("normalized", normalize_target(F.col("target"))).withColumn(
        "supported", F.col("normalized").isin(*C.CAST_TARGETS)
    )


# --- proposals ----------------------------------------------------------------------
def propose_repairs(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """All candidate plans of all datasets: one comparison, then plans made per delta row.

    A reorder when nothing but the order differs; a rename when one column went, one came and
    their types agree; for each type mismatch, in Gold order, a strict cast and one that would
    drop rows.
    """
    delta = wide_delta(observed, gold)
    no_text = F.lit(None).cast("string")
    no_order = F.lit(None).cast("array<string>")

    def plan(kind, column, target, order, drop, action, confidence, explanation) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            column.alias("column"),
            target.alias("target"),
            order.alias("target_order"),
            F.lit(drop).alias("drop_invalid"),
            action.alias("action"),
            F.lit(confidence).alias("confidence"),
            F.lit(explanation).alias("explanation"),
        )

    gold_order = F.transform("g_order", lambda c: c["column"])
    reorder_only = (
        F.col("reorder_event")
        & (F.size("missing") == 0)
        & (F.size("new") == 0)
        & (F.size("mismatches") == 0)
        & (F.size("g_order") > 0)
    )
    reorder = F.when(
        reorder_only,
        F.array(
            plan(
                "REORDER", no_text, no_text, gold_order, False, reorder_text(gold_order),
                C.REORDER_CONFIDENCE, "Same columns and types in another order.",
            )
        ),
    )
    one_for_one = (F.size("missing") == 1) & (F.size("new") == 1)
    rename = F.when(
        one_for_one & (F.try_element_at("new", F.lit(1))["dtype"]
                       == F.try_element_at("missing", F.lit(1))["dtype"]),
        F.array(
            plan(
                "RENAME",
                F.try_element_at("new", F.lit(1))["column"],
                F.try_element_at("missing", F.lit(1))["column"],
                no_order,
                False,
                rename_text(
                    F.try_element_at("new", F.lit(1))["column"],
                    F.try_element_at("missing", F.lit(1))["column"],
                ),
                C.RENAME_CONFIDENCE,
                "One column went, one came, with the same type.",
            )
        ),
    )
    casts = F.flatten(
        F.transform(
            "mismatches",
            lambda m: F.array(
                plan(
                    "CAST", m["column"], m["gold"], no_order, False,
                    cast_text(m["column"], m["gold"]),
                    C.STRICT_CAST_CONFIDENCE, "Type differs; every value must survive.",
                ),
                plan(
                    "CAST", m["column"], m["gold"], no_order, True,
                    cast_text(m["column"], m["gold"], drop_invalid=True),
                    C.DROP_INVALID_CONFIDENCE, "Type differs; rows that fail would be dropped.",
                ),
            ),
        )
    )
    nothing = F.filter(casts, lambda p: F.lit(False))
    every = F.concat(F.coalesce(reorder, nothing), F.coalesce(rename, nothing), casts)
    return delta.select(
        "dataset", F.posexplode(every).alias("proposal_ordinal", "plan")
    ).select("dataset", "proposal_ordinal", "plan.*")


# --- decisions ------------------------------------------------------------------------
def governance_decision(confidence: Column) -> Column:
    return (
        F.when(confidence >= C.AUTO_APPROVE_THRESHOLD, "AUTO_APPROVE")
        .when(confidence >= C.APPROVAL_THRESHOLD, "REQUIRES_HUMAN_APPROVAL")
        .otherwise("QUARANTINE")
    )


def orchestrator_decision(confidence: Column, risk: Column) -> Column:
    """Decision of the unattended mode, which also looks at the measured risk."""
    return (
        F.when(risk == "CRITICAL_RISK", "HARD_BLOCK")
        .when(confidence >= C.AUTO_APPROVE_THRESHOLD, "AUTO_APPLY")
        .when(
            (confidence >= C.APPROVAL_THRESHOLD) & risk.isin("LOW_RISK", "MEDIUM_RISK"),
            "AUTO_APPLY",
        )
        .otherwise("QUARANTINE")
    )


def select_plan(plans: DataFrame) -> DataFrame:
    """The best viable plan of each dataset.

    Quarantined plans are out; then keeping rows beats dropping them, then confidence, then the
    order of proposal. The limit on the rank lets Spark cut each task's rows before the shuffle.
    """
    viable = plans.where(governance_decision(F.col("confidence")) != "QUARANTINE")
    best_first = Window.partitionBy("dataset").orderBy(
        F.contains("action", F.lit(C.DROP_INVALID_MARKER)),
        F.desc("confidence"),
        "proposal_ordinal",
    )
    return (
        viable.withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def plan_route(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """Where each selected plan goes.

    ``selected``: dataset, kind, column, target, confidence, source_backed; ``decisions``: dataset,
    column_name, target_dtype, status. A cast is never approved without a human, and without a SAFE
    proof of its own column and target it gets no ticket at all. If that was proved several times,
    every proof must be SAFE.
    """
    proof = decisions.groupBy(
        F.col("dataset").alias("_dataset"),
        F.col("column_name").alias("_column"),
        F.col("target_dtype").alias("_to"),
    ).agg(F.max_by("status", F.col("status") != "SAFE").alias("status"))
    is_cast = F.col("kind") == "CAST"
    route = (
        F.when(is_cast & ~F.col("status").eqNullSafe(F.lit("SAFE")), "BLOCKED_BY_CONVERSION_SAFETY")
        .when(is_cast | F.col("source_backed"), "REQUIRES_HUMAN_APPROVAL")
        .otherwise(governance_decision(F.col("confidence")))
    )
    wanted = selected.withColumn("_target", normalize_target(F.col("target")))
    same = (
        (F.col("kind") == "CAST")
        & (F.col("dataset") == F.col("_dataset"))
        & (F.col("column") == F.col("_column"))
        & (F.col("_target") == F.col("_to"))
    )
    return (
        wanted.join(proof, same, "left")
        .withColumn("route", route)
        .drop("_target", "_dataset", "_column", "_to")
    )


# --- cast allowlist -----------------------------------------------------------------
class AllowlistError(ValueError):
    """The configured list of cast pairs is malformed."""


def parse_allowlist(text: str | None) -> list[tuple[str, str]]:
    """Pairs of a comma-separated ``source->target`` list; anything odd is refused."""
    if text is None or not text.strip():
        return []
    pairs: list[tuple[str, str]] = []
    for entry in (part.strip() for part in text.split(",")):
        sides = entry.split("->")
        if len(sides) != 2 or any(side != side.strip() for side in sides):
            raise AllowlistError(f"Not a source->target pair: {entry!r}.")
        pair = (sides[0].lower(), sides[1].lower())
        if not set(pair) <= set(C.CAST_TARGETS):
            raise AllowlistError(f"Unsupported type in {entry!r}.")
        if pair in pairs:
            raise AllowlistError(f"Repeated pair: {entry!r}.")
        pairs.append(pair)
    return pairs


def cast_allowlist(
    plans: DataFrame, observed: DataFrame, allowed: Sequence[tuple[str, str]]
) -> DataFrame:
    """Cast plans with the pair they need and whether it is allowed.

    The source type is the observed logical type of the column. The list is configuration: at
    most the sixteen pairs of the four cast types.
    """
    typed = plans.withColumn("a", parse_action(F.col("action"))).where(F.col("a.kind") == "CAST")
    source = observed.select(
        "dataset",
        F.col("column").alias("cast_column"),
        F.lower(F.trim("dtype")).alias("source_dtype"),
    )
    joined = typed.select(
        "dataset",
        "action",
        F.col("a.column").alias("cast_column"),
        F.lower(F.trim("a.target")).alias("target_dtype"),
        F.col("a.drop_invalid").alias("drop_invalid"),
        F.col("a.error").alias("error"),
    ).join(source, ["dataset", "cast_column"], "left")
    known = [f"{s}->{t}" for s, t in allowed]
    pair = F.concat("source_dtype", F.lit("->"), "target_dtype")
    listed = pair.isin(*known) if known else F.lit(False)
    outcome = (
        F.when(F.col("error").isNotNull(), "MALFORMED_ACTION")
        .when(F.col("drop_invalid"), "DROP_INVALID_FORBIDDEN")
        .when(F.col("source_dtype").isNull(), "SOURCE_COLUMN_MISSING")
        .when(
            ~F.col("source_dtype").isin(*C.CAST_TARGETS)
            | ~F.col("target_dtype").isin(*C.CAST_TARGETS),
            "UNSUPPORTED_PAIR",
        )
        .when(~listed, "PAIR_NOT_ALLOWED")
        .otherwise("ALLOWED")
    )
    return joined.select("dataset", "action", pair.alias("pair"), outcome.alias("outcome"))


# --- publication gates --------------------------------------------------------------
def safety_gates(
    facts: DataFrame, publication_schemas: Sequence[str] = ("gold_publish", "gold_publish_data")
) -> DataFrame:
    """First failing gate of each ticket, and whether it is a refusal or a conflict.

    Columns: ticket_id, schema_version_id, sandbox_applied, risk_level, integrity_status,
    original_row_count, final_row_count, action, logical_target, live_eligible, source_schema,
    confirmed, already_executed, target_busy.
    """
    def no(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    version = F.col("schema_version_id")
    gate = (
        F.when(version.isNull() | (version == ""), "SCHEMA_VERSION_MISSING")
        .when(no(F.col("sandbox_applied")), "SANDBOX_NOT_APPLIED")
        .when(no(F.col("risk_level") == "LOW_RISK"), "RISK_NOT_LOW")
        .when(no(F.col("integrity_status") == "NO_VOLUME_CHANGE"), "VOLUME_CHANGED")
        .when(no(F.col("original_row_count") == F.col("final_row_count")), "ROW_COUNTS_DIFFER")
        .when(F.contains("action", F.lit(C.DROP_INVALID_MARKER)), "DROP_INVALID_FORBIDDEN")
        .when(~is_identifier(F.col("logical_target")), "INVALID_TARGET")
        .when(no(F.col("live_eligible")), "NOT_LIVE_ELIGIBLE")
        .when(F.col("source_schema").isin(*publication_schemas), "SOURCE_IS_PUBLICATION")
        .when(no(F.col("confirmed")), "NOT_CONFIRMED")
        .when(F.col("already_executed"), "ALREADY_EXECUTED")
        .when(F.col("target_busy"), "TARGET_BUSY")
    )
    conflict = F.col("gate").isin("ALREADY_EXECUTED", "TARGET_BUSY")
    return facts.select("ticket_id", gate.alias("gate")).withColumn(
        "verdict",
        F.when(F.col("gate").isNull(), "PASS").when(conflict, "CONFLICT").otherwise("NOT_ALLOWED"),
    )


def output_match(manifests: DataFrame, executions: DataFrame) -> DataFrame:
    """Whether each execution recomputed exactly what was approved. No approved print, no match.

    ``manifests``: manifest_id, ticket_id, recorded_at, output_fingerprint. Of a ticket's manifests the
    latest counts. Executions without a ticket, which would all meet in one task, are not joined.
    """
    newest = F.struct("recorded_at", "manifest_id")
    approved = (
        manifests.where(F.col("ticket_id").isNotNull())
        .groupBy("ticket_id")
        .agg(F.max_by("output_fingerprint", newest).alias("approved"))
    )
    fresh = executions.select(
        "execution_id", "ticket_id", F.col("output_fingerprint").alias("recomputed")
    )
    outcome = (
        F.when(F.col("approved").isNull() | (F.col("approved") == ""), "NO_APPROVED_FINGERPRINT")
        .when(~F.col("approved").eqNullSafe(F.col("recomputed")), "MISMATCH")
        .otherwise("MATCH")
    )
    return left_join_known(fresh, approved, "ticket_id").select(
        "execution_id", "ticket_id", outcome.alias("outcome")
    )


def parse_actions(plans: DataFrame) -> DataFrame:
    """``plans`` (action) with its typed form and, where it is a valid reorder, canonical text."""
    typed = plans.withColumn("a", parse_action(F.col("action")))
    return typed.select(
        *[c for c in plans.columns],
        "a.*",
        F.when(F.col("a.target_order").isNotNull(), reorder_text(F.col("a.target_order"))).alias(
            "canonical_text"
        ),
    )


def identifier_gate(names: DataFrame) -> DataFrame:
    """``names`` (name, execution_hex) with validity and, for valid names, the version name."""
    valid = is_identifier(F.col("name"))
    return names.withColumn("valid", valid).withColumn(
        "version_name",
        F.when(F.col("valid"), version_name(F.col("name"), F.col("execution_hex"))),
    )
