"""Append-only ledgers: versions, identities, runs, tickets, manifests, markers, executions.

State is folded from rows, never updated. Folds are aggregates wherever order allows it, so a
busy ticket, target or execution is reduced in every task before it is shuffled. The two places
that need neighbours or numbers in sequence (``register_versions``, ``execution_transitions``)
cut the sorted rows into pieces of about equal size and join the pieces up afterwards, so one key's
history is not one task's work, even if all of it happened at one moment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from goldseam import constants as C
from goldseam.functions.actions import is_identifier
from goldseam.functions.dtypes import all_registrable
from goldseam.operators.fingerprint import gold_fingerprint
from goldseam.operators.joining import left_join_known
from goldseam.operators.ordering import in_pieces


def _blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


# --- Gold versions ---------------------------------------------------------------
def definition_error(candidate: DataFrame) -> Column:
    """First rule a Gold definition breaks, or null.

    Columns used: schema_name, format_version, columns (name, dtype), created_by.
    """
    columns = F.col("columns")
    names = F.transform(columns, lambda c: c["name"])
    return (
        F.when(~F.coalesce(F.col("schema_name").rlike(C.SCHEMA_NAME), F.lit(False)), "INVALID_NAME")
        .when(
            ~F.coalesce(F.col("format_version") == C.GOLD_FORMAT_VERSION, F.lit(False)),
            "UNSUPPORTED_FORMAT_VERSION",
        )
        .when(columns.isNull() | (F.size(columns) == 0), "NO_COLUMNS")
        .when(F.exists(names, _blank), "EMPTY_COLUMN_NAME")
        .when(F.size(F.array_distinct(names)) != F.size(names), "DUPLICATE_COLUMN_NAME")
        .when(
            ~F.coalesce(all_registrable(F.transform(columns, lambda c: c["dtype"])), F.lit(False)),
            "UNSUPPORTED_DTYPE",
        )
        .when(_blank(F.col("created_by")), "NO_AUTHOR")
    )


def register_versions(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each candidate: REGISTERED with its number, DUPLICATE_DEFINITION or the rule broken.

    ``candidates``: candidate_id, schema_name, format_version, columns, created_by, submitted_at;
    ``existing``: schema_name, version_number, fingerprint. Candidates count in order of
    (submitted_at, candidate_id); of equal definitions the first is registered. One that is valid but
    has no time cannot be ordered: NO_SUBMISSION_TIME. Numbers go on from the family's highest:
    counted per family and piece of the sorted candidates, then offset by the pieces before.
    """
    error = F.coalesce(
        definition_error(candidates), F.when(F.col("submitted_at").isNull(), "NO_SUBMISSION_TIME")
    )
    checked = gold_fingerprint(candidates.withColumn("error", error)).withColumn(
        "moment", F.struct("submitted_at", "candidate_id")
    )
    valid = checked.where(F.col("error").isNull())
    firsts = valid.groupBy("schema_name", "fingerprint").agg(F.min("moment").alias("moment"))
    fresh = firsts.join(
        existing.select("schema_name", "fingerprint"), ["schema_name", "fingerprint"], "left_anti"
    ).select(
        "schema_name",
        "fingerprint",
        F.col("moment.candidate_id").alias("candidate_id"),
        F.col("moment.submitted_at").alias("submitted_at"),
    )
    fresh = in_pieces(
        fresh, "schema_name", ["submitted_at", "candidate_id"], "piece", "version-candidates"
    )
    highest = existing.groupBy("schema_name").agg(F.max("version_number").alias("highest"))
    earlier_pieces = Window.partitionBy("schema_name").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        fresh.groupBy("schema_name", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier_pieces), F.lit(0)))
        .join(highest, "schema_name", "left")
        .select(
            "schema_name",
            "piece",
            (F.coalesce("highest", F.lit(0)) + F.col("before")).alias("offset"),
        )
    )
    within_piece = Window.partitionBy("schema_name", "piece").orderBy("submitted_at", "candidate_id")
    numbered = (
        fresh.withColumn("place", F.row_number().over(within_piece))
        .join(offsets, ["schema_name", "piece"])
        .select("candidate_id", (F.col("offset") + F.col("place")).alias("version_number"))
    )
    return checked.join(numbered, "candidate_id", "left").select(
        "candidate_id",
        "schema_name",
        F.when(F.col("error").isNull(), F.col("fingerprint")).alias("fingerprint"),
        F.coalesce(
            "error",
            F.when(F.col("version_number").isNotNull(), "REGISTERED").otherwise(
                "DUPLICATE_DEFINITION"
            ),
        ).alias("outcome"),
        F.col("version_number").cast("bigint").alias("version_number"),
    )


def gold_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The versions asked for by (schema_name, version_number); null columns where there is none."""
    return wanted.join(versions, ["schema_name", "version_number"], "left")


def gold_latest(versions: DataFrame) -> DataFrame:
    """Highest version of each family, with all its columns."""
    rest = [c for c in versions.columns if c not in ("schema_name", "version_number")]
    return (
        versions.groupBy("schema_name")
        .agg(
            F.max("version_number").alias("version_number"),
            F.max_by(F.struct(*rest), "version_number").alias("v"),
        )
        .select("schema_name", "version_number", *[F.col(f"v.{c}").alias(c) for c in rest])
    )


def gold_history(versions: DataFrame) -> DataFrame:
    """All versions, newest first within a family."""
    return versions.orderBy("schema_name", F.desc("version_number"))


# --- identities --------------------------------------------------------------------
def identity(natural_key: Sequence[str]) -> Column:
    """Surrogate key from the natural one, so that parallel runs agree on it."""
    framed = [
        F.concat(F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c)) for c in natural_key
    ]
    return F.sha2(F.concat(*framed), 256)


def resolve_identities(
    incoming: DataFrame, dimension: DataFrame, natural_key: Sequence[str], id_column: str
) -> DataFrame:
    """Each distinct natural key with its id and whether it is new to the dimension.

    Keys with a part that is no identifier have no id and are marked invalid. ``distinct`` folds
    repeats before the shuffle, so a source seen a billion times moves once per task.
    """
    names = [c for c in natural_key if c.endswith(("schema", "table", "target"))]
    valid = F.lit(True)
    for name in names:
        valid = valid & is_identifier(F.col(name))
    known = dimension.select(*natural_key, F.col(id_column).alias("known_id"))
    return (
        incoming.select(*natural_key)
        .distinct()
        .join(known, list(natural_key), "left")
        .withColumn(
            "status",
            F.when(F.col("known_id").isNotNull(), "EXISTING")
            .when(valid, "NEW")
            .otherwise("INVALID_IDENTIFIER"),
        )
        .select(
            *natural_key,
            F.coalesce(
                "known_id", F.when(F.col("status") == "NEW", identity(natural_key))
            ).alias(id_column),
            "status",
        )
    )


# --- runs ----------------------------------------------------------------------------
def check_runs(
    runs: DataFrame, datasets: DataFrame, snapshots: DataFrame, ledger: DataFrame
) -> DataFrame:
    """``runs`` to append, with the first rule each one breaks (null: it may be appended).

    ``ledger`` holds the runs already recorded, which baselines must come from.
    """
    dataset = datasets.select("dataset_id", F.lit(True).alias("dataset_known"))
    snapshot = snapshots.select("snapshot_id", F.col("dataset_id").alias("snapshot_dataset"))
    baseline = ledger.select(
        F.col("run_id").alias("baseline_run_id"),
        F.col("dataset_id").alias("baseline_dataset"),
        F.col("purpose").alias("baseline_purpose"),
        F.col("outcome").alias("baseline_outcome"),
    )
    has_snapshot = F.col("snapshot_id").isNotNull()
    has_baseline = F.col("baseline_run_id").isNotNull()
    simulation = F.col("purpose") == "SIMULATION"
    allowed = F.when(simulation, F.col("outcome").isin("CAPTURED", "FAILED")).otherwise(
        F.col("outcome").isin("MATCHED", "DRIFTED", "FAILED")
    )
    failed = F.col("outcome") == "FAILED"
    code, text = F.col("failure_code"), F.col("failure_reason")
    violation = (
        F.when(F.col("dataset_known").isNull(), "UNKNOWN_DATASET")
        .when(~F.coalesce(F.col("purpose").isin(*C.RUN_PURPOSES), F.lit(False)), "INVALID_PURPOSE")
        .when(~F.coalesce(allowed, F.lit(False)), "INVALID_OUTCOME")
        .when(F.col("started_at").isNull() | F.col("completed_at").isNull(), "MISSING_TIME")
        .when(F.col("completed_at") < F.col("started_at"), "TIMES_REVERSED")
        .when(has_snapshot & F.col("snapshot_dataset").isNull(), "UNKNOWN_SNAPSHOT")
        .when(has_snapshot & (F.col("snapshot_dataset") != F.col("dataset_id")), "SNAPSHOT_OF_OTHER_DATASET")
        .when(has_baseline & F.col("baseline_dataset").isNull(), "UNKNOWN_BASELINE")
        .when(has_baseline & (F.col("baseline_dataset") != F.col("dataset_id")), "BASELINE_OF_OTHER_DATASET")
        .when(
            has_baseline
            & ((F.col("baseline_purpose") != "SIMULATION") | (F.col("baseline_outcome") != "CAPTURED")),
            "BASELINE_NOT_CAPTURED",
        )
        .when(simulation & has_baseline, "SIMULATION_WITH_BASELINE")
        .when((F.col("outcome") == "CAPTURED") & ~has_snapshot, "CAPTURE_WITHOUT_SNAPSHOT")
        .when(~simulation & ~has_baseline, "REVALIDATION_WITHOUT_BASELINE")
        .when(F.col("outcome").isin("MATCHED", "DRIFTED") & ~has_snapshot, "REVALIDATION_WITHOUT_SNAPSHOT")
        .when(failed & ~F.coalesce(code.rlike(C.FAILURE_CODE), F.lit(False)), "INVALID_FAILURE_CODE")
        .when(
            failed & text.isNotNull() & ((text == "") | (F.length(text) > C.FAILURE_REASON_MAX_LENGTH)),
            "INVALID_FAILURE_REASON",
        )
        .when(~failed & (code.isNotNull() | text.isNotNull()), "DIAGNOSTICS_ON_SUCCESS")
        .when(F.col("requested_by").isNotNull() & _blank(F.col("requested_by")), "BLANK_REQUESTER")
    )
    return (
        left_join_known(
            left_join_known(runs.join(dataset, "dataset_id", "left"), snapshot, "snapshot_id"),
            baseline,
            "baseline_run_id",
        ).select(*[F.col(c) for c in runs.columns], violation.alias("violation"))
    )


def list_runs(runs: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Runs by completion time, then id; of one dataset, or of all with the dataset first."""
    if dataset_id is not None:
        return runs.where(F.col("dataset_id") == dataset_id).orderBy("completed_at", "run_id")
    return runs.orderBy("dataset_id", "completed_at", "run_id")


REVALIDATION_FACTS = (
    ("PRIMARY_KEY", "source_primary_key"),
    ("ROW_COUNT", "source_row_count"),
    ("SCHEMA_FINGERPRINT", "source_schema_fingerprint"),
    ("DATASET_FINGERPRINT", "source_dataset_fingerprint"),
)


def revalidate(fresh: DataFrame, baselines: DataFrame) -> DataFrame:
    """MATCHED or DRIFTED for each fresh read against its baseline, with what drifted.

    ``fresh``: run_id, baseline_run_id and the four facts; ``baselines``: run_id and the facts.
    """
    base = baselines.select(
        F.col("run_id").alias("baseline_run_id"),
        F.struct(*[F.col(c) for _, c in REVALIDATION_FACTS]).alias("base"),
    )
    drifted = F.array_compact(
        F.array(
            *[
                F.when(~F.col(c).eqNullSafe(F.col(f"base.{c}")), F.lit(name))
                for name, c in REVALIDATION_FACTS
            ]
        )
    )
    return (
        fresh.join(base, "baseline_run_id")
        .withColumn("drifted", drifted)
        .select(
            "run_id",
            "baseline_run_id",
            F.when(F.size("drifted") > 0, "DRIFTED").otherwise("MATCHED").alias("outcome"),
            "drifted",
        )
    )


# --- tickets ---------------------------------------------------------------------------
_PROVENANCE = (
    "source_schema", "source_table", "source_primary_key", "source_row_count",
    "source_schema_fingerprint", "source_dataset_fingerprint",
)


def ticket_lineage(
    tickets: DataFrame, runs: DataFrame, snapshots: DataFrame, gold_versions: DataFrame
) -> DataFrame:
    """Whether each ticket can be replayed from what it names; mismatching facts by name.

    ``tickets``: ticket_id, embedded, run_id, the six provenance facts, schema_version_id,
    gold_columns, action, live_eligible. ``snapshots`` carry the source's schema and table.
    """
    run = runs.select(
        "run_id",
        F.col("dataset_id").alias("run_dataset"),
        F.col("snapshot_id").alias("run_snapshot"),
        ((F.col("purpose") == "SIMULATION") & (F.col("outcome") == "CAPTURED")).alias("captured"),
    )
    snapshot = snapshots.select(
        F.col("snapshot_id").alias("run_snapshot"),
        F.col("dataset_id").alias("snapshot_dataset"),
        F.struct(*_PROVENANCE).alias("s"),
    )
    version = gold_versions.select("schema_version_id", F.col("columns").alias("registered"))
    joined = left_join_known(tickets, run, "run_id")
    joined = left_join_known(joined, snapshot, "run_snapshot")
    joined = left_join_known(joined, version, "schema_version_id")
    mismatches = F.array_compact(
        F.array(
            *[F.when(~F.col(c).eqNullSafe(F.col(f"s.{c}")), F.lit(c)) for c in _PROVENANCE]
        )
    )
    has_run = F.col("run_id").isNotNull()
    registered_reorder = (
        F.col("action").startswith("REORDER_COLUMNS") & F.col("schema_version_id").isNotNull()
    )
    outcome = (
        F.when(F.col("embedded") == has_run, "REPLAY_SOURCE_NOT_UNIQUE")
        .when(F.col("live_eligible") & ~has_run, "LIVE_WITHOUT_LINEAGE")
        .when(registered_reorder & F.col("registered").isNull(), "GOLD_VERSION_MISSING")
        .when(registered_reorder & (F.col("registered") != F.col("gold_columns")), "GOLD_VERSION_DIFFERS")
        .when(~has_run, "VALID")
        .when(~F.coalesce("captured", F.lit(False)), "RUN_NOT_CAPTURED")
        .when(F.col("s").isNull(), "SNAPSHOT_MISSING")
        .when(F.col("snapshot_dataset") != F.col("run_dataset"), "SNAPSHOT_OF_OTHER_DATASET")
        .when(F.size(mismatches) > 0, "PROVENANCE_DIFFERS")
        .otherwise("VALID")
    )
    return joined.select("ticket_id", outcome.alias("outcome"), mismatches.alias("m")).select(
        "ticket_id",
        "outcome",
        F.when(F.col("outcome") == "PROVENANCE_DIFFERS", F.col("m"))
        .otherwise(F.array().cast("array<string>"))
        .alias("mismatches"),
    )


def ticket_states(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current state of each ticket: PENDING until its first valid decision, which stands.

    ``decisions``: ticket_id, decision_id, decision, operator, decided_at. Valid are APPROVED and
    REJECTED by a named operator. ``refused_decisions`` counts the others.
    """
    valid = F.col("decision").isin("APPROVED", "REJECTED") & ~_blank(F.col("operator"))
    folded = decisions.groupBy("ticket_id").agg(
        F.min(
            F.when(valid, F.struct("decided_at", "decision_id", "decision", "operator"))
        ).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    return tickets.join(folded, "ticket_id", "left").select(
        *[F.col(c) for c in tickets.columns],
        F.coalesce("first.decision", F.lit("PENDING")).alias("status"),
        F.col("first.decision_id").alias("decision_id"),
        F.col("first.operator").alias("decided_by"),
        F.col("first.decided_at").alias("decided_at"),
        (
            F.coalesce("n", F.lit(0)) - F.when(F.col("first").isNotNull(), 1).otherwise(0)
        ).cast("bigint").alias("refused_decisions"),
    )


def pending_tickets(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tickets no valid decision was made on."""
    valid = F.col("decision").isin("APPROVED", "REJECTED") & ~_blank(F.col("operator"))
    return tickets.join(decisions.where(valid).select("ticket_id"), "ticket_id", "left_anti")


def manifest_audit(tickets: DataFrame, manifests: DataFrame) -> DataFrame:
    """First way in which a ticket's latest manifest disagrees with the ticket.

    ``tickets``: ticket_id, action, confidence, schema_version_id, run_id, decision;
    ``manifests``: ticket_id, manifest_id, recorded_at, execution_mode, action, confidence,
    schema_version_id, run_id, decision, decision_valid.
    """
    fields = (
        "execution_mode", "action", "confidence", "schema_version_id", "run_id", "decision",
        "decision_valid",
    )
    latest = manifests.groupBy("ticket_id").agg(
        F.max_by(F.struct("manifest_id", *fields), F.struct("recorded_at", "manifest_id")).alias("m")
    )
    is_cast = F.col("action").startswith("CAST_COLUMN")
    verdict = (
        F.when(F.col("m").isNull(), "NO_MANIFEST")
        .when(F.col("m.execution_mode") != "sandbox", "NOT_SANDBOX")
        .when(is_cast & F.col("m.decision").isNull(), "NO_CAST_OUTCOME")
        .when(is_cast & ~F.col("m.decision_valid"), "INVALID_CAST_OUTCOME")
        .when(is_cast & ~F.col("m.decision").eqNullSafe(F.col("decision")), "CAST_OUTCOME_DIFFERS")
        .when(~is_cast & F.col("m.decision").isNotNull(), "UNEXPECTED_CAST_OUTCOME")
        .when(~F.col("m.schema_version_id").eqNullSafe(F.col("schema_version_id")), "VERSION_DIFFERS")
        .when(
            ~F.col("m.action").eqNullSafe(F.col("action"))
            | ~F.col("m.confidence").eqNullSafe(F.col("confidence")),
            "PLAN_DIFFERS",
        )
        .when(~F.col("m.run_id").eqNullSafe(F.col("run_id")), "RUN_DIFFERS")
        .otherwise("CONSISTENT")
    )
    return tickets.join(latest, "ticket_id", "left").select(
        "ticket_id", F.col("m.manifest_id").alias("manifest_id"), verdict.alias("outcome")
    )


# --- markers -------------------------------------------------------------------------------
def latest_marker(markers: DataFrame) -> DataFrame:
    """What is published now, per target: the newest marker says it, publish or rollback."""
    rest = [c for c in markers.columns if c != "logical_target"]
    return (
        markers.groupBy("logical_target")
        .agg(
            F.max_by(F.struct(*rest), F.struct("recorded_at", "marker_id")).alias("m")
        )
        .select("logical_target", *[F.col(f"m.{c}").alias(c) for c in rest])
    )


def _with_marks(executions: DataFrame, markers: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Outcome of each (execution, operation) and the version its matching marker names.

    Markers are folded per target first, so repeats of one operation do not pile up in the join.
    """
    marks = (
        markers.groupBy("execution_id", "operation", "target_id")
        .agg(F.min_by("physical_table", F.struct("recorded_at", "marker_id")).alias("marked_table"))
        .withColumnRenamed("target_id", "marker_target")
        .withColumn("marked", F.lit(True))
    )
    same = F.col("marked") & F.col("marker_target").eqNullSafe(F.col("target_id"))
    return (
        executions.join(marks, ["execution_id", "operation"], "left")
        .groupBy("execution_id", "operation", *keep)
        .agg(
            F.bool_or(same).alias("same"),
            F.count("marked").alias("n"),
            F.max(F.when(same, F.col("marked_table"))).alias("physical_table"),
        )
        .select(
            "execution_id",
            "operation",
            *keep,
            F.when(F.coalesce("same", F.lit(False)), "completed")
            .when(F.col("n") > 0, "identity_mismatch")
            .otherwise("not_committed")
            .alias("outcome"),
            "physical_table",
        )
    )


def operation_outcome(executions: DataFrame, markers: DataFrame) -> DataFrame:
    """completed, identity_mismatch or not_committed for each (execution, operation).

    ``executions``: execution_id, operation, target_id. An operation is completed when one of its
    markers names the same target, missing ids being equal to each other only.
    """
    return _with_marks(executions, markers, []).drop("physical_table")


def rollback_staleness(executions: DataFrame, markers: DataFrame) -> DataFrame:
    """Whether each COMPLETED execution may still be rolled back.

    The newest marker of the target must be this execution's own publish for the same target, and
    no newer execution of the target may have completed.
    """
    newest = latest_marker(markers).select(
        "logical_target",
        F.col("execution_id").alias("marker_execution"),
        F.col("operation").alias("marker_operation"),
        F.col("target_id").alias("marker_target"),
    )
    done = executions.where(F.col("status").isin("COMPLETED", "ROLLING_BACK", "ROLLED_BACK"))
    last_done = done.groupBy("logical_target").agg(
        F.max_by("execution_id", F.struct("completed_at", "execution_id")).alias("last_execution")
    )
    current = (
        F.col("marker_execution").eqNullSafe(F.col("execution_id"))
        & F.col("marker_operation").eqNullSafe(F.lit("PUBLISH"))
        & F.col("marker_target").eqNullSafe(F.col("target_id"))
    )
    return (
        executions.where(F.col("status") == "COMPLETED")
        .join(newest, "logical_target", "left")
        .join(last_done, "logical_target", "left")
        .select(
            "execution_id",
            "logical_target",
            F.when(~F.col("last_execution").eqNullSafe(F.col("execution_id")), "SUPERSEDED")
            .when(~current, "STALE_MARKER")
            .otherwise("CURRENT")
            .alias("outcome"),
        )
    )


# --- executions -------------------------------------------------------------------------------
def reconcile(
    executions: DataFrame, markers: DataFrame, as_of: str, stale_seconds: int = C.STALE_SECONDS
) -> DataFrame:
    """Settles executions stuck in RUNNING or ROLLING_BACK from what the markers prove.

    Only stale ones reach the join. Without a marker a publish has failed, while a rollback is
    left for review; so is anything whose marker names another target.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    since = F.when(
        F.col("status") == "ROLLING_BACK", F.coalesce("rollback_started_at", "started_at")
    ).otherwise(F.col("started_at"))
    stuck = (
        executions.where(F.col("status").isin("RUNNING", "ROLLING_BACK"))
        .where(since <= now - F.make_interval(secs=F.lit(stale_seconds)))
        .withColumn(
            "operation", F.when(F.col("status") == "RUNNING", "PUBLISH").otherwise("ROLLBACK")
        )
    )
    running = F.col("status") == "RUNNING"
    settled = (
        F.when(F.col("outcome") == "completed", F.when(running, "COMPLETED").otherwise("ROLLED_BACK"))
        .when((F.col("outcome") == "not_committed") & running, "FAILED")
        .otherwise(F.col("status"))
    )
    return _with_marks(stuck, markers, ["status"]).select(
        "execution_id",
        F.col("status").alias("old_status"),
        "outcome",
        settled.alias("new_status"),
        F.when(settled == "COMPLETED", F.col("physical_table")).alias("physical_table"),
        (settled == F.col("status")).alias("needs_review"),
    )


def execution_conflicts(executions: DataFrame) -> DataFrame:
    """Tickets with several executions that did not fail, and targets with several in flight.

    Both rules in one scan and one shuffle.
    """
    claims = F.array_compact(
        F.array(
            F.when(
                F.col("status").isin(*C.TICKET_TAKEN_STATUSES),
                F.struct(F.lit("TICKET").alias("rule"), F.col("ticket_id").alias("subject")),
            ),
            F.when(
                F.col("status").isin(*C.TARGET_BUSY_STATUSES),
                F.struct(F.lit("TARGET").alias("rule"), F.col("logical_target").alias("subject")),
            ),
        )
    )
    return (
        executions.select(F.explode(claims).alias("c"))
        .groupBy("c.rule", "c.subject")
        .agg(F.count(F.lit(1)).alias("executions"))
        .where(F.col("executions") > 1)
    )


def candidate_conflicts(candidates: DataFrame, executions: DataFrame) -> DataFrame:
    """Requests that may not start: their ticket is taken, or their target is busy."""
    taken = (
        executions.where(F.col("status").isin(*C.TICKET_TAKEN_STATUSES))
        .select("ticket_id")
        .distinct()
        .withColumn("already_executed", F.lit(True))
    )
    busy = (
        executions.where(F.col("status").isin(*C.TARGET_BUSY_STATUSES))
        .select("logical_target")
        .distinct()
        .withColumn("target_busy", F.lit(True))
    )
    return (
        candidates.join(taken, "ticket_id", "left")
        .join(busy, "logical_target", "left")
        .select(
            *[F.col(c) for c in candidates.columns],
            F.coalesce("already_executed", F.lit(False)).alias("already_executed"),
            F.coalesce("target_busy", F.lit(False)).alias("target_busy"),
        )
    )


_LEGAL = {
    "PENDING": ("RUNNING", "FAILED"),
    "RUNNING": ("COMPLETED", "FAILED"),
    "COMPLETED": ("ROLLING_BACK",),
    "ROLLING_BACK": ("ROLLED_BACK",),
}


def execution_transitions(events: DataFrame) -> DataFrame:
    """Each event with the status before it and whether the step is legal.

    ``events``: execution_id, event_id, recorded_at, status. The status before is the previous
    event of the same piece of the sorted events, or else the last one of the execution's nearest
    earlier piece. Events without an execution are one history. An event without a time has no place
    in the history: it is listed as illegal and precedes no other.
    """
    undated = events.where(F.col("recorded_at").isNull()).select(
        "execution_id",
        "event_id",
        F.lit(None).cast("string").alias("previous_status"),
        "status",
        F.lit(False).alias("legal"),
    )
    dated = in_pieces(
        events.where(F.col("recorded_at").isNotNull()).select(
            "execution_id", "event_id", "recorded_at", "status"
        ),
        "execution_id", ["recorded_at", "event_id"], "piece", "execution-events",
    )
    within_piece = Window.partitionBy("execution_id", "piece").orderBy("recorded_at", "event_id")
    over_pieces = Window.partitionBy("execution_id").orderBy("piece")
    closing = (
        dated.groupBy("execution_id", "piece")
        .agg(F.max_by("status", F.struct("recorded_at", "event_id")).alias("last_status"))
        .select(
            F.col("execution_id").alias("own_id"),
            F.col("piece").alias("own_piece"),
            F.lag("last_status").over(over_pieces).alias("opening_status"),
        )
    )
    previous = F.coalesce("same_piece", "opening_status")
    legal = F.when(previous.isNull(), F.col("status").isin("PENDING", "RUNNING"))
    for before, after in _LEGAL.items():
        legal = legal.when(previous == before, F.col("status").isin(*after))
    return (
        dated.withColumn("same_piece", F.lag("status").over(within_piece))
        .join(
            closing,
            F.col("execution_id").eqNullSafe(F.col("own_id")) & (F.col("piece") == F.col("own_piece")),
        )
        .select(
            "execution_id",
            "event_id",
            previous.alias("previous_status"),
            "status",
            legal.otherwise(F.lit(False)).alias("legal"),
        )
        .unionByName(undated)
    )


def execution_state(events: DataFrame) -> DataFrame:
    """Latest status of each execution; events without a time say nothing about that."""
    return events.where(F.col("recorded_at").isNotNull()).groupBy("execution_id").agg(
        F.max_by("status", F.struct("recorded_at", "event_id")).alias("status"),
        F.max("recorded_at").alias("recorded_at"),
    )


def check_revalidation_links(
    links: DataFrame, executions: DataFrame, runs: DataFrame
) -> DataFrame:
    """Whether a revalidation run may be attached to an execution.

    ``links``: execution_id, revalidation_run_id; ``executions``: execution_id, status,
    simulation_run_id, revalidation_run_id.
    """
    execution = executions.select(
        "execution_id",
        "status",
        "simulation_run_id",
        F.col("revalidation_run_id").alias("attached"),
    )
    run = runs.select(
        F.col("run_id").alias("revalidation_run_id"),
        F.col("purpose").alias("run_purpose"),
        F.col("baseline_run_id").alias("run_baseline"),
    )
    outcome = (
        F.when(F.col("status").isNull(), "UNKNOWN_EXECUTION")
        .when(F.col("status") != "RUNNING", "NOT_RUNNING")
        .when(
            ~F.col("run_purpose").eqNullSafe(F.lit("LIVE_REVALIDATION")), "NOT_A_REVALIDATION"
        )
        .when(F.col("simulation_run_id").isNull(), "NO_SIMULATION")
        .when(~F.col("run_baseline").eqNullSafe(F.col("simulation_run_id")), "OTHER_BASELINE")
        .when(
            F.col("attached").isNotNull()
            & (F.col("attached") != F.col("revalidation_run_id")),
            "ALREADY_ATTACHED",
        )
        .otherwise("ATTACHED")
    )
    return (
        links.join(execution, "execution_id", "left")
        .join(run, "revalidation_run_id", "left")
        .select("execution_id", "revalidation_run_id", outcome.alias("outcome"))
    )
