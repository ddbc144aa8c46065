"""The life of a migration with its ledgers: every step is recorded, and later steps read the records.

Ledgers are append-only Parquet tables below one folder. ``Lifecycle`` calls the steps of
``plans.migration``; what it adds is what they need and leave: runs and snapshots, tickets, decisions,
manifests, and the events of executions. Tables of a ledger are small next to the data they tell about.

A publication is what the commit log of its target says. Whatever step a writer dies in, ``reconcile`` brings
view, marker and execution into agreement: the log decides the execution's state and what the view shows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from goldseam.operators import ledger
from goldseam.operators.fingerprint import provenance_fingerprint
from goldseam.operators.joining import left_join_known
from goldseam.plans.migration import (
    Approval,
    Execution,
    Table,
    Ticket,
    approve,
    execute_live,
    open_ticket,
    publication_gate,
)
from goldseam.sources import snapshots
from goldseam.sources.manifests import append_manifests
from goldseam.sources.publish import Publisher, StaleRollback
from goldseam.sources.tables import consistent_read

_FACTS = (
    "source_primary_key array<string>, source_row_count bigint, source_schema_fingerprint string, "
    "source_dataset_fingerprint string"
)
SCHEMAS = {
    "datasets": "dataset_id string",
    "snapshots": f"snapshot_id string, dataset_id string, provenance_fingerprint string, {_FACTS}, folder string",
    "runs": f"run_id string, dataset_id string, purpose string, outcome string, snapshot_id string, "
    f"baseline_run_id string, started_at timestamp_ntz, completed_at timestamp_ntz, failure_code string, "
    f"failure_reason string, requested_by string, {_FACTS}",
    "tickets": "ticket_id string, dataset_id string, run_id string, action string, confidence double, "
    "schema_version_id string, decision string",
    "decisions": "ticket_id string, decision_id string, decision string, operator string, decided_at timestamp_ntz",
    "manifests": "manifest_id string, ticket_id string, run_id string, recorded_at timestamp_ntz, "
    "execution_mode string, action string, confidence double, schema_version_id string, decision string, "
    "decision_valid boolean, original_row_count bigint, final_row_count bigint, integrity_status string, "
    "risk_level string, output_fingerprint string, output_set_fingerprint string, "
    "outcome string",
    "events": "event_id string, execution_id string, ticket_id string, logical_target string, target_id string, "
    "status string, recorded_at timestamp_ntz, detail string",
    "links": "execution_id string, revalidation_run_id string, attached_at timestamp_ntz",
}
#: What a failed run says about itself: a fixed code and text, nothing of the error or the data.
FAILURES = {
    "SOURCE_VALIDATION_FAILED": "The source does not meet the rules of a trusted read.",
    "SOURCE_READ_FAILED": "The source could not be read completely.",
}
# Within one moment events follow this order.
_ORDER = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "ROLLING_BACK", "ROLLED_BACK")


class LifecycleRefused(RuntimeError):
    """A step is not allowed by what the ledgers say; the message is a stable code."""


@dataclass(frozen=True)
class Captured:
    """A recorded complete read and the snapshot that stands for it."""

    run_id: str
    dataset_id: str
    snapshot: Row


def decision_json(decision: Row | None) -> str | None:
    return None if decision is None else json.dumps(decision.asDict(), sort_keys=True)


class Lifecycle:
    """Steps of a migration below ``folder``, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str, target_id: str | None = None) -> None:
        self.spark, self.folder, self.target_id = spark, folder.rstrip("/"), target_id
        self.publisher = Publisher(spark, f"{self.folder}/publish")

    # --- ledgers ---------------------------------------------------------------------
    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/ledgers/{name}"
        if not self.publisher.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def _rows(self, name: str, rows: Sequence[dict]) -> DataFrame:
        """Rows of a ledger; times are given as text."""
        texts = SCHEMAS[name].replace("timestamp_ntz", "string")
        columns = [part.split()[0] for part in SCHEMAS[name].split(", ")]
        listed = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], texts)
        kinds = dict(part.split() for part in SCHEMAS[name].split(", "))
        return listed.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])

    def _append(self, name: str, rows: Sequence[dict]) -> None:
        self._rows(name, rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledgers/{name}")

    def append_run(self, **run: object) -> None:
        """Appends a run that keeps all rules; otherwise nothing is written and the rule is named."""
        checked = ledger.check_runs(
            self._rows("runs", [run]), self.read("datasets"), self.read("snapshots"), self.read("runs")
        )
        violation = checked.first().violation
        if violation is not None:
            raise LifecycleRefused(violation)
        self._append("runs", [run])

    def append_runs(self, runs: DataFrame) -> DataFrame:
        """Appends all ``runs`` that keep the rules; returns them all, with the rule each other one breaks.

        A run may name a baseline of the same table: baselines are captured simulations, which have none
        themselves, so those are checked first, and the others against them and the ledger. A run_id that
        is missing, in the ledger, or repeated in the table is refused.
        """
        columns = [part.split()[0] for part in SCHEMAS["runs"].split(", ")]
        known, datasets, stored = self.read("runs"), self.read("datasets"), self.read("snapshots")
        times = runs.groupBy("run_id").agg((F.count("*") > 1).alias("repeated"))
        used = known.select("run_id", F.lit(True).alias("used")).distinct()
        bad_id = (
            F.when(F.col("run_id").isNull(), "RUN_ID_MISSING")
            .when(F.coalesce("used", "repeated", F.lit(False)), "RUN_ID_USED")
        )
        listed = left_join_known(left_join_known(runs.select(*columns), times, "run_id"), used, "run_id")
        listed = listed.select(*columns, bad_id.alias("bad_id"))
        fit = listed.where("bad_id IS NULL").drop("bad_id")
        # simulations first, then what names them, then verdicts that know both
        for _ in range(2):
            accepted = ledger.check_runs(fit, datasets, stored, known).where("violation IS NULL").drop("violation")
            known = self.read("runs").unionByName(accepted)
        checked = ledger.check_runs(fit, datasets, stored, known).unionByName(
            listed.where("bad_id IS NOT NULL").withColumnRenamed("bad_id", "violation")
        )
        batch = f"{self.folder}/batches/{uuid.uuid4().hex}"
        checked.write.parquet(batch)
        result = self.spark.read.schema(checked.schema).parquet(batch)
        accepted = result.where("violation IS NULL").drop("violation")
        accepted.write.mode("append").parquet(f"{self.folder}/ledgers/runs")
        return result

    def fail_run(
        self, dataset_id: str, run_id: str, as_of: str, code: str, baseline: Captured | None = None,
        requested_by: str | None = None,
    ) -> None:
        """Records a read that failed, under one of the codes of FAILURES."""
        if code not in FAILURES:
            raise LifecycleRefused("UNKNOWN_FAILURE_CODE")
        self.append_run(
            run_id=run_id, dataset_id=dataset_id, outcome="FAILED", failure_code=code, failure_reason=FAILURES[code],
            purpose="SIMULATION" if baseline is None else "LIVE_REVALIDATION",
            baseline_run_id=None if baseline is None else baseline.run_id,
            started_at=as_of, completed_at=as_of, requested_by=requested_by,
        )

    def executions(self) -> DataFrame:
        """Executions folded from their events, as the ledger operators take them."""
        when = {s: F.max(F.when(F.col("status") == s, F.col("recorded_at"))) for s in _ORDER}
        newest = F.struct("recorded_at", "event_id")
        return self.read("events").groupBy("execution_id").agg(
            F.max("ticket_id").alias("ticket_id"),
            F.max("logical_target").alias("logical_target"),
            F.max("target_id").alias("target_id"),
            F.max_by("status", newest).alias("status"),
            when["RUNNING"].alias("started_at"),
            when["ROLLING_BACK"].alias("rollback_started_at"),
            when["COMPLETED"].alias("completed_at"),
        )

    def _event(self, execution_id: str, ticket_id: str, target: str, status: str, as_of: str, detail=None) -> None:
        self._append(
            "events",
            [
                {
                    "event_id": f"{execution_id}-{_ORDER.index(status)}", "execution_id": execution_id,
                    "ticket_id": ticket_id, "logical_target": target, "target_id": self.target_id,
                    "status": status, "recorded_at": as_of, "detail": detail,
                }
            ],
        )

    # --- reads -----------------------------------------------------------------------------
    def capture(
        self, table: Table, dataset_id: str, run_id: str, as_of: str, baseline: Captured | None = None
    ) -> Captured:
        """One trusted read, its snapshot (stored if new, reused if known), and the run that records it.

        With ``baseline`` it is a revalidation, whose outcome says whether the source drifted. A read that
        fails, or whose key is not proved, leaves a failed run.
        """
        if self.read("datasets").where(F.col("dataset_id") == dataset_id).isEmpty():
            self._append("datasets", [{"dataset_id": dataset_id}])
        try:
            read = consistent_read(table.data, dataset_id, table.key)
        except Exception as error:
            self.fail_run(dataset_id, run_id, as_of, "SOURCE_READ_FAILED", baseline)
            raise LifecycleRefused("SOURCE_READ_FAILED") from error
        if not read.key_proved:
            self.fail_run(dataset_id, run_id, as_of, "SOURCE_VALIDATION_FAILED", baseline)
            raise LifecycleRefused("KEY_NOT_PROVED")
        facts = {
            "source_primary_key": list(table.key), "source_row_count": read.row_count,
            "source_schema_fingerprint": read.schema_fingerprint,
            "source_dataset_fingerprint": read.data_fingerprint,
        }
        described = provenance_fingerprint(self.spark.createDataFrame([tuple(facts.values())], _FACTS)).first()
        incoming = {"dataset_id": dataset_id, "provenance_fingerprint": described.provenance_fingerprint, **facts}
        snapshot = self._resolve(incoming, table.data, f"{dataset_id}-{run_id}")
        outcome = "CAPTURED"
        if baseline is not None:
            changed = [k for k in facts if baseline.snapshot[k] != facts[k]]
            outcome = "DRIFTED" if changed else "MATCHED"
        self.append_run(
            run_id=run_id, dataset_id=dataset_id, outcome=outcome, snapshot_id=snapshot.snapshot_id,
            purpose="SIMULATION" if baseline is None else "LIVE_REVALIDATION",
            baseline_run_id=None if baseline is None else baseline.run_id,
            started_at=as_of, completed_at=as_of, **facts,
        )
        return Captured(run_id, dataset_id, snapshot)

    def _resolve(self, incoming: dict, data: DataFrame, snapshot_id: str) -> Row:
        evidence = [part.split()[0] for part in _FACTS.split(", ")]
        rows, stored = self._rows("snapshots", [incoming]), self.read("snapshots")
        outcome = snapshots.snapshot_dedupe(rows, stored, evidence).first().outcome
        if outcome == "CONFLICT":
            raise LifecycleRefused("SNAPSHOT_CONFLICT")
        key = [F.col(c) == incoming[c] for c in ("dataset_id", "provenance_fingerprint")]
        if outcome == "NEW":
            folder = f"{self.folder}/snapshots/{snapshot_id}"
            count, fingerprint = snapshots.capture(data, folder)
            if (count, fingerprint) != (incoming["source_row_count"], incoming["source_dataset_fingerprint"]):
                raise LifecycleRefused("SOURCE_CHANGED_DURING_CAPTURE")
            self._append("snapshots", [{**incoming, "snapshot_id": snapshot_id, "folder": folder}])
        return self.read("snapshots").where(key[0] & key[1]).first()

    # --- decisions -----------------------------------------------------------------------
    def open(
        self, table: Table, captured: Captured, action: str, confidence: float, ticket_id: str,
        schema_version_id: str, allowed_pairs: Sequence[tuple[str, str]] = (),
    ) -> Ticket:
        """A ticket on a captured read; its plan is proved on the stored snapshot."""
        stored = snapshots.load_verified(
            self.spark, captured.snapshot.folder, captured.dataset_id,
            captured.snapshot.source_row_count, captured.snapshot.source_dataset_fingerprint,
        )
        ticket = open_ticket(
            Table(stored, table.key, table.gold, table.source_backed), captured.dataset_id, action,
            confidence, ticket_id, schema_version_id, allowed_pairs,
        )
        self._append(
            "tickets",
            [
                {
                    "ticket_id": ticket_id, "dataset_id": captured.dataset_id, "run_id": captured.run_id,
                    "action": action, "confidence": confidence, "schema_version_id": schema_version_id,
                    "decision": decision_json(ticket.decision),
                }
            ],
        )
        return ticket

    def approve(self, ticket: Ticket, captured: Captured, operator: str, as_of: str) -> Approval:
        """Runs the plan on the snapshot; an approval leaves a decision and a manifest."""
        state = ledger.ticket_states(
            self.read("tickets").where(F.col("ticket_id") == ticket.ticket_id), self.read("decisions")
        ).first()
        if state is None or state.status != "PENDING":
            raise LifecycleRefused("TICKET_NOT_PENDING")
        approval = approve(ticket, snapshots.load_snapshot(self.spark, captured.snapshot.folder), operator)
        if not approval.approved:
            return approval
        manifest = {
            **approval.manifest, "manifest_id": f"{ticket.ticket_id}-sandbox", "run_id": captured.run_id,
            "recorded_at": as_of, "confidence": ticket.confidence, "schema_version_id": ticket.schema_version_id,
            "decision": decision_json(ticket.decision), "decision_valid": True,
            "output_fingerprint": approval.output_fingerprint,
            "output_set_fingerprint": approval.output_set_fingerprint,
        }
        append_manifests(
            self._rows("manifests", [manifest]), self.read("tickets"), f"{self.folder}/ledgers/manifests"
        )
        self._append(
            "decisions",
            [
                {
                    "ticket_id": ticket.ticket_id, "decision_id": f"{ticket.ticket_id}-1",
                    "decision": "APPROVED", "operator": operator.strip(), "decided_at": as_of,
                }
            ],
        )
        return approval

    def refuse(self, ticket_id: str, operator: str, as_of: str) -> None:
        """Rejects a pending ticket; it cannot be approved or executed any more."""
        if not operator.strip():
            raise LifecycleRefused("OPERATOR_MISSING")
        tickets = self.read("tickets").where(F.col("ticket_id") == ticket_id)
        state = ledger.ticket_states(tickets, self.read("decisions")).first()
        if state is None or state.status != "PENDING":
            raise LifecycleRefused("TICKET_NOT_PENDING")
        decision = {
            "ticket_id": ticket_id, "decision_id": f"{ticket_id}-1", "decision": "REJECTED",
            "operator": operator.strip(), "decided_at": as_of,
        }
        self._append("decisions", [decision])

    def approval(self, ticket: Ticket) -> Approval:
        """The approval that the ledgers hold: the latest manifest, if it agrees with the ticket."""
        tickets = self.read("tickets").where(F.col("ticket_id") == ticket.ticket_id)
        state = ledger.ticket_states(tickets, self.read("decisions")).first()
        if state is None or state.status != "APPROVED":
            raise LifecycleRefused("TICKET_NOT_APPROVED")
        manifests = self.read("manifests").where(F.col("ticket_id") == ticket.ticket_id)
        audit = ledger.manifest_audit(tickets, manifests).first()
        if audit.outcome != "CONSISTENT":
            raise LifecycleRefused(audit.outcome)
        row = manifests.where(F.col("manifest_id") == audit.manifest_id).first()
        return Approval(
            True, row.outcome, row.final_row_count, row.output_fingerprint, row.output_set_fingerprint, row.asDict()
        )

    # --- publication ---------------------------------------------------------------------
    def execute(
        self, ticket: Ticket, captured: Captured, table: Table, target: str, execution_id: str, as_of: str,
        *, confirmed: bool, allowed_pairs: Sequence[tuple[str, str]] = (),
    ) -> Execution:
        """Gates and audit first; then RUNNING, a revalidated fresh read, the publish, and how it ended.

        If something fails, the log of the target says how it ended. Where even that cannot be read, the
        execution stays RUNNING, for ``reconcile``. An execution's id is used once; a failed one is followed
        by another execution of the same ticket.
        """
        approval = self.approval(ticket)
        if not self.read("events").where(F.col("execution_id") == execution_id).isEmpty():
            raise LifecycleRefused("EXECUTION_ID_USED")
        gate = publication_gate(ticket, approval, target, confirmed, self.executions(), self.spark)
        if gate is not None:
            return Execution(False, gate)
        self._event(execution_id, ticket.ticket_id, target, "RUNNING", as_of)
        revalidation = f"{execution_id}-revalidation"
        try:
            try:
                self.capture(table, ticket.dataset, revalidation, as_of, captured)
            finally:  # a failed read is attached as well
                if not self.read("runs").where(F.col("run_id") == revalidation).isEmpty():
                    self.attach(execution_id, revalidation, as_of)
            result = execute_live(
                ticket, approval, table.data, self.publisher, target, execution_id, as_of,
                confirmed=confirmed, allowed_pairs=allowed_pairs, target_id=self.target_id,
            )
        except Exception as error:
            record = self._settled(execution_id, ticket.ticket_id, target, as_of, error)
            if record is None:
                raise
            return Execution(True, "PUBLISHED", record["physical_table"], record["previous_physical_table"])
        status = "COMPLETED" if result.published else "FAILED"
        self._event(execution_id, ticket.ticket_id, target, status, as_of, result.outcome)
        return result

    def _settled(self, execution_id: str, ticket_id: str, target: str, as_of: str, error: Exception):
        """The record of a publish that failed after its commit; otherwise the execution has failed."""
        try:
            record = self.publisher.committed(target, execution_id, "PUBLISH")
        except Exception:
            return None  # in doubt: it stays RUNNING
        if record is None:
            self._event(execution_id, ticket_id, target, "FAILED", as_of, type(error).__name__)
            return None
        self._event(execution_id, ticket_id, target, "COMPLETED", as_of, "SETTLED_BY_LOG")
        try:
            self.publisher.repair(target)
        except Exception:  # published all the same; ``reconcile`` brings the view up to date
            return record
        return record

    def attach(self, execution_id: str, run_id: str, as_of: str) -> None:
        """Links a revalidation run to the running execution that it was made for."""
        simulated = self.read("tickets").select("ticket_id", F.col("run_id").alias("simulation_run_id"))
        attached = self.read("links").select("execution_id", "revalidation_run_id")
        executions = self.executions().where(F.col("execution_id") == execution_id)
        executions = left_join_known(executions, simulated, "ticket_id").join(attached, "execution_id", "left")
        link = {"execution_id": execution_id, "revalidation_run_id": run_id, "attached_at": as_of}
        checked = ledger.check_revalidation_links(
            self._rows("links", [link]).drop("attached_at"), executions, self.read("runs")
        )
        outcome = checked.first().outcome
        if outcome != "ATTACHED":
            raise LifecycleRefused(outcome)
        if attached.where(F.col("execution_id") == execution_id).isEmpty():
            self._append("links", [link])

    def rollback(self, execution_id: str, as_of: str) -> None:
        """Points the target back to the version before, if this execution is still its newest.

        Both the executions and the markers must say so; the version comes from the marker.
        """
        executions, markers = self.executions(), self.publisher.markers()
        verdict = (
            ledger.rollback_staleness(executions, markers)
            .where(F.col("execution_id") == execution_id)
            .first()
        )
        if verdict is None:
            raise StaleRollback("NOT_COMPLETED")
        if verdict.outcome != "CURRENT":
            raise StaleRollback(verdict.outcome)
        row = executions.where(F.col("execution_id") == execution_id).first()
        mark = ledger.latest_marker(markers).where(F.col("logical_target") == row.logical_target).first()
        self._event(execution_id, row.ticket_id, row.logical_target, "ROLLING_BACK", as_of)
        try:
            self.publisher.rollback(
                row.logical_target, execution_id, mark.previous_physical_table, as_of, self.target_id
            )
        except Exception:
            # committed after all, or left for review
            if self.publisher.committed(row.logical_target, execution_id, "ROLLBACK") is None:
                raise
            self.publisher.repair(row.logical_target)
        self._event(execution_id, row.ticket_id, row.logical_target, "ROLLED_BACK", as_of)

    def reconcile(self, as_of: str) -> DataFrame:
        """Settles stuck executions from the markers and appends the new states; returns what it found.

        Every view that lags behind its log is brought up to date.
        """
        self.publisher.repair_all()
        found = ledger.reconcile(self.executions(), self.publisher.markers(), as_of).collect()
        known = {r.execution_id: r for r in self.executions().collect()} if found else {}
        for row in found:  # executions stuck in flight: a handful
            if not row.needs_review:
                of = known[row.execution_id]
                self._event(
                    row.execution_id, of.ticket_id, of.logical_target, row.new_status, as_of, "RECONCILED"
                )
        return self.spark.createDataFrame(
            found,
            "execution_id string, old_status string, outcome string, new_status string, "
            "physical_table string, needs_review boolean",
        )
