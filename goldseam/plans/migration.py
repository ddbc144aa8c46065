"""The life of a migration: simulate many tables, approve one ticket, publish it, roll it back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from goldseam import constants as C
from goldseam.functions import cast_rules as rules
from goldseam.functions.dtypes import logical_dtype
from goldseam.functions.encoding import quoted
from goldseam.operators import governance, ledger
from goldseam.operators.cast import Cast, cast_decision
from goldseam.operators.fingerprint import schema_fingerprint
from goldseam.operators.profile import key_proof
from goldseam.operators.repair import integrity_status, risk_level
from goldseam.plans.evidence import Evidence, gather, typed_action
from goldseam.session import exact_names
from goldseam.sources.publish import Publisher
from goldseam.sources.tables import column_metadata

Columns = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Table:
    """A dataset to migrate: its data, its declared key, and the Gold schema it should have."""

    data: DataFrame
    key: Sequence[str]
    gold: Columns
    source_backed: bool = False

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(f.name, logical_dtype(f)) for f in self.data.schema.fields]


def schema_rows(spark: SparkSession, schemas: Mapping[str, Columns]) -> DataFrame:
    """Schemas as rows of dataset, ordinal, column, dtype."""
    rows = [
        (dataset, i, name, dtype)
        for dataset, columns in schemas.items()
        for i, (name, dtype) in enumerate(columns)
    ]
    return spark.createDataFrame(
        rows, "dataset string, ordinal int, column string, dtype string"
    )


def simulate(
    spark: SparkSession, tables: Mapping[str, Table], allowed_pairs: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Drift, plan, proof and route of every table, one row each.

    Drift and plans come from schemas alone. Data is read only where the selected plan is a cast,
    and then only the key and that column.
    """
    observed = schema_rows(spark, {n: t.columns for n, t in tables.items()})
    gold = schema_rows(spark, {n: t.gold for n, t in tables.items()})
    selected = governance.select_plan(governance.propose_repairs(observed, gold))
    chosen = selected.collect()
    decisions = [_decide(tables[p.dataset], p) for p in chosen if p.kind == "CAST"]
    proofs = (
        reduce(lambda a, b: a.unionByName(b), decisions)
        if decisions
        else spark.createDataFrame(
            [], "dataset string, column_name string, target_dtype string, status string"
        )
    )
    backed = spark.createDataFrame(
        [(n, t.source_backed) for n, t in tables.items()], "dataset string, source_backed boolean"
    )
    plans = spark.createDataFrame(chosen, selected.schema).join(backed, "dataset")
    routed = governance.plan_route(plans, proofs).select(
        "dataset", "action", "confidence", "status", "route"
    )
    blocked = _blocked_casts(spark, tables, chosen, allowed_pairs)
    return backed.select("dataset").join(routed, "dataset", "left").select(
        "dataset",
        F.coalesce("action", F.lit("none")).alias("action"),
        F.coalesce("status", F.lit("none")).alias("status"),
        F.when(F.col("action").isNull(), "NO_VIABLE_PLAN")
        .when(F.col("dataset").isin(*blocked) if blocked else F.lit(False), "CAST_PAIR_NOT_ALLOWED")
        .otherwise(F.col("route"))
        .alias("route"),
    )


def _decide(table: Table, plan: Row) -> DataFrame:
    return cast_decision(table.data, [Cast(plan.column, plan.target)], table.key).select(
        F.lit(plan.dataset).alias("dataset"), "column_name", "target_dtype", "status"
    )


def _blocked_casts(spark, tables, chosen, allowed) -> list[str]:
    """Source-backed casts whose pair of types is not on the allowlist."""
    allowed = set(allowed)
    return [
        p.dataset
        for p in chosen
        if p.kind == "CAST"
        and tables[p.dataset].source_backed
        and (dict(tables[p.dataset].columns)[p.column], p.target) not in allowed
    ]


def read_family(spark: SparkSession, folders: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """Tables of one schema, each in a folder of its own, as one read; ``dataset`` is the folder's name."""
    found = spark.read.parquet(*folders)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return found.select("*", F.url_decode(name).alias(dataset))


@exact_names
def simulate_family(
    data: DataFrame,
    gold: DataFrame,
    allowed_pairs: Sequence[tuple[str, str]] = (),
    source_backed: DataFrame | None = None,
    dataset: str = "dataset",
) -> DataFrame:
    """As ``simulate``, for any number of tables that share one schema: dataset, action, status, route.

    ``data``: the rows of all tables, told apart by the column ``dataset``; ``gold``: dataset, ordinal,
    column, dtype of every table to migrate; ``source_backed``: the datasets whose source is a database.
    Rows of other datasets are not judged; a table in ``gold`` without rows is an empty one, whose casts
    lose nothing.

    Plans stay rows. All casts are proved by one scan of the columns to be cast: a row is held to the
    cast its table asks for. The plan holds one proof per pair of column and type asked for, so it is
    bounded by the schema and not by the number of tables; failures are folded in each task, so a
    table with a third of all rows is no one task's work.
    """
    fields = [f for f in data.schema.fields if f.name != dataset]
    columns = [(i, f.name, logical_dtype(f)) for i, f in enumerate(fields)]
    tables = gold.select("dataset").distinct()
    observed = tables.select("dataset", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype"))
        for i, name, dtype in columns
    ])))
    selected = governance.select_plan(governance.propose_repairs(observed, gold))
    backed = tables.withColumn("source_backed", F.lit(False))
    if source_backed is not None:
        listed = source_backed.select("dataset", F.lit(True).alias("listed")).distinct()
        backed = tables.join(listed, "dataset", "left").select(
            "dataset", F.coalesce("listed", F.lit(False)).alias("source_backed")
        )
    casts = selected.where("kind = 'CAST'").select(
        "dataset", F.col("column").alias("column_name"),
        governance.normalize_target(F.col("target")).alias("target_dtype"),
    )
    failures = _failures_by_table(data, fields, casts, dataset)
    status = (
        F.when(~F.col("target_dtype").isin(*C.CAST_TARGETS), "UNSUPPORTED")
        .when(F.coalesce("unsupported", F.lit(False)), "UNSUPPORTED")
        .when(F.coalesce("failed", F.lit(0)) > 0, "UNSAFE")
        .otherwise("SAFE")
    )
    proofs = casts.join(failures, "dataset", "left").select(
        "dataset", "column_name", "target_dtype", status.alias("status")
    )
    routed = governance.plan_route(selected.join(backed, "dataset"), proofs)
    types = F.create_map(*[F.lit(x) for _, name, dtype in columns for x in (name, dtype)])
    pair = F.concat(types[F.col("column")], F.lit(">"), F.col("target"))
    known = [f"{a}>{b}" for a, b in allowed_pairs]
    blocked = (F.col("kind") == "CAST") & F.col("source_backed") & ~(pair.isin(*known) if known else F.lit(False))
    return tables.join(routed, "dataset", "left").select(
        "dataset",
        F.coalesce("action", F.lit("none")).alias("action"),
        F.coalesce("status", F.lit("none")).alias("status"),
        F.when(F.col("action").isNull(), "NO_VIABLE_PLAN")
        .when(blocked, "CAST_PAIR_NOT_ALLOWED")
        .otherwise(F.col("route"))
        .alias("route"),
    )


def _failures_by_table(
    data: DataFrame, fields: Sequence[T.StructField], casts: DataFrame, dataset: str
) -> DataFrame:
    """dataset, failed, unsupported: what the cast of each table (in ``casts``) would lose.

    The pairs asked for come to the driver: at most four per column.
    """
    asked = casts.where(F.col("target_dtype").isin(*C.CAST_TARGETS)).select("column_name", "target_dtype")
    pairs = sorted(tuple(r) for r in asked.distinct().collect())
    kinds = {f.name: f.dataType for f in fields}
    places = {name: f"_v{i}" for i, name in enumerate(dict.fromkeys(name for name, _ in pairs))}
    reason = F.lit(None).cast("string")
    for name, target in pairs:
        wanted = (F.col("column_name") == name) & (F.col("target_dtype") == target)
        reason = F.when(wanted, rules.reason(F.col(places[name]), kinds[name], target)).otherwise(reason)
    values = [quoted(name).alias(place) for name, place in places.items()]
    rows = data.select(quoted(dataset).alias("_dataset"), *values).join(
        casts, F.col("_dataset") == F.col("dataset")
    )
    judged = rows.select("dataset", reason.alias("reason")).where("reason IS NOT NULL")
    return judged.groupBy("dataset").agg(
        F.count("*").alias("failed"),
        F.bool_or(F.col("reason") == C.UNSUPPORTED_SOURCE_VALUE).alias("unsupported"),
    )


@dataclass(frozen=True)
class Ticket:
    """A plan waiting for, or past, a human decision, with the evidence it was made on."""

    ticket_id: str
    dataset: str
    action: str
    confidence: float
    key: Sequence[str]
    gold: Columns
    observed: Columns
    row_count: int
    schema_fingerprint: str
    data_fingerprint: str
    set_fingerprint: str
    decision: Row | None
    schema_version_id: str | None = None
    live_eligible: bool = True
    source_schema: str = "public"


@dataclass(frozen=True)
class Approval:
    """Outcome of the sandbox run that an approval rests on."""

    approved: bool
    outcome: str
    row_count: int = 0
    output_fingerprint: str | None = None
    output_set_fingerprint: str | None = None
    manifest: Mapping[str, object] = field(default_factory=dict)


class TicketRefused(ValueError):
    """The table cannot get a ticket; the message is a stable code."""


def _schema_print(df: DataFrame, dataset: str) -> str:
    return schema_fingerprint(column_metadata(df, dataset)).first().schema_fingerprint


def open_ticket(
    table: Table,
    dataset: str,
    action: str,
    confidence: float,
    ticket_id: str,
    schema_version_id: str | None = None,
    allowed_pairs: Sequence[tuple[str, str]] = (),
) -> Ticket:
    """Read the source once, prove key and plan, and record what was seen."""
    unknown = [d for _, d in table.gold if d not in C.DTYPE_TO_DATABASE_TYPE]
    if unknown:
        raise TicketRefused(f"UNPUBLISHABLE_DTYPE: {','.join(unknown)}")
    if not key_proof(table.data, dataset, table.key).first().proved:
        raise TicketRefused("KEY_NOT_PROVED")
    plan = typed_action(table.data, action)
    if plan.kind == "CAST" and plan.error is None:
        source = dict(table.columns).get(plan.column)
        if source is None:
            raise TicketRefused("CAST_SOURCE_MISSING")
        if (source, Cast(plan.column, plan.target).normalized) not in set(allowed_pairs):
            raise TicketRefused("CAST_PAIR_NOT_ALLOWED")
    evidence = gather(table.data, action, table.key, sets=True)
    if evidence.corrected is None:
        raise TicketRefused(evidence.outcome)
    return Ticket(
        ticket_id,
        dataset,
        action,
        confidence,
        tuple(table.key),
        tuple(table.gold),
        tuple(table.columns),
        evidence.row_count,
        _schema_print(table.data, dataset),
        evidence.source_fingerprint,
        evidence.source_set,
        evidence.decision,
        schema_version_id,
    )


def _source_drift(ticket: Ticket, df: DataFrame, evidence: Evidence) -> list[str]:
    """What no longer is as the ticket recorded it, in the fixed order."""
    facts = (
        ("PRIMARY_KEY", set(ticket.key) <= set(df.columns), True),
        ("ROW_COUNT", ticket.row_count, evidence.row_count),
        ("SCHEMA_FINGERPRINT", ticket.schema_fingerprint, _schema_print(df, ticket.dataset)),
        (
            "DATASET_FINGERPRINT",
            (ticket.data_fingerprint, ticket.set_fingerprint),
            (evidence.source_fingerprint, evidence.source_set),
        ),
    )
    return [name for name, recorded, fresh in facts if recorded != fresh]


def _matches_gold(ticket: Ticket, corrected: DataFrame) -> bool:
    return [(f.name, logical_dtype(f)) for f in corrected.schema.fields] == list(ticket.gold)


def approve(ticket: Ticket, snapshot: DataFrame, operator: str) -> Approval:
    """Run the plan on the snapshot the ticket names; anything unexpected keeps it pending."""
    if not operator.strip():
        return Approval(False, "NO_OPERATOR")
    evidence = gather(snapshot, ticket.action, ticket.key, sets=True)
    drift = _source_drift(ticket, snapshot, evidence)
    if drift:
        return Approval(False, f"REPLAY_DIFFERS:{','.join(drift)}")
    if evidence.corrected is None:
        return Approval(False, evidence.outcome)
    if evidence.decision != ticket.decision:
        return Approval(False, "STALE_DECISION")
    if not _matches_gold(ticket, evidence.corrected):
        return Approval(False, "INCOMPLETE_MATCH")
    counts = snapshot.sparkSession.range(1).select(
        integrity_status(F.lit(ticket.row_count), F.lit(evidence.row_count)).alias("integrity"),
        risk_level(F.lit(True), F.lit(ticket.row_count), F.lit(evidence.row_count)).alias("risk"),
    ).first()
    manifest = {
        "ticket_id": ticket.ticket_id,
        "action": ticket.action,
        "operator": operator.strip(),
        "execution_mode": "sandbox",
        "outcome": evidence.outcome,
        "original_row_count": ticket.row_count,
        "final_row_count": evidence.row_count,
        "integrity_status": counts.integrity,
        "risk_level": counts.risk,
    }
    return Approval(
        True, evidence.outcome, evidence.row_count, evidence.output_fingerprint, evidence.output_set, manifest
    )


@dataclass(frozen=True)
class Execution:
    """Outcome of a live execution."""

    published: bool
    outcome: str
    physical_table: str | None = None
    previous_physical_table: str | None = None


def publication_gate(
    ticket: Ticket,
    approval: Approval,
    target: str,
    confirmed: bool,
    executions: DataFrame | None,
    spark: SparkSession,
) -> str | None:
    """The first gate that a live execution does not pass, or None."""
    manifest = approval.manifest
    facts = spark.createDataFrame(
        [
            (
                ticket.ticket_id, ticket.schema_version_id, approval.approved,
                manifest.get("risk_level"), manifest.get("integrity_status"),
                manifest.get("original_row_count"), manifest.get("final_row_count"),
                ticket.action, target, ticket.live_eligible, ticket.source_schema, confirmed,
            )
        ],
        "ticket_id string, schema_version_id string, sandbox_applied boolean, risk_level string, "
        "integrity_status string, original_row_count bigint, final_row_count bigint, action string, "
        "logical_target string, live_eligible boolean, source_schema string, confirmed boolean",
    )
    if executions is None:
        facts = facts.withColumns({"already_executed": F.lit(False), "target_busy": F.lit(False)})
    else:
        facts = ledger.candidate_conflicts(facts, executions)
    return governance.safety_gates(facts).first().gate


def execute_live(
    ticket: Ticket,
    approval: Approval,
    fresh: DataFrame,
    publisher: Publisher,
    target: str,
    execution_id: str,
    as_of: str,
    *,
    confirmed: bool,
    executions: DataFrame | None = None,
    allowed_pairs: Sequence[tuple[str, str]] = (),
    target_id: str | None = None,
) -> Execution:
    """Repair a fresh read and publish it, if it is provably what was approved."""
    spark = fresh.sparkSession
    gate = publication_gate(ticket, approval, target, confirmed, executions, spark)
    if gate is not None:
        return Execution(False, gate)
    if ticket.decision is not None:
        pair = (ticket.decision.source_dtype, ticket.decision.target_dtype)
        if pair not in set(allowed_pairs):
            return Execution(False, "CAST_PAIR_NOT_ALLOWED")
    evidence = gather(fresh, ticket.action, ticket.key, sets=True)
    drift = _source_drift(ticket, fresh, evidence)
    if drift:
        return Execution(False, f"DRIFTED:{','.join(drift)}")
    if evidence.corrected is None:
        return Execution(False, evidence.outcome)
    if evidence.decision != ticket.decision:
        return Execution(False, "DECISION_DIFFERS")
    if not _matches_gold(ticket, evidence.corrected):
        return Execution(False, "INCOMPLETE_MATCH")
    approved = (approval.output_fingerprint, approval.output_set_fingerprint)
    if not all(approved):
        return Execution(False, "NO_APPROVED_FINGERPRINT")
    if approved != (evidence.output_fingerprint, evidence.output_set):
        return Execution(False, "OUTPUT_MISMATCH")
    version, previous = publisher.publish(
        target, evidence.corrected, execution_id, approval.row_count, ticket.gold, as_of, target_id,
        approval.output_fingerprint, approval.output_set_fingerprint,
    )
    return Execution(True, "PUBLISHED", version, previous)
