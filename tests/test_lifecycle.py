"""The recorded life of a migration on a small table."""

import pytest
from pyspark.sql import functions as F

from goldseam.operators.governance import output_match, plan_route
from goldseam.operators.joining import left_join_known
from goldseam.operators.ledger import execution_transitions
from goldseam.plans.lifecycle import Lifecycle, LifecycleRefused
from goldseam.plans.migration import Table
from goldseam.sources.publish import StaleRollback

GOLD = [("id", "int64"), ("amount", "int64")]
PAIRS = [("object", "int64")]
CAST = "CAST_COLUMN amount TO int64"


def table(spark, *amounts):
    data = spark.createDataFrame(list(enumerate(amounts)), "id bigint, amount string")
    return Table(data, ["id"], GOLD, source_backed=True)


@pytest.fixture(scope="module")
def life(spark, tmp_path_factory):
    return Lifecycle(spark, str(tmp_path_factory.mktemp("life")), "t")


def test_drift_review_and_reconciliation(spark, life):
    plain = table(spark, "1", "2", "-3")
    read = life.capture(plain, "d", "s1", "2024-01-01 00:00:00")
    assert life.capture(plain, "d", "s2", "2024-01-01 01:00:00").snapshot.snapshot_id == read.snapshot.snapshot_id
    ticket = life.open(plain, read, CAST, 0.85, "t1", "v1", PAIRS)
    with pytest.raises(LifecycleRefused, match="TICKET_NOT_APPROVED"):
        life.execute(ticket, read, plain, "life_view", "e0", "2024-01-02 00:00:00", confirmed=True, allowed_pairs=PAIRS)
    assert life.read("events").isEmpty()
    assert life.approve(ticket, read, "ops", "2024-01-02 00:00:00").approved
    with pytest.raises(LifecycleRefused, match="TICKET_NOT_PENDING"):
        life.approve(ticket, read, "ops", "2024-01-02 00:00:00")
    drifted = table(spark, "1", "2", "4")
    result = life.execute(
        ticket, read, drifted, "life_view", "e1", "2024-01-03 00:00:00", confirmed=True, allowed_pairs=PAIRS
    )
    assert not result.published and result.outcome.startswith("DRIFTED")
    outcomes = {r.run_id: r.outcome for r in life.read("runs").collect()}
    assert outcomes == {"s1": "CAPTURED", "s2": "CAPTURED", "e1-revalidation": "DRIFTED"}
    with pytest.raises(StaleRollback, match="NOT_COMPLETED"):
        life.rollback("e1", "2024-01-04 00:00:00")
    assert not life.execute(
        ticket, read, plain, "life_view", "e2", "2024-01-05 00:00:00", confirmed=False, allowed_pairs=PAIRS
    ).published
    assert life.execute(
        ticket, read, plain, "life_view", "e3", "2024-01-05 01:00:00", confirmed=True, allowed_pairs=PAIRS
    ).published
    assert [tuple(r) for r in spark.table("life_view").orderBy("id").collect()] == [(0, 1), (1, 2), (2, -3)]
    # an execution that died without a word is settled from the markers
    life._event("e4", "t9", "other_view", "RUNNING", "2024-01-06 00:00:00")
    settled = life.reconcile("2024-01-06 01:00:00").collect()
    assert [(r.execution_id, r.new_status) for r in settled] == [("e4", "FAILED")]
    states = {r.execution_id: r.status for r in life.executions().collect()}
    assert states == {"e1": "FAILED", "e3": "COMPLETED", "e4": "FAILED"}
    assert execution_transitions(life.read("events")).where(~F.col("legal")).isEmpty()
    with pytest.raises(LifecycleRefused, match="UNKNOWN_BASELINE"):
        life.append_run(
            run_id="x", dataset_id="d", purpose="LIVE_REVALIDATION", outcome="MATCHED", snapshot_id="d-s1",
            baseline_run_id="nope", started_at="2024-01-01 00:00:00", completed_at="2024-01-01 00:00:00",
        )


def test_conflicting_evidence_is_refused(spark, life):
    row = life.capture(table(spark, "7"), "c", "s9", "2024-01-01 00:00:00").snapshot.asDict()
    row.update(source_row_count=99, folder=None)
    with pytest.raises(LifecycleRefused, match="SNAPSHOT_CONFLICT"):
        life._resolve(row, table(spark, "7").data, "again")


def test_latest_manifest_counts_once(spark):
    manifests = spark.createDataFrame(
        [(1, "t", 5, "old"), (2, "t", 6, "new"), (3, None, 7, "x")],
        "manifest_id int, ticket_id string, recorded_at int, output_fingerprint string",
    )
    executions = spark.createDataFrame(
        [("e1", "t", "new"), ("e2", "t", "old"), ("e3", None, "x")],
        "execution_id string, ticket_id string, output_fingerprint string",
    )
    got = {r.execution_id: r.outcome for r in output_match(manifests, executions).collect()}
    assert got == {"e1": "MATCH", "e2": "MISMATCH", "e3": "NO_APPROVED_FINGERPRINT"}


def test_route_needs_the_proof_of_its_own_column(spark):
    selected = spark.createDataFrame(
        [("a", "CAST", "v", " INT64 ", 0.85, False), ("b", "CAST", "v", "int64", 0.85, False)],
        "dataset string, kind string, column string, target string, confidence double, source_backed boolean",
    )
    proofs = spark.createDataFrame(
        [("a", "v", "int64", "SAFE"), ("a", "w", "int64", "UNSAFE"), ("b", "w", "int64", "SAFE"), ("b", "v", "bool", "SAFE")],
        "dataset string, column_name string, target_dtype string, status string",
    )
    got = {r.dataset: r.route for r in plan_route(selected, proofs).collect()}
    assert got == {"a": "REQUIRES_HUMAN_APPROVAL", "b": "BLOCKED_BY_CONVERSION_SAFETY"}


def test_join_spreads_rows_without_a_key(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 1000, 20).select(F.col("id").alias("k"), F.lit("x").alias("y"))
    joined = left_join_known(left, right, "k")
    assert joined.count() == 1000 and joined.where("y = 'x'").count() == 50
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(k#" in (plan := left_join_known(left, right, "k")._jdf.queryExecution().toString())
        assert "_spread#" in plan.split("hashpartitioning(k#")[1].split(")")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
