import datetime
import random

from pyspark.sql import functions as F

from spark_rows import rows
from goldseam.operators import governance, ledger
from goldseam.operators.ordering import in_pieces

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_versions_number_on_across_days_and_skip_duplicates(spark):
    rng = random.Random(3)
    candidates = [
        (i, "hot" if i % 3 else f"f{i % 5}", 1, [("id", "int64"), (f"c{rng.randrange(40)}", "object")], "ops",
         at(rng.randrange(5 * 24 * 60)))
        for i in range(200)
    ]
    schema = (
        "candidate_id int, schema_name string, format_version int, "
        "columns array<struct<name:string,dtype:string>>, created_by string, submitted_at timestamp_ntz"
    )
    existing = spark.createDataFrame(
        [("hot", 7, "x" * 64)], "schema_name string, version_number int, fingerprint string"
    )
    got = {
        r.candidate_id: (r.outcome, r.version_number)
        for r in ledger.register_versions(spark.createDataFrame(candidates, schema), existing).collect()
    }
    seen, highest, want = set(), {"hot": 7}, {}
    for i, name, _, columns, _, _ in sorted(candidates, key=lambda c: (c[5], c[0])):
        if (name, columns[1][0]) in seen:
            want[i] = ("DUPLICATE_DEFINITION", None)
        else:
            seen.add((name, columns[1][0]))
            highest[name] = highest.get(name, 0) + 1
            want[i] = ("REGISTERED", highest[name])
    assert got == want


def test_definition_rules(spark):
    good = [("id", "int64")]
    cases = [
        ("good_1", 1, good, "ops", None), ("Bad", 1, good, "ops", "INVALID_NAME"), ("1x", 1, good, "ops", "INVALID_NAME"),
        ("a\n", 1, good, "ops", "INVALID_NAME"), ("a", 2, good, "ops", "UNSUPPORTED_FORMAT_VERSION"),
        ("a", 1, [], "ops", "NO_COLUMNS"), ("a", 1, [(" ", "int64")], "ops", "EMPTY_COLUMN_NAME"),
        ("a", 1, [("x", "int64"), ("x", "bool")], "ops", "DUPLICATE_COLUMN_NAME"),
        ("a", 1, [("x", "nonsense")], "ops", "UNSUPPORTED_DTYPE"), ("a", 1, [("x", None)], "ops", "UNSUPPORTED_DTYPE"),
        ("a", 1, [("x", "uuid"), ("y", "Int64"), ("z", "category")], "ops", None), ("a", 1, good, "  ", "NO_AUTHOR"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(cases)],
        "i int, schema_name string, format_version int, columns array<struct<name:string,dtype:string>>, created_by string",
    )
    got = [r[0] for r in df.orderBy("i").select(ledger.definition_error(df)).collect()]
    assert got == [c[4] for c in cases]


def test_first_valid_decision_stands(spark):
    tickets = spark.createDataFrame([(1,), (2,), (3,)], "ticket_id int")
    decisions = spark.createDataFrame(
        [
            (1, 10, "MAYBE", "ann", at(0)), (1, 11, "REJECTED", "ann", at(1)), (1, 12, "APPROVED", "bob", at(2)),
            (2, 13, "APPROVED", " ", at(0)),
        ],
        "ticket_id int, decision_id int, decision string, operator string, decided_at timestamp_ntz",
    )
    states = ledger.ticket_states(tickets, decisions)
    assert rows(states, "ticket_id", "status", "decision_id", "refused_decisions") == [
        (1, "REJECTED", 11, 2), (2, "PENDING", None, 1), (3, "PENDING", None, 0),
    ]
    assert rows(ledger.pending_tickets(tickets, decisions)) == [(2,), (3,)]


MARKER = (
    "marker_id string, execution_id string, logical_target string, physical_table string, "
    "previous_physical_table string, operation string, recorded_at timestamp_ntz, target_id string"
)


def test_operation_outcomes_compare_missing_ids_with_missing_ids(spark):
    markers = spark.createDataFrame(
        [
            ("m1", "e1", "t", "v1", None, "PUBLISH", at(0), None), ("m2", "e2", "t", "v2", "v1", "PUBLISH", at(1), "x"),
            ("m3", "e2", "t", "v2", "v1", "PUBLISH", at(2), "y"),
        ],
        MARKER,
    )
    executions = spark.createDataFrame(
        [("e1", "PUBLISH", None), ("e2", "PUBLISH", "y"), ("e2", "ROLLBACK", "y"), ("e3", "PUBLISH", None)],
        "execution_id string, operation string, target_id string",
    )
    assert rows(ledger.operation_outcome(executions, markers)) == [
        ("e1", "PUBLISH", "completed"), ("e2", "PUBLISH", "completed"), ("e2", "ROLLBACK", "not_committed"),
        ("e3", "PUBLISH", "not_committed"),
    ]
    other = executions.where("execution_id = 'e1'").withColumn("target_id", executions.execution_id)
    assert rows(ledger.operation_outcome(other, markers)) == [("e1", "PUBLISH", "identity_mismatch")]


def test_reconcile_settles_only_what_is_stale_and_proved(spark):
    markers = spark.createDataFrame(
        [
            ("m1", "done", "t", "v1", None, "PUBLISH", at(0), "x"), ("m2", "other", "t", "v2", None, "PUBLISH", at(0), "z"),
            ("m3", "back", "t", None, "v1", "ROLLBACK", at(0), "x"),
        ],
        MARKER,
    )
    executions = spark.createDataFrame(
        [
            ("done", "t", "RUNNING", at(0), None, "x"), ("lost", "t", "RUNNING", at(0), None, "x"),
            ("other", "t", "RUNNING", at(0), None, "x"), ("young", "t", "RUNNING", at(56), None, "x"),
            ("edge", "t", "RUNNING", at(55), None, "x"), ("back", "t", "ROLLING_BACK", at(0), at(1), "x"),
            ("stuck", "t", "ROLLING_BACK", at(0), at(1), "x"), ("new_back", "t", "ROLLING_BACK", at(0), at(58), "x"),
            ("fine", "t", "COMPLETED", at(0), None, "x"),
        ],
        "execution_id string, logical_target string, status string, started_at timestamp_ntz, "
        "rollback_started_at timestamp_ntz, target_id string",
    )
    got = rows(ledger.reconcile(executions, markers, "2024-01-01 01:00:00"), "execution_id", "new_status", "physical_table")
    assert got == [
        ("back", "ROLLED_BACK", None), ("done", "COMPLETED", "v1"), ("edge", "FAILED", None), ("lost", "FAILED", None),
        ("other", "RUNNING", None), ("stuck", "ROLLING_BACK", None),
    ]


def test_transitions_over_midnight(spark):
    steps = [("RUNNING", 0), ("COMPLETED", 60 * 24), ("COMPLETED", 60 * 24 + 1), ("ROLLING_BACK", 60 * 72), ("ROLLED_BACK", 60 * 73)]
    events = spark.createDataFrame(
        [("e", i, at(m), s) for i, (s, m) in enumerate(steps)],
        "execution_id string, event_id int, recorded_at timestamp_ntz, status string",
    )
    got = [(r.previous_status, r.legal) for r in ledger.execution_transitions(events).orderBy("event_id").collect()]
    assert got == [(None, True), ("RUNNING", True), ("COMPLETED", False), ("COMPLETED", True), ("ROLLING_BACK", True)]
    assert ledger.execution_state(events).first().status == "ROLLED_BACK"


def test_failed_executions_may_be_tried_again(spark):
    executions = spark.createDataFrame(
        [("t1", "a", "FAILED"), ("t1", "a", "RUNNING"), ("t2", "b", "COMPLETED"), ("t2", "b", "ROLLED_BACK"), ("t3", "a", "PENDING")],
        "ticket_id string, logical_target string, status string",
    )
    assert rows(ledger.execution_conflicts(executions)) == [("TARGET", "a", 2), ("TICKET", "t2", 2)]
    candidates = spark.createDataFrame([("t9", "a"), ("t2", "b"), ("t9", "b")], "ticket_id string, logical_target string")
    assert rows(ledger.candidate_conflicts(candidates, executions)) == [
        ("t2", "b", True, False), ("t9", "a", False, True), ("t9", "b", False, False),
    ]


def test_identities_agree_between_runs_and_do_not_run_together(spark):
    schema = "source_system string, source_schema string, source_table string"
    key = ["source_system", "source_schema", "source_table"]
    incoming = spark.createDataFrame([("a", "bc", "d"), ("a", "b", "cd"), ("a", "bc", "d"), ("a", "b-", "d")], schema)
    none = spark.createDataFrame([], schema + ", id string")
    first = ledger.resolve_identities(incoming, none, key, "id")
    ids = {r.id for r in first.collect() if r.status == "NEW"}
    assert len(ids) == 2 and first.where("status = 'INVALID_IDENTIFIER'").count() == 1
    again = ledger.resolve_identities(incoming, first.where("status = 'NEW'").drop("status"), key, "id")
    assert {r.id for r in again.collect() if r.status == "EXISTING"} == ids


GATES = (
    "ticket_id string, schema_version_id string, sandbox_applied boolean, risk_level string, integrity_status string, "
    "original_row_count bigint, final_row_count bigint, action string, logical_target string, live_eligible boolean, "
    "source_schema string, confirmed boolean, already_executed boolean, target_busy boolean"
)


def test_each_gate_in_turn(spark):
    names = [part.split()[0] for part in GATES.split(", ")]
    good = dict(zip(names, ("ok", "v1", True, "LOW_RISK", "NO_VOLUME_CHANGE", 5, 5, "RENAME_COLUMN a -> b", "t", True,
                            "public", True, False, False)))
    broken = [
        ("schema_version_id", None, "SCHEMA_VERSION_MISSING"), ("sandbox_applied", False, "SANDBOX_NOT_APPLIED"),
        ("risk_level", "HIGH_RISK", "RISK_NOT_LOW"), ("integrity_status", "DATA_GAIN_EVENT", "VOLUME_CHANGED"),
        ("final_row_count", 4, "ROW_COUNTS_DIFFER"), ("action", "CAST_COLUMN a TO int64 WITH_DROP_INVALID", "DROP_INVALID_FORBIDDEN"),
        ("logical_target", "x;drop", "INVALID_TARGET"), ("live_eligible", None, "NOT_LIVE_ELIGIBLE"),
        ("source_schema", "gold_publish_data", "SOURCE_IS_PUBLICATION"), ("confirmed", False, "NOT_CONFIRMED"),
        ("already_executed", True, "ALREADY_EXECUTED"), ("target_busy", True, "TARGET_BUSY"),
    ]
    cases = [{**good}]
    for i in range(len(broken)):
        case = {**good, "ticket_id": str(i)}
        for field, value, _ in broken[i:]:
            case[field] = value
        cases.append(case)
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cases], GATES)
    got = {r.ticket_id: (r.gate, r.verdict) for r in governance.safety_gates(df).collect()}
    want = {"ok": (None, "PASS")}
    for i, (_, _, gate) in enumerate(broken):
        want[str(i)] = (gate, "CONFLICT" if gate in ("ALREADY_EXECUTED", "TARGET_BUSY") else "NOT_ALLOWED")
    assert got == want


def test_one_family_at_one_moment_is_numbered_in_pieces(spark):
    names = [f"n{(i * 7919) % 5000}" for i in range(6000)]
    candidates = spark.createDataFrame(
        [(i, "hot", 1, [("id", "int64"), (names[i], "object")], "ops", T0) for i in range(6000)],
        "candidate_id int, schema_name string, format_version int, "
        "columns array<struct<name:string,dtype:string>>, created_by string, submitted_at timestamp_ntz",
    )
    existing = spark.createDataFrame([], "schema_name string, version_number int, fingerprint string")
    got = {
        r.candidate_id: r.version_number for r in ledger.register_versions(candidates, existing).collect()
    }
    assert [got[i] for i in range(5000)] == list(range(1, 5001))
    assert {got[i] for i in range(5000, 6000)} == {None}


def test_pieces_split_a_key_at_one_moment(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("k"), F.lit(T0).alias("t"), "id")
    with_conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {name: spark.conf.get(name) for name in with_conf}
    try:
        for name, value in with_conf.items():
            spark.conf.set(name, value)
        cut = in_pieces(df, "k", ["t", "id"], "piece", "test-pieces")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    pieces = cut.groupBy("piece").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    pieces = pieces.orderBy("piece").collect()
    assert len(pieces) == 6 and max(p.n for p in pieces) < 10_000 and sum(p.n for p in pieces) == 30_000
    assert all(a.hi < b.lo for a, b in zip(pieces, pieces[1:]))


def test_transitions_at_one_moment_and_without_an_execution(spark):
    rng = random.Random(5)
    status = [rng.choice(["PENDING", "RUNNING", "COMPLETED", "ROLLING_BACK", "ROLLED_BACK", "FAILED"]) for _ in range(4000)]
    events = spark.createDataFrame(
        [("e" if i % 4 else None, i, T0, s) for i, s in enumerate(status)],
        "execution_id string, event_id int, recorded_at timestamp_ntz, status string",
    )
    got = {r.event_id: r.previous_status for r in ledger.execution_transitions(events).collect()}
    last, want = {}, {}
    for i, s in enumerate(status):
        own = i % 4 == 0
        want[i], last[own] = last.get(own), s
    assert got == want
    assert ledger.execution_transitions(events.limit(0)).collect() == []
