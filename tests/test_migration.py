"""Repairs, snapshots, publication and the whole life of a migration."""

import uuid

import pytest
from pyspark.sql import functions as F

from spark_rows import rows
from goldseam.operators import profile, repair
from goldseam.operators.fingerprint import measure
from goldseam.plans import evidence
from goldseam.plans.repairs import apply_repair
from goldseam.plans.migration import Table, TicketRefused, approve, execute_live, open_ticket, simulate
from goldseam.session import shared_folder
from goldseam.sources import publish, snapshots
from goldseam.sources.tables import InvalidIdentifierError, fetch_table, require_identifier

AS_OF = "2024-05-01 00:00:00"
GOLD = [("id", "int64"), ("amount", "int64")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "10"), (2, "20"), (3, "-30")], "id bigint, amount string")


def repaired(df, action, gold=GOLD, **kw):
    return apply_repair(df, action, gold, ["id"], as_of=AS_OF, **kw)


def test_safe_cast_changes_only_its_column(texts):
    result = repaired(texts, "CAST_COLUMN amount TO int64")
    assert result.applied and result.outcome == "CAST_SAFE"
    assert rows(result.data) == [(1, 10), (2, 20), (3, -30)]
    m = result.manifest.first()
    assert m.matches_gold_order and m.risk_level == "LOW_RISK" and m.original_row_count == m.final_row_count == 3
    assert m.component_versions["type_repair"] == "phase3.1-policy-v1"


def test_one_bad_value_leaves_everything_as_it_was(spark, texts):
    df = texts.unionByName(spark.createDataFrame([(4, "abc")], texts.schema))
    result = repaired(df, "CAST_COLUMN amount TO int64")
    assert not result.applied and result.outcome == "CAST_UNSAFE" and result.data is df
    m = result.manifest.first()
    assert m.risk_level == "HIGH_RISK" and not m.matches_gold_order and "PARSE_ERROR" in m.conversion_outcome


@pytest.mark.parametrize(
    "action,outcome",
    [
        ("CAST_COLUMN amount TO int64 WITH_DROP_INVALID", "DROP_INVALID_FORBIDDEN"),
        ("CAST_COLUMN Amount TO int64", "CAST_SOURCE_MISSING"),
        ("CAST_COLUMN amount TO decimal", "CAST_UNSUPPORTED"),
        ("CAST_COLUMN amount int64", "INVALID_CAST"),
        ("RENAME_COLUMN nope -> id2", "RENAME_REFUSED"),
        ("RENAME_COLUMN amount -> id", "RENAME_REFUSED"),
        ('REORDER_COLUMNS TO ["amount","id"]', "TARGET_NOT_GOLD_ORDER"),
        ('REORDER_COLUMNS TO ["id","amount"]', "NOT_REORDER_ONLY"),
        ("DROP_COLUMN amount", "UNSUPPORTED_ACTION"),
    ],
)
def test_refused_repairs(texts, action, outcome):
    result = repaired(texts, action)
    assert (result.applied, result.outcome) == (False, outcome)
    assert result.data is texts


def test_live_casts_need_an_allowed_pair(texts):
    assert repaired(texts, "CAST_COLUMN amount TO int64", mode="live").outcome == "CAST_PAIR_NOT_ALLOWED"
    allowed = repaired(texts, "CAST_COLUMN amount TO int64", mode="live", allowed_pairs=[("object", "int64")])
    assert allowed.applied


def test_rename_by_case_only(spark):
    df = spark.createDataFrame([(1, "a")], "Customer_ID bigint, name string")
    assert repair.rename_column(df, "Customer_ID", "customer_id").columns == ["customer_id", "name"]


def test_names_that_differ_by_case_are_two_columns(spark):
    df = spark.createDataFrame([(1, "5", None)], "id bigint, Amount string, amount string")
    observed = rows(profile.observe_schema(df, "d"), "column", "null_count", "unique_count")
    assert observed == [("Amount", 0, 1), ("amount", 1, 0), ("id", 0, 1)]
    assert profile.key_proof(df, "d", ["id"]).first().proved
    found = evidence.gather(df, "CAST_COLUMN Amount TO int64", ["id"])
    assert found.outcome == "CAST_SAFE" and found.source_fingerprint == measure(df).first().data_fingerprint
    assert found.corrected.first() == (1, 5, None)
    assert evidence.gather(df, "CAST_COLUMN amount TO int64", ["id"]).outcome == "CAST_UNSAFE"
    renamed = repair.rename_column(df, "Amount", "total")
    assert renamed.columns == ["id", "total", "amount"]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_reorder_keeps_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1.5, None), (None, float("nan"), 2)], "o string, n double, i bigint")
    gold = [("i", "int64"), ("n", "float64"), ("o", "object")]
    for frame in (df, df.limit(0)):
        result = apply_repair(frame, 'REORDER_COLUMNS TO ["i","n","o"]', gold, ["i"], as_of=AS_OF)
        assert result.outcome == "REORDERED" and result.data.columns == ["i", "n", "o"]
        assert repair.exact_difference(frame, result.data).count() == 0


@pytest.mark.parametrize(
    "action,expected",
    [
        ("CAST_COLUMN amount TO int64", "CAST_SAFE"), ("CAST_COLUMN amount TO float64", "CAST_SAFE"),
        ("CAST_COLUMN amount TO bool", "CAST_UNSAFE"), ("CAST_COLUMN amount TO object", "CAST_SAFE"),
        ("CAST_COLUMN amount TO uuid", "CAST_UNSUPPORTED"), ("RENAME_COLUMN amount -> total", "RENAMED"),
        ('REORDER_COLUMNS TO ["amount","id"]', "REORDERED"),
    ],
)
def test_evidence_of_one_scan_equals_separate_proofs(texts, action, expected):
    found = evidence.gather(texts, action, ["id"])
    assert found.outcome == expected
    assert (found.row_count, found.source_fingerprint) == tuple(measure(texts).first())
    if found.corrected is not None:
        assert found.output_fingerprint == measure(found.corrected).first().data_fingerprint
    if action.startswith("CAST"):
        assert found.decision == evidence.cast_decision(
            texts, [evidence.Cast("amount", action.split()[-1])], ["id"]
        ).first()


def test_values_that_differ_from_their_proof_are_not_applied(texts, monkeypatch):
    real = evidence.rules.converted
    monkeypatch.setattr(evidence.rules, "converted", lambda *a: real(*a) + 1)
    result = repaired(texts, "CAST_COLUMN amount TO int64")
    assert (result.applied, result.outcome) == (False, "CAST_ERROR")


def test_evidence_falls_back_for_long_text(spark):
    df = spark.createDataFrame([(1, str(2**130 + 1)), (2, "1")], "id bigint, amount string")
    found = evidence.gather(df, "CAST_COLUMN amount TO float64", ["id"])
    assert found.outcome == "CAST_UNSAFE" and found.decision.reason_codes == ["PRECISION_LOSS"]


def test_snapshots_are_rechecked_and_never_overwritten(spark, texts):
    folder = shared_folder(spark, "test")
    count, mark = snapshots.capture(texts, folder)
    assert rows(snapshots.load_verified(spark, folder, "d", count, mark)) == rows(texts)
    with pytest.raises(snapshots.ReplayRefused):
        snapshots.load_verified(spark, folder, "d", count, "0" * 64)
    with pytest.raises(snapshots.ReplayRefused):
        snapshots.load_verified(spark, folder, "d", count + 1, mark)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        snapshots.write_snapshot(texts, folder)


def test_folders_come_from_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_only_identifiers_reach_sql(spark):
    for name in ("1a", "a b", "a;b", "x" * 64, "", "a\n"):
        with pytest.raises(InvalidIdentifierError):
            require_identifier(name, "table")
    with pytest.raises(InvalidIdentifierError):
        fetch_table(spark, "a`; DROP")


def test_version_names_keep_their_suffix():
    assert publish.version_table("customer", "a1b2c3d4-e5f6-0718-0000-0") == "customer__a1b2c3d4e5f60718"
    names = {publish.version_table("x" * 63, e * 32) for e in "ab"}
    assert len(names) == 2 and all(len(n) == 63 for n in names)


@pytest.fixture
def site(spark):
    return publish.Publisher(spark, shared_folder(spark, "publish")), "v_" + uuid.uuid4().hex[:10]


def test_publish_twice_and_roll_back_to_nothing(spark, site):
    publisher, target = site
    one = spark.createDataFrame([(1, 10)], "id int, amount bigint")
    two = spark.createDataFrame([(1, 11), (2, 12)], "id int, amount bigint")
    first, before = publisher.publish(target, one, "1" * 32, 1, GOLD, "2024-01-01 00:00:00", "t")
    assert before is None and dict(spark.table(target).dtypes)["id"] == "bigint"
    second, previous = publisher.publish(target, two, "2" * 32, 2, GOLD, "2024-01-02 00:00:00", "t")
    assert previous == first and spark.table(target).count() == 2
    with pytest.raises(publish.StaleRollback):
        publisher.rollback(target, "1" * 32, None, "2024-01-03 00:00:00", "t")
    with pytest.raises(publish.StaleRollback):
        publisher.rollback(target, "2" * 32, first, "2024-01-03 00:00:00", "other")
    publisher.rollback(target, "2" * 32, first, "2024-01-03 00:00:00", "t")
    assert rows(spark.table(target)) == [(1, 10)]
    with pytest.raises(publish.StaleRollback):
        publisher.rollback(target, "2" * 32, first, "2024-01-04 00:00:00", "t")
    assert spark.read.parquet(publisher.version_folder(second)).count() == 2
    assert [r.operation for r in publisher.markers().orderBy("recorded_at").collect()] == [
        "PUBLISH", "PUBLISH", "ROLLBACK",
    ]


def test_first_publish_rolls_back_to_no_view(spark, site):
    publisher, target = site
    publisher.publish(target, spark.createDataFrame([(1, 10)], "id int, amount bigint"), "3" * 32, 1, GOLD, AS_OF)
    publisher.rollback(target, "3" * 32, None, "2024-06-01 00:00:00")
    assert not spark.catalog.tableExists(target)


def test_refused_publications_leave_the_view(spark, site):
    publisher, target = site
    df = spark.createDataFrame([(1, 10)], "id bigint, amount bigint")
    publisher.publish(target, df, "4" * 32, 1, GOLD, "2024-01-01 00:00:00")
    wider = df.withColumn("extra", F.lit(1).cast("bigint"))
    with pytest.raises(publish.PublicationRefused):
        publisher.publish(target, wider, "5" * 32, 1, [*GOLD, ("extra", "int64")], "2024-01-02 00:00:00")
    with pytest.raises(publish.PublicationRefused):
        publisher.publish(target, df, "6" * 32, 2, GOLD, "2024-01-02 00:00:00")
    with pytest.raises(publish.PublicationRefused):
        publisher.publish(target, df.withColumn("amount", F.lit("x")), "7" * 32, 1, GOLD, "2024-01-02 00:00:00")
    with pytest.raises(publish.PublicationRefused, match="approved"):
        publisher.publish(target, df, "b" * 32, 1, GOLD, "2024-01-02 00:00:00", expected_fingerprint="0" * 64)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        publisher.publish(target, df, "4" * 32, 1, GOLD, "2024-01-02 00:00:00")
    assert rows(spark.table(target)) == [(1, 10)] and publisher.markers().count() == 1


PAIRS = [("object", "int64")]


def test_life_of_a_cast(spark, texts, site):
    publisher, target = site
    table = Table(texts, ["id"], GOLD, source_backed=True)
    routed = simulate(spark, {"sales": table}, PAIRS).first()
    assert (routed.action, routed.route) == ("CAST_COLUMN amount TO int64", "REQUIRES_HUMAN_APPROVAL")
    ticket = open_ticket(table, "sales", routed.action, 0.85, "t1", "v1", PAIRS)
    approval = approve(ticket, texts, "ann")
    assert approval.approved, approval.outcome

    def run(df, **kw):
        options = {"confirmed": True, "allowed_pairs": PAIRS, **kw}
        return execute_live(ticket, approval, df, publisher, target, "8" * 32, AS_OF, **options)

    assert run(texts, confirmed=False).outcome == "NOT_CONFIRMED"
    assert run(texts, allowed_pairs=[]).outcome == "CAST_PAIR_NOT_ALLOWED"
    changed = texts.withColumn("amount", F.when(F.col("id") == 2, "21").otherwise(F.col("amount")))
    assert run(changed).outcome == "DRIFTED:DATASET_FINGERPRINT"
    assert run(texts.where("id < 3")).outcome == "DRIFTED:ROW_COUNT,DATASET_FINGERPRINT"
    taken = spark.createDataFrame([("t1", "other", "COMPLETED")], "ticket_id string, logical_target string, status string")
    assert run(texts, executions=taken).outcome == "ALREADY_EXECUTED"
    done = run(texts.repartition(3))
    assert done.published and rows(spark.table(target)) == [(1, 10), (2, 20), (3, -30)]


def test_life_of_a_rename_and_a_reorder(spark, site):
    publisher, target = site
    renamed = spark.createDataFrame([(1, 5), (2, 6)], "Id bigint, amount bigint")
    ticket = open_ticket(Table(renamed, ["Id"], GOLD), "d", "RENAME_COLUMN Id -> id", 0.85, "t2", "v1")
    done = execute_live(ticket, approve(ticket, renamed, "ann"), renamed, publisher, target, "9" * 32, AS_OF, confirmed=True)
    assert done.published and spark.table(target).columns == ["id", "amount"]
    turned = spark.createDataFrame([(7, 1)], "amount bigint, id bigint")
    ticket = open_ticket(Table(turned, ["id"], GOLD), "d", 'REORDER_COLUMNS TO ["id","amount"]', 0.9, "t3", "v1")
    done = execute_live(
        ticket, approve(ticket, turned, "ann"), turned, publisher, target, "a" * 32, "2024-06-01 00:00:00", confirmed=True
    )
    assert done.published and rows(spark.table(target)) == [(1, 7)]


def test_half_repaired_tables_are_not_approved(spark):
    df = spark.createDataFrame([(1, "5")], "Id bigint, amount string")
    ticket = open_ticket(Table(df, ["Id"], GOLD), "d", "RENAME_COLUMN Id -> id", 0.85, "t", "v1")
    assert approve(ticket, df, "ann").outcome == "INCOMPLETE_MATCH"
    assert approve(ticket, df, "  ").outcome == "NO_OPERATOR"


def test_tickets_that_cannot_be_opened(spark, texts):
    doubled = texts.unionByName(texts)
    cases = [
        (Table(doubled, ["id"], GOLD), "CAST_COLUMN amount TO int64", PAIRS, "KEY_NOT_PROVED"),
        (Table(texts, ["id"], GOLD), "CAST_COLUMN amount TO int64", [], "CAST_PAIR_NOT_ALLOWED"),
        (Table(texts, ["id"], [("id", "int64"), ("amount", "int32")]), "CAST_COLUMN amount TO int32", PAIRS, "UNPUBLISHABLE_DTYPE: int32"),
        (Table(texts, ["id"], GOLD), "CAST_COLUMN amount TO bool", [("object", "bool")], "CAST_UNSAFE"),
    ]
    for table, action, pairs, message in cases:
        with pytest.raises(TicketRefused, match=message):
            open_ticket(table, "d", action, 0.85, "t", "v1", pairs)
