"""Publication as a commit log: exclusive numbers, and agreement wherever a writer dies."""

import threading

import pytest
from pyspark.sql import functions as F

from goldseam.operators.ledger import execution_transitions
from goldseam.plans.lifecycle import Lifecycle, LifecycleRefused
from goldseam.plans.migration import Table
from goldseam.sources.commit_log import CommitLog, NoExclusiveCommit, NumberTaken
from goldseam.sources.publish import ConcurrentPublication, Publisher, StaleRollback

GOLD = [("id", "int64"), ("amount", "int64")]
PAIRS = [("object", "int64")]
CAST = "CAST_COLUMN amount TO int64"


class Died(Exception):
    """Stands for the end of a writer."""


def test_numbers_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.head("a") is None and log.targets() == []
    log.commit("a", 1, {"x": "é", "y": None})
    with pytest.raises(NumberTaken):
        log.commit("a", 1, {"x": "other"})
    log.commit("a", 2, {"x": "2"})
    log.commit("b", 1, {"x": "b"})
    assert log.head("a").number == 2 and log.record("a", 1)["x"] == "é" and log.targets() == ["a", "b"]
    rows = log.records("x string, commit_number bigint", "a").orderBy("commit_number").collect()
    assert [tuple(r) for r in rows] == [("é", 1), ("2", 2)]
    assert log.records("x string").count() == 3
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.name.startswith(".") and not p.name.endswith(".crc")]


def test_many_writers_of_one_number(spark, tmp_path):
    log, won = CommitLog(spark, str(tmp_path)), []

    def write(i):
        try:
            log.commit("t", 1, {"by": str(i)})
            won.append(i)
        except NumberTaken:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.head("t")["by"] == str(won[0])


def test_other_stores(spark, tmp_path):
    """Stores with an exclusive rename use it (tried on the local one); others are refused."""

    class Renaming(CommitLog):
        def __init__(self, *args):
            super().__init__(*args)
            self.kind = "hdfs"

        def _take_name(self, system, draft, final):
            kind = self.kind

            class Kind:
                def getUri(self):
                    return self

                def getScheme(self):
                    return kind

            class System(Kind):
                def getUri(self):
                    return type("Uri", (), {"getScheme": lambda _: kind})()

            if kind == "hdfs":
                real = system.getUri()
                probe = System()
                probe.getUri = lambda: _Uri(real, kind)
                return super()._take_name(probe, draft, final)
            return super()._take_name(System(), draft, final)

    class _Uri:
        def __init__(self, real, kind):
            self.getScheme = lambda: kind
            self._get_object_id = real._get_object_id
            self._target_id = real._target_id

    log = Renaming(spark, str(tmp_path))
    log.commit("t", 1, {"x": "1"})
    with pytest.raises(NumberTaken):
        log.commit("t", 1, {"x": "2"})
    assert log.head("t")["x"] == "1"
    log.kind = "s3a"
    with pytest.raises(NoExclusiveCommit):
        log.commit("t", 2, {"x": "2"})
    assert log.head("t").number == 1


def frame(spark, *amounts):
    return spark.createDataFrame(list(enumerate(amounts)), "id bigint, amount bigint")


def publish(publisher, target, df, execution, hour):
    return publisher.publish(target, df, execution, df.count(), GOLD, f"2024-01-01 {hour:02}:00:00", "t")


def shown(spark, view):
    return [r.amount for r in spark.table(view).orderBy("id").collect()] if spark.catalog.tableExists(view) else None


def test_two_publishers_of_one_target(spark, tmp_path):
    """The second commits while the first is writing: the first is refused and changes nothing."""
    other = Publisher(spark, str(tmp_path))

    class Slow(Publisher):
        def _check(self, *args):
            super()._check(*args)
            publish(other, "race_view", frame(spark, 2), "2" * 16, 2)

    with pytest.raises(ConcurrentPublication):
        publish(Slow(spark, str(tmp_path)), "race_view", frame(spark, 1), "1" * 16, 1)
    assert shown(spark, "race_view") == [2]
    assert [r.execution_id for r in other.markers().collect()] == ["2" * 16]
    # again, now alone; then a rollback meets a newer publish
    publish(other, "race_view", frame(spark, 1), "1" * 16, 3)
    assert shown(spark, "race_view") == [1]
    with pytest.raises(StaleRollback):
        other.rollback("race_view", "2" * 16, None, "2024-01-02 00:00:00", "t")


def test_a_view_that_a_slow_writer_sets_back_is_set_right(spark, tmp_path):
    """While the first shows its version, a newer one is committed and shown: the newest stays."""

    class Late(Publisher):
        def _show(self, target, record):
            if record.number == 1:
                publish(Publisher(self.spark, self.folder), target, frame(self.spark, 2), "2" * 16, 2)
            super()._show(target, record)

    publish(Late(spark, str(tmp_path)), "late_view", frame(spark, 1), "1" * 16, 1)
    assert shown(spark, "late_view") == [2]


def test_clock_that_runs_back(spark, tmp_path):
    publisher = Publisher(spark, str(tmp_path))
    publish(publisher, "clock_view", frame(spark, 1), "b" * 16, 9)
    publish(publisher, "clock_view", frame(spark, 2), "a" * 16, 3)
    times = [r.recorded_at for r in publisher.markers().orderBy("marker_id").collect()]
    assert times == sorted(times) and shown(spark, "clock_view") == [2]
    publisher.rollback("clock_view", "a" * 16, f"clock_view__{'b' * 16}", "2024-01-01 00:00:00", "t")
    assert shown(spark, "clock_view") == [1]
    assert publisher.repair("clock_view") == "AGREES" and publisher.repair("nothing") == "NEVER_PUBLISHED"
    spark.sql("DROP VIEW clock_view")
    assert publisher.repair_all() == {"clock_view": "REPOINTED"} and shown(spark, "clock_view") == [1]


class Stopping(Publisher):
    """A publisher that dies before or after one step."""

    stop: tuple = ()

    def _dying(self, step, call):
        if (step, "before") == Stopping.stop:
            raise Died
        result = call()
        if (step, "after") == Stopping.stop:
            raise Died
        return result

    def _write(self, *args):
        return self._dying("write", lambda: super(Stopping, self)._write(*args))

    def _check(self, *args):
        return self._dying("check", lambda: super(Stopping, self)._check(*args))

    def _commit(self, *args, **fields):
        return self._dying("commit", lambda: super(Stopping, self)._commit(*args, **fields))

    def _show(self, *args):
        return self._dying("show", lambda: super(Stopping, self)._show(*args))


def table(spark, *amounts):
    data = spark.createDataFrame(list(enumerate(amounts)), "id bigint, amount string")
    return Table(data, ["id"], GOLD, source_backed=True)


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    """A lifecycle with a captured table and many approved tickets."""
    life = Lifecycle(spark, str(tmp_path_factory.mktemp("dying")), "t")
    life.publisher = Stopping(spark, life.publisher.folder)
    plain = table(spark, "1", "2")
    read = life.capture(plain, "d", "s1", "2024-01-01 00:00:00")
    first = life.open(plain, read, CAST, 0.85, "t0", "v1", PAIRS)
    life.approve(first, read, "ops", "2024-01-01 01:00:00")
    return life, plain, read, first


@pytest.mark.parametrize(
    ("step", "when", "killed"),
    [
        ("write", "after", False), ("commit", "before", False), ("commit", "after", False), ("show", "before", False),
        ("check", "after", True), ("commit", "after", True), ("show", "before", True),
    ],
)
def test_every_step_once(spark, ready, monkeypatch, step, when, killed):
    """Failed (settled at once) or killed (settled by reconcile): view, marker and state agree."""
    life, plain, read, ticket = ready
    name = f"{step}_{when}_{'killed' if killed else 'failed'}"
    execution, view, at = f"e{name}", f"v_{name}", "2024-01-03 00:00:00"
    if killed:
        monkeypatch.setattr(life, "_settled", lambda *a: None)  # nobody is left to settle it
    monkeypatch.setattr(life, "executions", lambda: Lifecycle.executions(life).where(F.col("execution_id") == execution))
    Stopping.stop = (step, when)
    public = step == "show" or (step, when) == ("commit", "after")

    def run():
        return life.execute(ticket, read, plain, view, execution, at, confirmed=True, allowed_pairs=PAIRS)

    try:
        if public and not killed:
            assert run().published
        else:
            with pytest.raises(Died):
                run()
    finally:
        Stopping.stop = ()
    if killed:
        life.reconcile("2024-01-04 00:00:00")
    elif step == "show":
        life.publisher.repair_all()
    state = life.executions().first().status
    marks = life.publisher.markers().where(F.col("execution_id") == execution).count()
    assert (state, marks) == (("COMPLETED", 1) if public else ("FAILED", 0))
    assert shown(spark, view) == ([1, 2] if public else None)
    assert execution_transitions(life.read("events")).where(~F.col("legal")).isEmpty()
    with pytest.raises(LifecycleRefused, match="EXECUTION_ID_USED"):
        run()


def test_rollback_dies_after_its_commit(spark, tmp_path):
    life = Lifecycle(spark, str(tmp_path), "t")
    life.publisher = Stopping(spark, life.publisher.folder)
    plain = table(spark, "5")
    read = life.capture(plain, "d", "s1", "2024-01-01 00:00:00")
    ticket = life.open(plain, read, CAST, 0.85, "t1", "v1", PAIRS)
    life.approve(ticket, read, "ops", "2024-01-01 01:00:00")
    assert life.execute(ticket, read, plain, "rb_view", "e1", "2024-01-02 00:00:00", confirmed=True, allowed_pairs=PAIRS).published
    Stopping.stop = ("commit", "before")
    try:
        with pytest.raises(Died):
            life.rollback("e1", "2024-01-03 00:00:00")
    finally:
        Stopping.stop = ()
    assert shown(spark, "rb_view") == [5]
    assert life.executions().first().status == "ROLLING_BACK"
    assert life.reconcile("2024-01-04 00:00:00").first().needs_review
    life.publisher.rollback("rb_view", "e1", None, "2024-01-04 01:00:00", "t")
    assert [r.new_status for r in life.reconcile("2024-01-05 00:00:00").collect()] == ["ROLLED_BACK"]
    assert shown(spark, "rb_view") is None
    links = life.read("links").collect()
    assert [(r.execution_id, r.revalidation_run_id) for r in links] == [("e1", "e1-revalidation")]
    with pytest.raises(LifecycleRefused, match="NOT_RUNNING"):
        life.attach("e1", "e1-revalidation", "2024-01-05 00:00:00")


def test_refused_tickets_and_failed_reads(spark, tmp_path):
    life = Lifecycle(spark, str(tmp_path), "t")
    plain = table(spark, "5")
    read = life.capture(plain, "d", "s1", "2024-01-01 00:00:00")
    ticket = life.open(plain, read, CAST, 0.85, "t1", "v1", PAIRS)
    with pytest.raises(LifecycleRefused, match="OPERATOR_MISSING"):
        life.refuse("t1", "  ", "2024-01-02 00:00:00")
    life.refuse("t1", "ops", "2024-01-02 00:00:00")
    for again in (
        lambda: life.refuse("t1", "ops", "2024-01-02 00:00:00"),
        lambda: life.refuse("unknown", "ops", "2024-01-02 00:00:00"),
        lambda: life.approve(ticket, read, "ops", "2024-01-02 00:00:00"),
    ):
        with pytest.raises(LifecycleRefused, match="TICKET_NOT_PENDING"):
            again()
    with pytest.raises(LifecycleRefused, match="TICKET_NOT_APPROVED"):
        life.execute(ticket, read, plain, "no_view", "e1", "2024-01-03 00:00:00", confirmed=True, allowed_pairs=PAIRS)
    twice = Table(plain.data.union(plain.data), ["id"], GOLD, source_backed=True)
    with pytest.raises(LifecycleRefused, match="KEY_NOT_PROVED"):
        life.capture(twice, "d", "s2", "2024-01-02 00:00:00")
    broken = plain.data.select("id", F.raise_error(F.lit("secret 4711")).cast("string").alias("amount"))
    with pytest.raises(LifecycleRefused, match="SOURCE_READ_FAILED"):
        life.capture(Table(broken, ["id"], GOLD, source_backed=True), "d", "s3", "2024-01-02 00:00:00")
    ok = life.open(plain, read, CAST, 0.85, "t2", "v1", PAIRS)
    life.approve(ok, read, "ops", "2024-01-02 01:00:00")
    with pytest.raises(LifecycleRefused, match="KEY_NOT_PROVED"):
        life.execute(ok, read, twice, "no_view", "e2", "2024-01-03 00:00:00", confirmed=True, allowed_pairs=PAIRS)
    runs = {r.run_id: (r.purpose, r.outcome, r.failure_code, r.baseline_run_id) for r in life.read("runs").collect()}
    assert runs == {
        "s1": ("SIMULATION", "CAPTURED", None, None),
        "s2": ("SIMULATION", "FAILED", "SOURCE_VALIDATION_FAILED", None),
        "s3": ("SIMULATION", "FAILED", "SOURCE_READ_FAILED", None),
        "e2-revalidation": ("LIVE_REVALIDATION", "FAILED", "SOURCE_VALIDATION_FAILED", "s1"),
    }
    assert life.read("runs").where(F.col("failure_reason").contains("4711")).isEmpty()
    assert [tuple(r)[:2] for r in life.read("links").collect()] == [("e2", "e2-revalidation")]
    assert life.executions().first().status == "FAILED"


def test_a_table_of_runs(spark, tmp_path):
    life = Lifecycle(spark, str(tmp_path), "t")
    life.capture(table(spark, "5"), "d", "s1", "2024-01-01 00:00:00")
    base = {"dataset_id": "d", "started_at": "2024-01-01 00:00:00", "completed_at": "2024-01-01 00:00:01"}
    stored = {"snapshot_id": "d-s1", "outcome": "CAPTURED", "purpose": "SIMULATION"}
    again = {"purpose": "LIVE_REVALIDATION", "outcome": "MATCHED", "snapshot_id": "d-s1"}
    batch = [
        {"run_id": "a", **base, **stored},
        {"run_id": "b", **base, **again, "baseline_run_id": "a"},  # of the same table
        {"run_id": "c", **base, **again, "baseline_run_id": "s1"},  # of the ledger
        {"run_id": "x1", **base, **again, "baseline_run_id": "b"},  # no captured simulation
        {"run_id": "x2", **base, **again, "baseline_run_id": "x3"},
        {"run_id": "x3", **base, **stored, "dataset_id": "?"},
        {"run_id": "x4", **base, **stored}, {"run_id": "x4", **base, **stored},
        {"run_id": "s1", **base, **stored}, {"run_id": None, **base, **stored},
    ]
    got = {(r.run_id, r.violation) for r in life.append_runs(life._rows("runs", batch)).collect()}
    assert got == {
        ("a", None), ("b", None), ("c", None), ("x1", "BASELINE_NOT_CAPTURED"), ("x2", "UNKNOWN_BASELINE"),
        ("x3", "UNKNOWN_DATASET"), ("x4", "RUN_ID_USED"), ("s1", "RUN_ID_USED"), (None, "RUN_ID_MISSING"),
    }
    assert sorted(r.run_id for r in life.read("runs").collect()) == ["a", "b", "c", "s1"]
