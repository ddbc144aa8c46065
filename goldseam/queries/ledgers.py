"""Queries on ledgers: versions, identities, runs, tickets, manifests, markers, executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.operators import ledger as ops
from goldseam.operators.fingerprint import gold_fingerprint
from goldseam.queries import register
from goldseam.queries.fixtures import Fixture, with_sql

# --- Gold versions ---------------------------------------------------------------------
# A third of all candidates belong to one family.
_CANDIDATES = Fixture(
    "events",
    [
        "event_id AS candidate_id",
        "CASE WHEN event_id % 29 = 0 THEN 'Bad Name' WHEN user_id % 3 = 0 THEN 'family_0' "
        "ELSE concat('family_', CAST(user_id % 12 AS STRING)) END AS schema_name",
        "CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS format_version",
        "CASE WHEN event_id % 41 = 0 THEN 'id' WHEN event_id % 43 = 0 THEN '' "
        "ELSE concat('c', CAST(event_id % 400 AS STRING)) END AS second_name",
        "CASE WHEN event_id % 37 = 0 THEN 'nonsense' ELSE 'float64' END AS second_dtype",
        "CASE WHEN event_id % 47 = 0 THEN '  ' ELSE 'ops' END AS created_by",
        "CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END AS submitted_at",
    ],
)
_EXISTING = Fixture(
    "customer",
    [
        "concat('family_', CAST(c_custkey % 11 AS STRING)) AS schema_name",
        "CAST(floor(c_custkey / 11) AS BIGINT) + 1 AS version_number",
        "concat('c', CAST(c_custkey % 600 AS STRING)) AS second_name",
        "c_name AS change_summary",
    ],
)


def _definition_sql(second_dtype: str) -> str:
    return (
        "sha256(concat('{\"columns\":[{\"dtype\":\"int64\",\"name\":\"id\"},{\"dtype\":\"', "
        f"{second_dtype}, '\",\"name\":\"', second_name, '\"}}],\"format_version\":1}}'))"
    )


def _definition(second_dtype):
    return F.array(
        F.struct(F.lit("id").alias("name"), F.lit("int64").alias("dtype")),
        F.struct(F.col("second_name").alias("name"), second_dtype.alias("dtype")),
    )


def _existing(spark, sf_dir):
    versions = _EXISTING.frame(spark, sf_dir).select(
        "schema_name",
        "version_number",
        F.lit(1).alias("format_version"),
        _definition(F.lit("float64")).alias("columns"),
        "change_summary",
    )
    return gold_fingerprint(versions)


def _registered_sql(candidates: Fixture) -> str:
    return with_sql(
        "SELECT candidate_id, schema_name, CASE WHEN error IS NULL THEN fingerprint ELSE 'none' END AS fingerprint, "
        "coalesce(error, CASE WHEN v IS NULL THEN 'DUPLICATE_DEFINITION' ELSE 'REGISTERED' END) AS outcome, "
        "coalesce(v, -1) AS version_number FROM k LEFT JOIN n USING (candidate_id)",
        c=candidates,
        e=_EXISTING,
        k="SELECT *, " + _definition_sql("second_dtype") + " AS fingerprint, CASE "
        "WHEN NOT regexp_full_match(schema_name, '[a-z][a-z0-9_]*') THEN 'INVALID_NAME' "
        "WHEN format_version <> 1 THEN 'UNSUPPORTED_FORMAT_VERSION' WHEN second_name = '' THEN 'EMPTY_COLUMN_NAME' "
        "WHEN second_name = 'id' THEN 'DUPLICATE_COLUMN_NAME' WHEN second_dtype = 'nonsense' THEN 'UNSUPPORTED_DTYPE' "
        "WHEN trim(created_by) = '' THEN 'NO_AUTHOR' WHEN submitted_at IS NULL THEN 'NO_SUBMISSION_TIME' END AS error FROM c",
        x="SELECT schema_name, version_number, " + _definition_sql("'float64'") + " AS fingerprint FROM e",
        fresh="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, fingerprint "
        "ORDER BY submitted_at, candidate_id) AS rn FROM k WHERE error IS NULL) f WHERE rn = 1 AND NOT EXISTS "
        "(SELECT 1 FROM x WHERE x.schema_name = f.schema_name AND x.fingerprint = f.fingerprint)",
        n="SELECT candidate_id, row_number() OVER (PARTITION BY schema_name ORDER BY submitted_at, candidate_id) "
        "+ coalesce((SELECT max(version_number) FROM x WHERE x.schema_name = fresh.schema_name), 0) AS v FROM fresh",
    )


def _registered(spark, sf_dir, fixture):
    candidates = fixture.frame(spark, sf_dir).withColumn("columns", _definition(F.col("second_dtype")))
    registered = ops.register_versions(candidates, _existing(spark, sf_dir))
    return registered.withColumn(
        "fingerprint", F.coalesce("fingerprint", F.lit("none"))
    ).withColumn("version_number", F.coalesce("version_number", F.lit(-1)))


@register("register_versions", _registered_sql(_CANDIDATES))
def register_versions(spark, sf_dir):
    return _registered(spark, sf_dir, _CANDIDATES)


# A bulk load: one family, one moment, nearly every definition new.
_BULK = Fixture(
    "orders",
    [
        "o_orderkey AS candidate_id",
        "CASE WHEN o_orderkey % 50 = 0 THEN 'family_1' ELSE 'family_0' END AS schema_name",
        "1 AS format_version",
        "concat('b', CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE -o_orderkey END AS STRING)) AS second_name",
        "'float64' AS second_dtype",
        "'ops' AS created_by",
        "CAST('2024-03-01 12:00:00' AS TIMESTAMP) AS submitted_at",
    ],
)


@register("register_versions_bulk", _registered_sql(_BULK))
def register_versions_bulk(spark, sf_dir):
    return _registered(spark, sf_dir, _BULK)


@register(
    "gold_latest",
    with_sql(
        "SELECT schema_name, version_number, second_name, change_summary FROM e QUALIFY "
        "row_number() OVER (PARTITION BY schema_name ORDER BY version_number DESC) = 1",
        e=_EXISTING,
    ),
)
def gold_latest(spark, sf_dir):
    return ops.gold_latest(_EXISTING.frame(spark, sf_dir))


_WANTED = Fixture(
    "orders",
    [
        "o_orderkey",
        "concat('family_', CAST(o_custkey % 13 AS STRING)) AS schema_name",
        "CAST(o_orderkey % 160 AS BIGINT) AS version_number",
    ],
)


@register(
    "gold_version",
    with_sql(
        "SELECT o_orderkey, w.schema_name, w.version_number, coalesce(second_name, 'none') AS second_name "
        "FROM w LEFT JOIN e ON e.schema_name = w.schema_name AND e.version_number = w.version_number",
        e=_EXISTING,
        w=_WANTED,
    ),
)
def gold_version(spark, sf_dir):
    found = ops.gold_version(_EXISTING.frame(spark, sf_dir), _WANTED.frame(spark, sf_dir))
    return found.select(
        "o_orderkey", "schema_name", "version_number",
        F.coalesce("second_name", F.lit("none")).alias("second_name"),
    )


@register("gold_history", with_sql("SELECT * FROM e ORDER BY schema_name, version_number DESC", e=_EXISTING))
def gold_history(spark, sf_dir):
    return ops.gold_history(_EXISTING.frame(spark, sf_dir))


# --- identities ----------------------------------------------------------------------------
_SEEN = Fixture(
    "orders",
    [
        "concat('sys_', CAST(o_custkey % 5 AS STRING)) AS source_system",
        "CASE o_orderstatus WHEN 'F' THEN 'finance' WHEN 'O' THEN 'ops' ELSE 'people' END AS source_schema",
        "CASE WHEN o_custkey % 50 = 0 THEN '9bad' ELSE concat('t_', CAST(o_custkey AS STRING)) END AS source_table",
    ],
)
_KNOWN = Fixture(
    "customer",
    [
        "CASE WHEN c_custkey % 3 = 0 THEN concat('sys_', CAST(c_custkey % 5 AS STRING)) "
        "ELSE 'retired' END AS source_system",
        "'finance' AS source_schema",
        "concat('t_', CAST(c_custkey AS STRING)) AS source_table",
        "md5(CAST(c_custkey AS STRING)) AS source_dataset_id",
    ],
)
_FRAMED = "concat(length(source_system), ':', source_system, length(source_schema), ':', source_schema, length(source_table), ':', source_table)"


@register(
    "resolve_datasets",
    with_sql(
        "SELECT source_system, source_schema, source_table, status, coalesce(known, CASE WHEN status = 'NEW' "
        f"THEN sha256({_FRAMED}) END, 'none') AS source_dataset_id FROM (SELECT s.*, k.source_dataset_id AS known, "
        "CASE WHEN k.source_dataset_id IS NOT NULL THEN 'EXISTING' WHEN regexp_full_match(s.source_table, "
        "'[a-zA-Z_][a-zA-Z0-9_]{0,62}') THEN 'NEW' ELSE 'INVALID_IDENTIFIER' END AS status "
        "FROM (SELECT DISTINCT * FROM s) s LEFT JOIN k USING (source_system, source_schema, source_table))",
        s=_SEEN,
        k=_KNOWN,
    ),
)
def resolve_datasets(spark, sf_dir):
    resolved = ops.resolve_identities(
        _SEEN.frame(spark, sf_dir),
        _KNOWN.frame(spark, sf_dir),
        ["source_system", "source_schema", "source_table"],
        "source_dataset_id",
    )
    return resolved.withColumn("source_dataset_id", F.coalesce("source_dataset_id", F.lit("none")))


_TARGETS_SEEN = Fixture(
    "events",
    [
        "concat('pub_', event_type) AS publication_system",
        "concat('target_', CAST(user_id AS STRING)) AS logical_target",
    ],
)
_TARGETS_KNOWN = Fixture(
    "customer",
    [
        "'pub_click' AS publication_system",
        "concat('target_', CAST(c_custkey AS STRING)) AS logical_target",
        "md5(c_name) AS publication_target_id",
    ],
)


@register(
    "resolve_targets",
    with_sql(
        "SELECT DISTINCT s.publication_system, s.logical_target, CASE WHEN k.publication_target_id IS NULL THEN 'NEW' "
        "ELSE 'EXISTING' END AS status, coalesce(k.publication_target_id, sha256(concat(length(s.publication_system), ':', "
        "s.publication_system, length(s.logical_target), ':', s.logical_target))) AS publication_target_id "
        "FROM s LEFT JOIN k USING (publication_system, logical_target)",
        s=_TARGETS_SEEN,
        k=_TARGETS_KNOWN,
    ),
)
def resolve_targets(spark, sf_dir):
    return ops.resolve_identities(
        _TARGETS_SEEN.frame(spark, sf_dir),
        _TARGETS_KNOWN.frame(spark, sf_dir),
        ["publication_system", "logical_target"],
        "publication_target_id",
    )


# --- runs ------------------------------------------------------------------------------------
_RUNS = Fixture(
    "events",
    [
        "event_id AS run_id",
        "CASE WHEN event_id % 53 = 0 THEN -5 ELSE user_id END AS dataset_id",
        "CASE WHEN k = 0 THEN 'BACKFILL' WHEN k < 10 THEN 'SIMULATION' ELSE 'LIVE_REVALIDATION' END AS purpose",
        "CASE WHEN k IN (1, 2, 3) THEN 'CAPTURED' WHEN k = 4 THEN 'MATCHED' WHEN k < 10 THEN 'FAILED' "
        "WHEN k < 14 THEN 'MATCHED' WHEN k < 17 THEN 'DRIFTED' WHEN k = 19 THEN 'CAPTURED' ELSE 'FAILED' END AS outcome",
        "CASE WHEN k IN (2, 12, 5, 6, 7) THEN NULL WHEN event_id % 59 = 0 THEN user_id + 1 "
        "WHEN event_id % 61 = 0 THEN -1 ELSE user_id END AS snapshot_id",
        "CASE WHEN k < 9 OR k = 13 THEN NULL WHEN event_id % 67 = 0 THEN -1 WHEN event_id % 71 = 0 THEN user_id + 4 "
        "ELSE user_id END AS baseline_run_id",
        "ts AS started_at",
        "CASE WHEN event_id % 73 = 0 THEN ts - INTERVAL '1' MINUTE WHEN event_id % 79 = 0 THEN NULL "
        "ELSE ts + INTERVAL '1' MINUTE END AS completed_at",
        "CASE WHEN k IN (5, 17, 18) THEN 'SOURCE_READ_FAILED' WHEN k = 6 THEN 'bad code' WHEN k = 11 THEN 'X1' END AS failure_code",
        "CASE WHEN k = 17 AND event_id % 3 = 0 THEN '' WHEN k = 18 THEN repeat('x', 1001) END AS failure_reason",
        "CASE WHEN event_id % 83 = 0 THEN ' ' WHEN event_id % 2 = 0 THEN 'ops' END AS requested_by",
    ],
    inner=["event_id % 20 AS k"],
)
_RUN_DATASETS = Fixture("customer", ["c_custkey AS dataset_id"])
_RUN_SNAPSHOTS = Fixture("customer", ["c_custkey AS snapshot_id", "c_custkey AS dataset_id"])
_RUN_LEDGER = Fixture(
    "customer",
    [
        "c_custkey AS run_id",
        "c_custkey AS dataset_id",
        "CASE WHEN c_custkey % 4 = 3 THEN 'LIVE_REVALIDATION' ELSE 'SIMULATION' END AS purpose",
        "CASE c_custkey % 4 WHEN 2 THEN 'FAILED' WHEN 3 THEN 'MATCHED' ELSE 'CAPTURED' END AS outcome",
    ],
)


@register(
    "run_violations",
    with_sql(
        "SELECT r.run_id, coalesce(CASE WHEN d.dataset_id IS NULL THEN 'UNKNOWN_DATASET' "
        "WHEN r.purpose = 'BACKFILL' THEN 'INVALID_PURPOSE' "
        "WHEN (r.purpose = 'SIMULATION' AND r.outcome NOT IN ('CAPTURED','FAILED')) OR (r.purpose = 'LIVE_REVALIDATION' "
        "AND r.outcome NOT IN ('MATCHED','DRIFTED','FAILED')) THEN 'INVALID_OUTCOME' "
        "WHEN r.completed_at IS NULL THEN 'MISSING_TIME' WHEN r.completed_at < r.started_at THEN 'TIMES_REVERSED' "
        "WHEN r.snapshot_id IS NOT NULL AND s.snapshot_id IS NULL THEN 'UNKNOWN_SNAPSHOT' "
        "WHEN s.dataset_id <> r.dataset_id THEN 'SNAPSHOT_OF_OTHER_DATASET' "
        "WHEN r.baseline_run_id IS NOT NULL AND b.run_id IS NULL THEN 'UNKNOWN_BASELINE' "
        "WHEN b.dataset_id <> r.dataset_id THEN 'BASELINE_OF_OTHER_DATASET' "
        "WHEN b.purpose <> 'SIMULATION' OR b.outcome <> 'CAPTURED' THEN 'BASELINE_NOT_CAPTURED' "
        "WHEN r.purpose = 'SIMULATION' AND b.run_id IS NOT NULL THEN 'SIMULATION_WITH_BASELINE' "
        "WHEN r.outcome = 'CAPTURED' AND r.snapshot_id IS NULL THEN 'CAPTURE_WITHOUT_SNAPSHOT' "
        "WHEN r.purpose = 'LIVE_REVALIDATION' AND r.baseline_run_id IS NULL THEN 'REVALIDATION_WITHOUT_BASELINE' "
        "WHEN r.outcome IN ('MATCHED','DRIFTED') AND r.snapshot_id IS NULL THEN 'REVALIDATION_WITHOUT_SNAPSHOT' "
        "WHEN r.outcome = 'FAILED' AND NOT coalesce(regexp_full_match(failure_code, '[A-Z][A-Z0-9_]{1,63}'), false) "
        "THEN 'INVALID_FAILURE_CODE' WHEN r.outcome = 'FAILED' AND (failure_reason = '' OR length(failure_reason) > 1000) "
        "THEN 'INVALID_FAILURE_REASON' WHEN r.outcome <> 'FAILED' AND (failure_code IS NOT NULL OR failure_reason IS NOT NULL) "
        "THEN 'DIAGNOSTICS_ON_SUCCESS' WHEN trim(requested_by) = '' THEN 'BLANK_REQUESTER' END, 'none') AS violation "
        "FROM r LEFT JOIN d USING (dataset_id) LEFT JOIN s ON s.snapshot_id = r.snapshot_id "
        "LEFT JOIN b ON b.run_id = r.baseline_run_id",
        r=_RUNS, d=_RUN_DATASETS, s=_RUN_SNAPSHOTS, b=_RUN_LEDGER,
    ),
)
def run_violations(spark, sf_dir):
    checked = ops.check_runs(
        _RUNS.frame(spark, sf_dir),
        _RUN_DATASETS.frame(spark, sf_dir),
        _RUN_SNAPSHOTS.frame(spark, sf_dir),
        _RUN_LEDGER.frame(spark, sf_dir),
    )
    return checked.select("run_id", F.coalesce("violation", F.lit("none")).alias("violation"))


@register(
    "list_runs",
    with_sql("SELECT run_id, dataset_id, purpose, outcome FROM r ORDER BY dataset_id, completed_at, run_id", r=_RUNS),
)
def list_runs(spark, sf_dir):
    return ops.list_runs(_RUNS.frame(spark, sf_dir)).select("run_id", "dataset_id", "purpose", "outcome")


_FACTS = (
    "CASE WHEN {k} = 1 THEN 'id,line' ELSE 'id' END AS key_text",
    "{n} * 10 + CASE WHEN {k} IN (2, 5) THEN 1 ELSE 0 END AS source_row_count",
    "md5(CAST({n} * 3 + CASE WHEN {k} = 3 THEN 1 ELSE 0 END AS STRING)) AS source_schema_fingerprint",
    "md5(CAST({n} * 7 + CASE WHEN {k} IN (4, 5) THEN 1 ELSE 0 END AS STRING)) AS source_dataset_fingerprint",
)
_FRESH = Fixture(
    "events",
    ["event_id AS run_id", "user_id AS baseline_run_id",
     *[f.format(k="event_id % 8", n="user_id") for f in _FACTS]],
)
_BASE = Fixture(
    "customer", ["c_custkey AS run_id", *[f.format(k="0", n="c_custkey") for f in _FACTS]]
)


@register(
    "revalidate",
    with_sql(
        "SELECT run_id, baseline_run_id, drifted, CASE WHEN drifted = '' THEN 'MATCHED' ELSE 'DRIFTED' END AS outcome FROM "
        "(SELECT f.run_id, f.baseline_run_id, concat_ws(',', CASE WHEN f.key_text <> b.key_text THEN 'PRIMARY_KEY' END, "
        "CASE WHEN f.source_row_count <> b.source_row_count THEN 'ROW_COUNT' END, "
        "CASE WHEN f.source_schema_fingerprint <> b.source_schema_fingerprint THEN 'SCHEMA_FINGERPRINT' END, "
        "CASE WHEN f.source_dataset_fingerprint <> b.source_dataset_fingerprint THEN 'DATASET_FINGERPRINT' END) AS drifted "
        "FROM f JOIN b ON b.run_id = f.baseline_run_id)",
        f=_FRESH,
        b=_BASE,
    ),
)
def revalidate(spark, sf_dir):
    def shaped(df):
        return df.withColumn("source_primary_key", F.split("key_text", ","))

    found = ops.revalidate(
        shaped(_FRESH.frame(spark, sf_dir)), shaped(_BASE.frame(spark, sf_dir))
    )
    return found.withColumn("drifted", F.array_join("drifted", ","))


# --- tickets ----------------------------------------------------------------------------------
_TICKETS = Fixture(
    "orders",
    [
        "o_orderkey AS ticket_id",
        "k IN (0, 1) AS embedded",
        "CASE WHEN k IN (1, 2) THEN NULL WHEN k = 3 THEN -1 ELSE o_custkey END AS run_id",
        "CASE WHEN k = 1 THEN NULL WHEN k = 4 THEN -1 ELSE o_custkey END AS schema_version_id",
        "CASE WHEN k IN (4, 5, 6) THEN 'REORDER_COLUMNS TO [\"a\",\"b\"]' ELSE 'CAST_COLUMN a TO int64' END AS action",
        "CASE WHEN k = 5 THEN 'a:object,b:int64' ELSE 'a:int64,b:int64' END AS gold_text",
        "k > 2 OR o_orderkey % 28 = 1 AS live_eligible",
        "'public' AS source_schema",
        "concat('t_', CAST(o_custkey + CASE WHEN k = 7 THEN 1 ELSE 0 END AS STRING)) AS source_table",
        "CASE WHEN k = 8 THEN 'a,b' ELSE 'a' END AS key_text",
        "o_custkey + CASE WHEN k IN (7, 9) THEN 1 ELSE 0 END AS source_row_count",
        "md5(CAST(o_custkey AS STRING)) AS source_schema_fingerprint",
        "CASE WHEN k = 10 THEN NULL ELSE md5(CAST(o_custkey * 2 AS STRING)) END AS source_dataset_fingerprint",
    ],
    inner=["o_orderkey % 14 AS k"],
)
_TICKET_RUNS = Fixture(
    "customer",
    [
        "c_custkey AS run_id",
        "c_custkey AS dataset_id",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS snapshot_id",
        "CASE WHEN c_custkey % 17 = 0 THEN 'LIVE_REVALIDATION' ELSE 'SIMULATION' END AS purpose",
        "CASE WHEN c_custkey % 19 = 0 THEN 'FAILED' ELSE 'CAPTURED' END AS outcome",
    ],
)
_TICKET_SNAPSHOTS = Fixture(
    "customer",
    [
        "c_custkey AS snapshot_id",
        "CASE WHEN c_custkey % 23 = 0 THEN -1 ELSE c_custkey END AS dataset_id",
        "'public' AS source_schema",
        "concat('t_', CAST(c_custkey AS STRING)) AS source_table",
        "'a' AS key_text",
        "c_custkey AS source_row_count",
        "md5(CAST(c_custkey AS STRING)) AS source_schema_fingerprint",
        "md5(CAST(c_custkey * 2 AS STRING)) AS source_dataset_fingerprint",
    ],
)
_TICKET_VERSIONS = Fixture(
    "customer", ["c_custkey AS schema_version_id", "'a:int64,b:int64' AS gold_text"]
)
_DIFFS = ", ".join(
    f"CASE WHEN t.{c} IS DISTINCT FROM s.{c} THEN '{n}' END"
    for n, c in (
        ("source_schema", "source_schema"), ("source_table", "source_table"),
        ("source_primary_key", "key_text"), ("source_row_count", "source_row_count"),
        ("source_schema_fingerprint", "source_schema_fingerprint"),
        ("source_dataset_fingerprint", "source_dataset_fingerprint"),
    )
)


@register(
    "ticket_lineage",
    with_sql(
        "SELECT ticket_id, outcome, CASE WHEN outcome = 'PROVENANCE_DIFFERS' THEN diffs ELSE '' END AS mismatches FROM "
        "(SELECT t.ticket_id, d.diffs, CASE WHEN t.embedded = (t.run_id IS NOT NULL) THEN 'REPLAY_SOURCE_NOT_UNIQUE' "
        "WHEN t.live_eligible AND t.run_id IS NULL THEN 'LIVE_WITHOUT_LINEAGE' "
        "WHEN starts_with(t.action, 'REORDER') AND t.schema_version_id IS NOT NULL AND v.gold_text IS NULL THEN 'GOLD_VERSION_MISSING' "
        "WHEN starts_with(t.action, 'REORDER') AND t.schema_version_id IS NOT NULL AND v.gold_text <> t.gold_text THEN 'GOLD_VERSION_DIFFERS' "
        "WHEN t.run_id IS NULL THEN 'VALID' "
        "WHEN r.run_id IS NULL OR r.purpose <> 'SIMULATION' OR r.outcome <> 'CAPTURED' THEN 'RUN_NOT_CAPTURED' "
        "WHEN s.snapshot_id IS NULL THEN 'SNAPSHOT_MISSING' WHEN s.dataset_id <> r.dataset_id THEN 'SNAPSHOT_OF_OTHER_DATASET' "
        "WHEN d.diffs <> '' THEN 'PROVENANCE_DIFFERS' ELSE 'VALID' END AS outcome "
        "FROM t LEFT JOIN r ON r.run_id = t.run_id LEFT JOIN s ON s.snapshot_id = r.snapshot_id "
        f"LEFT JOIN v ON v.schema_version_id = t.schema_version_id, LATERAL (SELECT concat_ws(',', {_DIFFS}) AS diffs) d)",
        t=_TICKETS, r=_TICKET_RUNS, s=_TICKET_SNAPSHOTS, v=_TICKET_VERSIONS,
    ),
)
def ticket_lineage(spark, sf_dir):
    def keyed(df):
        return df.withColumn("source_primary_key", F.split("key_text", ","))

    def columns(name):
        return F.transform(
            F.split("gold_text", ","),
            lambda c: F.struct(
                F.split_part(c, F.lit(":"), F.lit(1)).alias("name"),
                F.split_part(c, F.lit(":"), F.lit(2)).alias("dtype"),
            ),
        ).alias(name)

    tickets = keyed(_TICKETS.frame(spark, sf_dir)).select("*", columns("gold_columns"))
    versions = _TICKET_VERSIONS.frame(spark, sf_dir).select("schema_version_id", columns("columns"))
    found = ops.ticket_lineage(
        tickets, _TICKET_RUNS.frame(spark, sf_dir), keyed(_TICKET_SNAPSHOTS.frame(spark, sf_dir)), versions
    )
    return found.withColumn("mismatches", F.array_join("mismatches", ","))


_OPEN = Fixture("customer", ["c_custkey AS ticket_id"])
_DECISIONS = Fixture(
    "events",
    [
        "event_id AS decision_id",
        "user_id + CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 200 END AS ticket_id",
        "CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'REJECTED' WHEN 'view' THEN 'MAYBE' "
        "WHEN 'signup' THEN 'APPROVED' ELSE 'REJECTED' END AS decision",
        "CASE WHEN event_type = 'signup' THEN '  ' ELSE concat('op_', CAST(event_id % 5 AS STRING)) END AS operator",
        "ts AS decided_at",
    ],
)
_VALID = "decision IN ('APPROVED','REJECTED') AND trim(operator) <> ''"


@register(
    "ticket_states",
    with_sql(
        "SELECT t.ticket_id, coalesce(f.decision, 'PENDING') AS status, coalesce(f.decision_id, -1) AS decision_id, "
        "coalesce(f.operator, 'none') AS decided_by, coalesce(n, 0) - CASE WHEN f.ticket_id IS NULL THEN 0 ELSE 1 END "
        "AS refused_decisions FROM t LEFT JOIN (SELECT ticket_id, count(*) AS n FROM d GROUP BY 1) c USING (ticket_id) "
        f"LEFT JOIN (SELECT * FROM d WHERE {_VALID} QUALIFY row_number() OVER "
        "(PARTITION BY ticket_id ORDER BY decided_at, decision_id) = 1) f USING (ticket_id)",
        t=_OPEN, d=_DECISIONS,
    ),
)
def ticket_states(spark, sf_dir):
    states = ops.ticket_states(_OPEN.frame(spark, sf_dir), _DECISIONS.frame(spark, sf_dir))
    return states.select(
        "ticket_id", "status", F.coalesce("decision_id", F.lit(-1)).alias("decision_id"),
        F.coalesce("decided_by", F.lit("none")).alias("decided_by"), "refused_decisions",
    )


@register(
    "pending_tickets",
    with_sql(f"SELECT ticket_id FROM t WHERE ticket_id NOT IN (SELECT ticket_id FROM d WHERE {_VALID})",
             t=_OPEN, d=_DECISIONS),
)
def pending_tickets(spark, sf_dir):
    return ops.pending_tickets(_OPEN.frame(spark, sf_dir), _DECISIONS.frame(spark, sf_dir))


_AUDITED = Fixture(
    "customer",
    [
        "c_custkey AS ticket_id",
        "CASE WHEN c_custkey % 2 = 0 THEN 'CAST_COLUMN a TO int64' ELSE 'RENAME_COLUMN a -> b' END AS action",
        "CAST(0.85 AS DOUBLE) AS confidence",
        "c_custkey % 7 AS schema_version_id",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS run_id",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('SAFE ', CAST(c_custkey AS STRING)) END AS decision",
    ],
)
_MANIFESTS = Fixture(
    "events",
    [
        "event_id AS manifest_id",
        "t AS ticket_id",
        "ts AS recorded_at",
        "CASE WHEN k = 0 THEN 'live' ELSE 'sandbox' END AS execution_mode",
        "CASE WHEN k = 1 THEN 'CAST_COLUMN z TO int64' WHEN t % 2 = 0 THEN 'CAST_COLUMN a TO int64' "
        "ELSE 'RENAME_COLUMN a -> b' END AS action",
        "CAST(CASE WHEN k = 2 THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence",
        "t % 7 + CASE WHEN k = 3 THEN 1 ELSE 0 END AS schema_version_id",
        "CASE WHEN t % 3 = 0 AND k <> 4 THEN NULL ELSE t END AS run_id",
        "CASE WHEN (t % 2 = 0 AND k <> 5) OR k = 6 THEN concat('SAFE ', CAST(t + CASE WHEN k = 7 THEN 1 ELSE 0 END AS STRING)) END AS decision",
        "k <> 8 AS decision_valid",
    ],
    inner=["event_id % 11 AS k", "user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 900 END AS t"],
)


@register(
    "manifest_audit",
    with_sql(
        "SELECT t.ticket_id, coalesce(m.manifest_id, -1) AS manifest_id, CASE WHEN m.manifest_id IS NULL THEN 'NO_MANIFEST' "
        "WHEN m.execution_mode <> 'sandbox' THEN 'NOT_SANDBOX' "
        "WHEN t.ticket_id % 2 = 0 AND m.decision IS NULL THEN 'NO_CAST_OUTCOME' "
        "WHEN t.ticket_id % 2 = 0 AND NOT m.decision_valid THEN 'INVALID_CAST_OUTCOME' "
        "WHEN t.ticket_id % 2 = 0 AND m.decision IS DISTINCT FROM t.decision THEN 'CAST_OUTCOME_DIFFERS' "
        "WHEN t.ticket_id % 2 <> 0 AND m.decision IS NOT NULL THEN 'UNEXPECTED_CAST_OUTCOME' "
        "WHEN m.schema_version_id IS DISTINCT FROM t.schema_version_id THEN 'VERSION_DIFFERS' "
        "WHEN m.action <> t.action OR m.confidence <> t.confidence THEN 'PLAN_DIFFERS' "
        "WHEN m.run_id IS DISTINCT FROM t.run_id THEN 'RUN_DIFFERS' ELSE 'CONSISTENT' END AS outcome "
        "FROM t LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ticket_id "
        "ORDER BY recorded_at DESC, manifest_id DESC) = 1) m USING (ticket_id)",
        t=_AUDITED, m=_MANIFESTS,
    ),
)
def manifest_audit(spark, sf_dir):
    audit = ops.manifest_audit(_AUDITED.frame(spark, sf_dir), _MANIFESTS.frame(spark, sf_dir))
    return audit.withColumn("manifest_id", F.coalesce("manifest_id", F.lit(-1)))


# --- markers and executions -----------------------------------------------------------------------
_MARKERS = Fixture(
    "events",
    [
        "event_id AS marker_id",
        "CASE event_id % 12 WHEN 3 THEN -1 - event_id WHEN 7 THEN -1 - event_id WHEN 11 THEN event_id + 1 "
        "WHEN 5 THEN event_id + 1 ELSE event_id END AS execution_id",
        "concat('target_', CAST(user_id AS STRING)) AS logical_target",
        "CASE WHEN event_type = 'view' THEN NULL ELSE concat('v_', CAST(event_id AS STRING)) END AS physical_table",
        "CASE WHEN event_type = 'error' THEN 'ROLLBACK' ELSE 'PUBLISH' END AS operation",
        "ts AS recorded_at",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS target_id",
    ],
)
_EXECUTIONS = Fixture(
    "events",
    [
        "event_id AS execution_id",
        "user_id AS ticket_id",
        "concat('target_', CAST(user_id AS STRING)) AS logical_target",
        "CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END END AS target_id",
        "CASE event_id % 7 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'ROLLING_BACK' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'ROLLED_BACK' "
        "ELSE 'COMPLETED' END AS status",
        "ts AS started_at",
        "CASE WHEN event_id % 14 = 1 THEN ts + INTERVAL '1' HOUR END AS rollback_started_at",
        "ts + INTERVAL '2' MINUTE AS completed_at",
    ],
)
_LATEST = (
    "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY logical_target ORDER BY recorded_at DESC, marker_id DESC) = 1"
)


@register(
    "latest_marker",
    with_sql(
        f"SELECT logical_target, marker_id, execution_id, operation, coalesce(physical_table, 'none') AS physical_table "
        f"FROM ({_LATEST})", m=_MARKERS,
    ),
)
def latest_marker(spark, sf_dir):
    return ops.latest_marker(_MARKERS.frame(spark, sf_dir)).select(
        "logical_target", "marker_id", "execution_id", "operation",
        F.coalesce("physical_table", F.lit("none")).alias("physical_table"),
    )


def _outcome_sql(executions: str) -> str:
    return (
        "SELECT e.execution_id, e.operation, CASE WHEN bool_or(m.marker_id IS NOT NULL AND m.target_id IS NOT DISTINCT FROM "
        "e.target_id) THEN 'completed' WHEN count(m.marker_id) > 0 THEN 'identity_mismatch' ELSE 'not_committed' END AS outcome "
        f"FROM ({executions}) e LEFT JOIN m ON m.execution_id = e.execution_id AND m.operation = e.operation "
        "GROUP BY e.execution_id, e.operation"
    )


@register(
    "operation_outcome",
    with_sql(
        _outcome_sql(
            "SELECT *, CASE WHEN status IN ('ROLLING_BACK','ROLLED_BACK') THEN 'ROLLBACK' ELSE 'PUBLISH' END AS operation FROM x"
        ),
        m=_MARKERS, x=_EXECUTIONS,
    ),
)
def operation_outcome(spark, sf_dir):
    operation = F.when(F.col("status").isin("ROLLING_BACK", "ROLLED_BACK"), "ROLLBACK").otherwise("PUBLISH")
    executions = _EXECUTIONS.frame(spark, sf_dir).withColumn("operation", operation)
    return ops.operation_outcome(executions, _MARKERS.frame(spark, sf_dir))


@register(
    "rollback_staleness",
    with_sql(
        "SELECT x.execution_id, x.logical_target, CASE WHEN l.execution_id <> x.execution_id THEN 'SUPERSEDED' "
        "WHEN m.execution_id IS DISTINCT FROM x.execution_id OR m.operation <> 'PUBLISH' OR "
        "m.target_id IS DISTINCT FROM x.target_id THEN 'STALE_MARKER' ELSE 'CURRENT' END AS outcome FROM x "
        f"LEFT JOIN ({_LATEST}) m USING (logical_target) LEFT JOIN (SELECT * FROM x WHERE status IN "
        "('COMPLETED','ROLLING_BACK','ROLLED_BACK') QUALIFY row_number() OVER (PARTITION BY logical_target "
        "ORDER BY completed_at DESC, execution_id DESC) = 1) l USING (logical_target) WHERE x.status = 'COMPLETED'",
        m=_MARKERS, x=_EXECUTIONS,
    ),
)
def rollback_staleness(spark, sf_dir):
    return ops.rollback_staleness(_EXECUTIONS.frame(spark, sf_dir), _MARKERS.frame(spark, sf_dir))


_AS_OF = "2024-01-20 00:00:00"


@register(
    "reconcile",
    with_sql(
        "SELECT execution_id, old_status, outcome, new_status, new_status = old_status AS needs_review, "
        "CASE WHEN new_status = 'COMPLETED' THEN coalesce(physical_table, 'none') ELSE 'none' END AS physical_table FROM ("
        "SELECT s.execution_id, s.status AS old_status, o.outcome, CASE WHEN o.outcome = 'completed' THEN "
        "CASE s.status WHEN 'RUNNING' THEN 'COMPLETED' ELSE 'ROLLED_BACK' END "
        "WHEN o.outcome = 'not_committed' AND s.status = 'RUNNING' THEN 'FAILED' ELSE s.status END AS new_status, "
        "(SELECT arg_min(physical_table, marker_id) FROM m WHERE m.execution_id = s.execution_id AND m.operation = s.operation "
        "AND m.target_id IS NOT DISTINCT FROM s.target_id) AS physical_table "
        f"FROM s JOIN ({_outcome_sql('SELECT * FROM s')}) o USING (execution_id))",
        m=_MARKERS, x=_EXECUTIONS,
        s="SELECT *, CASE status WHEN 'RUNNING' THEN 'PUBLISH' ELSE 'ROLLBACK' END AS operation FROM x "
        "WHERE status IN ('RUNNING','ROLLING_BACK') AND CASE WHEN status = 'ROLLING_BACK' THEN "
        "coalesce(rollback_started_at, started_at) ELSE started_at END "
        f"<= TIMESTAMP '{_AS_OF}' - INTERVAL '300' SECOND",
    ),
)
def reconcile(spark, sf_dir):
    settled = ops.reconcile(_EXECUTIONS.frame(spark, sf_dir), _MARKERS.frame(spark, sf_dir), _AS_OF)
    return settled.withColumn("physical_table", F.coalesce("physical_table", F.lit("none")))


_CLAIMS = Fixture(
    "orders",
    [
        "o_orderkey AS execution_id",
        "CAST(o_custkey AS STRING) AS ticket_id",
        "concat('t_', CAST(o_custkey % 700 AS STRING)) AS logical_target",
        "CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' "
        "WHEN 3 THEN 'ROLLING_BACK' WHEN 4 THEN 'ROLLED_BACK' ELSE 'FAILED' END AS status",
    ],
)
_TAKEN = "status IN ('PENDING','RUNNING','COMPLETED','ROLLING_BACK','ROLLED_BACK')"
_BUSY = "status IN ('PENDING','RUNNING','ROLLING_BACK')"


@register(
    "execution_conflicts",
    with_sql(
        f"SELECT 'TICKET' AS rule, ticket_id AS subject, count(*) AS executions FROM x WHERE {_TAKEN} GROUP BY ticket_id "
        f"HAVING count(*) > 1 UNION ALL SELECT 'TARGET', logical_target, count(*) FROM x WHERE {_BUSY} "
        "GROUP BY logical_target HAVING count(*) > 1",
        x=_CLAIMS,
    ),
)
def execution_conflicts(spark, sf_dir):
    return ops.execution_conflicts(_CLAIMS.frame(spark, sf_dir))


_REQUESTS = Fixture(
    "customer",
    ["CAST(c_custkey AS STRING) AS ticket_id", "concat('t_', CAST(c_custkey % 900 AS STRING)) AS logical_target"],
)


@register(
    "candidate_conflicts",
    with_sql(
        f"SELECT ticket_id, logical_target, ticket_id IN (SELECT ticket_id FROM x WHERE {_TAKEN}) AS already_executed, "
        f"logical_target IN (SELECT logical_target FROM x WHERE {_BUSY}) AS target_busy FROM r",
        x=_CLAIMS, r=_REQUESTS,
    ),
)
def candidate_conflicts(spark, sf_dir):
    return ops.candidate_conflicts(_REQUESTS.frame(spark, sf_dir), _CLAIMS.frame(spark, sf_dir))


_STEPS = Fixture(
    "events",
    [
        "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS execution_id",
        "event_id",
        "CASE WHEN event_id % 61 = 0 THEN NULL ELSE ts END AS recorded_at",
        "CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'COMPLETED' WHEN 'purchase' THEN 'ROLLING_BACK' "
        "WHEN 'signup' THEN 'ROLLED_BACK' ELSE 'FAILED' END AS status",
    ],
)


def _transitions_sql(steps: Fixture) -> str:
    return with_sql(
        "SELECT execution_id, event_id, status, coalesce(p, 'none') AS previous_status, CASE "
        "WHEN recorded_at IS NULL THEN false WHEN p IS NULL THEN "
        "status IN ('PENDING','RUNNING') ELSE (p, status) IN (('PENDING','RUNNING'), ('PENDING','FAILED'), "
        "('RUNNING','COMPLETED'), ('RUNNING','FAILED'), ('COMPLETED','ROLLING_BACK'), ('ROLLING_BACK','ROLLED_BACK')) END AS legal "
        "FROM (SELECT *, lag(status) OVER (PARTITION BY execution_id ORDER BY recorded_at, event_id) AS p FROM s "
        "WHERE recorded_at IS NOT NULL UNION ALL SELECT *, NULL FROM s WHERE recorded_at IS NULL)",
        s=steps,
    )


def _transitions(spark, sf_dir, fixture):
    steps = ops.execution_transitions(fixture.frame(spark, sf_dir))
    return steps.withColumn("previous_status", F.coalesce("previous_status", F.lit("none")))


@register("execution_transitions", _transitions_sql(_STEPS))
def execution_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir, _STEPS)


# A replayed log: all events of nearly all rows belong to one execution and carry one of two times.
_REPLAYED = Fixture(
    "orders",
    [
        "CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS execution_id",
        "o_orderkey AS event_id",
        "CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN CAST('2024-03-01 12:00:00' AS TIMESTAMP) "
        "ELSE CAST('2024-03-01 12:00:01' AS TIMESTAMP) END AS recorded_at",
        "CASE o_custkey % 6 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'ROLLING_BACK' "
        "WHEN 3 THEN 'ROLLED_BACK' WHEN 4 THEN 'PENDING' ELSE 'FAILED' END AS status",
    ],
)


@register("execution_transitions_replayed", _transitions_sql(_REPLAYED))
def execution_transitions_replayed(spark, sf_dir):
    return _transitions(spark, sf_dir, _REPLAYED)


@register(
    "execution_state",
    with_sql(
        "SELECT execution_id, status, CAST(recorded_at AS VARCHAR) AS recorded_at FROM s WHERE recorded_at IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY recorded_at DESC, event_id DESC) = 1",
        s=_STEPS,
    ),
)
def execution_state(spark, sf_dir):
    return ops.execution_state(_STEPS.frame(spark, sf_dir)).withColumn(
        "recorded_at", F.col("recorded_at").cast("string")
    )


_LINKS = Fixture(
    "orders",
    [
        "o_orderkey AS execution_id",
        "CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 5 ELSE o_custkey END AS revalidation_run_id",
    ],
)
_LINKED = Fixture(
    "orders",
    [
        "CASE WHEN o_orderkey % 17 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS execution_id",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status",
        "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_custkey * 2 END AS simulation_run_id",
        "CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 WHEN o_orderkey % 13 = 1 THEN o_custkey END AS revalidation_run_id",
    ],
)
_LINK_RUNS = Fixture(
    "customer",
    [
        "c_custkey AS run_id",
        "CASE WHEN c_custkey % 7 = 0 THEN 'SIMULATION' ELSE 'LIVE_REVALIDATION' END AS purpose",
        "c_custkey * 2 AS baseline_run_id",
    ],
)


@register(
    "revalidation_links",
    with_sql(
        "SELECT l.execution_id, l.revalidation_run_id, CASE WHEN x.execution_id IS NULL THEN 'UNKNOWN_EXECUTION' "
        "WHEN x.status <> 'RUNNING' THEN 'NOT_RUNNING' WHEN r.purpose IS DISTINCT FROM 'LIVE_REVALIDATION' THEN 'NOT_A_REVALIDATION' "
        "WHEN x.simulation_run_id IS NULL THEN 'NO_SIMULATION' WHEN r.baseline_run_id <> x.simulation_run_id THEN 'OTHER_BASELINE' "
        "WHEN x.revalidation_run_id <> l.revalidation_run_id THEN 'ALREADY_ATTACHED' ELSE 'ATTACHED' END AS outcome "
        "FROM l LEFT JOIN x ON x.execution_id = l.execution_id LEFT JOIN r ON r.run_id = l.revalidation_run_id",
        l=_LINKS, x=_LINKED, r=_LINK_RUNS,
    ),
)
def revalidation_links(spark, sf_dir):
    return ops.check_revalidation_links(
        _LINKS.frame(spark, sf_dir), _LINKED.frame(spark, sf_dir), _LINK_RUNS.frame(spark, sf_dir)
    )
