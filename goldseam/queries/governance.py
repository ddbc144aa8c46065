"""Queries on types, proposals, decisions, gates and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.constants import DATABASE_TYPE_TO_DTYPE, DTYPE_TO_DATABASE_TYPE
from goldseam.operators import governance as ops, repair
from goldseam.operators.cast import Cast, cast_decision
from goldseam.queries import register
from goldseam.queries.fixtures import GOLD, GOLD_SQL, OBSERVED, OBSERVED_SQL, Fixture, duck, with_sql


def _case(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} END"


_DECLARED = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CAST(pos AS INT) AS ordinal",
        "CASE (o_orderkey + 7 * pos) % 19 " + " ".join(
            f"WHEN {i} THEN '{t}'" for i, t in enumerate(DATABASE_TYPE_TO_DTYPE)
        ) + " WHEN 16 THEN 'money' WHEN 17 THEN 'interval' ELSE 'bytea' END AS database_type",
    ],
    repeat=4,
)


@register(
    "type_map_in",
    with_sql(
        f"SELECT *, coalesce({_case('database_type', DATABASE_TYPE_TO_DTYPE)}, 'none') AS dtype, "
        f"{_case('database_type', DATABASE_TYPE_TO_DTYPE)} IS NULL AS refused FROM f",
        f=_DECLARED,
    ),
)
def type_map_in(spark, sf_dir):
    mapped = ops.type_map_in(_DECLARED.frame(spark, sf_dir))
    return mapped.withColumn("dtype", F.coalesce("dtype", F.lit("none")))


_GOLD_DTYPES = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CAST(pos AS INT) AS ordinal",
        "concat('c', CAST(pos AS STRING)) AS `column`",
        "CASE (o_orderkey + 5 * pos) % 14 " + " ".join(
            f"WHEN {i} THEN '{t}'" for i, t in enumerate(DTYPE_TO_DATABASE_TYPE)
        ) + " WHEN 10 THEN 'int32' WHEN 11 THEN 'Int64' WHEN 12 THEN 'float32' "
        "ELSE 'category' END AS dtype",
    ],
    repeat=4,
)


@register(
    "unpublishable",
    duck(
        with_sql(
            "SELECT dataset, ordinal, `column` AS column_name, dtype FROM f "
            "WHERE dtype IN ('int32', 'Int64', 'float32', 'category')",
            f=_GOLD_DTYPES,
        )
    ),
)
def unpublishable(spark, sf_dir):
    return ops.unpublishable(_GOLD_DTYPES.frame(spark, sf_dir)).withColumnRenamed(
        "column", "column_name"
    )


_TARGETS = Fixture(
    "orders",
    [
        "o_orderkey",
        "CASE o_orderkey % 9 WHEN 0 THEN ' int64 ' WHEN 1 THEN 'INT64' WHEN 2 THEN 'Int64' "
        "WHEN 3 THEN concat(chr(9), 'Float64') WHEN 4 THEN 'Boolean' WHEN 5 THEN 'BOOL' "
        "WHEN 6 THEN 'boolean' WHEN 7 THEN 'Object' ELSE 'decimal' END AS target",
    ],
)


@register(
    "target_normalize",
    with_sql(
        "SELECT o_orderkey, target, normalized, "
        "normalized IN ('int64','float64','bool','object') AS supported FROM "
        "(SELECT *, CASE WHEN t IN ('Int64','Float64','Boolean') THEN t ELSE lower(t) END AS normalized "
        "FROM (SELECT *, trim(target, concat(' ', chr(9))) AS t FROM f))",
        f=_TARGETS,
    ),
)
def target_normalize(spark, sf_dir):
    return ops.target_normalize(_TARGETS.frame(spark, sf_dir))


# --- proposals and selection over the catalog of one dataset per order ---------------------
_PLANS = (
    "d AS (SELECT coalesce(o.dataset, g.dataset) AS dataset, "
    "count(*) FILTER (o.dataset IS NULL) AS missing, count(*) FILTER (g.dataset IS NULL) AS new, "
    "count(*) FILTER (o.dtype <> g.dtype) AS mismatched, "
    "bool_or(o.ordinal IS DISTINCT FROM g.ordinal) AS reordered, "
    'max(CASE WHEN o.dataset IS NULL THEN g."column" END) AS missing_name, '
    "max(CASE WHEN o.dataset IS NULL THEN g.dtype END) AS missing_dtype, "
    'max(CASE WHEN g.dataset IS NULL THEN o."column" END) AS new_name, '
    "max(CASE WHEN g.dataset IS NULL THEN o.dtype END) AS new_dtype "
    'FROM o FULL JOIN g ON o.dataset = g.dataset AND o."column" = g."column" '
    "GROUP BY coalesce(o.dataset, g.dataset)), "
    "ren AS (SELECT dataset FROM d WHERE missing = 1 AND new = 1 AND missing_dtype = new_dtype), "
    "mm AS (SELECT o.dataset, o.\"column\" AS c, g.dtype AS t, "
    "row_number() OVER (PARTITION BY o.dataset ORDER BY g.ordinal) - 1 AS i "
    'FROM o JOIN g ON o.dataset = g.dataset AND o."column" = g."column" WHERE o.dtype <> g.dtype), '
    "p AS (SELECT d.dataset, 0 AS proposal_ordinal, 'REORDER' AS kind, 0.9 AS confidence, "
    "concat('REORDER_COLUMNS TO ', '[\"', (SELECT string_agg(\"column\", '\",\"' ORDER BY ordinal) "
    "FROM g WHERE g.dataset = d.dataset), '\"]') AS action FROM d "
    "WHERE reordered AND missing + new + mismatched = 0 "
    "UNION ALL SELECT d.dataset, 0, 'RENAME', 0.85, concat('RENAME_COLUMN ', new_name, ' -> ', "
    "missing_name) FROM d JOIN ren USING (dataset) "
    "UNION ALL SELECT mm.dataset, CAST(2 * i + CASE WHEN ren.dataset IS NULL THEN 0 ELSE 1 END AS INT), "
    "'CAST', 0.85, concat('CAST_COLUMN ', c, ' TO ', t) FROM mm LEFT JOIN ren USING (dataset) "
    "UNION ALL SELECT mm.dataset, CAST(2 * i + 1 + CASE WHEN ren.dataset IS NULL THEN 0 ELSE 1 END AS INT), "
    "'CAST', 0.7, concat('CAST_COLUMN ', c, ' TO ', t, ' WITH_DROP_INVALID') "
    "FROM mm LEFT JOIN ren USING (dataset))"
)


def _with_plans(body: str) -> str:
    return f"WITH o AS ({OBSERVED_SQL}), g AS ({GOLD_SQL}), {_PLANS} {body}"


def _plans(spark, sf_dir):
    return ops.propose_repairs(OBSERVED.frame(spark, sf_dir), GOLD.frame(spark, sf_dir))


_SHOWN = ("dataset", "proposal_ordinal", "kind", "confidence", "action")
_SELECT = "SELECT dataset, proposal_ordinal, kind, CAST(confidence AS DOUBLE) AS confidence, action FROM p"


@register("propose_repairs", _with_plans(_SELECT))
def propose_repairs(spark, sf_dir):
    return _plans(spark, sf_dir).select(*_SHOWN)


@register(
    "drop_invalid_blocked",
    _with_plans(
        "SELECT dataset, action, 'DROP_INVALID_FORBIDDEN' AS outcome FROM p "
        "WHERE contains(action, 'WITH_DROP_INVALID')"
    ),
)
def drop_invalid_blocked(spark, sf_dir):
    return repair.drop_invalid_blocked(_plans(spark, sf_dir)).select("dataset", "action", "outcome")


@register(
    "select_plan",
    _with_plans(
        f"{_SELECT} WHERE confidence >= 0.8 QUALIFY row_number() OVER (PARTITION BY dataset "
        "ORDER BY contains(action, 'WITH_DROP_INVALID'), confidence DESC, proposal_ordinal) = 1"
    ),
)
def select_plan(spark, sf_dir):
    return ops.select_plan(_plans(spark, sf_dir)).select(*_SHOWN)


# A plan list per customer: confidences around the thresholds, some plans that drop rows.
_CANDIDATES = Fixture(
    "customer",
    [
        "concat('ds_', CAST(c_custkey AS STRING)) AS dataset",
        "CAST(pos - 1 AS INT) AS proposal_ordinal",
        "CASE (c_custkey + pos) % 6 WHEN 0 THEN 0.70 WHEN 1 THEN 0.80 WHEN 2 THEN 0.85 "
        "WHEN 3 THEN 0.92 WHEN 4 THEN 0.95 ELSE 0.79 END AS raw_confidence",
        "CASE WHEN (c_custkey * pos) % 3 = 0 THEN 'CAST_COLUMN a TO int64 WITH_DROP_INVALID' "
        "ELSE 'CAST_COLUMN a TO int64' END AS action",
        "CASE (c_custkey + pos * pos) % 4 WHEN 0 THEN 'LOW_RISK' WHEN 1 THEN 'MEDIUM_RISK' "
        "WHEN 2 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level",
    ],
    repeat=4,
)
_CONF = "CAST(raw_confidence AS DOUBLE)"


def _candidates(spark, sf_dir):
    return _CANDIDATES.frame(spark, sf_dir).withColumn(
        "confidence", F.col("raw_confidence").cast("double")
    ).drop("raw_confidence")


@register(
    "select_plan_top",
    with_sql(
        f"SELECT dataset, proposal_ordinal, {_CONF} AS confidence, action FROM f "
        "WHERE raw_confidence >= 0.80 QUALIFY row_number() OVER (PARTITION BY dataset "
        "ORDER BY contains(action, 'WITH_DROP_INVALID'), raw_confidence DESC, proposal_ordinal) = 1",
        f=_CANDIDATES,
    ),
)
def select_plan_top(spark, sf_dir):
    return ops.select_plan(_candidates(spark, sf_dir)).drop("risk_level")


@register(
    "governance_decision",
    with_sql(
        f"SELECT dataset, proposal_ordinal, {_CONF} AS confidence, CASE WHEN raw_confidence >= 0.92 "
        "THEN 'AUTO_APPROVE' WHEN raw_confidence >= 0.80 THEN 'REQUIRES_HUMAN_APPROVAL' "
        "ELSE 'QUARANTINE' END AS decision FROM f",
        f=_CANDIDATES,
    ),
)
def governance_decision(spark, sf_dir):
    plans = _candidates(spark, sf_dir)
    return plans.select(
        "dataset", "proposal_ordinal", "confidence",
        ops.governance_decision(F.col("confidence")).alias("decision"),
    )


@register(
    "orchestrator_decision",
    with_sql(
        "SELECT dataset, proposal_ordinal, risk_level, CASE WHEN risk_level = 'CRITICAL_RISK' "
        "THEN 'HARD_BLOCK' WHEN raw_confidence >= 0.92 THEN 'AUTO_APPLY' "
        "WHEN raw_confidence >= 0.80 AND risk_level IN ('LOW_RISK','MEDIUM_RISK') THEN 'AUTO_APPLY' "
        "ELSE 'QUARANTINE' END AS decision FROM f",
        f=_CANDIDATES,
    ),
)
def orchestrator_decision(spark, sf_dir):
    plans = _candidates(spark, sf_dir)
    return plans.select(
        "dataset", "proposal_ordinal", "risk_level",
        ops.orchestrator_decision(F.col("confidence"), F.col("risk_level")).alias("decision"),
    )


# Selected plans per user with a cast proof over that user's events.
_ROUTED = Fixture(
    "events",
    [
        "concat('u_', CAST(user_id AS STRING)) AS dataset",
        "user_id",
        "event_id",
        "CASE WHEN user_id % 4 = 1 AND event_id % 50 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END AS v",
        "CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END AS w",
    ],
)


@register(
    "plan_route",
    with_sql(
        "SELECT dataset, kind, CASE WHEN kind = 'CAST' AND bad > 0 THEN 'BLOCKED_BY_CONVERSION_SAFETY' "
        "WHEN kind = 'CAST' OR source_backed THEN 'REQUIRES_HUMAN_APPROVAL' "
        "WHEN confidence >= 0.92 THEN 'AUTO_APPROVE' WHEN confidence >= 0.8 "
        "THEN 'REQUIRES_HUMAN_APPROVAL' ELSE 'QUARANTINE' END AS route FROM "
        "(SELECT dataset, CASE WHEN min(user_id) % 4 < 2 THEN 'CAST' ELSE 'RENAME' END AS kind, "
        "min(user_id) % 3 = 0 AS source_backed, CASE WHEN min(user_id) % 5 = 0 THEN 0.95 ELSE 0.85 END "
        "AS confidence, count(*) FILTER (v = 'x') AS bad FROM f GROUP BY dataset)",
        f=_ROUTED,
    ),
)
def plan_route(spark, sf_dir):
    events = _ROUTED.frame(spark, sf_dir)
    # the proof of another column, which mostly fails, must not decide
    casts = [Cast("v", "int64"), Cast("w", "int64"), Cast("v", "bool")]
    decisions = cast_decision(events, casts, ["event_id"], by=["dataset"])
    user = F.min("user_id")
    selected = events.groupBy("dataset").agg(
        F.when(user % 4 < 2, "CAST").otherwise("RENAME").alias("kind"),
        F.lit("v").alias("column"),
        F.when(user % 4 < 2, "int64").otherwise("w").alias("target"),
        (user % 3 == 0).alias("source_backed"),
        F.when(user % 5 == 0, 0.95).otherwise(0.85).alias("confidence"),
    )
    return ops.plan_route(selected, decisions).select("dataset", "kind", "route")


# --- allowlist -----------------------------------------------------------------------
_ALLOWED = "object->int64,int64->float64"


@register(
    "cast_allowlist",
    with_sql(
        "SELECT dataset, concat('CAST_COLUMN ', name, ' TO ', gold, suffix) AS action, "
        "concat(seen, '->', gold) AS pair, CASE WHEN suffix <> '' THEN 'DROP_INVALID_FORBIDDEN' "
        "WHEN concat(seen, '->', gold) IN ('object->int64', 'int64->float64') THEN 'ALLOWED' "
        "ELSE 'PAIR_NOT_ALLOWED' END AS outcome FROM (SELECT o.dataset, o.\"column\" AS name, o.dtype AS seen, "
        "g.dtype AS gold FROM o JOIN g ON g.dataset = o.dataset AND g.\"column\" = o.\"column\" "
        "WHERE g.dtype <> o.dtype), (VALUES (''), (' WITH_DROP_INVALID')) s(suffix)",
        o=OBSERVED_SQL,
        g=GOLD_SQL,
    ),
)
def cast_allowlist(spark, sf_dir):
    allowed = ops.parse_allowlist(_ALLOWED)
    return ops.cast_allowlist(_plans(spark, sf_dir), OBSERVED.frame(spark, sf_dir), allowed)


# --- gates -------------------------------------------------------------------------------
_FACTS = Fixture(
    "orders",
    [
        "o_orderkey AS ticket_id",
        "CASE WHEN a = 0 THEN NULL ELSE 'v1' END AS schema_version_id",
        "a <> 1 AS sandbox_applied",
        "CASE WHEN a = 2 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS risk_level",
        "CASE WHEN a = 3 OR b = 3 THEN 'DATA_LOSS_EVENT' ELSE 'NO_VOLUME_CHANGE' END AS integrity_status",
        "o_custkey AS original_row_count",
        "o_custkey - CASE WHEN a = 4 THEN 1 ELSE 0 END AS final_row_count",
        "CASE WHEN a = 5 THEN 'CAST_COLUMN a TO int64 WITH_DROP_INVALID' "
        "ELSE 'CAST_COLUMN a TO int64' END AS action",
        "CASE WHEN a = 6 THEN '1st' WHEN b = 6 THEN concat('t', chr(10)) ELSE 'target' END AS logical_target",
        "a <> 7 AS live_eligible",
        "CASE WHEN a = 8 THEN 'gold_publish' ELSE 'public' END AS source_schema",
        "a <> 9 AS confirmed",
        "a = 10 OR b = 10 AS already_executed",
        "a = 11 OR b = 10 AS target_busy",
    ],
    inner=["o_orderkey % 14 AS a", "o_custkey % 23 AS b"],
)


@register(
    "safety_gates",
    with_sql(
        "SELECT ticket_id, coalesce(gate, 'none') AS gate, CASE WHEN gate IS NULL THEN 'PASS' "
        "WHEN gate IN ('ALREADY_EXECUTED','TARGET_BUSY') THEN 'CONFLICT' ELSE 'NOT_ALLOWED' END AS verdict "
        "FROM (SELECT ticket_id, CASE WHEN schema_version_id IS NULL THEN 'SCHEMA_VERSION_MISSING' "
        "WHEN NOT sandbox_applied THEN 'SANDBOX_NOT_APPLIED' WHEN risk_level <> 'LOW_RISK' THEN 'RISK_NOT_LOW' "
        "WHEN integrity_status <> 'NO_VOLUME_CHANGE' THEN 'VOLUME_CHANGED' "
        "WHEN original_row_count <> final_row_count THEN 'ROW_COUNTS_DIFFER' "
        "WHEN contains(action, 'WITH_DROP_INVALID') THEN 'DROP_INVALID_FORBIDDEN' "
        "WHEN NOT regexp_full_match(logical_target, '[a-zA-Z_][a-zA-Z0-9_]{0,62}') THEN 'INVALID_TARGET' "
        "WHEN NOT live_eligible THEN 'NOT_LIVE_ELIGIBLE' "
        "WHEN source_schema IN ('gold_publish','gold_publish_data') THEN 'SOURCE_IS_PUBLICATION' "
        "WHEN NOT confirmed THEN 'NOT_CONFIRMED' WHEN already_executed THEN 'ALREADY_EXECUTED' "
        "WHEN target_busy THEN 'TARGET_BUSY' END AS gate FROM f)",
        f=_FACTS,
    ),
)
def safety_gates(spark, sf_dir):
    gates = ops.safety_gates(_FACTS.frame(spark, sf_dir))
    return gates.withColumn("gate", F.coalesce("gate", F.lit("none")))


_APPROVED = Fixture(
    "customer",
    [
        "c_custkey * 2 + pos AS manifest_id",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS ticket_id",
        "CASE WHEN pos = 1 THEN DATE '2024-01-01' WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' "
        "ELSE DATE '2024-01-02' END AS recorded_at",
        "CASE WHEN pos = 1 THEN md5('superseded') WHEN c_custkey % 5 = 0 THEN NULL "
        "ELSE md5(CAST(c_custkey AS STRING)) END AS output_fingerprint",
    ],
    repeat=2,
)
_RECOMPUTED = Fixture(
    "orders",
    [
        "o_orderkey AS execution_id",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS ticket_id",
        "md5(CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS STRING)) AS output_fingerprint",
    ],
)


@register(
    "output_match",
    with_sql(
        "SELECT e.execution_id, coalesce(e.ticket_id, -1) AS ticket_id, CASE WHEN m.output_fingerprint IS NULL "
        "THEN 'NO_APPROVED_FINGERPRINT' WHEN m.output_fingerprint <> e.output_fingerprint THEN 'MISMATCH' "
        "ELSE 'MATCH' END AS outcome FROM e LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER "
        "(PARTITION BY ticket_id ORDER BY recorded_at DESC, manifest_id DESC) = 1) m USING (ticket_id)",
        m=_APPROVED,
        e=_RECOMPUTED,
    ),
)
def output_match(spark, sf_dir):
    matched = ops.output_match(_APPROVED.frame(spark, sf_dir), _RECOMPUTED.frame(spark, sf_dir))
    return matched.withColumn("ticket_id", F.coalesce("ticket_id", F.lit(-1)))


# --- actions and names --------------------------------------------------------------------
_ACTIONS = Fixture(
    "orders",
    [
        "o_orderkey",
        "CASE o_orderkey % 14 "
        "WHEN 0 THEN concat('RENAME_COLUMN c', CAST(o_custkey AS STRING), ' -> id') "
        "WHEN 1 THEN 'RENAME_COLUMN a->b' "
        "WHEN 2 THEN concat('CAST_COLUMN c', CAST(o_custkey AS STRING), ' TO int64') "
        "WHEN 3 THEN 'CAST_COLUMN  a   TO float64 WITH_DROP_INVALID' "
        "WHEN 4 THEN 'CAST_COLUMN a TO int64 NOW' "
        "WHEN 5 THEN 'CAST_COLUMN a INTO int64' "
        "WHEN 6 THEN concat('REORDER_COLUMNS TO [\"c', CAST(o_custkey AS STRING), '\",\"b\"]') "
        "WHEN 7 THEN 'REORDER_COLUMNS TO [\"b\", \"a\"]' "
        "WHEN 8 THEN 'REORDER_COLUMNS TO [\"b\",\"b\"]' "
        "WHEN 9 THEN 'REORDER_COLUMNS TO [\"b\",1]' "
        "WHEN 10 THEN 'REORDER_COLUMNS TO []' "
        "WHEN 11 THEN 'REORDER_COLUMNS TO [\"b\"] x' "
        "WHEN 12 THEN 'REORDER_COLUMNS TO' "
        "ELSE 'DROP_TABLE x' END AS action",
    ],
)


@register(
    "parse_actions",
    with_sql(
        "SELECT o_orderkey, CASE WHEN r THEN 'RENAME' WHEN c THEN 'CAST' WHEN o THEN 'REORDER' ELSE 'none' END AS kind, "
        "CASE WHEN NOT r AND NOT c AND NOT o THEN 'UNSUPPORTED_ACTION' WHEN r AND NOT ok THEN 'INVALID_RENAME' "
        "WHEN c AND NOT ok THEN 'INVALID_CAST' WHEN o AND NOT ok THEN 'INVALID_REORDER' ELSE 'none' END AS error, "
        "CASE WHEN (r OR c) AND ok THEN w[2] ELSE '' END AS column_name, "
        "CASE WHEN (r OR c) AND ok THEN w[4] ELSE '' END AS target, "
        "CASE WHEN o AND ok THEN replace(action, ', ', ',') ELSE '' END AS canonical_text, "
        "c AND ok AND len(w) = 5 AS drop_invalid FROM (SELECT *, CASE "
        "WHEN r THEN len(w) = 4 AND w[3] = '->' "
        "WHEN c THEN (len(w) = 4 OR (len(w) = 5 AND w[5] = 'WITH_DROP_INVALID')) AND w[3] = 'TO' "
        "ELSE regexp_full_match(action, 'REORDER_COLUMNS TO \\[\"\\w+\"(, ?\"\\w+\")*\\]') "
        "AND NOT contains(action, '\"b\",\"b\"') END AS ok FROM "
        "(SELECT *, string_split_regex(action, '\\s+') AS w, starts_with(action, 'RENAME_COLUMN') AS r, "
        "starts_with(action, 'CAST_COLUMN') AS c, starts_with(action, 'REORDER_COLUMNS') AS o FROM f))",
        f=_ACTIONS,
    ),
)
def parse_actions(spark, sf_dir):
    parsed = ops.parse_actions(_ACTIONS.frame(spark, sf_dir))
    empty = F.lit("")
    return parsed.select(
        "o_orderkey",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.coalesce("error", F.lit("none")).alias("error"),
        F.coalesce("column", empty).alias("column_name"),
        F.coalesce("target", empty).alias("target"),
        F.coalesce("canonical_text", empty).alias("canonical_text"),
        "drop_invalid",
    )


_NAMES = Fixture(
    "orders",
    [
        "o_orderkey",
        "CASE o_orderkey % 8 WHEN 0 THEN concat('t_', CAST(o_custkey AS STRING)) WHEN 1 THEN '1abc' "
        "WHEN 2 THEN 'has space' WHEN 3 THEN repeat('x', 63) WHEN 4 THEN repeat('x', 64) "
        "WHEN 5 THEN concat('nl', chr(10)) WHEN 6 THEN concat('_', repeat('y', 50)) ELSE '' END AS name",
        "md5(CAST(o_orderkey AS STRING)) AS execution_hex",
    ],
)


@register(
    "identifier_gate",
    with_sql(
        "SELECT o_orderkey, valid, CASE WHEN valid THEN concat(substr(name, 1, 45), '__', "
        "substr(execution_hex, 1, 16)) ELSE '' END AS version_name FROM "
        "(SELECT *, regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]{0,62}') AS valid FROM f)",
        f=_NAMES,
    ),
)
def identifier_gate(spark, sf_dir):
    gated = ops.identifier_gate(_NAMES.frame(spark, sf_dir))
    return gated.select("o_orderkey", "valid", F.coalesce("version_name", F.lit("")).alias("version_name"))
