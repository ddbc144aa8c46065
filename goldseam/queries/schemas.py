"""Queries on schema comparison: one dataset per order, all compared in one job."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.functions.dtypes import dtype_to_database_type
from goldseam.operators import delta as ops
from goldseam.queries import register
from goldseam.queries.fixtures import GOLD, GOLD_SQL, OBSERVED, OBSERVED_SQL, Fixture, duck, with_sql

_BOTH = {"o": OBSERVED_SQL, "g": GOLD_SQL}


def _schemas(spark, sf_dir):
    return OBSERVED.frame(spark, sf_dir), GOLD.frame(spark, sf_dir)


def _joined(name: str) -> F.Column:
    return F.array_join(name, ",")


_MISSING = (
    'SELECT dataset, string_agg("column", \',\' ORDER BY "column") AS missing_columns '
    'FROM g ANTI JOIN o USING (dataset, "column") GROUP BY dataset'
)
_NEW = (
    'SELECT dataset, string_agg("column", \',\' ORDER BY "column") AS new_columns '
    'FROM o ANTI JOIN g USING (dataset, "column") GROUP BY dataset'
)
_TYPES = (
    'SELECT o.dataset, o."column" AS column_name, o.dtype AS observed, g.dtype AS gold, g.ordinal '
    'FROM o JOIN g ON o.dataset = g.dataset AND o."column" = g."column" WHERE o.dtype <> g.dtype'
)
_ORDERS = (
    "SELECT coalesce(a.dataset, b.dataset) AS dataset, a.names IS DISTINCT FROM b.names AS reorder_event "
    'FROM (SELECT dataset, list("column" ORDER BY ordinal) AS names FROM o GROUP BY dataset) a '
    'FULL JOIN (SELECT dataset, list("column" ORDER BY ordinal) AS names FROM g GROUP BY dataset) b '
    "ON a.dataset = b.dataset"
)


@register("delta_missing", with_sql(_MISSING, **_BOTH))
def delta_missing(spark, sf_dir):
    return ops.delta_missing(*_schemas(spark, sf_dir)).withColumn(
        "missing_columns", _joined("missing_columns")
    )


@register("delta_new", with_sql(_NEW, **_BOTH))
def delta_new(spark, sf_dir):
    return ops.delta_new(*_schemas(spark, sf_dir)).withColumn("new_columns", _joined("new_columns"))


@register(
    "delta_types", with_sql(f"SELECT dataset, column_name, observed, gold FROM ({_TYPES})", **_BOTH)
)
def delta_types(spark, sf_dir):
    return ops.delta_types(*_schemas(spark, sf_dir)).withColumnRenamed("column", "column_name")


@register("delta_reorder", with_sql(_ORDERS, **_BOTH))
def delta_reorder(spark, sf_dir):
    return ops.delta_reorder(*_schemas(spark, sf_dir))


DELTA_SQL = with_sql(
    "SELECT r.dataset, r.reorder_event, coalesce(m.missing_columns, '') AS missing_columns, "
    "coalesce(n.new_columns, '') AS new_columns, coalesce(t.mismatches, '') AS type_mismatches "
    f"FROM ({_ORDERS}) r LEFT JOIN ({_MISSING}) m USING (dataset) LEFT JOIN ({_NEW}) n USING (dataset) "
    "LEFT JOIN (SELECT dataset, string_agg(concat(column_name, ':', observed, '>', gold), ',' "
    f"ORDER BY ordinal) AS mismatches FROM ({_TYPES}) GROUP BY dataset) t USING (dataset)",
    **_BOTH,
)


@register("schema_delta", DELTA_SQL)
def schema_delta(spark, sf_dir):
    delta = ops.schema_delta(*_schemas(spark, sf_dir))
    shown = F.transform(
        "type_mismatches",
        lambda m: F.concat(m["column"], F.lit(":"), m["observed"], F.lit(">"), m["gold"]),
    )
    return delta.select(
        "dataset",
        "reorder_event",
        _joined("missing_columns").alias("missing_columns"),
        _joined("new_columns").alias("new_columns"),
        F.array_join(shown, ",").alias("type_mismatches"),
    )


@register(
    "complete_match",
    with_sql(
        "SELECT coalesce(o.dataset, g.dataset) AS dataset, "
        "count(*) FILTER (o.dataset IS NULL) AS missing_count, "
        "count(*) FILTER (g.dataset IS NULL) AS new_count, "
        "count(*) FILTER (o.dtype <> g.dtype) AS mismatch_count, "
        "bool_or(o.ordinal IS DISTINCT FROM g.ordinal) AS reorder_event, "
        "count(*) FILTER (o.dtype IS DISTINCT FROM g.dtype OR o.ordinal IS DISTINCT FROM g.ordinal) = 0 "
        'AS matches FROM o FULL JOIN g ON o.dataset = g.dataset AND o."column" = g."column" '
        "GROUP BY coalesce(o.dataset, g.dataset)",
        **_BOTH,
    ),
)
def complete_match(spark, sf_dir):
    return ops.complete_match(*_schemas(spark, sf_dir))


# --- reorder-only proof: one outcome per o_orderkey % 18 --------------------------------
_PROOF = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CASE WHEN k = 0 THEN NULL ELSE k <> 1 END AS reorder_event",
        "CASE WHEN k = 2 THEN 'z' ELSE '-' END AS missing",
        "CASE WHEN k = 3 THEN 'y' ELSE '-' END AS new",
        "CASE WHEN k = 4 THEN 'a' ELSE '-' END AS mismatched",
        "CASE WHEN k = 5 THEN NULL WHEN k = 6 THEN 'b,b,c' WHEN k = 9 THEN 'a,b,c' "
        "WHEN k = 10 THEN 'b,a' ELSE 'b,a,c' END AS observed_text",
        "CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN 'a,a,c' WHEN k = 11 THEN 'a,b,d' "
        "ELSE 'a,b,c' END AS gold_text",
        "CASE WHEN k = 12 THEN NULL WHEN k = 14 THEN 'a,b' WHEN k = 6 THEN 'b,c' "
        "ELSE 'a,b,c' END AS observed_names",
        "CASE WHEN k = 13 THEN NULL WHEN k = 15 THEN 'a,b,x' ELSE 'a,b,c' END AS gold_names",
        "CASE WHEN k = 16 THEN 'object' ELSE 'int64' END AS observed_b",
        "CASE WHEN o_custkey % 3 = 0 THEN 'int64' ELSE 'float64' END AS other",
        "k",
    ],
    inner=["o_orderkey % 18 AS k"],
)

def _outcome_sql() -> str:
    """The proof as SQL over the texts: sorted unique names stand for sets."""
    def members(text: str) -> str:
        return f"array_to_string(list_sort(list_distinct(string_split({text}, ','))), ',')"

    def size(text: str) -> str:
        return f"len(string_split({text}, ','))"

    return (
        "CASE WHEN reorder_event IS NULL THEN 'INVALID_DELTA' "
        "WHEN NOT reorder_event THEN 'NOT_REORDER_EVENT' "
        "WHEN missing <> '-' THEN 'MISSING_COLUMNS' WHEN new <> '-' THEN 'NEW_COLUMNS' "
        "WHEN mismatched <> '-' THEN 'TYPE_MISMATCHES' "
        "WHEN observed_text IS NULL THEN 'INVALID_OBSERVED_ORDER' "
        f"WHEN len(list_distinct(string_split(observed_text, ','))) <> {size('observed_text')} "
        "THEN 'DUPLICATE_OBSERVED_COLUMN' WHEN gold_text IS NULL THEN 'INVALID_GOLD_ORDER' "
        f"WHEN len(list_distinct(string_split(gold_text, ','))) <> {size('gold_text')} "
        "THEN 'DUPLICATE_GOLD_COLUMN' WHEN observed_text = gold_text THEN 'ALREADY_ORDERED' "
        f"WHEN {size('observed_text')} <> {size('gold_text')} THEN 'COLUMN_COUNT_MISMATCH' "
        f"WHEN {members('observed_text')} <> {members('gold_text')} THEN 'COLUMN_MEMBERSHIP_MISMATCH' "
        "WHEN observed_names IS NULL THEN 'OBSERVED_SCHEMA_INCONSISTENT' "
        "WHEN gold_names IS NULL THEN 'GOLD_SCHEMA_INCONSISTENT' "
        f"WHEN {members('observed_names')} <> {members('observed_text')} THEN 'OBSERVED_SCHEMA_INCONSISTENT' "
        f"WHEN {members('gold_names')} <> {members('gold_text')} THEN 'GOLD_SCHEMA_INCONSISTENT' "
        "WHEN observed_b <> 'int64' THEN 'DTYPE_MISMATCH' ELSE 'ELIGIBLE' END"
    )


def _types(names: str, b_type: F.Column) -> F.Column:
    listed = F.split(names, ",")
    kinds = F.transform(listed, lambda n: F.when(n == "b", b_type).otherwise(F.col("other")))
    return F.map_from_arrays(listed, kinds)


def _listed(text: str) -> F.Column:
    return F.filter(F.split(text, ","), lambda n: n != "-")


@register(
    "reorder_eligibility",
    with_sql(
        f"SELECT dataset, outcome, outcome = 'ELIGIBLE' AS eligible FROM "
        f"(SELECT dataset, {_outcome_sql()} AS outcome FROM f)",
        f=_PROOF,
    ),
)
def reorder_eligibility(spark, sf_dir):
    f = _PROOF.frame(spark, sf_dir)
    mismatch = F.transform(
        _listed("mismatched"),
        lambda n: F.struct(n.alias("column"), F.lit("object").alias("observed"), F.lit("int64").alias("gold")),
    )
    schemas = f.select(
        "dataset",
        "reorder_event",
        _listed("missing").alias("missing_columns"),
        _listed("new").alias("new_columns"),
        mismatch.alias("type_mismatches"),
        F.split("observed_text", ",").alias("observed_order"),
        F.split("gold_text", ",").alias("gold_order"),
        _types("observed_names", F.col("observed_b")).alias("observed_types"),
        _types("gold_names", F.lit("int64")).alias("gold_types"),
    )
    return ops.reorder_eligibility(schemas)


_EVIDENCE = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CASE k WHEN 0 THEN 'RENAME_COLUMN a -> b' WHEN 1 THEN 'REORDER_COLUMNS TO [\"a\",1]' "
        "WHEN 2 THEN 'REORDER_COLUMNS TO [\"a\", \"b\", \"c\"]' "
        "WHEN 6 THEN 'REORDER_COLUMNS TO [\"a\",\"c\",\"b\"]' "
        "WHEN 7 THEN 'REORDER_COLUMNS [\"a\",\"b\",\"c\"]' "
        "ELSE 'REORDER_COLUMNS TO [\"a\",\"b\",\"c\"]' END AS action",
        "k = 3 AS has_decision",
        "CASE WHEN k = 4 THEN 'a,b,c' WHEN k = 10 THEN 'b,a' ELSE 'b,a,c' END AS observed_text",
        "CASE WHEN k = 5 THEN 'object' ELSE 'int64' END AS observed_b",
        "CASE WHEN k = 8 THEN 'b,c,a' WHEN k = 9 THEN 'b,b,c' WHEN k = 10 THEN 'b,a' "
        "ELSE 'b,a,c' END AS replay_text",
        "'int64' AS other",
        "k",
    ],
    inner=["o_orderkey % 12 AS k"],
)

@register(
    "reorder_evidence",
    with_sql(
        "SELECT dataset, CASE WHEN NOT starts_with(action, 'REORDER_COLUMNS') THEN 'NOT_A_REORDER' "
        "WHEN NOT starts_with(action, 'REORDER_COLUMNS TO ') THEN 'MALFORMED_ACTION' "
        "WHEN NOT regexp_full_match(substr(action, 20), '\\[\"[a-z]\"(, ?\"[a-z]\")*\\]') "
        "THEN 'MALFORMED_ACTION' WHEN contains(action, ', ') THEN 'NOT_CANONICAL' "
        "WHEN has_decision THEN 'UNEXPECTED_DECISION' "
        "WHEN observed_text = 'a,b,c' THEN 'NOT_REORDER_ONLY:NOT_REORDER_EVENT' "
        "WHEN observed_text = 'b,a' THEN 'NOT_REORDER_ONLY:MISSING_COLUMNS' "
        "WHEN observed_b <> 'int64' THEN 'NOT_REORDER_ONLY:TYPE_MISMATCHES' "
        "WHEN substr(action, 20) <> '[\"a\",\"b\",\"c\"]' THEN 'TARGET_NOT_GOLD_ORDER' "
        "WHEN len(list_distinct(string_split(replay_text, ','))) < 3 THEN 'INVALID_REPLAY_COLUMNS' "
        "WHEN replay_text <> observed_text THEN 'REPLAY_ORDER_MISMATCH' ELSE 'VALID' END AS outcome "
        "FROM f",
        f=_EVIDENCE,
    ),
)
def reorder_evidence(spark, sf_dir):
    f = _EVIDENCE.frame(spark, sf_dir)
    tickets = f.select(
        "dataset",
        "action",
        "has_decision",
        F.split("observed_text", ",").alias("observed_order"),
        F.split(F.lit("a,b,c"), ",").alias("gold_order"),
        _types("observed_text", F.col("observed_b")).alias("observed_types"),
        F.map_from_arrays(
            F.split(F.lit("a,b,c"), ","), F.split(F.lit("int64,int64,int64"), ",")
        ).alias("gold_types"),
        F.split("replay_text", ",").alias("replay_order"),
    )
    return ops.reorder_evidence(tickets)


# --- two observations ----------------------------------------------------------------------
_PROVIDED = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CAST(pos - 1 AS INT) AS ordinal",
        "CASE pos WHEN 1 THEN 'id' WHEN 2 THEN 'amount' WHEN 3 THEN 'status' WHEN 4 THEN 'placed_at' "
        "ELSE 'priority' END AS `column`",
        "CASE pos WHEN 1 THEN 'int64' WHEN 2 THEN 'float64' WHEN 4 THEN 'datetime' "
        "ELSE 'object' END AS dtype",
        "CAST(o_custkey % (pos + 1) + CASE WHEN o_custkey % 11 = 0 AND pos = 3 THEN 1 ELSE 0 END "
        "AS BIGINT) AS null_count",
    ],
    repeat=5,
)


@register(
    "schema_matches_data",
    with_sql(
        "SELECT coalesce(p.dataset, o.dataset) AS dataset, "
        "bool_and(p.ordinal IS NOT DISTINCT FROM o.ordinal AND p.null_count IS NOT DISTINCT FROM "
        "o.null_count AND p.dtype IS NOT DISTINCT FROM o.dtype) AS matches "
        'FROM p FULL JOIN o ON p.dataset = o.dataset AND p."column" = o."column" '
        "GROUP BY coalesce(p.dataset, o.dataset)",
        p=duck(_PROVIDED.sql()),
        o=OBSERVED_SQL,
    ),
)
def schema_matches_data(spark, sf_dir):
    return ops.schema_matches_data(
        _PROVIDED.frame(spark, sf_dir), OBSERVED.frame(spark, sf_dir)
    )


_PG_SQL = (
    "CASE dtype WHEN 'int64' THEN 'bigint' WHEN 'float64' THEN 'double precision' "
    "WHEN 'datetime' THEN 'timestamp without time zone' ELSE 'text' END"
)


@register(
    "signature_compat",
    with_sql(
        "SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(len(a.s), 0) AS published_columns, "
        "coalesce(len(b.s), 0) AS proposed_columns, "
        "(a.s IS NULL OR a.s IS NOT DISTINCT FROM b.s) AS compatible FROM "
        "(SELECT CASE WHEN CAST(substr(dataset, 4) AS BIGINT) % 13 = 0 THEN concat('gone_', dataset) "
        f"ELSE dataset END AS dataset, list(concat(\"column\", '/', {_PG_SQL}) ORDER BY ordinal) AS s FROM g "
        "GROUP BY 1) a FULL JOIN "
        f"(SELECT dataset, list(concat(\"column\", '/', {_PG_SQL}) ORDER BY ordinal) AS s FROM o "
        "GROUP BY dataset) b ON a.dataset = b.dataset",
        **_BOTH,
    ),
)
def signature_compat(spark, sf_dir):
    observed, gold = _schemas(spark, sf_dir)
    typed = dtype_to_database_type(F.col("dtype"))
    gone = F.substring("dataset", 4, 20).cast("bigint") % 13 == 0
    target = F.when(gone, F.concat(F.lit("gone_"), "dataset")).otherwise(F.col("dataset"))
    return ops.signature_compat(
        gold.withColumn("database_type", typed).withColumn("dataset", target),
        observed.withColumn("database_type", typed),
    )
