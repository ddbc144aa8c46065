"""Queries on repairs, their proofs and their audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from goldseam.operators import repair as ops
from goldseam.operators.cast import Cast, with_cast
from goldseam.plans.repairs import apply_repair
from goldseam.queries import register
from goldseam.queries.fixtures import SAFE_TEXTS, Fixture, table, with_sql
from goldseam.queries.fingerprints import fingerprint_sql

_AS_OF = "2024-02-01 00:00:00"
_RENAMED = Fixture("customer", ["c_custkey AS Cust_Key", "c_name", "c_nationkey"])
_REVERSED = Fixture("customer", ["c_name", "c_custkey"])
_CUSTOMER_GOLD = [("c_custkey", "int64"), ("c_name", "object")]


@register("repair_rename", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def repair_rename(spark, sf_dir):
    return ops.rename_column(_RENAMED.frame(spark, sf_dir), "Cust_Key", "c_custkey")


@register(
    "repair_cast",
    with_sql(
        "SELECT o_orderkey, CAST(count_text AS BIGINT) AS count_text, amount_text, flag_text, "
        "coalesce(maybe_count, -1) AS maybe_count, o_totalprice FROM f",
        f=SAFE_TEXTS,
    ),
)
def repair_cast(spark, sf_dir):
    df = SAFE_TEXTS.frame(spark, sf_dir)
    gold = [
        ("o_orderkey", "int64"), ("count_text", "int64"), ("amount_text", "object"),
        ("flag_text", "object"), ("maybe_count", "int64"), ("o_totalprice", "float64"),
    ]
    result = apply_repair(
        df, "CAST_COLUMN count_text TO int64", gold, ["o_orderkey"], as_of=_AS_OF
    )
    return result.data.withColumn("maybe_count", F.coalesce("maybe_count", F.lit(-1)))


@register("repair_reorder", "SELECT c_custkey, c_name FROM customer")
def repair_reorder(spark, sf_dir):
    action = 'REORDER_COLUMNS TO ["c_custkey","c_name"]'
    return apply_repair(
        _REVERSED.frame(spark, sf_dir), action, _CUSTOMER_GOLD, ["c_custkey"], as_of=_AS_OF
    ).data


# Six candidates for one reorder; only the first keeps everything.
_CANDIDATES = {
    "kept": ("PRESERVED", lambda df: df.select("o_custkey", "o_orderkey", "o_totalprice")),
    "other_order": (
        "TARGET_ORDER_MISMATCH", lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice")
    ),
    "row_lost": (
        "ROW_COUNT_MISMATCH",
        lambda df: df.where("o_orderkey > 0").select("o_custkey", "o_orderkey", "o_totalprice"),
    ),
    "value_changed": (
        "VALUE_OR_NULL_MISMATCH",
        lambda df: df.selectExpr(
            "o_custkey + CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END AS o_custkey", "o_orderkey",
            "o_totalprice",
        ),
    ),
    "null_added": (
        "VALUE_OR_NULL_MISMATCH",
        lambda df: df.selectExpr(
            "o_custkey", "o_orderkey", "CASE WHEN o_orderkey <> 7 THEN o_totalprice END AS o_totalprice"
        ),
    ),
    "type_changed": (
        "COLUMN_DTYPE_MISMATCH",
        lambda df: df.selectExpr(
            "CAST(o_custkey AS STRING) AS o_custkey", "o_orderkey", "o_totalprice"
        ),
    ),
}


@register(
    "preservation_proof",
    " UNION ALL ".join(
        f"SELECT '{name}' AS candidate, '{outcome}' AS outcome, count(*) AS rows_before FROM orders"
        for name, (outcome, _) in _CANDIDATES.items()
    ),
)
def preservation_proof(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    order = ["o_custkey", "o_orderkey", "o_totalprice"]
    proofs = [
        ops.preservation_proof(before, change(before), order).select(
            F.lit(name).alias("candidate"), "outcome"
        )
        for name, (_, change) in _CANDIDATES.items()
    ]
    counted = before.agg(F.count("*").alias("rows_before")).select(
        F.explode(F.array(*[F.lit(n) for n in _CANDIDATES])).alias("candidate"), "rows_before"
    )
    return reduce(lambda a, b: a.unionByName(b), proofs).join(counted, "candidate")


# Rows before and after per group of parts, with losses on both sides of every limit.
_LOSSES = Fixture(
    "lineitem",
    [
        "l_partkey % 6 AS g",
        "l_orderkey",
        "CASE l_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 20 WHEN 3 THEN 300 "
        "WHEN 4 THEN 10000000 ELSE 1 END AS m",
        "l_partkey % 12 <> 5 AS was_applied",
    ],
)
_RISK_SQL = (
    "CASE WHEN NOT applied THEN 'HIGH_RISK' WHEN rows_after < rows_before THEN CASE "
    "WHEN (rows_before - rows_after) * 100 < rows_before THEN 'LOW_RISK' "
    "WHEN (rows_before - rows_after) * 10 < rows_before THEN 'MEDIUM_RISK' "
    "WHEN (rows_before - rows_after) * 2 < rows_before THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END "
    "WHEN rows_after > rows_before THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END"
)
_STATUS_SQL = (
    "CASE WHEN rows_after < rows_before THEN 'DATA_LOSS_EVENT' "
    "WHEN rows_after > rows_before THEN 'DATA_GAIN_EVENT' ELSE 'NO_VOLUME_CHANGE' END"
)
_COUNTS_SQL = (
    "SELECT g, was_applied AS applied, count(*) AS rows_before, "
    "count(*) FILTER (l_orderkey % m <> 0 OR m = 1) + CASE WHEN g = 5 THEN 10 ELSE 0 END AS rows_after "
    "FROM f GROUP BY g, was_applied"
)


def _counts(spark, sf_dir):
    kept = (F.col("l_orderkey") % F.col("m") != 0) | (F.col("m") == 1)
    return (
        _LOSSES.frame(spark, sf_dir)
        .groupBy("g", F.col("was_applied").alias("applied"))
        .agg(F.count("*").alias("rows_before"), F.count_if(kept).alias("kept"))
        .select(
            "g", "applied", "rows_before",
            (F.col("kept") + F.when(F.col("g") == 5, 10).otherwise(0)).alias("rows_after"),
        )
    )


@register(
    "integrity_status",
    with_sql(
        f"SELECT g, applied, rows_before, rows_after, {_STATUS_SQL} AS integrity_status FROM ({_COUNTS_SQL})",
        f=_LOSSES,
    ),
)
def integrity_status(spark, sf_dir):
    status = ops.integrity_status(F.col("rows_before"), F.col("rows_after"))
    return _counts(spark, sf_dir).withColumn("integrity_status", status)


# The same rule per supplier, where groups are small and sit near the limits.
_PER_SUPPLIER = (
    "SELECT l_suppkey AS g, l_suppkey % 9 <> 0 AS applied, count(*) AS rows_before, "
    "count(*) FILTER (l_orderkey % (l_suppkey % 40 + 2) <> 0) AS rows_after FROM lineitem GROUP BY l_suppkey"
)


@register(
    "risk_tier",
    with_sql(
        f"SELECT g, applied, rows_before, rows_after, {_STATUS_SQL} AS integrity_status, {_RISK_SQL} AS risk_level "
        f"FROM ({_COUNTS_SQL} UNION ALL {_PER_SUPPLIER})",
        f=_LOSSES,
    ),
)
def risk_tier(spark, sf_dir):
    supplier = F.col("l_suppkey")
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .groupBy(supplier.alias("g"))
        .agg(
            F.count("*").alias("rows_before"),
            F.count_if(F.col("l_orderkey") % (supplier % 40 + 2) != 0).alias("rows_after"),
        )
        .withColumn("applied", F.col("g") % 9 != 0)
    )
    return ops.risk_tiers(_counts(spark, sf_dir).unionByName(per_supplier))


@register(
    "healing_manifest",
    with_sql(
        "SELECT 'CAST_COLUMN count_text TO int64' AS action, true AS applied, 'CAST_SAFE' AS outcome, "
        "'sandbox' AS execution_mode, m.row_count AS original_row_count, m.row_count AS final_row_count, "
        "'NO_VOLUME_CHANGE' AS integrity_status, 'LOW_RISK' AS risk_level, m.data_fingerprint AS fingerprint, "
        "concat('{\"column_name\":\"count_text\",\"status\":\"SAFE\",\"source_dtype\":\"object\",\"target_dtype\":\"int64\","
        "\"policy_version\":\"phase3.1-policy-v1\",\"total_count\":', m.row_count, ',\"null_count\":0,\"converted_count\":', "
        "m.row_count, ',\"failed_count\":0,\"diagnostic_count\":0,\"reason_codes\":[]}') AS conversion_outcome "
        f"FROM ({fingerprint_sql('x', '(SELECT o_orderkey, CAST(count_text AS BIGINT) AS count_text FROM f)', [('o_orderkey', 'int64'), ('count_text', 'int64')])}) m",
        f=SAFE_TEXTS,
    ),
)
def healing_manifest(spark, sf_dir):
    df = SAFE_TEXTS.frame(spark, sf_dir).select("o_orderkey", "count_text")
    gold = [("o_orderkey", "int64"), ("count_text", "int64")]
    manifest = apply_repair(
        df, "CAST_COLUMN count_text TO int64", gold, ["o_orderkey"], as_of=_AS_OF
    ).manifest
    return manifest.select(
        "action", "applied", "outcome", "execution_mode", "original_row_count", "final_row_count",
        "integrity_status", "risk_level", F.col("corrected_output_fingerprint").alias("fingerprint"),
        "conversion_outcome",
    )


@register(
    "repair_cast_values",
    with_sql(
        "SELECT o_orderkey, CAST(amount_text AS DOUBLE) AS amount_text, "
        "lower(trim(flag_text)) IN ('true', '1') AS flag_text FROM f",
        f=SAFE_TEXTS,
    ),
)
def repair_cast_values(spark, sf_dir):
    df = SAFE_TEXTS.frame(spark, sf_dir).select("o_orderkey", "amount_text", "flag_text")
    return with_cast(with_cast(df, Cast("amount_text", "float64")), Cast("flag_text", "bool"))
