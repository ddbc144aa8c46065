"""Repairs as projections, the proof that they kept the data, and the risk they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from goldseam import constants as C
from goldseam.functions.encoding import quoted
from goldseam.operators.fingerprint import measure
from goldseam.session import exact_names


class RepairRefused(ValueError):
    """The repair cannot be applied; the input stays as it was."""


@exact_names
def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column, exactly as spelled. A missing source or a taken name is refused."""
    if old not in df.columns:
        raise RepairRefused(f"Rename source column not found: {old}.")
    if new in df.columns:
        raise RepairRefused(f"Rename target column already exists: {new}.")
    return df.select(*[quoted(c).alias(new if c == old else c) for c in df.columns])


@exact_names
def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Columns in the given order, which must hold exactly the columns there are."""
    if len(set(order)) != len(order) or sorted(order) != sorted(df.columns):
        raise RepairRefused("The target order does not hold exactly the columns of the data.")
    return df.select(*[quoted(c) for c in order])


def preservation_proof(before: DataFrame, after: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: ``PRESERVED``, or the first property a reorder failed to keep.

    Names and types are settled on the schemas. Rows are compared by count and by a fingerprint
    over the same column order on both sides, so neither side is shuffled.
    """
    spark = before.sparkSession
    types_before = {f.name: f.dataType for f in before.schema.fields}
    types_after = {f.name: f.dataType for f in after.schema.fields}
    failure = None
    if list(after.columns) != list(order):
        failure = "TARGET_ORDER_MISMATCH"
    elif len(after.columns) != len(before.columns):
        failure = "COLUMN_COUNT_MISMATCH"
    elif set(after.columns) != set(before.columns):
        failure = "COLUMN_MEMBERSHIP_MISMATCH"
    if failure:
        return spark.createDataFrame([(failure,)], "outcome string")
    if types_before != types_after:
        counts = before.agg(F.count(F.lit(1)).alias("n")).unionByName(
            after.agg(F.count(F.lit(1)).alias("n"))
        )
        return counts.agg(F.count_distinct("n").alias("counts")).select(
            F.when(F.col("counts") > 1, "ROW_COUNT_MISMATCH")
            .otherwise("COLUMN_DTYPE_MISMATCH")
            .alias("outcome")
        )
    columns = sorted(before.columns)
    sides = []
    for name, df in (("before", before), ("after", after)):
        sides.append(
            measure(df, columns).select(
                F.lit(name).alias("side"), "row_count", F.col("data_fingerprint").alias("digest")
            )
        )
    return (
        sides[0]
        .unionByName(sides[1])
        .agg(
            F.count_distinct("row_count").alias("counts"),
            F.count_distinct("digest").alias("digests"),
        )
        .select(
            F.when(F.col("counts") > 1, "ROW_COUNT_MISMATCH")
            .when(F.col("digests") > 1, "VALUE_OR_NULL_MISMATCH")
            .otherwise("PRESERVED")
            .alias("outcome")
        )
    )


def exact_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side the other lacks, counted; the full form of the proof, for checks."""
    columns = sorted(before.columns)
    left, right = before.select(*columns), after.select(*columns)
    return left.exceptAll(right).unionByName(right.exceptAll(left))


# --- counts to status and risk -------------------------------------------------------
def integrity_status(before: Column, after: Column) -> Column:
    return (
        F.when(after < before, "DATA_LOSS_EVENT")
        .when(after > before, "DATA_GAIN_EVENT")
        .otherwise("NO_VOLUME_CHANGE")
    )


def risk_level(applied: Column, before: Column, after: Column) -> Column:
    lost = F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))
    by_loss = (
        F.when(lost < 0.01, "LOW_RISK")
        .when(lost < 0.10, "MEDIUM_RISK")
        .when(lost < 0.50, "HIGH_RISK")
        .otherwise("CRITICAL_RISK")
    )
    return (
        F.when(~applied, "HIGH_RISK")
        .when(after < before, by_loss)
        .when(after > before, "MEDIUM_RISK")
        .otherwise("LOW_RISK")
    )


def risk_tiers(counts: DataFrame) -> DataFrame:
    """``counts`` (applied, rows_before, rows_after) with integrity_status and risk_level."""
    before, after = F.col("rows_before"), F.col("rows_after")
    return counts.withColumn("integrity_status", integrity_status(before, after)).withColumn(
        "risk_level", risk_level(F.col("applied"), before, after)
    )


def drop_invalid_blocked(plans: DataFrame) -> DataFrame:
    """Plans that would drop rows. They may be proposed and are never executed."""
    return plans.where(F.contains("action", F.lit(C.DROP_INVALID_MARKER))).withColumn(
        "outcome", F.lit("DROP_INVALID_FORBIDDEN")
    )
