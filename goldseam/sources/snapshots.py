"""Snapshots: stored once per dataset and provenance, replayed only after a recheck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from goldseam.operators.fingerprint import measure

_KEY = ["dataset_id", "provenance_fingerprint"]


def snapshot_dedupe(incoming: DataFrame, stored: DataFrame, evidence: Sequence[str]) -> DataFrame:
    """NEW, REUSED or CONFLICT for each distinct incoming snapshot.

    A snapshot is identified by dataset and provenance fingerprint. If it is stored already, or
    comes several times, all of its evidence must agree. Repeats are folded before the shuffle.
    """
    digest = F.sha2(F.to_json(F.struct(*evidence)), 256)
    arriving = (
        incoming.select(*_KEY, digest.alias("e"))
        .groupBy(*_KEY)
        .agg(
            F.min("e").alias("low"), F.max("e").alias("high"), F.count(F.lit(1)).alias("observations")
        )
    )
    known = stored.select(*_KEY, digest.alias("stored_evidence"))
    outcome = (
        F.when(F.col("low") != F.col("high"), "CONFLICT")
        .when(F.col("stored_evidence").isNull(), "NEW")
        .when(F.col("stored_evidence") == F.col("low"), "REUSED")
        .otherwise("CONFLICT")
    )
    return arriving.join(known, _KEY, "left").select(
        *_KEY, "observations", outcome.alias("outcome")
    )


def write_snapshot(df: DataFrame, folder: str) -> None:
    """Store the data once; an existing folder is never overwritten."""
    df.write.mode("errorifexists").parquet(folder)


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def replay_check(stored: DataFrame, dataset: str, row_count: int, fingerprint: str) -> DataFrame:
    """One row: whether the stored data still has the count and fingerprint on record."""
    measured = measure(stored).select(
        F.lit(dataset).alias("dataset"),
        F.col("row_count").alias("replay_row_count"),
        F.col("data_fingerprint").alias("replay_fingerprint"),
    )
    return measured.select(
        "dataset",
        F.lit(row_count).cast("bigint").alias("row_count"),
        "replay_row_count",
        F.when(F.col("replay_row_count") != row_count, "ROW_COUNT_DIFFERS")
        .when(F.col("replay_fingerprint") != fingerprint, "FINGERPRINT_DIFFERS")
        .otherwise("VERIFIED")
        .alias("outcome"),
    )


class ReplayRefused(RuntimeError):
    """The stored data is not what its record says."""


def load_verified(
    spark: SparkSession, folder: str, dataset: str, row_count: int, fingerprint: str
) -> DataFrame:
    """The stored data, after a full recheck against its record."""
    stored = load_snapshot(spark, folder)
    outcome = replay_check(stored, dataset, row_count, fingerprint).first().outcome
    if outcome != "VERIFIED":
        raise ReplayRefused(f"{dataset}: {outcome}")
    return stored


def capture(df: DataFrame, folder: str) -> tuple[int, str]:
    """Store a snapshot and return its row count and fingerprint, measured on what was stored."""
    write_snapshot(df, folder)
    row = measure(load_snapshot(df.sparkSession, folder)).first()
    return row.row_count, row.data_fingerprint
