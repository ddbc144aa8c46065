"""The manifest ledger: append only, and only with the lineage of its ticket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from goldseam.operators.joining import left_join_known


def check_manifest_lineage(manifests: DataFrame, tickets: DataFrame) -> DataFrame:
    """``manifests`` with the rule each one breaks, or null.

    A manifest that names an ingestion run needs a ticket that names the same run.
    """
    ticket = tickets.select(
        "ticket_id", F.col("run_id").alias("ticket_run"), F.lit(True).alias("ticket_known")
    )
    sourced = F.col("run_id").isNotNull()
    violation = (
        F.when(sourced & F.col("ticket_id").isNull(), "SOURCE_WITHOUT_TICKET")
        .when(sourced & F.col("ticket_known").isNull(), "UNKNOWN_TICKET")
        .when(sourced & ~F.col("ticket_run").eqNullSafe(F.col("run_id")), "RUN_DIFFERS_FROM_TICKET")
    )
    return left_join_known(manifests, ticket, "ticket_id").select(
        *[F.col(c) for c in manifests.columns], violation.alias("violation")
    )


def append_manifests(manifests: DataFrame, tickets: DataFrame, folder: str) -> None:
    """Append the manifests whose lineage holds; the others stay out."""
    checked = check_manifest_lineage(manifests, tickets)
    checked.where(F.col("violation").isNull()).drop("violation").write.mode("append").parquet(folder)
