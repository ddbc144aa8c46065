"""Publishing immutable versions behind a stable view, and rolling back.

A version is a Parquet folder that is written once, read back and checked. Then its marker is committed:
the next number of the target's log, which only one writer can take. That is the moment of publication;
the view is computed from the log afterwards. A writer that dies before the commit leaves files that
nobody refers to and changes nothing; one that dies after it leaves a view that lags, which ``repair`` brings up to
date. So does every later publish or rollback.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from goldseam.constants import DTYPE_TO_DATABASE_TYPE, MAX_IDENTIFIER_LENGTH, VERSION_SUFFIX_HEX
from goldseam.functions.dtypes import as_published, logical_dtype
from goldseam.functions.encoding import quoted
from goldseam.operators.fingerprint import measure, measure_set
from goldseam.session import case_sensitive, exact_names
from goldseam.sources.commit_log import CommitLog, NumberTaken, Record
from goldseam.sources.tables import require_identifier

MARKER_SCHEMA = (
    "marker_id string, execution_id string, logical_target string, physical_table string, "
    "previous_physical_table string, operation string, recorded_at timestamp_ntz, target_id string"
)


# What a record holds on top of its marker: where the version's rows are, and what to go back to.
RECORD_SCHEMA = (
    f"{MARKER_SCHEMA}, folder string, columns array<string>, previous_folder string, "
    "previous_columns array<string>, commit_number bigint"
)


class PublicationRefused(RuntimeError):
    """The version does not meet a publication rule; the view was not touched."""


class StaleRollback(RuntimeError):
    """Another operation came after this execution's publish."""


class ConcurrentPublication(RuntimeError):
    """Another writer committed to the target meanwhile; nothing of this one is public."""


def version_table(target: str, execution_id: str) -> str:
    suffix = f"__{execution_id.replace('-', '')[:VERSION_SUFFIX_HEX]}"
    return target[: MAX_IDENTIFIER_LENGTH - len(suffix)] + suffix


def signature(df: DataFrame) -> list[tuple[str, str]]:
    """(name, published type) of each column, in order; of decimals with precision and scale."""
    listed = []
    for f in df.schema.fields:
        published = DTYPE_TO_DATABASE_TYPE[logical_dtype(f)]
        if isinstance(f.dataType, T.DecimalType):
            published += f"({f.dataType.precision},{f.dataType.scale})"
        elif published == "text" and isinstance(f.dataType, T.VariantType):
            published += " of mixed types"
        listed.append((f.name, published))
    return listed


@exact_names
def _canonical(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            as_published(quoted(f.name), f).alias(f.name, metadata={"logical": logical_dtype(f)})
            for f in df.schema.fields
        ]
    )


@dataclass(frozen=True)
class Publisher:
    """Versions and logs below one folder; views in the session's current database.

    The steps that a writer may die in are methods of their own: write, check, commit, show.
    """

    spark: SparkSession
    folder: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/_log")

    def exists(self, folder: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def markers(self) -> DataFrame:
        """The markers of all commits; among equal times their ids follow the log."""
        return self.log.records(MARKER_SCHEMA)

    def version_folder(self, physical_table: str) -> str:
        """Where the rows of a published version are."""
        named = self.log.records(RECORD_SCHEMA).where(F.col("physical_table") == physical_table)
        row = named.where("operation = 'PUBLISH'").first()
        if row is None:
            raise LookupError(f"{physical_table} was never published.")
        return row.folder

    def committed(self, target: str, execution_id: str, operation: str) -> Record | None:
        """The record of an execution's publish or rollback, if there is one."""
        own = self.log.records(RECORD_SCHEMA, target).where(
            (F.col("execution_id") == execution_id) & (F.col("operation") == operation)
        )
        row = own.orderBy("commit_number").first()
        return None if row is None else Record(row.commit_number, row.asDict())

    # --- steps ---------------------------------------------------------------------------
    def _write(self, df: DataFrame, folder: str) -> None:
        with case_sensitive(self.spark):
            df.write.mode("errorifexists").parquet(folder)

    def _check(
        self, folder: str, expected_rows: int, expected_fingerprint: str | None, expected_set: str | None
    ) -> None:
        with case_sensitive(self.spark):
            stored = self.spark.read.parquet(folder)
            expected = [p for p in (expected_fingerprint, expected_set) if p is not None]
            if not expected:
                written = stored.count()
            else:
                written, *found = (measure if expected_set is None else measure_set)(stored).first()
                if found[-len(expected):] != expected:
                    raise PublicationRefused("The stored rows are not the approved ones.")
        if written != expected_rows:
            raise PublicationRefused(f"{written} rows written, {expected_rows} expected.")

    def _commit(self, target: str, after: Record | None, as_of: str, **fields: object) -> Record:
        """The next record of the target, if ``after`` is still its newest."""
        number = 1 if after is None else after.number + 1
        moment = datetime.fromisoformat(as_of)
        if after is not None:  # times never run backwards along the log
            moment = max(moment, datetime.fromisoformat(after["recorded_at"]))
        marker_id = f"{number:020}-{fields['execution_id']}-{fields['operation'].lower()}"
        try:
            return self.log.commit(
                target, number,
                {**fields, "logical_target": target, "marker_id": marker_id, "recorded_at": moment.isoformat()},
            )
        except NumberTaken as error:
            raise ConcurrentPublication(str(error)) from error

    def _show(self, target: str, record: Record) -> None:
        if record["physical_table"] is None:
            self.spark.sql(f"DROP VIEW IF EXISTS `{target}`")
        else:
            self.spark.sql(f"CREATE OR REPLACE VIEW `{target}` AS {_view_text(record)}")

    # --- the view ------------------------------------------------------------------------
    def repair(self, target: str) -> str:
        """Computes the view from the log: AGREES, REPOINTED, DROPPED, or NEVER_PUBLISHED.

        The log is looked at again after the view moved, so of several writers at once the newest
        record is what the view shows in the end.
        """
        require_identifier(target, "logical target")
        outcome, record = "AGREES", self.log.head(target)
        if record is None:
            return "NEVER_PUBLISHED"
        while True:
            wanted = None if record["physical_table"] is None else _view_text(record)
            if wanted != self._view(target):
                self._show(target, record)
                outcome = "DROPPED" if wanted is None else "REPOINTED"
            newest = self.log.head(target)
            if newest.number == record.number:
                return outcome
            record = newest

    def _view(self, target: str) -> str | None:
        if not self.spark.catalog.tableExists(target):
            return None
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED `{target}`").where("col_name = 'View Text'").first()
        return None if described is None else described.data_type

    def repair_all(self) -> dict[str, str]:
        """``repair`` of every target that has a log."""
        return {target: self.repair(target) for target in self.log.targets()}

    # --- operations --------------------------------------------------------------------------
    def publish(
        self,
        target: str,
        df: DataFrame,
        execution_id: str,
        expected_rows: int,
        gold_columns: Sequence[tuple[str, str]],
        as_of: str,
        target_id: str | None = None,
        expected_fingerprint: str | None = None,
        expected_set: str | None = None,
    ) -> tuple[str, str | None]:
        """Write a version, check it, commit its marker, show it. Returns the new and the previous version.

        Types come from Gold, never from the values. With ``expected_fingerprint`` or, where rows may be
        crafted, ``expected_set`` the stored rows themselves must be the approved ones, so a source that changed between proof and write is
        caught before anything is public. A publish that was committed is not made again; one that died
        before its commit may be. If another writer commits first, this one is refused; its files stay,
        unreferenced.
        """
        require_identifier(target, "logical target")
        for name in df.columns:
            require_identifier(name, "column")
        if len({name.lower() for name in df.columns}) < len(df.columns):
            # a view names columns whatever their case
            raise PublicationRefused("Two columns differ only by case.")
        if [(f.name, logical_dtype(f)) for f in df.schema.fields] != list(gold_columns):
            raise PublicationRefused("The data does not have exactly the Gold columns and types.")
        if self.committed(target, execution_id, "PUBLISH") is not None:
            raise PublicationRefused("PUBLICATION_ALREADY_EXISTS: this execution's publish was committed.")
        head = self.log.head(target)
        shown = head if head is not None and head["physical_table"] is not None else None
        canonical = _canonical(df)
        if shown is not None:
            published = self.spark.read.parquet(shown["folder"])
            if signature(published) != signature(canonical):
                raise PublicationRefused("Not the names, order and types published before.")
        physical_table = version_table(target, execution_id)
        folder = f"{self.folder}/{physical_table}/attempt-{uuid.uuid4().hex}"
        self._write(canonical, folder)
        self._check(folder, expected_rows, expected_fingerprint, expected_set)
        record = self._commit(
            target,
            head,
            as_of,
            execution_id=execution_id,
            operation="PUBLISH",
            target_id=target_id,
            physical_table=physical_table,
            folder=folder,
            columns=df.columns,
            previous_physical_table=shown and shown["physical_table"],
            previous_folder=shown and shown["folder"],
            previous_columns=shown and shown["columns"],
        )
        self.repair(target)
        return record["physical_table"], record["previous_physical_table"]

    def rollback(
        self,
        target: str,
        execution_id: str,
        previous: str | None,
        as_of: str,
        target_id: str | None = None,
    ) -> None:
        """Commit that the version before is current again, and show it; without one the view goes.

        Refused unless the newest record is this execution's own publish, and ``previous`` is the
        version that it says came before. Versions stay.
        """
        require_identifier(target, "logical target")
        head = self.log.head(target)
        if (
            head is None
            or head["execution_id"] != execution_id
            or head["operation"] != "PUBLISH"
            or head["target_id"] != target_id
        ):
            raise StaleRollback(f"{target}: not the current publish.")
        if previous != head["previous_physical_table"]:
            raise StaleRollback(f"{target}: not the version before this publish.")
        self._commit(
            target,
            head,
            as_of,
            execution_id=execution_id,
            operation="ROLLBACK",
            target_id=target_id,
            physical_table=previous,
            folder=head["previous_folder"],
            columns=head["previous_columns"],
            previous_physical_table=head["physical_table"],
            previous_folder=head["folder"],
            previous_columns=head["columns"],
        )
        self.repair(target)


def _view_text(record: Record) -> str:
    listed = ", ".join(f"`{c}`" for c in record["columns"])
    return f"SELECT {listed} FROM parquet.`{record['folder']}`"
