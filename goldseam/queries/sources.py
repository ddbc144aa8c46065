"""Queries on reading, snapshots, manifests and publication."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from goldseam.operators.fingerprint import dataset_fingerprint
from goldseam.operators.profile import observe_nulls
from goldseam.queries import register
from goldseam.queries.fingerprints import fingerprint_sql
from goldseam.queries.fixtures import Fixture, table, with_sql
from goldseam.queries.profiling import TABLE_COLUMNS
from goldseam.session import shared_folder
from goldseam.sources import manifests, publish, snapshots
from goldseam.sources.tables import column_metadata as read_metadata, consistent_read as read_unchanged
from goldseam.sources.tables import fetch_table as read_table, trusted_read

_READS = {
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "customer": ["c_custkey"],
}
_TYPE_NAMES = {
    "int64": ("bigint", "64", "0", "null", "bigint"),
    "int32": ("bigint", "32", "0", "null", "int"),
    "float64": ("double precision", "53", "null", "null", "double"),
    "object": ("text", "null", "null", "null", "string"),
    "datetime": ("timestamp without time zone", "null", "null", "6", "timestamp_ntz"),
}
_INT32 = ("l_linenumber", "c_nationkey", "p_size")


def _attributes(name: str, dtype: str) -> tuple[str, ...]:
    return _TYPE_NAMES["int32" if name in _INT32 else dtype]


def _schema_json(columns) -> str:
    parts = []
    for name, dtype in columns:
        database, precision, scale, time, spark_type = _attributes(name, dtype)
        parts.append(
            f'["{name}","{database}",{precision},{scale},{time},"YES",null,"spark","{spark_type}",null,null,null]'
        )
    return f"[{','.join(parts)}]"


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _summary_sql(tables):
    return " UNION ALL ".join(
        f"SELECT f.dataset, '{','.join(key)}' AS primary_key, (SELECT count(*) = count(DISTINCT ({', '.join(key)})) "
        f"FROM {t}) AS key_proved, f.row_count, sha256('{_schema_json(TABLE_COLUMNS[t])}') AS schema_fingerprint, "
        f"f.data_fingerprint FROM ({fingerprint_sql(t, t, TABLE_COLUMNS[t])}) f"
        for t, key in tables.items()
    )


@register("trusted_read_summary", _summary_sql(_READS))
def trusted_read_summary(spark, sf_dir):
    reads = _union(trusted_read(table(spark, sf_dir, t), t, key) for t, key in _READS.items())
    return reads.withColumn("primary_key", F.array_join("primary_key", ","))


_UNCHANGED = {t: _READS[t] for t in ("orders", "customer") if t in _READS}


@register("consistent_read", _summary_sql(_UNCHANGED))
def consistent_read(spark, sf_dir):
    """The evidence of reads whose files were the same before and after both scans."""
    reads = [read_unchanged(table(spark, sf_dir, t), t, key) for t, key in _UNCHANGED.items()]
    schema = trusted_read(table(spark, sf_dir, "orders"), "orders", _READS["orders"]).schema
    return spark.createDataFrame(reads, schema).withColumn("primary_key", F.array_join("primary_key", ","))


_DESCRIBED = ("lineitem", "orders", "customer", "events")


@register(
    "column_metadata",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, {i} AS ordinal, '{name}' AS column_name, '{_attributes(name, dtype)[0]}' AS data_type, "
        f"'{_attributes(name, dtype)[1].replace('null', 'none')}' AS numeric_precision, "
        f"'{_attributes(name, dtype)[2].replace('null', 'none')}' AS numeric_scale, "
        f"'{_attributes(name, dtype)[3].replace('null', 'none')}' AS datetime_precision, 'YES' AS is_nullable, "
        f"'{_attributes(name, dtype)[4]}' AS udt_name, count(*) - count({name}) AS null_count FROM {t}"
        for t in _DESCRIBED
        for i, (name, dtype) in enumerate(TABLE_COLUMNS[t])
    ),
)
def column_metadata(spark, sf_dir):
    """The declared attributes, next to the nulls each column really has."""
    frames = []
    for t in _DESCRIBED:
        df = table(spark, sf_dir, t)
        nulls = observe_nulls(df, t).select("dataset", "ordinal", "null_count")
        frames.append(read_metadata(df, t).join(nulls, ["dataset", "ordinal"]))
    listed = ("numeric_precision", "numeric_scale", "datetime_precision")
    return _union(frames).select(
        "dataset", "ordinal", "column_name", "data_type",
        *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in listed],
        "is_nullable", "udt_name", "null_count",
    )


# Times as text, as the comparison of results prefers it; all columns are read.
_AS_TEXT = "* REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate)"


def _dates_as_text(df):
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@register("fetch_table", f"SELECT {_AS_TEXT} FROM orders")
def fetch_table(spark, sf_dir):
    return _dates_as_text(read_table(spark, "orders", path=sf_dir))


# --- snapshots ---------------------------------------------------------------------------
_INCOMING = Fixture(
    "orders",
    [
        "o_custkey AS dataset_id",
        "md5(CAST(o_orderkey % 4 AS STRING)) AS provenance_fingerprint",
        "'id' AS source_primary_key",
        "o_orderkey % 4 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS source_row_count",
    ],
)
_STORED = Fixture(
    "customer",
    [
        "c_custkey AS dataset_id",
        "CASE WHEN c_custkey % 2 = 0 THEN md5(CAST(c_custkey % 4 AS STRING)) ELSE md5('other') END "
        "AS provenance_fingerprint",
        "CASE WHEN c_custkey % 5 = 0 THEN 'id2' ELSE 'id' END AS source_primary_key",
        "c_custkey % 4 AS source_row_count",
    ],
)


@register(
    "snapshot_dedupe",
    with_sql(
        "SELECT i.dataset_id, i.provenance_fingerprint, count(*) AS observations, CASE "
        "WHEN count(DISTINCT (i.source_primary_key, i.source_row_count)) > 1 THEN 'CONFLICT' "
        "WHEN max(s.dataset_id) IS NULL THEN 'NEW' WHEN max(s.source_primary_key) = max(i.source_primary_key) "
        "AND max(s.source_row_count) = max(i.source_row_count) THEN 'REUSED' ELSE 'CONFLICT' END AS outcome "
        "FROM i LEFT JOIN s USING (dataset_id, provenance_fingerprint) GROUP BY i.dataset_id, i.provenance_fingerprint",
        i=_INCOMING, s=_STORED,
    ),
)
def snapshot_dedupe(spark, sf_dir):
    return snapshots.snapshot_dedupe(
        _INCOMING.frame(spark, sf_dir),
        _STORED.frame(spark, sf_dir),
        ["source_primary_key", "source_row_count"],
    )


@register(
    "snapshot_replay_check",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS row_count, count(*) AS replay_row_count, 'VERIFIED' AS outcome FROM {t}"
        for t in ("orders", "documents", "embeddings")
    )
    + " UNION ALL SELECT 'events', count(*), count(*), 'FINGERPRINT_DIFFERS' FROM events",
)
def snapshot_replay_check(spark, sf_dir):
    """Stored and reloaded tables against the evidence of the original; one record is false."""
    checks = []
    for name in ("orders", "documents", "embeddings", "events"):
        df = table(spark, sf_dir, name)
        evidence = dataset_fingerprint(df, name).first()
        folder = shared_folder(spark, "snapshots")
        snapshots.write_snapshot(df, folder)
        recorded = "0" * 64 if name == "events" else evidence.data_fingerprint
        stored = snapshots.load_snapshot(spark, folder)
        checks.append(snapshots.replay_check(stored, name, evidence.row_count, recorded))
    return _union(checks)


# --- manifests ----------------------------------------------------------------------------
_NEW_MANIFESTS = Fixture(
    "orders",
    [
        "o_orderkey AS manifest_id",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN -1 ELSE o_custkey END AS ticket_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_custkey + 1 ELSE o_custkey END AS run_id",
        "o_totalprice AS confidence",
    ],
)
_TICKETS = Fixture(
    "customer",
    ["c_custkey AS ticket_id", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS run_id"],
)


@register(
    "manifest_append",
    with_sql(
        "SELECT manifest_id, coalesce(m.ticket_id, -2) AS ticket_id, coalesce(m.run_id, -2) AS run_id FROM m "
        "LEFT JOIN t ON t.ticket_id = m.ticket_id WHERE m.run_id IS NULL OR (t.ticket_id IS NOT NULL AND t.run_id = m.run_id)",
        m=_NEW_MANIFESTS, t=_TICKETS,
    ),
)
def manifest_append(spark, sf_dir):
    """The ledger after one append: only manifests whose lineage holds are in it."""
    folder = shared_folder(spark, "manifests")
    manifests.append_manifests(
        _NEW_MANIFESTS.frame(spark, sf_dir), _TICKETS.frame(spark, sf_dir), folder
    )
    return spark.read.parquet(folder).select(
        "manifest_id",
        F.coalesce("ticket_id", F.lit(-2)).alias("ticket_id"),
        F.coalesce("run_id", F.lit(-2)).alias("run_id"),
    )


@register(
    "manifest_lineage",
    with_sql(
        "SELECT manifest_id, CASE WHEN m.run_id IS NULL THEN 'none' WHEN m.ticket_id IS NULL THEN 'SOURCE_WITHOUT_TICKET' "
        "WHEN t.ticket_id IS NULL THEN 'UNKNOWN_TICKET' WHEN t.run_id IS DISTINCT FROM m.run_id THEN 'RUN_DIFFERS_FROM_TICKET' "
        "ELSE 'none' END AS violation FROM m LEFT JOIN t ON t.ticket_id = m.ticket_id",
        m=_NEW_MANIFESTS, t=_TICKETS,
    ),
)
def manifest_lineage(spark, sf_dir):
    checked = manifests.check_manifest_lineage(
        _NEW_MANIFESTS.frame(spark, sf_dir), _TICKETS.frame(spark, sf_dir)
    )
    return checked.select("manifest_id", F.coalesce("violation", F.lit("none")).alias("violation"))


# --- publication -----------------------------------------------------------------------------
_GOLD = [
    ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "object"),
    ("o_totalprice", "float64"), ("o_orderdate", "datetime"), ("o_orderpriority", "object"),
]
_REST = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_FIRST = Fixture("orders", ["o_orderkey", "o_custkey", *_REST])
_SECOND = Fixture("orders", ["o_orderkey", "o_custkey + 1 AS o_custkey", *_REST])


def _publisher(spark):
    return publish.Publisher(spark, shared_folder(spark, "publish")), f"orders_{uuid.uuid4().hex[:12]}"


def _publish(publisher, target, df, number):
    execution = f"{number:016x}"
    rows = df.count()
    publisher.publish(target, df, execution, rows, _GOLD, f"2024-01-0{number} 00:00:00", "t1")
    return execution


@register("publish_version", with_sql(f"SELECT {_AS_TEXT} FROM s", s=_SECOND))
def publish_version(spark, sf_dir):
    """What the view shows after two versions were published."""
    publisher, target = _publisher(spark)
    _publish(publisher, target, _FIRST.frame(spark, sf_dir), 1)
    _publish(publisher, target, _SECOND.frame(spark, sf_dir), 2)
    return _dates_as_text(spark.table(target))


@register("rollback_version", with_sql(f"SELECT {_AS_TEXT} FROM f", f=_FIRST))
def rollback_version(spark, sf_dir):
    """What the view shows after the second of two versions was rolled back."""
    publisher, target = _publisher(spark)
    _publish(publisher, target, _FIRST.frame(spark, sf_dir), 1)
    second = _publish(publisher, target, _SECOND.frame(spark, sf_dir), 2)
    previous = publish.version_table(target, f"{1:016x}")
    publisher.rollback(target, second, previous, "2024-01-03 00:00:00", "t1")
    return _dates_as_text(spark.table(target))


@register(
    "publication_markers",
    "SELECT operation, CAST(n AS BIGINT) AS version_rows FROM (SELECT count(*) AS n FROM orders), "
    "(VALUES ('PUBLISH'), ('PUBLISH'), ('ROLLBACK')) v(operation)",
)
def publication_markers(spark, sf_dir):
    """The marker log of two publishes and one rollback, with the rows of the version it names."""
    publisher, target = _publisher(spark)
    _publish(publisher, target, _FIRST.frame(spark, sf_dir), 1)
    second = _publish(publisher, target, _SECOND.frame(spark, sf_dir), 2)
    names = [publish.version_table(target, f"{i:016x}") for i in (1, 2)]
    publisher.rollback(target, second, names[0], "2024-01-03 00:00:00", "t1")
    sizes = _union(
        spark.read.parquet(publisher.version_folder(n)).agg(F.count("*").alias("version_rows")).select(
            F.lit(n).alias("physical_table"), "version_rows"
        )
        for n in names
    )
    return publisher.markers().join(sizes, "physical_table").select("operation", "version_rows")


class _Death(Exception):
    """Ends a publisher in the middle of its work."""


_DEATHS = [(step, when) for step in ("write", "check", "commit", "show") for when in ("before", "after")]
_PUBLIC = [("commit", "after"), ("show", "before"), ("show", "after")]


@register(
    "publication_steps",
    "SELECT died, CAST(found AS BIGINT) AS markers, CAST(n * (1 + found) AS BIGINT) AS shown, repaired FROM "
    "(SELECT count(*) AS n FROM orders), (VALUES "
    + ", ".join(
        f"('{when} {step}', {int((step, when) in _PUBLIC)}, "
        f"'{'REPOINTED' if (step, when) in _PUBLIC and (step, when) != ('show', 'after') else 'AGREES'}')"
        for step, when in _DEATHS
    )
    + ") v(died, found, repaired)",
)
def publication_steps(spark, sf_dir):
    """A publisher dies before and after each step of a second version of twice the rows; then a repair.

    Before the commit nothing is public and the view stays; after it the view is brought up to date. So marker and
    view agree in every case.
    """
    first = _FIRST.frame(spark, sf_dir)
    double = first.union(first)
    rows = first.count()
    publisher, base = _publisher(spark)

    class Dying(publish.Publisher):
        def _until(self, step, call):
            if (step, "before") == self.death:
                raise _Death
            result = call()
            if (step, "after") == self.death:
                raise _Death
            return result

        def _write(self, *args):
            return self._until("write", lambda: super(Dying, self)._write(*args))

        def _check(self, *args):
            return self._until("check", lambda: super(Dying, self)._check(*args))

        def _commit(self, *args, **fields):
            return self._until("commit", lambda: super(Dying, self)._commit(*args, **fields))

        def _show(self, *args):
            return self._until("show", lambda: super(Dying, self)._show(*args))

    found = []
    for number, death in enumerate(_DEATHS):
        target = f"{base}_{number}"
        _publish(publisher, target, first, 1)
        dying = Dying(spark, publisher.folder)
        object.__setattr__(dying, "death", death)
        try:
            dying.publish(target, double, f"{2:016x}", 2 * rows, _GOLD, "2024-01-02 00:00:00", "t1")
        except _Death:
            pass
        repaired = publisher.repair(target)
        marked = publisher.committed(target, f"{2:016x}", "PUBLISH")
        shown = spark.table(target).agg(F.count("*").alias("shown"))
        name = " ".join(reversed(death))
        found.append(
            shown.select(
                F.lit(name).alias("died"), F.lit(int(marked is not None)).cast("bigint").alias("markers"), "shown",
                F.lit(repaired).alias("repaired"),
            )
        )
    return _union(found)
