"""Queries on whole workflows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from goldseam.functions.dtypes import logical_dtype
from goldseam.operators.ledger import latest_marker, ticket_states
from goldseam.plans.evidence import gather
from goldseam.plans.lifecycle import Lifecycle, LifecycleRefused
from goldseam.plans.migration import Table, simulate, simulate_family
from goldseam.queries import register
from goldseam.queries.casts import int64_case
from goldseam.queries.fingerprints import fingerprint_sql
from goldseam.queries.fixtures import INT_TEXT, SAFE_TEXTS, Fixture, table, with_sql
from goldseam.session import shared_folder
from goldseam.sources.publish import StaleRollback


def _tables(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    events = INT_TEXT.frame(spark, sf_dir)
    texts = SAFE_TEXTS.frame(spark, sf_dir).select("o_orderkey", "count_text")
    pair = [("c_custkey", "int64"), ("c_name", "object")]
    return {
        "renamed": Table(customer.selectExpr("c_custkey AS Cust_Key", "c_name"), ["Cust_Key"], pair),
        "reordered": Table(customer.select("c_name", "c_custkey"), ["c_custkey"], pair),
        "unchanged": Table(customer.select("c_custkey", "c_name"), ["c_custkey"], pair),
        "unsafe_cast": Table(
            events, ["event_id"], [("event_id", "int64"), ("user_id", "int64"), ("v", "int64")]
        ),
        "safe_cast": Table(
            texts, ["o_orderkey"], [("o_orderkey", "int64"), ("count_text", "int64")], True
        ),
        "blocked_pair": Table(
            orders.select("o_orderkey", "o_custkey"),
            ["o_orderkey"],
            [("o_orderkey", "int64"), ("o_custkey", "float64")],
            True,
        ),
        "not_castable": Table(
            orders.select("o_orderkey", "o_totalprice"),
            ["o_orderkey"],
            [("o_orderkey", "int64"), ("o_totalprice", "decimal")],
        ),
    }


_BAD_COUNT = f"(SELECT count(*) FILTER ({int64_case('v')} <> 'OK') FROM f)"


@register(
    "simulate_migration",
    with_sql(
        "SELECT * FROM (VALUES ('renamed', 'RENAME_COLUMN Cust_Key -> c_custkey', 'none', 'REQUIRES_HUMAN_APPROVAL'), "
        "('reordered', 'REORDER_COLUMNS TO [\"c_custkey\",\"c_name\"]', 'none', 'REQUIRES_HUMAN_APPROVAL'), "
        "('unchanged', 'none', 'none', 'NO_VIABLE_PLAN'), "
        "('safe_cast', 'CAST_COLUMN count_text TO int64', 'SAFE', 'REQUIRES_HUMAN_APPROVAL'), "
        "('blocked_pair', 'CAST_COLUMN o_custkey TO float64', 'SAFE', 'CAST_PAIR_NOT_ALLOWED'), "
        "('not_castable', 'CAST_COLUMN o_totalprice TO decimal', 'UNSUPPORTED', 'BLOCKED_BY_CONVERSION_SAFETY')) "
        "v(dataset, action, status, route) UNION ALL "
        f"SELECT 'unsafe_cast', 'CAST_COLUMN v TO int64', CASE WHEN {_BAD_COUNT} > 0 THEN 'UNSAFE' ELSE 'SAFE' END, "
        f"CASE WHEN {_BAD_COUNT} > 0 THEN 'BLOCKED_BY_CONVERSION_SAFETY' ELSE 'REQUIRES_HUMAN_APPROVAL' END",
        f=INT_TEXT,
    ),
)
def simulate_migration(spark, sf_dir):
    return simulate(spark, _tables(spark, sf_dir), [("object", "int64")])


# One table per customer, one of them with a third of all rows; what Gold wants differs by table.
_FAMILY = Fixture(
    "orders",
    [
        "CASE WHEN o_custkey % 3 = 0 THEN 't0' ELSE concat('t', CAST(o_custkey AS STRING)) END AS dataset",
        "o_orderkey",
        "o_orderstatus",
        "CASE WHEN o_orderkey % 40 = 0 THEN '0.1' ELSE CAST(o_orderkey AS STRING) END AS v",
    ],
)
_WISHES = {
    0: [("o_orderkey", "int64"), ("o_orderstatus", "object"), ("v", "int64")],
    1: [("o_orderkey", "int64"), ("o_orderstatus", "object"), ("v", "float64")],
    2: [("o_orderkey", "int64"), ("v", "object"), ("o_orderstatus", "object")],
    3: [("o_orderkey", "int64"), ("o_orderstatus", "object"), ("v", "object")],
    4: [("o_orderkey", "int64"), ("o_orderstatus", "object"), ("amount", "object")],
    5: [("o_orderkey", "float64"), ("o_orderstatus", "object"), ("v", "object")],
}
_WISH = "CAST(substr(dataset, 2) AS BIGINT) % 6"


@register(
    "simulate_family",
    with_sql(
        "SELECT dataset, CASE w WHEN 0 THEN 'CAST_COLUMN v TO int64' WHEN 1 THEN 'CAST_COLUMN v TO float64' "
        "WHEN 2 THEN 'REORDER_COLUMNS TO [\"o_orderkey\",\"v\",\"o_orderstatus\"]' "
        "WHEN 4 THEN 'RENAME_COLUMN v -> amount' WHEN 5 THEN 'CAST_COLUMN o_orderkey TO float64' "
        "ELSE 'none' END AS action, "
        "CASE WHEN w IN (0, 1) AND bad > 0 THEN 'UNSAFE' WHEN w IN (0, 1, 5) THEN 'SAFE' ELSE 'none' END AS status, "
        "CASE WHEN w = 3 THEN 'NO_VIABLE_PLAN' WHEN w = 1 AND backed THEN 'CAST_PAIR_NOT_ALLOWED' "
        "WHEN w IN (0, 1) AND bad > 0 THEN 'BLOCKED_BY_CONVERSION_SAFETY' ELSE 'REQUIRES_HUMAN_APPROVAL' END AS route "
        f"FROM (SELECT dataset, {_WISH} AS w, CAST(substr(dataset, 2) AS BIGINT) % 4 = 1 AS backed, "
        "count(*) FILTER (v = '0.1') AS bad FROM f GROUP BY ALL)",
        f=_FAMILY,
    ),
)
def simulate_family_query(spark, sf_dir):
    rows = _FAMILY.frame(spark, sf_dir)
    names = rows.select("dataset").distinct()
    wish = F.expr(_WISH)
    columns = F.lit(None).cast("array<struct<column:string,dtype:string>>")
    for w, listed in _WISHES.items():
        wanted = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(d).alias("dtype")) for n, d in listed])
        columns = F.when(wish == w, wanted).otherwise(columns)
    gold = names.select("dataset", F.posexplode(columns).alias("ordinal", "x")).select(
        "dataset", "ordinal", "x.column", "x.dtype"
    )
    backed = names.where("CAST(substr(dataset, 2) AS BIGINT) % 4 = 1")
    return simulate_family(rows, gold, [("object", "int64"), ("int64", "float64")], backed)


_SOURCE = [("o_orderkey", "int64"), ("count_text", "object"), ("o_totalprice", "float64")]
_OUTPUT = [("o_orderkey", "int64"), ("count_text", "int64"), ("o_totalprice", "float64")]


@register(
    "evidence_one_scan",
    with_sql(
        "SELECT 'CAST_SAFE' AS outcome, s.row_count, s.data_fingerprint AS source_fingerprint, "
        "o.data_fingerprint AS output_fingerprint, s.row_count AS converted_count FROM "
        f"({fingerprint_sql('x', 'f', _SOURCE)}) s, ("
        + fingerprint_sql(
            "x",
            "(SELECT o_orderkey, CAST(count_text AS BIGINT) AS count_text, o_totalprice FROM f)",
            _OUTPUT,
        )
        + ") o",
        f=SAFE_TEXTS,
    ),
)
def evidence_one_scan(spark, sf_dir):
    """Source print, cast proof and output print of one repair, all from one scan."""
    df = SAFE_TEXTS.frame(spark, sf_dir).select("o_orderkey", "count_text", "o_totalprice")
    found = gather(df, "CAST_COLUMN count_text TO int64", ["o_orderkey"])
    row = (
        found.outcome, found.row_count, found.source_fingerprint, found.output_fingerprint,
        found.decision.converted_count,
    )
    return spark.createDataFrame(
        [row],
        "outcome string, row_count bigint, source_fingerprint string, output_fingerprint string, "
        "converted_count bigint",
    )


_LIFE = """SELECT step, outcome, CAST(CASE WHEN counted THEN n ELSE 0 END AS BIGINT) AS row_count FROM
(SELECT count(*) AS n FROM orders), (VALUES
('snapshot', 'NEW', true), ('run s1', 'CAPTURED', true),
('run e1-revalidation', 'MATCHED', true), ('run e2-revalidation', 'MATCHED', true),
('ticket t1', 'APPROVED', true), ('ticket t2', 'APPROVED', true),
('execution e1', 'COMPLETED', false), ('execution e2', 'ROLLED_BACK', false),
('refused e1 again', 'ALREADY_EXECUTED', false), ('refused rollback e1', 'SUPERSEDED', false),
('published', 'e1', true)) v(step, outcome, counted)"""


@register("lifecycle_ledgers", _LIFE)
def lifecycle_ledgers(spark, sf_dir):
    """Simulate, approve, publish, roll back and refuse on all orders; what the ledgers show in the end."""
    kept = [c for c in table(spark, sf_dir, "orders").columns if c != "o_custkey"]

    text = F.col("o_custkey").cast("string").alias("o_custkey")
    data = table(spark, sf_dir, "orders").select(text, *kept)
    gold = [(f.name, "int64" if f.name == "o_custkey" else logical_dtype(f)) for f in data.schema.fields]
    plain = Table(data, ["o_orderkey"], gold, source_backed=True)
    life = Lifecycle(spark, shared_folder(spark, "lifecycle"), "t")
    target, pairs, action = f"orders_{uuid.uuid4().hex[:12]}", [("object", "int64")], "CAST_COLUMN o_custkey TO int64"
    refused = []

    def refusal(step: str, call) -> None:
        try:
            outcome = call()
            refused.append((step, outcome.outcome))
        except (LifecycleRefused, StaleRollback) as error:
            refused.append((step, str(error)))

    read = life.capture(plain, "orders", "s1", "2024-01-01 00:00:00")
    tickets = {name: life.open(plain, read, action, 0.85, name, "v1", pairs) for name in ("t1", "t2")}
    for ticket in tickets.values():
        life.approve(ticket, read, "ops", "2024-01-02 00:00:00")

    def execute(ticket: str, execution: str, hour: int):
        return life.execute(
            tickets[ticket], read, plain, target, execution, f"2024-01-03 0{hour}:00:00", confirmed=True,
            allowed_pairs=pairs,
        )

    execute("t1", "e1", 1)
    refusal("refused e1 again", lambda: execute("t1", "e9", 2))
    execute("t2", "e2", 4)
    refusal("refused rollback e1", lambda: life.rollback("e1", "2024-01-04 00:00:00"))
    life.rollback("e2", "2024-01-04 01:00:00")
    nothing = F.lit(0).cast("bigint").alias("row_count")
    runs, stored = life.read("runs"), life.read("snapshots")
    states = ticket_states(life.read("tickets"), life.read("decisions"))
    manifests = life.read("manifests").select("ticket_id", "final_row_count")
    shown = latest_marker(life.publisher.markers()).where(F.col("logical_target") == target)
    parts = [
        stored.select(
            F.lit("snapshot").alias("step"),
            F.when(F.col("snapshot_id") == "orders-s1", "NEW").otherwise("other").alias("outcome"),
            F.col("source_row_count").alias("row_count"),
        ),
        runs.select(F.concat(F.lit("run "), "run_id").alias("step"), "outcome", F.col("source_row_count").alias("row_count")),
        states.join(manifests, "ticket_id", "left").select(
            F.concat(F.lit("ticket "), "ticket_id").alias("step"),
            F.col("status").alias("outcome"),
            F.coalesce("final_row_count", F.lit(0)).alias("row_count"),
        ),
        life.executions().select(
            F.concat(F.lit("execution "), "execution_id").alias("step"), F.col("status").alias("outcome"), nothing
        ),
        spark.createDataFrame(refused, "step string, outcome string").select("step", "outcome", nothing),
        spark.table(target).agg(F.count("*").alias("row_count")).select(
            F.lit("published").alias("step"),
            F.lit("e1" if shown.first().physical_table.endswith("__e1") else "other").alias("outcome"),
            "row_count",
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
