"""Drifted inputs derived from the driver's tables, in SQL that Spark and DuckDB both run.

Every fixture covers its whole table, so the work of a query grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from goldseam.sources.tables import fetch_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fetch_table(spark, name, path=sf_dir)


@dataclass(frozen=True)
class Fixture:
    """Expressions over one table; ``repeat`` gives each row positions 1..n as ``pos`` first."""

    source: str
    expressions: Sequence[str]
    where: str | None = None
    repeat: int = 0
    inner: Sequence[str] = ()

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.source)
        if self.repeat:
            df = df.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(self.repeat))))
        if self.inner:
            df = df.selectExpr("*", *self.inner)
        if self.where:
            df = df.where(self.where)
        return df.selectExpr(*self.expressions)

    def sql(self) -> str:
        source = self.source
        if self.repeat:
            source = f"(SELECT *, unnest(range(1, {self.repeat + 1})) AS pos FROM {source})"
        if self.inner:
            source = f"(SELECT *, {', '.join(self.inner)} FROM {source})"
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {', '.join(self.expressions)} FROM {source}{where}"


def with_sql(body: str, **fixtures: Fixture | str) -> str:
    """A SQL text with the named fixtures as common tables in front."""
    parts = [
        f"{name} AS ({f if isinstance(f, str) else f.sql()})" for name, f in fixtures.items()
    ]
    return f"WITH {', '.join(parts)} {body}"


# --- columns with drifted values ---------------------------------------------------
_INT_TEXT = (
    "CASE event_id % 10 "
    "WHEN 0 THEN concat('0', CAST(event_id AS STRING)) "
    "WHEN 1 THEN concat(' ', CAST(event_id AS STRING)) "
    "WHEN 2 THEN concat(CAST(event_id AS STRING), '.5') "
    "WHEN 3 THEN '9223372036854775808' "
    "WHEN 4 THEN '-Infinity' "
    "WHEN 5 THEN NULL "
    "WHEN 6 THEN concat(CAST(event_id AS STRING), chr(10)) "
    "WHEN 7 THEN concat('-', CAST(event_id AS STRING)) "
    "WHEN 8 THEN concat('+', CAST(event_id AS STRING)) "
    "ELSE CAST(event_id AS STRING) END"
)
_BOOL_TEXT = (
    "CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN ' 1 ' "
    "WHEN 3 THEN 'yes' WHEN 4 THEN '0' WHEN 5 THEN '1.0' WHEN 6 THEN NULL ELSE 't' END"
)
_FLOAT_TEXT = (
    "CASE event_id % 8 WHEN 0 THEN concat(CAST(event_id AS STRING), '.5') WHEN 1 THEN '0.1' "
    "WHEN 2 THEN '1e3' WHEN 3 THEN '9007199254740993' WHEN 4 THEN 'NaN' WHEN 5 THEN NULL "
    "WHEN 6 THEN '0.25' ELSE '.5' END"
)
# Real prices, short exact fractions, integers beyond 2^53, and text of more than 38 characters.
_PRICE_TEXT = (
    "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS STRING) "
    "WHEN 1 THEN concat('-', CAST(o_orderkey AS STRING), CASE o_custkey % 4 WHEN 0 THEN '.5' "
    "WHEN 1 THEN '.250' WHEN 2 THEN '.125' ELSE '.3' END) "
    "WHEN 2 THEN concat(CAST(o_orderkey AS STRING), '00000000000000000') "
    "WHEN 3 THEN '1267650600228229401496703205376.0000000000' "
    "WHEN 4 THEN '1267650600228229401496703205377.0000000000' "
    "ELSE concat(CAST(o_custkey AS STRING), '.0') END"
)
_DOUBLE = (
    "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN o_totalprice "
    "WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) "
    "WHEN 4 THEN CAST('9223372036854775808' AS DOUBLE) ELSE NULL END"
)

INT_TEXT = Fixture("events", ["event_id", "user_id", f"{_INT_TEXT} AS v"])
BOOL_TEXT = Fixture("events", ["event_id", f"{_BOOL_TEXT} AS v"])
EVENT_TEXTS = Fixture(
    "events",
    [
        "event_id",
        "user_id",
        f"{_INT_TEXT} AS as_int",
        f"{_BOOL_TEXT} AS as_bool",
        f"{_FLOAT_TEXT} AS as_float",
        "value",
    ],
)
PRICE_TEXT = Fixture("orders", ["o_orderkey", f"{_PRICE_TEXT} AS v"])
DOUBLES = Fixture("orders", ["o_orderkey", "o_custkey", f"{_DOUBLE} AS v"])
SAFE_TEXTS = Fixture(
    "orders",
    [
        "o_orderkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('+', CAST(o_orderkey AS STRING)) "
        "ELSE CAST(-o_orderkey AS STRING) END AS count_text",
        "concat(CAST(o_custkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.50' "
        "WHEN 1 THEN '.125' ELSE '' END) AS amount_text",
        "CASE o_orderkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' 0 ' WHEN 2 THEN '1' "
        "ELSE 'false' END AS flag_text",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS maybe_count",
        "o_totalprice",
    ],
)
JSON_TEXT = Fixture(
    "events",
    [
        "event_id",
        "CASE WHEN event_id % 2 = 0 "
        "THEN concat(chr(123), '\"a\":', CAST(event_id % 10 AS STRING), ',\"b\":1', chr(125)) "
        "ELSE concat(chr(123), '\"b\":1,\"a\":', CAST((event_id - 1) % 10 AS STRING), chr(125)) "
        "END AS v",
        "props",
    ],
)

# --- many datasets: one per order ------------------------------------------------------
# Gold has five columns. The kind of drift is o_orderkey % 10: 0 none, 1 renamed, 2 reordered,
# 3 one type, 4 one more column, 5 one column less, 6 two types, 7 renamed and retyped,
# 8 reordered and one type, 9 renamed and one type elsewhere.
_DATASET = "concat('ds_', CAST(o_orderkey AS STRING))"
GOLD = Fixture(
    "orders",
    [
        f"{_DATASET} AS dataset",
        "CAST(pos - 1 AS INT) AS ordinal",
        "CASE pos WHEN 1 THEN 'id' WHEN 2 THEN 'amount' WHEN 3 THEN 'status' "
        "WHEN 4 THEN 'placed_at' ELSE 'priority' END AS \"column\"".replace('"', "`"),
        "CASE pos WHEN 1 THEN 'int64' WHEN 2 THEN 'float64' WHEN 4 THEN 'datetime' "
        "ELSE 'object' END AS dtype",
    ],
    repeat=5,
)
_SWAPPED = "CASE WHEN kind IN (2, 8) AND pos = 1 THEN 3 WHEN kind IN (2, 8) AND pos = 3 THEN 1 ELSE pos END"
OBSERVED = Fixture(
    "orders",
    [
        f"{_DATASET} AS dataset",
        f"CAST({_SWAPPED} - 1 AS INT) AS ordinal",
        "CASE pos WHEN 1 THEN 'id' "
        "WHEN 2 THEN CASE WHEN kind IN (1, 7) THEN 'Amount' ELSE 'amount' END "
        "WHEN 3 THEN CASE WHEN kind = 9 THEN 'Status' ELSE 'status' END "
        "WHEN 4 THEN 'placed_at' WHEN 5 THEN 'priority' ELSE 'note' END AS `column`",
        "CASE pos WHEN 1 THEN CASE WHEN kind IN (6, 8) THEN 'object' ELSE 'int64' END "
        "WHEN 2 THEN CASE WHEN kind IN (3, 6, 7, 9) THEN 'object' ELSE 'float64' END "
        "WHEN 4 THEN 'datetime' ELSE 'object' END AS dtype",
        "CAST(o_custkey % (pos + 1) AS BIGINT) AS null_count",
        "CAST(o_custkey AS BIGINT) AS unique_count",
    ],
    where="(pos <= 4 OR (pos = 5 AND kind <> 5) OR (pos = 6 AND kind = 4))",
    repeat=6,
    inner=["o_orderkey % 10 AS kind"],
)


def duck(sql: str) -> str:
    """Spark quotes names with backticks, DuckDB with double quotes."""
    return sql.replace("`", '"')


GOLD_SQL = duck(GOLD.sql())
OBSERVED_SQL = duck(OBSERVED.sql())
