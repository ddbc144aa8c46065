"""Queries on observed schemas, keys and inferred types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from goldseam.operators import profile as ops
from goldseam.queries import register
from goldseam.queries.fixtures import DOUBLES, JSON_TEXT, Fixture, duck, table, with_sql

# Columns of the driver's tables as (name, logical type), for the SQL side.
TABLE_COLUMNS = {
    "lineitem": [
        ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"),
        ("l_linenumber", "int64"), ("l_quantity", "float64"), ("l_extendedprice", "float64"),
        ("l_discount", "float64"), ("l_tax", "float64"), ("l_returnflag", "object"),
        ("l_linestatus", "object"), ("l_shipdate", "datetime"),
    ],
    "orders": [
        ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "object"),
        ("o_totalprice", "float64"), ("o_orderdate", "datetime"), ("o_orderpriority", "object"),
    ],
    "customer": [
        ("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int64"),
        ("c_acctbal", "float64"), ("c_mktsegment", "object"),
    ],
    "part": [
        ("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"),
        ("p_type", "object"), ("p_size", "int64"), ("p_retailprice", "float64"),
    ],
    "events": [
        ("event_id", "int64"), ("ts", "datetime"), ("user_id", "int64"),
        ("event_type", "object"), ("value", "float64"), ("props", "object"),
    ],
    "documents": [
        ("doc_id", "int64"), ("text", "object"), ("lang", "object"), ("source", "object"),
        ("n_chars", "int64"),
    ],
    "pages": [("page_id", "int64"), ("url", "object"), ("html", "object")],
}


def _count_sql(dataset: str, source: str, columns, extra_null=None) -> str:
    parts = []
    for i, (name, dtype) in enumerate(columns):
        null = f"{name} IS NULL OR isnan({name})" if dtype == "float64" else f"{name} IS NULL"
        parts.append(
            f"SELECT '{dataset}' AS dataset, {i} AS ordinal, '{name}' AS column_name, "
            f"'{dtype}' AS dtype, count(*) FILTER ({null}) AS null_count, "
            f"count(DISTINCT {name}) FILTER (NOT ({null})) AS unique_count FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _named(df):
    return df.withColumnRenamed("column", "column_name")


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@register(
    "observe_schema",
    " UNION ALL ".join(_count_sql(t, t, c) for t, c in TABLE_COLUMNS.items()),
)
def observe_schema(spark, sf_dir):
    return _named(_union(ops.observe_schema(table(spark, sf_dir, t), t) for t in TABLE_COLUMNS))


@register(
    "observe_schema_nan",
    with_sql(
        _count_sql("drifted", "f", [("o_orderkey", "int64"), ("o_custkey", "int64"), ("v", "float64")]),
        f=DOUBLES,
    ),
)
def observe_schema_nan(spark, sf_dir):
    return _named(ops.observe_schema(DOUBLES.frame(spark, sf_dir), "drifted"))


_TRUSTED = {
    "event_id": "bigint", "ts": "timestamp without time zone", "user_id": "integer",
    "event_type": "character varying", "value": "double precision", "props": "jsonb",
}


@register(
    "observe_schema_trusted",
    _count_sql(
        "events",
        "events",
        [(n, "json" if n == "props" else d) for n, d in TABLE_COLUMNS["events"]],
    ),
)
def observe_schema_trusted(spark, sf_dir):
    return _named(ops.observe_schema_trusted(table(spark, sf_dir, "events"), "events", _TRUSTED))


@register(
    "json_unique_count",
    with_sql(
        "SELECT 'v' AS column_name, count(*) FILTER (v IS NULL) AS null_count, "
        "count(DISTINCT concat(json_extract_string(v, '$.a'), '/', json_extract_string(v, '$.b'))) "
        "AS unique_count FROM f UNION ALL "
        "SELECT 'props', count(*) FILTER (props IS NULL), "
        "count(DISTINCT json_extract_string(props, '$.k')) FROM f",
        f=JSON_TEXT,
    ),
)
def json_unique_count(spark, sf_dir):
    df = JSON_TEXT.frame(spark, sf_dir)
    return _named(_union(ops.json_unique_count(df, c) for c in ("v", "props")))


@register(
    "observe_nulls",
    with_sql(
        "SELECT 'drifted' AS dataset, 0 AS ordinal, 'o_orderkey' AS column_name, 'int64' AS dtype, "
        "count(*) FILTER (o_orderkey IS NULL) AS null_count FROM f UNION ALL "
        "SELECT 'drifted', 1, 'o_custkey', 'int64', count(*) FILTER (o_custkey IS NULL) FROM f "
        "UNION ALL SELECT 'drifted', 2, 'v', 'float64', "
        "count(*) FILTER (v IS NULL OR isnan(v)) FROM f UNION ALL "
        "SELECT 'embeddings', 0, 'vec_id', 'int64', count(*) FILTER (vec_id IS NULL) FROM embeddings "
        "UNION ALL SELECT 'embeddings', 1, 'embedding', 'json', "
        "count(*) FILTER (embedding IS NULL) FROM embeddings UNION ALL "
        "SELECT 'embeddings', 2, 'label', 'int64', count(*) FILTER (label IS NULL) FROM embeddings",
        f=DOUBLES,
    ),
)
def observe_nulls(spark, sf_dir):
    drifted = ops.observe_nulls(DOUBLES.frame(spark, sf_dir), "drifted")
    nested = ops.observe_nulls(table(spark, sf_dir, "embeddings"), "embeddings")
    return _named(drifted.unionByName(nested))


_KEYS = {
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "customer": ["c_custkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "conversations": ["conv_id", "turn"],
    "documents": ["doc_id"],
}


@register(
    "key_proof",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, '{','.join(k)}' AS primary_key, count(*) AS row_count, "
        f"count(*) FILTER ({' OR '.join(c + ' IS NULL' for c in k)}) AS null_key_rows, "
        f"count(*) - count(DISTINCT ({', '.join(k)})) AS surplus_rows, "
        f"count(*) = count(DISTINCT ({', '.join(k)})) AS proved FROM {t}"
        for t, k in _KEYS.items()
    ),
)
def key_proof(spark, sf_dir):
    proofs = _union(ops.key_proof(table(spark, sf_dir, t), t, k) for t, k in _KEYS.items())
    return proofs.withColumn("primary_key", F.array_join("primary_key", ","))


# A catalog with one table per order. Constraint names repeat across tables of a schema.
_CONSTRAINTS = Fixture(
    "orders",
    [
        "concat('pk_', CAST(o_orderkey % 100 AS STRING)) AS constraint_name",
        "o_orderstatus AS constraint_schema",
        "o_orderstatus AS table_schema",
        "concat('t_', CAST(o_orderkey AS STRING)) AS table_name",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'FOREIGN KEY' ELSE 'PRIMARY KEY' END AS constraint_type",
    ],
)
_KEY_USAGE = Fixture(
    "orders",
    [
        "concat(CASE WHEN pos <= 1 + o_orderkey % 3 THEN 'pk_' ELSE 'ix_' END, "
        "CAST(o_orderkey % 100 AS STRING)) AS constraint_name",
        "o_orderstatus AS constraint_schema",
        "o_orderstatus AS table_schema",
        "concat('t_', CAST(o_orderkey AS STRING)) AS table_name",
        "concat('c', CAST((o_custkey + 7 * pos) % 10 AS STRING)) AS column_name",
        "CAST(pos AS INT) AS ordinal_position",
    ],
    repeat=3,
)


@register(
    "key_discovery",
    with_sql(
        "SELECT u.table_schema, u.table_name, "
        "string_agg(column_name, ',' ORDER BY ordinal_position) AS primary_key "
        "FROM u JOIN t ON u.constraint_name = t.constraint_name "
        "AND u.constraint_schema = t.constraint_schema AND u.table_schema = t.table_schema "
        "AND u.table_name = t.table_name WHERE t.constraint_type = 'PRIMARY KEY' "
        "GROUP BY u.table_schema, u.table_name",
        t=_CONSTRAINTS,
        u=_KEY_USAGE,
    ),
)
def key_discovery(spark, sf_dir):
    keys = ops.discover_keys(_CONSTRAINTS.frame(spark, sf_dir), _KEY_USAGE.frame(spark, sf_dir))
    return keys.withColumn("primary_key", F.array_join("primary_key", ","))


# Mixed values per user: JSON scalars of five kinds, nulls first for some users.
_MIXED = Fixture(
    "events",
    [
        "concat('u_', CAST(user_id AS STRING)) AS dataset",
        "event_id",
        "CASE WHEN user_id % 7 = 6 THEN 'null' WHEN event_id % 4 = 0 THEN 'null' "
        "WHEN user_id % 7 = 0 THEN CAST(event_id AS STRING) "
        "WHEN user_id % 7 = 1 THEN 'true' WHEN user_id % 7 = 2 THEN '\"text\"' "
        "WHEN user_id % 7 = 3 THEN CASE WHEN event_id % 2 = 0 THEN '1.5' ELSE '1.5e0' END WHEN user_id % 7 = 4 THEN props "
        "WHEN event_id % 2 = 1 THEN '7' ELSE 'false' END AS v",
    ],
)


@register(
    "infer_logical_type",
    with_sql(
        "SELECT dataset, coalesce(arg_min(CASE WHEN v = 'null' THEN NULL "
        "WHEN v IN ('true','false') THEN 'bool' WHEN v LIKE '\"%' THEN 'object' "
        "WHEN v LIKE '1.5%' THEN 'float64' WHEN starts_with(v, chr(123)) THEN 'json' ELSE 'int64' END, "
        "CASE WHEN v = 'null' THEN NULL ELSE event_id END), 'object') AS dtype FROM f GROUP BY dataset",
        f=_MIXED,
    ),
)
def infer_logical_type(spark, sf_dir):
    values = _MIXED.frame(spark, sf_dir).withColumn("v", F.parse_json("v"))
    return ops.infer_logical_type(values, ["dataset"], "v", "event_id")


# Schemas after a repair: the plan kind is o_orderkey % 4 (rename, applied cast, failed cast, none).
_CORRECTED = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CAST(pos - 1 AS INT) AS ordinal",
        "CASE pos WHEN 1 THEN 'id' WHEN 2 THEN CASE WHEN k = 0 THEN 'amount' ELSE 'Amount' END "
        "WHEN 3 THEN 'placed_at' ELSE 'fresh' END AS `column`",
        "CASE WHEN pos = 1 THEN 'int64' ELSE 'object' END AS native_dtype",
        "CASE WHEN pos = 4 AND o_custkey % 2 = 0 THEN 'uuid' END AS inferred_dtype",
    ],
    repeat=4,
    inner=["o_orderkey % 4 AS k"],
)
_BEFORE = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CASE pos WHEN 1 THEN 'id' WHEN 2 THEN 'Amount' ELSE 'placed_at' END AS `column`",
        "CASE pos WHEN 1 THEN 'int64' WHEN 2 THEN 'decimal' ELSE 'datetime' END AS dtype",
    ],
    repeat=3,
)
_APPLIED = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CASE o_orderkey % 4 WHEN 0 THEN 'RENAME' WHEN 3 THEN 'NONE' ELSE 'CAST' END AS kind",
        "'Amount' AS `column`",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'amount' ELSE 'object' END AS target",
        "o_orderkey % 4 <> 2 AS applied",
    ],
)


@register(
    "corrected_schema",
    duck(
        with_sql(
            "SELECT c.dataset, c.ordinal, c.`column` AS column_name, "
            "CASE WHEN c.native_dtype <> 'object' THEN c.native_dtype "
            "WHEN p.kind = 'CAST' AND p.applied AND p.`column` = c.`column` THEN p.target "
            "ELSE coalesce(b.dtype, c.inferred_dtype, 'object') END AS dtype "
            "FROM c LEFT JOIN p ON p.dataset = c.dataset LEFT JOIN b ON b.dataset = c.dataset AND "
            "b.`column` = CASE WHEN p.kind = 'RENAME' AND p.target = c.`column` THEN p.`column` "
            "ELSE c.`column` END",
            c=_CORRECTED,
            b=_BEFORE,
            p=_APPLIED,
        )
    ),
)
def corrected_schema(spark, sf_dir):
    return _named(
        ops.corrected_schema(
            _CORRECTED.frame(spark, sf_dir),
            _BEFORE.frame(spark, sf_dir),
            _APPLIED.frame(spark, sf_dir),
        )
    )
