"""Queries on row encodings and fingerprints."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import functions as F, types as T

from goldseam.functions.dtypes import as_published, has_odd_keys
from goldseam.functions.encoding import cell_text
from goldseam.operators import fingerprint as ops
from goldseam.queries import register
from goldseam.queries.fixtures import DOUBLES, GOLD, GOLD_SQL, Fixture, duck, table, with_sql
from goldseam.queries.profiling import TABLE_COLUMNS

_TAG = {"int64": "i", "float64": "f", "datetime": "t"}


def cell_sql(name: str, dtype: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    if dtype == "object":
        return f"CASE WHEN {name} IS NULL THEN 'N' ELSE concat('s', length({name}), ':', {name}) END"
    closed = f"concat('{_TAG[dtype]}', {text}, ';')"
    if dtype == "float64":
        return (
            f"CASE WHEN {name} IS NULL OR isnan({name}) THEN 'N' WHEN {name} = 'inf' THEN 'fInfinity;' "
            f"WHEN {name} = '-inf' THEN 'f-Infinity;' ELSE {closed} END"
        )
    return f"CASE WHEN {name} IS NULL THEN 'N' ELSE {closed} END"


def row_sql(columns) -> str:
    return " || ".join(cell_sql(n, d) for n, d in columns)


def header_sql(columns) -> str:
    listed = ",".join(f'["{n}","{d}"]' for n, d in columns)
    return f'["cells-v3",[{listed}]]'


def _crc32_sql(bits: str) -> str:
    """CRC-32 of the four bytes of a number below 2^32, big end first.

    It is linear in the bits: the value at zero, changed by one constant for each bit that is set.
    """
    zero = zlib.crc32(bytes(4))
    text = str(zero)
    for i in range(32):
        change = zlib.crc32((1 << i).to_bytes(4, "big")) ^ zero
        text = f"xor({text}, (({bits} >> {i}) & 1) * {change})"
    return text


def fingerprint_sql(dataset: str, source: str, columns) -> str:
    return (
        f"SELECT '{dataset}' AS dataset, row_count, sha256(concat_ws('|', '{header_sql(columns)}', "
        f"row_count, sums)) AS data_fingerprint FROM (SELECT count(*) AS row_count FROM {source}), "
        f"(SELECT string_agg(s, '|' ORDER BY lane) AS sums FROM (SELECT lane, "
        f"sum(CAST({_crc32_sql('v')} AS HUGEINT)) AS s FROM (SELECT lane, "
        f"CAST('0x' || substr(h, 1 + 8 * lane, 8) AS BIGINT) AS v FROM (SELECT sha256({row_sql(columns)}) AS h, "
        f"unnest(range(0, 8)) AS lane FROM {source})) GROUP BY lane))"
    )


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@register(
    "row_encoding",
    f"SELECT o_orderkey, {row_sql(TABLE_COLUMNS['orders'])} AS row_text FROM orders",
)
def row_encoding(spark, sf_dir):
    return ops.row_encoding(table(spark, sf_dir, "orders"), ["o_orderkey"])


@register(
    "dataset_fingerprint",
    " UNION ALL ".join(fingerprint_sql(t, t, c) for t, c in TABLE_COLUMNS.items()),
)
def dataset_fingerprint(spark, sf_dir):
    return _union(ops.dataset_fingerprint(table(spark, sf_dir, t), t) for t in TABLE_COLUMNS)


_DOUBLE_COLUMNS = [("o_orderkey", "int64"), ("o_custkey", "int64"), ("v", "float64")]


@register(
    "dataset_fingerprint_nulls",
    with_sql(
        fingerprint_sql("drifted", "f", _DOUBLE_COLUMNS).replace("CAST(v AS VARCHAR)",
        "CASE WHEN v > 1e7 THEN '9.223372036854776E18' ELSE CAST(v AS VARCHAR) END"),
        f=DOUBLES,
    ),
)
def dataset_fingerprint_nulls(spark, sf_dir):
    return ops.dataset_fingerprint(DOUBLES.frame(spark, sf_dir), "drifted")


def _merkle_sql(dataset: str, columns) -> str:
    """Leaves by six digits of the hash, then nodes by three, then the root."""
    leaves = (
        f"SELECT substr(h, 1, 6) AS prefix, sum(c) AS n, sha256(string_agg(h || 'x' || c, ',' ORDER BY h)) AS digest "
        f"FROM (SELECT sha256({row_sql(columns)}) AS h, count(*) AS c FROM {dataset} GROUP BY 1) GROUP BY 1"
    )
    nodes = (
        "SELECT substr(prefix, 1, 3) AS prefix, sum(n) AS n, "
        f"sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest FROM ({leaves}) GROUP BY 1"
    )
    return (
        f"SELECT '{dataset}' AS dataset, row_count, sha256(concat_ws('|', '{header_sql(columns)}', "
        f"row_count, digest)) AS data_fingerprint FROM (SELECT CAST(sum(n) AS BIGINT) AS row_count, "
        f"sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest FROM ({nodes}))"
    )


_MERKLE = ("orders", "lineitem", "customer")


@register(
    "dataset_fingerprint_merkle",
    " UNION ALL ".join(_merkle_sql(t, TABLE_COLUMNS[t]) for t in _MERKLE),
)
def dataset_fingerprint_merkle(spark, sf_dir):
    frames = [(t, table(spark, sf_dir, t)) for t in _MERKLE]
    return _union(ops.merkle_fingerprint(df, t) for t, df in frames)


@register("set_fingerprint")
def set_fingerprint(spark, sf_dir):
    """SQL has no SHAKE-128; tests hold the rows against hashlib."""
    return _union(ops.set_fingerprint(table(spark, sf_dir, t), t) for t in _MERKLE)


#: Orders as they are, and what may have happened to them, in Spark's and DuckDB's words alike.
_TAMPERED = {
    "OTHER_ORDER": "SELECT * FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL "
    "SELECT * FROM orders WHERE o_orderkey % 5 = 0",
    "ONE_REPLACED_BY_A_COPY": "SELECT * FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders) "
    "UNION ALL SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)",
    "ONE_LEFT_OUT": "SELECT * FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)",
    "TWO_TIMES_ALL": "SELECT * FROM orders UNION ALL SELECT * FROM orders",
}


@register(
    "set_fingerprint_changes",
    " UNION ALL ".join(
        f"SELECT '{name}' AS change, (SELECT count(*) FROM ({sql})) AS row_count, "
        f"(SELECT count(*) FROM (({sql}) EXCEPT ALL SELECT * FROM orders)) + (SELECT count(*) FROM "
        f"(SELECT * FROM orders EXCEPT ALL ({sql}))) = 0 AS same"
        for name, sql in _TAMPERED.items()
    ),
)
def set_fingerprint_changes(spark, sf_dir):
    """Whether the set fingerprint tells changed rows from the same rows in another order."""
    orders = table(spark, sf_dir, "orders")
    base = ops.set_fingerprint(orders, "orders").select(F.col("data_fingerprint").alias("base"))

    def judged(name, sql):
        changed = spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)
        return ops.set_fingerprint(changed, name).join(base).select(
            F.col("dataset").alias("change"), "row_count", (F.col("data_fingerprint") == F.col("base")).alias("same")
        )

    return _union(judged(name, sql) for name, sql in _TAMPERED.items())


_KINDS = ("date", "text", "timestamp", "timestamp_ntz", "decimal", "integer", "double", "boolean")
_PAIRS = [(a, b) for i, a in enumerate(_KINDS) for b in _KINDS[i + 1 :]]


@register(
    "variant_kinds",
    " UNION ALL ".join(
        f"SELECT '{a}' AS one, '{b}' AS other, count(*) AS row_count, CAST(0 AS BIGINT) AS equal_rows FROM orders"
        for a, b in _PAIRS
    ),
)
def variant_kinds(spark, sf_dir):
    """Row texts of variants that look alike and differ by type: of no pair of types any are equal."""
    day = F.col("o_orderdate").cast("date")
    values = {
        "date": day,
        "text": day.cast("string"),
        "timestamp": day.cast("timestamp"),
        "timestamp_ntz": day.cast("timestamp_ntz"),
        "decimal": (F.col("o_orderkey") % 2).cast("decimal(10,1)"),
        "integer": F.col("o_orderkey") % 2,
        "double": (F.col("o_orderkey") % 2).cast("double"),
        "boolean": F.col("o_orderkey") % 2 == 1,
    }
    df = table(spark, sf_dir, "orders").select(*[v.cast("variant").alias(k) for k, v in values.items()])
    texts = df.select(*[cell_text(df.schema[k]).alias(k) for k in _KINDS])
    counted = texts.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(a) == F.col(b)).alias(f"{a}_{b}") for a, b in _PAIRS],
    )
    listed = [
        F.struct(
            F.lit(a).alias("one"), F.lit(b).alias("other"),
            F.col("n").alias("row_count"), F.col(f"{a}_{b}").alias("equal_rows"),
        )
        for a, b in _PAIRS
    ]
    return counted.select(F.inline(F.array(*listed)))


# Pairs of nested values that look alike in JSON and differ by type or by what they hold.
_NESTED_PAIRS = {
    "struct of date, of text": ("named_struct('a', day)", "named_struct('a', cast(day as string))"),
    "array of integer, of decimal": ("array(n)", "array(cast(n as decimal(10,0)))"),
    "array of integer, of double": ("array(n)", "array(cast(n as double))"),
    "map with integer key, with text key": ("map(n, 1)", "map(cast(n as string), 1)"),
    "struct with a null field, without it": ("named_struct('a', n, 'b', cast(null as bigint))", "named_struct('a', n)"),
    "array of NaN, of the text": ("array(double('NaN'))", "array('NaN')"),
    "array of one list, of two": ("array(array(n, n), array(n))", "array(array(n), array(n, n))"),
    "mixed array with date, with text": (
        "to_variant_object(named_struct('x', array(day::variant, n::variant)))",
        "to_variant_object(named_struct('x', array(cast(day as string)::variant, n::variant)))",
    ),
    "mixed array with float, with decimal": (
        "to_variant_object(array(float(n)::variant, 'a'::variant))",
        "to_variant_object(array(cast(n as decimal(10,1))::variant, 'a'::variant))",
    ),
    "mixed array, deep": (
        "to_variant_object(array(array(array(day::variant, 1::variant))))",
        "to_variant_object(array(array(array(cast(day as string)::variant, 1::variant))))",
    ),
    "timestamp with zone, without": (
        "to_variant_object(array(cast(day as timestamp)))", "to_variant_object(array(cast(day as timestamp_ntz)))",
    ),
}


@register(
    "nested_kinds",
    " UNION ALL ".join(
        f"SELECT '{pair}' AS pair, count(*) AS row_count, CAST(0 AS BIGINT) AS equal_rows, count(*) AS same_when_published FROM orders"
        for pair in _NESTED_PAIRS
    ),
)
def nested_kinds(spark, sf_dir):
    """Row texts of nested cells that look alike: none are equal, and each is that of its published variant."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_orderdate").cast("date").alias("day")
    )
    exprs = [e for pair in _NESTED_PAIRS.values() for e in pair]
    df = rows.select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs)])
    texts = []
    for field in df.schema.fields:
        texts.append(cell_text(field).alias(field.name))
        published = as_published(F.col(field.name), field)
        stored = T.StructField(field.name, T.VariantType())
        # keys that are no text become text when published
        odd = has_odd_keys(field.dataType)
        texts.append(F.lit(True).alias(f"{field.name}_p") if odd else (cell_text(field) == cell_text(stored, published)).alias(f"{field.name}_p"))
    places = [(pair, f"c{2 * i}", f"c{2 * i + 1}") for i, pair in enumerate(_NESTED_PAIRS)]
    counted = df.select(*texts).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(a) == F.col(b)).alias(f"{a}_equal") for _, a, b in places],
        *[F.count_if(F.col(f"{a}_p") & F.col(f"{b}_p")).alias(f"{a}_same") for _, a, b in places],
    )
    listed = [
        F.struct(
            F.lit(pair).alias("pair"), F.col("n").alias("row_count"), F.col(f"{a}_equal").alias("equal_rows"),
            F.col(f"{a}_same").alias("same_when_published"),
        )
        for pair, a, _ in places
    ]
    return counted.select(F.inline(F.array(*listed)))


@register(
    "gold_fingerprint",
    with_sql(
        "SELECT dataset, sha256(concat('{\"columns\":[', string_agg(concat('{\"dtype\":\"', dtype, "
        "'\",\"name\":\"', \"column\", '\"}'), ',' ORDER BY ordinal), '],\"format_version\":1}')) AS fingerprint "
        "FROM g GROUP BY dataset",
        g=GOLD_SQL,
    ),
)
def gold_fingerprint(spark, sf_dir):
    columns = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "column", "dtype"))),
        lambda c: F.struct(c["column"].alias("name"), c["dtype"].alias("dtype"), c["ordinal"].alias("note")),
    )
    versions = GOLD.frame(spark, sf_dir).groupBy("dataset").agg(columns.alias("columns"))
    return ops.gold_fingerprint(versions.withColumn("format_version", F.lit(1))).select(
        "dataset", "fingerprint"
    )


_METADATA = Fixture(
    "orders",
    [
        "concat('ds_', CAST(o_orderkey AS STRING)) AS dataset",
        "CAST(pos AS INT) AS ordinal",
        "concat('c', CAST(pos AS STRING), '\"', o_orderstatus) AS column_name",
        "CASE (pos + o_custkey) % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'numeric' "
        "WHEN 2 THEN 'character varying' ELSE 'timestamp without time zone' END AS data_type",
        "CASE (pos + o_custkey) % 4 WHEN 0 THEN 64 WHEN 1 THEN 20 END AS numeric_precision",
        "CASE (pos + o_custkey) % 4 WHEN 0 THEN 0 WHEN 1 THEN 9 END AS numeric_scale",
        "CASE (pos + o_custkey) % 4 WHEN 3 THEN 6 END AS datetime_precision",
        "CASE WHEN pos = 1 THEN 'NO' ELSE 'YES' END AS is_nullable",
        "CASE (pos + o_custkey) % 4 WHEN 2 THEN 20 END AS character_maximum_length",
        "'pg_catalog' AS udt_schema",
        "'t' AS udt_name",
        "CAST(NULL AS STRING) AS domain_schema",
        "CAST(NULL AS STRING) AS domain_name",
        "CASE (pos + o_custkey) % 4 WHEN 2 THEN 'C' END AS collation_name",
    ],
    repeat=4,
)


def _attribute_sql(name: str) -> str:
    number = name.startswith(("numeric", "datetime", "character"))
    text = f"CAST({name} AS VARCHAR)" if number else f"CAST(to_json({name}) AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN 'null' ELSE {text} END"


@register(
    "schema_fingerprint",
    with_sql(
        "SELECT dataset, sha256(concat('[', string_agg(concat('[', "
        + ", ',', ".join(_attribute_sql(a) for a in ops.METADATA_ATTRIBUTES)
        + ", ']'), ',' ORDER BY ordinal), ']')) AS schema_fingerprint FROM m GROUP BY dataset",
        m=_METADATA,
    ),
)
def schema_fingerprint(spark, sf_dir):
    return ops.schema_fingerprint(_METADATA.frame(spark, sf_dir))


_PROVENANCE = Fixture(
    "orders",
    [
        "o_orderkey AS run_id",
        "CASE WHEN k = 0 THEN 'id,id' WHEN k = 1 THEN '1d' WHEN k = 6 THEN 'id,line' ELSE 'id' END AS key_text",
        "CASE WHEN k = 2 THEN -1 ELSE o_custkey END AS source_row_count",
        "CASE WHEN k = 3 THEN upper(concat(md5(o_orderpriority), md5('s'))) "
        "ELSE concat(md5(o_orderpriority), md5('s')) END AS source_schema_fingerprint",
        "CASE WHEN k = 4 THEN concat(md5(CAST(o_orderkey AS STRING)), md5('d'), chr(10)) "
        "WHEN k = 5 THEN md5('short') ELSE concat(md5(CAST(o_orderkey AS STRING)), md5('d')) END "
        "AS source_dataset_fingerprint",
    ],
    inner=["o_orderkey % 9 AS k"],
)


@register(
    "provenance_fingerprint",
    with_sql(
        "SELECT run_id, coalesce(error, 'none') AS provenance_error, CASE WHEN error IS NULL THEN sha256(concat("
        "'{\"format_version\":1,\"source_dataset_fingerprint\":\"', source_dataset_fingerprint, "
        "'\",\"source_primary_key\":[\"', replace(key_text, ',', '\",\"'), '\"],\"source_row_count\":', "
        "source_row_count, ',\"source_schema_fingerprint\":\"', source_schema_fingerprint, '\"}')) ELSE 'none' END "
        "AS provenance_fingerprint FROM (SELECT *, CASE WHEN key_text IN ('id,id', '1d') THEN 'INVALID_PRIMARY_KEY' "
        "WHEN source_row_count < 0 THEN 'INVALID_ROW_COUNT' "
        "WHEN NOT regexp_full_match(source_schema_fingerprint, '[0-9a-f]{64}') THEN 'INVALID_SCHEMA_FINGERPRINT' "
        "WHEN NOT regexp_full_match(source_dataset_fingerprint, '[0-9a-f]{64}') THEN 'INVALID_DATASET_FINGERPRINT' END "
        "AS error FROM f)",
        f=_PROVENANCE,
    ),
)
def provenance_fingerprint(spark, sf_dir):
    runs = _PROVENANCE.frame(spark, sf_dir).withColumn("source_primary_key", F.split("key_text", ","))
    return ops.provenance_fingerprint(runs).select(
        "run_id",
        F.coalesce("provenance_error", F.lit("none")).alias("provenance_error"),
        F.coalesce("provenance_fingerprint", F.lit("none")).alias("provenance_fingerprint"),
    )


_PAYLOADS = Fixture(
    "events",
    [
        "event_id AS payload_id",
        "event_id % 8 AS k",
        "CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS version",
        "concat('{\"format_version\":', CASE WHEN event_id % 17 = 0 THEN '3' WHEN event_id % 3 = 0 THEN '1' ELSE '2' END, "
        "',\"column_order\":[\"a\",\"b\"],\"dtypes\":{\"a\":\"int64\",\"b\":\"object\"},\"data\":{\"a\":[', "
        "CAST(event_id AS STRING), ',null],\"b\":[', CASE event_id % 8 "
        "WHEN 0 THEN '{\"__type__\":\"decimal\",\"value\":\"1.50\"}' "
        "WHEN 1 THEN '{\"__type__\":\"date\",\"value\":\"2024-02-30\"}' "
        "WHEN 2 THEN '{\"__type__\":\"uuid\",\"value\":\"00000000-0000-0000-0000-00000000000a\"}' "
        "WHEN 3 THEN '{\"__type__\":\"raw_json\",\"value\":{\"x\":1}}' "
        "WHEN 4 THEN '{\"__type__\":\"positive_infinity\"}' "
        "WHEN 5 THEN '{\"__type__\":\"python_datetime\",\"value\":\"2024-01-01T10:00:00\"}' "
        "WHEN 6 THEN concat('\"', event_type, '\"') ELSE props END, ']}}') AS payload",
    ],
)
_B_KIND = (
    "CASE k WHEN 0 THEN 'decimal' WHEN 1 THEN 'date' WHEN 2 THEN CASE WHEN version = 1 THEN 'object' ELSE 'uuid' END "
    "WHEN 3 THEN CASE WHEN version = 1 THEN 'object' ELSE 'raw_json' END WHEN 4 THEN 'positive_infinity' "
    "WHEN 5 THEN 'python_datetime' WHEN 6 THEN 'string' ELSE 'object' END"
)


@register(
    "decode_payloads",
    with_sql(
        "SELECT payload_id, 'a' AS column_name, 0 AS \"row\", 'int64' AS dtype, 'integer' AS kind, "
        "CAST(payload_id AS VARCHAR) AS text, true AS intact FROM f WHERE version < 3 UNION ALL "
        "SELECT payload_id, 'a', 1, 'int64', 'null', 'none', true FROM f WHERE version < 3 UNION ALL "
        f"SELECT payload_id, 'b', 0, 'object', {_B_KIND}, CASE k WHEN 0 THEN '1.50' WHEN 1 THEN '2024-02-30' "
        "WHEN 2 THEN CASE WHEN version = 1 THEN '{\"__type__\":\"uuid\",\"value\":\"00000000-0000-0000-0000-00000000000a\"}' "
        "ELSE '00000000-0000-0000-0000-00000000000a' END "
        "WHEN 3 THEN CASE WHEN version = 1 THEN '{\"__type__\":\"raw_json\",\"value\":{\"x\":1}}' ELSE '{\"x\":1}' END "
        "WHEN 4 THEN 'inf' WHEN 5 THEN '2024-01-01T10:00:00' WHEN 6 THEN event_type ELSE replace(props, ': ', ':') END, "
        "k <> 1 FROM (SELECT f.*, e.event_type, e.props FROM f JOIN events e ON e.event_id = f.payload_id) WHERE version < 3 "
        "UNION ALL SELECT payload_id, 'none', -1, 'none', 'UNSUPPORTED_VERSION', 'none', false FROM f WHERE version = 3",
        f=_PAYLOADS,
    ),
)
def decode_payloads(spark, sf_dir):
    cells = ops.decode_payloads(_PAYLOADS.frame(spark, sf_dir).select("payload_id", "payload"))
    return cells.select(
        "payload_id",
        F.coalesce("column", F.lit("none")).alias("column_name"),
        F.coalesce("row", F.lit(-1)).alias("row"),
        F.coalesce("dtype", F.lit("none")).alias("dtype"),
        "kind",
        F.coalesce("text", F.lit("none")).alias("text"),
        "intact",
    )


@register(
    "restore_payload_rows",
    with_sql(
        "SELECT payload_id, 0 AS \"row\", payload_id AS a, CASE WHEN k = 0 THEN 'DECIMAL' WHEN k = 1 THEN 'none' "
        "WHEN k = 2 THEN CASE WHEN version = 1 THEN 'OBJECT' ELSE 'STRING' END WHEN k IN (3, 7) THEN 'OBJECT' "
        "WHEN k = 4 THEN 'DOUBLE' WHEN k = 5 THEN 'TIMESTAMP_NTZ' ELSE 'STRING' END AS b_type FROM f WHERE version < 3 "
        "UNION ALL SELECT payload_id, 1, -1, 'none' FROM f WHERE version < 3",
        f=_PAYLOADS,
    ),
)
def restore_payload_rows(spark, sf_dir):
    """Stored payloads as rows again: a as a number, b as a variant of whatever type each cell had."""
    cells = ops.decode_payloads(_PAYLOADS.frame(spark, sf_dir).select("payload_id", "payload"))
    rows = ops.restore_rows(cells, [("a", "int64"), ("b", "object")])
    shape = F.regexp_extract(F.schema_of_variant("b"), "^[A-Z_]+", 0)
    return rows.select(
        "payload_id", "row", F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce(shape, F.lit("none")).alias("b_type")
    )


@register(
    "restore_payload_decimals",
    "SELECT o_orderkey AS payload_id, concat('7', o_orderkey, '12345678901234567890123456.25') AS v FROM orders",
)
def restore_payload_decimals(spark, sf_dir):
    """Stored decimals of about thirty digits as a typed column, in full."""
    cell = F.concat(F.lit('{"__type__":"decimal","value":"7'), "o_orderkey", F.lit('12345678901234567890123456.25"}'))
    payload = F.concat(
        F.lit('{"format_version":2,"column_order":["v"],"dtypes":{"v":"decimal"},"data":{"v":['), cell, F.lit("]}}")
    )
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payload_id"), payload.alias("payload"))
    rows = ops.restore_rows(ops.decode_payloads(stored), [("v", "decimal")])
    if not isinstance(rows.schema["v"].dataType, T.DecimalType):
        raise TypeError("The decimals did not come back as decimals.")
    return rows.select("payload_id", F.col("v").cast("string").alias("v"))


@register(
    "encode_payload_cells",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(to_json(c_name) AS VARCHAR) AS c_name, "
    "CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, "
    "CAST(to_json(c_mktsegment) AS VARCHAR) AS c_mktsegment FROM customer",
)
def encode_payload_cells(spark, sf_dir):
    return ops.encode_payload_cells(table(spark, sf_dir, "customer"))
