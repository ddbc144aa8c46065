"""Fingerprints of datasets, schemas, definitions and provenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from goldseam import constants as C
from goldseam.functions.actions import is_identifier
from goldseam.functions.encoding import quoted, row_text, schema_header
from goldseam.session import exact_names

_LANES = 8


# --- data ----------------------------------------------------------------------
@exact_names
def row_encoding(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key columns and the canonical text of each row."""
    return df.select(*[quoted(k) for k in key], row_text(df).alias("row_text"))


def row_digest(
    df: DataFrame, columns: Sequence[str] | None = None, at: Callable[[str], Column] = quoted
) -> Column:
    """SHA-256 of a row's typed cells, as 32 bytes."""
    return F.unhex(F.sha2(row_text(df, columns, at), 256))


def fingerprint_aggregates(digest: str, prefix: str = "") -> list[Column]:
    """Aggregates behind a dataset fingerprint, to be fused with others over the same scan.

    ``digest`` names a column holding ``row_digest``, selected first so that it is computed once.
    Each row is hashed with SHA-256 over its typed cells, and the eight 32-bit parts of the hash
    are summed. A sum needs no order and folds in every task, so no row is shuffled, whatever the
    size of the table, and repeated rows still count. Eight sums withstand accidents; for input that
    somebody may have crafted there are ``measure_set``, as cheap to move, and ``merkle_fingerprint``.

    CRC-32 of four bytes maps them one to one onto 32 bits, and is by far the cheapest native way
    from bytes to a number. Halves of 16 bits keep the sums exact in bigint for 2^47 rows.
    """
    sums = [F.count(F.lit(1)).alias(f"{prefix}row_count")]
    for lane in range(_LANES):
        part = f"crc32(substring({digest}, {1 + 4 * lane}, 4))"
        sums.append(F.expr(f"sum(shiftright({part}, 16)) AS {prefix}high_{lane}"))
        sums.append(F.expr(f"sum({part} & 65535) AS {prefix}low_{lane}"))
    return sums


def fingerprint_digest(header: str, prefix: str = "") -> Column:
    """The fingerprint from the columns that ``fingerprint_aggregates`` produced."""
    lane_sums = ", ".join(
        f"cast(cast(coalesce({prefix}high_{lane}, 0) AS decimal(20,0)) * 65536BD "
        f"+ coalesce({prefix}low_{lane}, 0) AS string)"
        for lane in range(_LANES)
    )
    counted = F.expr(f"concat_ws('|', {prefix}row_count, {lane_sums})")
    return F.sha2(F.concat_ws("|", F.lit(header), counted), 256)


def dataset_fingerprint(
    df: DataFrame, dataset: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Row count and fingerprint: changes with names, order, types, any value or any null."""
    return measure(df, columns).select(
        F.lit(dataset).alias("dataset"), "row_count", "data_fingerprint"
    )


@exact_names
def measure(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row_count and data_fingerprint."""
    sums = df.select(row_digest(df, columns).alias("_digest")).agg(
        *fingerprint_aggregates("_digest")
    )
    return sums.select(
        "row_count", fingerprint_digest(schema_header(df, columns)).alias("data_fingerprint")
    )


# Lanes of 16 bits that a row's digest is stretched to.
SET_LANES = 1024
_DIGEST_BYTES = 32


def _lane_sums(digests: Column) -> Column:
    """Per Arrow batch the sums of all lanes of its rows, at its last row; null at the others.

    ``digests`` holds one or more row digests behind one another. Each is stretched with SHAKE-128.
    The function travels with the plan, so workers need no copy of this package.
    """
    lanes, width = SET_LANES, _DIGEST_BYTES

    def fold(batch: pd.Series) -> pd.Series:
        from hashlib import shake_128

        sums = [None] * len(batch)
        if sums:
            values = batch.tolist()
            total = np.zeros((len(values[0]) // width, lanes), np.int64)
            for place in range(len(total)):
                own = slice(place * width, (place + 1) * width)
                for start in range(0, len(values), 256):
                    part = b"".join(shake_128(v[own]).digest(2 * lanes) for v in values[start : start + 256])
                    total[place] += np.frombuffer(part, "<u2").reshape(-1, lanes).sum(axis=0, dtype=np.int64)
            sums[-1] = total.ravel()
        return pd.Series(sums, dtype=object)

    return F.pandas_udf(fold, T.ArrayType(T.LongType()))(digests)


def aggregated_with_sets(rows: DataFrame, digests: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row: ``aggregates`` over ``rows``, and per digest column d the text ``d_lanes`` of its lane sums.

    All of it comes from one pass. A batch of rows leaves the worker as one array of sums; these are
    folded per lane in the task, so a task sends one row per lane, whatever its number of rows.
    A row counts at place 0, a lane at its own place.
    """
    batches = rows.withColumn("_batch", _lane_sums(F.concat(*digests)))
    places = F.concat(F.array(F.lit(None).cast("bigint")), "_batch")
    spread = batches.select(*rows.columns, F.posexplode_outer(places).alias("_at", "_sum"))
    folded = spread.groupBy(F.coalesce("_at", F.lit(0)).alias("_place")).agg(
        F.sum("_sum").alias("_lane"), *aggregates
    )
    own = [f for f in folded.schema.fields if f.name not in ("_place", "_lane")]
    lane = F.when(F.col("_place") > 0, F.struct("_place", "_lane"))
    whole = folded.agg(
        F.first(F.when(F.col("_place") == 0, F.struct(*[f.name for f in own])), True).alias("_own"),
        F.array_sort(F.collect_list(lane)).alias("_lanes"),
    )
    # A table without rows has no place 0; its counts are zero, as in an aggregate without groups.
    results = [
        (F.col(f"_own.{f.name}") if f.nullable else F.coalesce(F.col(f"_own.{f.name}"), F.lit(0))).alias(f.name)
        for f in own
    ]
    texts = [
        F.array_join(
            F.transform(
                F.slice("_lanes", 1 + i * SET_LANES, SET_LANES), lambda lane: lane["_lane"].cast("string")
            ),
            ",",
        ).alias(f"{digest}_lanes")
        for i, digest in enumerate(digests)
    ]
    return whole.select(*results, *texts)


def set_digest(header: str, row_count: str, lanes: str) -> Column:
    """The set fingerprint from what ``aggregated_with_sets`` produced."""
    return F.sha2(F.concat_ws("|", F.lit(header), F.lit(f"{SET_LANES}x16"), F.col(row_count), F.col(lanes)), 256)


@exact_names
def measure_set(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row_count, data_fingerprint as ``measure`` has it, and set_fingerprint, from one pass.

    For the set fingerprint a row's SHA-256 is stretched to 1024 lanes of 16 bits and the lanes are
    summed over all rows. To find other rows with equal sums is a short-vector problem in 1024
    dimensions, not the eight of ``measure``. The sums are kept whole (64 bits hold 2^47 rows)
    instead of modulo 2^16, so 65,536 copies of one row are not worth the same as those of another.
    Like ``measure`` it needs no order and shuffles no row. Repeated rows count each time; a table
    without rows has a fingerprint of its own per schema.
    """
    header = schema_header(df, columns)
    rows = df.select(row_digest(df, columns).alias("_digest"))
    found = aggregated_with_sets(rows, ["_digest"], fingerprint_aggregates("_digest"))
    return found.select(
        "row_count",
        fingerprint_digest(header).alias("data_fingerprint"),
        set_digest(header, "row_count", "_digest_lanes").alias("set_fingerprint"),
    )


def set_fingerprint(df: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and set fingerprint: the form of ``dataset_fingerprint`` for rows that may be crafted."""
    return measure_set(df, columns).select(
        F.lit(dataset).alias("dataset"), "row_count", F.col("set_fingerprint").alias("data_fingerprint")
    )


# Hex digits of a leaf's prefix: 16.7 million leaves, whatever the table, so equal rows have equal trees.
MERKLE_DEPTH = 6


@exact_names
def merkle_fingerprint(df: DataFrame, dataset: str) -> DataFrame:
    """Collision-resistant form: a tree of SHA-256 over sorted row hashes.

    Leaves are prefixes of the row hash, so they fill evenly whatever the keys look like. Equal
    rows are folded to one hash with a count before they move; hashes travel as 32 bytes. The depth
    is fixed, so the result depends on the rows alone. Inner levels join at most 4096 children, so
    no task ever holds more than one leaf or one node; a leaf of a table of 10^12 rows has 60,000.
    """
    depth = MERKLE_DEPTH
    hashed = (
        df.select(F.unhex(F.sha2(row_text(df), 256)).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    digits = F.lower(F.hex("h"))
    nodes = hashed.select(
        F.substring(digits, 1, depth).alias("prefix"),
        F.concat(digits, F.lit("x"), F.col("n").cast("string")).alias("item"),
        "n",
    )
    while True:
        nodes = nodes.groupBy("prefix").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("digest"),
            F.sum("n").alias("n"),
        )
        if depth == 0:
            break
        depth = max(0, depth - 3)
        nodes = nodes.select(
            F.substring("prefix", 1, depth).alias("prefix"),
            F.concat("prefix", F.lit("="), "digest").alias("item"),
            "n",
        )
    root = nodes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("digest"), F.lit("")).alias("digest"),
    )
    return root.select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        F.sha2(
            F.concat_ws(
                "|", F.lit(schema_header(df)), F.col("row_count").cast("string"), "digest"
            ),
            256,
        ).alias("data_fingerprint"),
    )


# --- definitions and metadata ------------------------------------------------------
def gold_json(format_version: Column, columns: Column) -> Column:
    """Canonical JSON of a Gold definition; only name and dtype of each column count."""
    kept = F.transform(
        columns, lambda c: F.struct(c["dtype"].alias("dtype"), c["name"].alias("name"))
    )
    return F.to_json(F.struct(kept.alias("columns"), format_version.alias("format_version")))


def gold_fingerprint(versions: DataFrame) -> DataFrame:
    """``versions`` (format_version, columns) with the fingerprint of each definition."""
    return versions.withColumn(
        "fingerprint", F.sha2(gold_json(F.col("format_version"), F.col("columns")), 256)
    )


METADATA_ATTRIBUTES = (
    "column_name", "data_type", "numeric_precision", "numeric_scale", "datetime_precision",
    "is_nullable", "character_maximum_length", "udt_schema", "udt_name", "domain_schema",
    "domain_name", "collation_name",
)
_NUMERIC_ATTRIBUTES = (
    "numeric_precision", "numeric_scale", "datetime_precision", "character_maximum_length",
)


def _json_scalar(name: str) -> Column:
    value = F.col(name)
    if name in _NUMERIC_ATTRIBUTES:
        text = value.cast("string")
    else:
        listed = F.to_json(F.array(value))
        text = F.when(value.isNotNull(), F.substring(listed, 2, F.length(listed) - 2))
    return F.coalesce(text, F.lit("null"))


def schema_fingerprint(metadata: DataFrame) -> DataFrame:
    """Per dataset, SHA-256 over the twelve metadata attributes of its columns, in order.

    A group is one table's columns, so the list is schema-sized.
    """
    described = F.concat(
        F.lit("["), F.concat_ws(",", *[_json_scalar(a) for a in METADATA_ATTRIBUTES]), F.lit("]")
    )
    return (
        metadata.select("dataset", F.struct(F.col("ordinal"), described.alias("d")).alias("c"))
        .groupBy("dataset")
        .agg(F.array_sort(F.collect_list("c")).alias("cs"))
        .select(
            "dataset",
            F.sha2(
                F.concat(
                    F.lit("["), F.array_join(F.transform("cs", lambda c: c["d"]), ","), F.lit("]")
                ),
                256,
            ).alias("schema_fingerprint"),
        )
    )


# --- provenance ----------------------------------------------------------------------
def _bad_key(key: Column) -> Column:
    return (
        key.isNull()
        | (F.size(key) == 0)
        | (F.size(F.array_distinct(key)) != F.size(key))
        | F.exists(key, lambda name: ~is_identifier(name))
    )


def _bad_fingerprint(value: Column) -> Column:
    return ~F.coalesce(value.rlike(C.FINGERPRINT), F.lit(False))


def provenance_fingerprint(runs: DataFrame) -> DataFrame:
    """``runs`` with provenance_fingerprint, or null and an error where the input is malformed.

    Columns used: source_primary_key, source_row_count, source_schema_fingerprint,
    source_dataset_fingerprint.
    """
    key, count = F.col("source_primary_key"), F.col("source_row_count")
    schema, data = F.col("source_schema_fingerprint"), F.col("source_dataset_fingerprint")
    error = (
        F.when(_bad_key(key), "INVALID_PRIMARY_KEY")
        .when(count.isNull() | (count < 0), "INVALID_ROW_COUNT")
        .when(_bad_fingerprint(schema), "INVALID_SCHEMA_FINGERPRINT")
        .when(_bad_fingerprint(data), "INVALID_DATASET_FINGERPRINT")
    )
    text = F.to_json(
        F.struct(
            F.lit(C.PROVENANCE_FORMAT_VERSION).alias("format_version"),
            data.alias("source_dataset_fingerprint"),
            key.alias("source_primary_key"),
            count.alias("source_row_count"),
            schema.alias("source_schema_fingerprint"),
        )
    )
    return runs.withColumn("provenance_error", error).withColumn(
        "provenance_fingerprint", F.when(F.col("provenance_error").isNull(), F.sha2(text, 256))
    )


# --- stored payloads ---------------------------------------------------------------
_PAYLOAD = (
    "format_version int, column_order array<string>, dtypes map<string,string>, "
    "data map<string,array<variant>>"
)
# Type tags of stored cells, per format version.
TAGS_V1 = (
    "positive_infinity", "negative_infinity", "decimal", "pandas_timestamp",
    "python_datetime", "date",
)
TAGS_V2 = (*TAGS_V1, "uuid", "raw_json")


# Any number of digits, an exponent, or one of the special values.
_DECIMAL = r"(?i)^\s*[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|s?nan[0-9]*)\s*\z"


def decode_payloads(payloads: DataFrame, tag_key: str = "__type__") -> DataFrame:
    """Stored payload texts as typed cells: payload_id, column, row, dtype, kind, text, intact, value.

    ``kind`` is the tag of a tagged cell, else the JSON type of a plain one. A version 1 payload
    has no uuid and raw_json tags, so such cells are plain JSON objects there. ``intact`` says
    whether the cell reads back as its kind and as the declared dtype. Payloads of other versions
    give one row with kind ``UNSUPPORTED_VERSION`` and no cell. ``value`` is the cell as a variant of
    its own type, null where it is not intact; a decimal of more than 38 digits stays text there.
    """
    parsed = payloads.select("payload_id", F.from_json("payload", _PAYLOAD).alias("p"))
    supported = F.col("p.format_version").isin(1, 2)
    cells = (
        parsed.select(
            "payload_id",
            F.col("p.format_version").alias("version"),
            F.col("p.dtypes").alias("dtypes"),
            F.explode_outer(F.when(supported, F.col("p.data"))).alias("column", "values"),
        )
        .select(
            "payload_id",
            "version",
            "column",
            F.col("dtypes")[F.col("column")].alias("dtype"),
            F.posexplode_outer("values").alias("row", "cell"),
        )
    )
    cell = F.col("cell")
    shape = F.schema_of_variant(cell)
    tag = F.try_variant_get(cell, f"$.{tag_key}", "string")
    known = F.when(F.col("version") == 1, tag.isin(*TAGS_V1)).otherwise(tag.isin(*TAGS_V2))
    plain = (
        F.when(F.is_variant_null(cell), "null")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BIGINT", "integer")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "number")
        .when(shape == "BOOLEAN", "boolean")
        .otherwise("string")
    )
    version_bad = F.col("version").isNull() | ~F.col("version").isin(1, 2)
    kind = F.when(version_bad, "UNSUPPORTED_VERSION").when(
        F.coalesce(known, F.lit(False)), tag
    ).otherwise(plain)
    inner = F.try_variant_get(cell, "$.value", "string")
    text = (
        F.when(F.col("kind") == "positive_infinity", "inf")
        .when(F.col("kind") == "negative_infinity", "-inf")
        .when(F.col("kind") == "raw_json", F.to_json(F.try_variant_get(cell, "$.value", "variant")))
        .when(F.col("kind").isin(*TAGS_V2), inner)
        .when(F.col("kind").isin("object", "array"), F.to_json(cell))
        .when(~F.col("kind").isin("null", "UNSUPPORTED_VERSION"), cell.cast("string"))
    )
    as_kind = (
        F.when(F.col("kind") == "decimal", F.col("text").rlike(_DECIMAL))
        .when(F.col("kind") == "date", F.col("text").try_cast("date").isNotNull())
        .when(
            F.col("kind").isin("pandas_timestamp", "python_datetime"),
            F.col("text").try_cast("timestamp").isNotNull(),
        )
        .when(
            F.col("kind") == "uuid",
            F.col("text").rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
        )
        .otherwise(F.col("kind") != "UNSUPPORTED_VERSION")
    )
    as_dtype = (
        F.when(F.col("kind") == "null", F.lit(True))
        .when(F.col("dtype") == "int64", F.col("text").try_cast("bigint").isNotNull())
        .when(F.col("dtype") == "float64", F.col("text").try_cast("double").isNotNull())
        .when(F.col("dtype") == "bool", F.col("kind") == "boolean")
        .otherwise(F.lit(True))
    )
    intact = F.coalesce(as_kind, F.lit(False)) & F.coalesce(as_dtype, F.lit(False))
    return (
        cells.withColumn("kind", kind)
        .withColumn("text", text)
        .withColumn("intact", intact)
        .select(
            "payload_id", "column", "row", "dtype", "kind", "text", "intact", _cell_value().alias("value")
        )
    )


def _cell_value() -> Column:
    """A decoded cell (cell, kind, dtype, text, intact) as a variant of its own type."""
    content = F.col("text")
    short = content.rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?$") & (F.length(content) <= 38)
    zoned = content.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    number = F.when(F.col("dtype") == "float64", content.try_cast("double").cast("variant")).otherwise(F.col("cell"))
    value = (
        F.when(F.col("kind") == "decimal", F.coalesce(F.when(short, F.try_parse_json(content)), content.cast("variant")))
        .when(F.col("kind") == "date", content.try_cast("date").cast("variant"))
        .when(
            F.col("kind").isin("pandas_timestamp", "python_datetime"),
            F.when(zoned, content.try_cast("timestamp").cast("variant")).otherwise(
                content.try_cast("timestamp_ntz").cast("variant")
            ),
        )
        .when(F.col("kind").isin("positive_infinity", "negative_infinity"), content.try_cast("double").cast("variant"))
        .when(F.col("kind") == "uuid", content.cast("variant"))
        .when(F.col("kind") == "raw_json", F.try_parse_json(content))
        .when(F.col("kind").isin("integer", "number"), number)
        .when(~F.col("kind").isin("null", "UNSUPPORTED_VERSION"), F.col("cell"))
    )
    return F.when(F.col("intact"), value)


_RESTORED = {
    "int64": "bigint", "float64": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz",
    "datetime_tz": "timestamp", "uuid": "string",
}
_FINITE = r"^\s*[+-]?0*([0-9]*)(?:[.]([0-9]*))?(?:[eE]([+-]?[0-9]+))?\s*\z"
_MOST_DIGITS = 38


def decimal_types(cells: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The type that holds every intact decimal of each column: one fold over the cells.

    It has room for the most digits before and after the point that any cell has. Where those are more than
    38 together, or a cell is infinite or not a number, it is text, so nothing is rounded or lost.
    """
    text, here = F.col("text"), F.col("intact") & (F.col("kind") != "null")
    shift = F.coalesce(F.regexp_extract(text, _FINITE, 3).try_cast("int"), F.lit(0))
    # an exponent out of range has room in no decimal either
    odd = ~text.rlike(_FINITE) | (F.abs(shift) > 2 * _MOST_DIGITS) | (F.regexp_extract(text, _FINITE, 3).rlike("[0-9]{4}"))
    before = F.length(F.regexp_extract(text, _FINITE, 1)) + F.greatest(shift, F.lit(0))
    after = F.greatest(F.length(F.regexp_extract(text, _FINITE, 2)) - shift, F.lit(0))
    folded = (
        cells.where(F.col("column").isin(*names) & here)
        .groupBy("column")
        .agg(F.max(before).alias("before"), F.max(after).alias("after"), F.bool_or(odd).alias("odd"))
        .collect()  # a row per column
    )
    found = dict.fromkeys(names, f"decimal({_MOST_DIGITS},0)")
    for row in folded:
        digits = max(row.before + row.after, 1)
        fits = not row.odd and digits <= _MOST_DIGITS
        found[row.column] = f"decimal({digits},{row.after})" if fits else "string"
    return found


def restore_rows(cells: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Decoded cells as rows again: payload_id, row, and each of ``columns`` (name, dtype) in its type.

    ``cells`` comes from ``decode_payloads``. Columns of other dtypes (object, json) are variants. A decimal
    column gets the type that holds all its cells exactly, see ``decimal_types``. Cells meet by payload and
    row, so a payload of any length is spread over all tasks.
    """
    restored = []
    decimals = [name for name, dtype in columns if dtype == "decimal"]
    sized = decimal_types(cells, decimals) if decimals else {}
    for name, dtype in columns:
        kind = sized.get(name) if dtype == "decimal" else _RESTORED.get(dtype)
        here = F.col("column") == name
        if kind is None:
            restored.append(F.first(F.when(here, F.col("value")), ignorenulls=True).alias(name))
        else:
            text = F.first(F.when(here & F.col("intact"), F.col("text")), ignorenulls=True)
            restored.append(text.try_cast(kind).alias(name))
    return cells.where(F.col("row").isNotNull()).groupBy("payload_id", "row").agg(*restored)


@exact_names
def encode_payload_cells(df: DataFrame, tag_key: str = "__type__") -> DataFrame:
    """Each column as the JSON text of its stored cells (version 2), one field per column.

    The counterpart of ``decode_payloads`` per row; a stored dataset itself is a Parquet folder.
    """
    def tagged(kind: str, text: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias(tag_key), text.alias("value")))

    def bare(kind: str) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias(tag_key)))

    encoded = []
    for field in df.schema.fields:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        listed = F.to_json(F.array(value))
        plain = F.when(value.isNotNull(), F.substring(listed, 2, F.length(listed) - 2))
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            text = (
                F.when(value == float("inf"), bare("positive_infinity"))
                .when(value == float("-inf"), bare("negative_infinity"))
                .when(~F.isnan(value), plain)
            )
        elif isinstance(field.dataType, T.DecimalType):
            text = tagged("decimal", value.cast("string"))
        elif isinstance(field.dataType, T.DateType):
            text = tagged("date", value.cast("string"))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            text = tagged("python_datetime", F.replace(value.cast("string"), F.lit(" "), F.lit("T")))
        elif field.metadata.get("logical") == "uuid":
            text = tagged("uuid", value)
        elif isinstance(field.dataType, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
            text = F.to_json(F.struct(F.lit("raw_json").alias(tag_key), value.alias("value")))
        else:
            text = plain
        encoded.append(
            F.coalesce(F.when(value.isNotNull(), text), F.lit("null")).alias(field.name)
        )
    return df.select(*encoded)
