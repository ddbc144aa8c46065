"""Observing tables: null and distinct counts, declared keys, logical types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from goldseam.constants import DATABASE_TYPE_TO_DTYPE
from goldseam.functions import cast_rules as rules
from goldseam.functions.dtypes import UnsupportedTypeError, logical_dtype
from goldseam.functions.encoding import quoted
from goldseam.session import exact_names

OBSERVED_SCHEMA = (
    "dataset string, ordinal int, column string, dtype string, "
    "null_count bigint, unique_count bigint"
)
_LONG_TEXT = 64


def canonical_json(value: Column, data_type: T.DataType) -> Column:
    """JSON text with sorted keys, so that objects equal up to key order have one text.

    Text that is not JSON stands for itself, behind a mark that no JSON text starts with.
    """
    if isinstance(data_type, T.StringType):
        return F.coalesce(
            F.to_json(F.try_parse_json(value)), F.concat(F.lit("~"), value)
        )
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    return F.to_json(F.parse_json(F.to_json(value)))


def _distinct_key(value: Column, data_type: T.DataType) -> Column:
    """What two values must share to count once; null where the value counts as null."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("bigint")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(data_type, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
        value = canonical_json(value, data_type)
    elif not isinstance(data_type, T.StringType):
        return value
    # Long text is shuffled as its digest. The mark makes digests longer than any short text.
    return F.when(
        F.octet_length(value) > _LONG_TEXT, F.concat(F.lit("#"), F.sha2(value, 256))
    ).otherwise(value)


def _lane_type(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(
        data_type, (T.StringType, T.VariantType, T.StructType, T.ArrayType, T.MapType)
    ):
        return "string"
    return data_type.simpleString()


@exact_names
def column_counts(df: DataFrame) -> DataFrame:
    """Per column position: null count (NaN included) and exact distinct count, in one scan.

    Every position has a row, also where the table is empty.

    Columns are turned into rows of (position, value), with one value field per type so that
    values keep their types. Grouping by value first lets every task fold its repeats, so a
    value that fills a third of a column leaves each task as one row. The width of a row does
    not grow with the number of columns.
    """
    fields = df.schema.fields
    lanes = {name: f"v{i}" for i, name in enumerate(dict.fromkeys(_lane_type(f.dataType) for f in fields))}
    cells = []
    for position, field in enumerate(fields):
        own = _lane_type(field.dataType)
        key = _distinct_key(quoted(field.name), field.dataType)
        cells.append(
            F.struct(
                F.lit(position).alias("ordinal"),
                *[
                    (key if lane_type == own else F.lit(None)).cast(lane_type).alias(lane)
                    for lane_type, lane in lanes.items()
                ],
            )
        )
    tall = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    names = list(lanes.values())
    per_value = tall.groupBy("ordinal", *names).agg(F.count(F.lit(1)).alias("n"))
    zeros = df.sparkSession.range(len(fields)).select(
        F.col("id").cast("int").alias("ordinal"),
        *[F.lit(None).cast(lane_type).alias(lane) for lane_type, lane in lanes.items()],
        F.lit(0).cast("bigint").alias("n"),
    )
    per_value = per_value.unionByName(zeros)
    any_value = F.lit(False)
    for name in names:
        any_value = any_value | F.col(name).isNotNull()
    return per_value.groupBy("ordinal").agg(
        F.sum(F.when(any_value, 0).otherwise(F.col("n"))).alias("null_count"),
        F.count_if(any_value).alias("unique_count"),
    )


def _observed(df: DataFrame, dataset: str, dtypes: Sequence[str]) -> DataFrame:
    def at(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ordinal") + 1)

    return column_counts(df).select(
        F.lit(dataset).alias("dataset"),
        "ordinal",
        at(df.columns).alias("column"),
        at(dtypes).alias("dtype"),
        "null_count",
        "unique_count",
    )


def observe_schema(df: DataFrame, dataset: str) -> DataFrame:
    """Order, logical type, null count and distinct count of every column."""
    return _observed(df, dataset, [logical_dtype(f) for f in df.schema.fields])


@exact_names
def observe_schema_trusted(
    df: DataFrame, dataset: str, column_types: Mapping[str, str]
) -> DataFrame:
    """As ``observe_schema``, with types from the source's own column metadata."""
    dtypes = []
    for name in df.columns:
        declared = column_types.get(name)
        if declared not in DATABASE_TYPE_TO_DTYPE:
            raise UnsupportedTypeError(f"No logical type for source type {declared!r} of {name!r}.")
        dtypes.append(DATABASE_TYPE_TO_DTYPE[declared])
    as_json = {n for n, d in zip(df.columns, dtypes, strict=True) if d == "json"}
    shaped = df.select(
        *[
            canonical_json(quoted(f.name), f.dataType).alias(f.name)
            if f.name in as_json
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )
    return _observed(shaped, dataset, dtypes)


@exact_names
def observe_nulls(df: DataFrame, dataset: str) -> DataFrame:
    """Order, logical type and null count only: no distinct count, so no shuffle of values."""
    fields = df.schema.fields
    counted = df.agg(
        *[
            F.count_if(rules.is_null(quoted(f.name), rules.source_kind(f.dataType))).alias(f"n{i}")
            for i, f in enumerate(fields)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column"),
                F.lit(logical_dtype(f)).alias("dtype"),
                F.col(f"n{i}").alias("null_count"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


@exact_names
def json_unique_count(df: DataFrame, column: str) -> DataFrame:
    """Distinct JSON values: objects equal up to key order count once."""
    field = next(f for f in df.schema.fields if f.name == column)
    value = quoted(column)
    canonical = canonical_json(value, field.dataType)
    key = F.when(
        F.octet_length(canonical) > _LONG_TEXT, F.concat(F.lit("#"), F.sha2(canonical, 256))
    ).otherwise(canonical)
    return df.agg(
        F.lit(column).alias("column"),
        F.count_if(value.isNull()).alias("null_count"),
        F.count_distinct(key).alias("unique_count"),
    )


# --- keys --------------------------------------------------------------------
def discover_keys(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Primary-key columns per table, in key order, from catalog tables.

    Joined on four columns: constraint names may repeat across tables of one schema.
    """
    on = ["constraint_name", "constraint_schema", "table_schema", "table_name"]
    primary = constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(*on).distinct()
    return (
        key_usage.join(primary, on, "inner")
        .groupBy("table_schema", "table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("k"))
        .select(
            "table_schema",
            "table_name",
            F.transform("k", lambda c: c["column_name"]).alias("primary_key"),
        )
    )


@exact_names
def key_proof(df: DataFrame, dataset: str, key: Sequence[str]) -> DataFrame:
    """Whether the declared key is unique and non-null; one row.

    Repeats of a key are folded on the map side, so a hot key costs one row per task.
    """
    null_key = F.lit(False)
    for name in key:
        null_key = null_key | quoted(name).isNull()
    keys = [quoted(name).alias(f"k{i}") for i, name in enumerate(key)]
    per_key = (
        df.select(*keys, null_key.alias("null_key"))
        .groupBy(*[f"k{i}" for i in range(len(key))], "null_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    measured = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("null_key"), F.col("n")).otherwise(0)), F.lit(0)).alias(
            "null_key_rows"
        ),
        F.coalesce(F.sum(F.when(~F.col("null_key"), F.col("n") - 1).otherwise(0)), F.lit(0)).alias(
            "surplus_rows"
        ),
    )
    return measured.select(
        F.lit(dataset).alias("dataset"),
        F.array(*[F.lit(k) for k in key]).alias("primary_key"),
        "row_count",
        "null_key_rows",
        "surplus_rows",
        ((F.col("null_key_rows") == 0) & (F.col("surplus_rows") == 0)).alias("proved"),
    )


# --- types from values and from repairs ------------------------------------------
_VALUE_TYPES = ("bool", "decimal", "datetime_tz", "datetime", "date", "json", "int64", "float64", "object")


def infer_logical_type(
    values: DataFrame, groups: Sequence[str], value: str, order: str, parsed_json: bool = True
) -> DataFrame:
    """Logical type of each group from its first non-null value, in ``order``.

    ``value`` is a variant. Spark parses the JSON number 1.5 to a decimal; JSON has no decimals, so in
    values that were parsed from JSON it counts as a double. Give ``parsed_json=False`` for variants
    that were made from typed columns. Types travel as small codes, which keeps the aggregation a
    hash one.
    """
    kind = F.schema_of_variant(quoted(value))
    names = (
        F.when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("DECIMAL"), "float64" if parsed_json else "decimal")
        .when(kind == "TIMESTAMP", "datetime_tz")
        .when(kind == "TIMESTAMP_NTZ", "datetime")
        .when(kind == "DATE", "date")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "json")
        .when(kind == "BIGINT", "int64")
        .when(kind.isin("DOUBLE", "FLOAT"), "float64")
        .otherwise("object")
    )
    codes = F.array_position(F.array(*[F.lit(n) for n in _VALUE_TYPES]), names).cast("int")
    missing = rules.is_null(quoted(value), "variant")
    return (
        values.select(
            *[quoted(g) for g in groups],
            F.when(~missing, codes).alias("code"),
            F.when(~missing, quoted(order)).alias("first"),
        )
        .groupBy(*groups)
        .agg(F.min_by("code", "first").alias("code"))
        .select(
            *groups,
            F.coalesce(
                F.element_at(F.array(*[F.lit(n) for n in _VALUE_TYPES]), F.col("code")),
                F.lit("object"),
            ).alias("dtype"),
        )
    )


def corrected_schema(corrected: DataFrame, observed: DataFrame, plans: DataFrame) -> DataFrame:
    """Logical types after a repair, many datasets at once.

    ``corrected``: dataset, ordinal, column, native_dtype, inferred_dtype; ``observed``: dataset,
    column, dtype; ``plans``: dataset, kind, column, target, applied. In order: a native type
    counts; then the target of an applied cast; then the type observed under the name the column
    had before a rename; then the inferred one.
    """
    plan = plans.select(
        "dataset",
        F.col("kind").alias("plan_kind"),
        F.col("column").alias("plan_column"),
        F.col("target").alias("plan_target"),
        F.col("applied").alias("plan_applied"),
    )
    renamed = (F.col("plan_kind") == "RENAME") & (F.col("column") == F.col("plan_target"))
    cast_done = (
        (F.col("plan_kind") == "CAST")
        & F.col("plan_applied")
        & (F.col("column") == F.col("plan_column"))
    )
    with_plan = corrected.join(plan, "dataset", "left").withColumn(
        "old_name", F.when(renamed, F.col("plan_column")).otherwise(F.col("column"))
    )
    before = observed.select(
        "dataset", F.col("column").alias("old_name"), F.col("dtype").alias("old_dtype")
    )
    return with_plan.join(before, ["dataset", "old_name"], "left").select(
        "dataset",
        "ordinal",
        "column",
        F.when(F.col("native_dtype") != "object", F.col("native_dtype"))
        .when(cast_done, F.col("plan_target"))
        .otherwise(F.coalesce("old_dtype", "inferred_dtype", F.lit("object")))
        .alias("dtype"),
    )
