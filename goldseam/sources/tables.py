"""Reading tables, their column metadata, and the complete trusted read."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from goldseam.constants import DTYPE_TO_DATABASE_TYPE, IDENTIFIER
from goldseam.functions.dtypes import logical_dtype
from goldseam.operators.fingerprint import dataset_fingerprint, schema_fingerprint
from goldseam.operators.profile import key_proof


class InvalidIdentifierError(ValueError):
    """A table, schema, column or target name that must not reach SQL text."""


def require_identifier(name: str, kind: str) -> str:
    if not re.fullmatch(IDENTIFIER.removeprefix("^").removesuffix(r"\z"), name):
        raise InvalidIdentifierError(f"Invalid {kind}: {name!r}.")
    return name


def fetch_table(
    spark: SparkSession,
    table: str,
    *,
    path: str | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """A whole table: from Parquet files, from a database, or from the catalog.

    ``jdbc`` takes Spark's reader options (url, driver, user, ...). For a large table give
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` as well, so that the
    read is split over executors.
    """
    if path is not None:
        return spark.read.parquet(f"{path.rstrip('/')}/{table}.parquet")
    for part in table.split("."):
        require_identifier(part, "table name")
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc, dbtable=table).load()
    return spark.table(table)


_METADATA_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("numeric_precision", T.IntegerType()),
        T.StructField("numeric_scale", T.IntegerType()),
        T.StructField("datetime_precision", T.IntegerType()),
        T.StructField("is_nullable", T.StringType()),
        T.StructField("character_maximum_length", T.IntegerType()),
        T.StructField("udt_schema", T.StringType()),
        T.StructField("udt_name", T.StringType()),
        T.StructField("domain_schema", T.StringType()),
        T.StructField("domain_name", T.StringType()),
        T.StructField("collation_name", T.StringType()),
    ]
)
# Bits or digits of the types that have a fixed precision.
_PRECISION = {"byte": (8, 0), "short": (16, 0), "integer": (32, 0), "long": (64, 0),
              "float": (24, None), "double": (53, None)}


def column_metadata(df: DataFrame, dataset: str) -> DataFrame:
    """Twelve attributes per column, in order, from the Spark schema."""
    rows = []
    for ordinal, field in enumerate(df.schema.fields):
        kind = field.dataType
        precision, scale = _PRECISION.get(kind.typeName(), (None, None))
        if isinstance(kind, T.DecimalType):
            precision, scale = kind.precision, kind.scale
        timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
        sized = isinstance(kind, (T.VarcharType, T.CharType))
        rows.append(
            (
                dataset,
                ordinal,
                field.name,
                DTYPE_TO_DATABASE_TYPE[logical_dtype(field)],
                precision,
                scale,
                6 if timed else 0 if isinstance(kind, T.DateType) else None,
                "YES" if field.nullable else "NO",
                kind.length if sized else None,
                "spark",
                kind.simpleString(),
                None,
                None,
                None,
            )
        )
    return df.sparkSession.createDataFrame(rows, _METADATA_SCHEMA)


class SourceChanged(RuntimeError):
    """A file of the source was replaced, changed or removed while it was read."""


def file_states(df: DataFrame) -> DataFrame | None:
    """(path, modificationTime, length) of the files behind ``df`` as they are now; None if it has none.

    Spark lists them, as tasks if they are many; no content is read. The list of files is the one
    that ``df`` fixed when it was made.
    """
    files = df.inputFiles()
    if not files:
        return None
    # paths are names here, not patterns
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in files]
    states = df.sparkSession.read.format("binaryFile").load(paths)
    return states.select("path", "modificationTime", "length")


def file_list_print(df: DataFrame) -> tuple[int, str] | None:
    """Number and fingerprint of ``file_states``, folded in the tasks; None if ``df`` has no files.

    A file that is gone makes the listing fail, which is a change as well.
    """
    try:
        states = file_states(df)
        return None if states is None else tuple(dataset_fingerprint(states, "files").first()[1:])
    except Exception as error:
        raise SourceChanged("SOURCE_CHANGED_DURING_READ") from error


def consistent_read(df: DataFrame, dataset: str, key: Sequence[str]) -> Row:
    """The row of ``trusted_read``, if no file changed from before its first scan until after its last.

    Both scans read the file list that ``df`` fixed. Lengths and times of these files are taken before
    and after; a file that was replaced in between, even by one with as many rows, refuses the read.
    Sources without files (a database, rows in memory) are held to equal counts alone, as in ``trusted_read``.
    """
    before = file_list_print(df)
    read = trusted_read(df, dataset, key).first()
    if before != file_list_print(df):
        raise SourceChanged("SOURCE_CHANGED_DURING_READ")
    return read


def trusted_read(df: DataFrame, dataset: str, key: Sequence[str]) -> DataFrame:
    """The evidence of one complete read, one row: key, proof, count and both fingerprints.

    Count and data fingerprint come from one aggregate over the scan. Only the key proof shuffles,
    and it reads the key columns alone. If the two scans do not count the same rows, the table changed
    in between, and the read fails.
    """
    parts = [
        key_proof(df, dataset, key).select(
            "dataset", "primary_key", F.col("proved").alias("key_proved"), F.col("row_count").alias("key_rows")
        ),
        schema_fingerprint(column_metadata(df, dataset)),
        dataset_fingerprint(df, dataset),
    ]
    facts = ("primary_key", "key_proved", "key_rows", "row_count", "schema_fingerprint", "data_fingerprint")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    read = rows.groupBy("dataset").agg(*[F.first(f, ignorenulls=True).alias(f) for f in facts])
    counted = F.when(F.col("key_rows") == F.col("row_count"), F.col("row_count")).otherwise(
        F.raise_error(F.lit("SOURCE_CHANGED_DURING_READ"))
    )
    return read.withColumn("row_count", counted).drop("key_rows")
