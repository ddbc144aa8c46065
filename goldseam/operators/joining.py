"""Joins on keys that are often null."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_UNHASHED = (T.MapType, T.VariantType, T.ArrayType, T.StructType)


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on ``key`` that spreads the rows without a key, which match nothing, over all tasks.

    Their place in the shuffle comes from a hash of the row. For all other rows the second join
    column is zero, written so that the optimizer does not see it and drop the column.
    """
    spread = "_spread"
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    hashed = [f"`{f.name}`" for f in left.schema.fields if not isinstance(f.dataType, _UNHASHED)]
    place = F.when(F.col(key).isNull(), F.xxhash64(*hashed)).otherwise(zero)
    return (
        left.withColumn(spread, place)
        .join(right.withColumn(spread, zero), [key, spread], "left")
        .drop(spread)
    )
