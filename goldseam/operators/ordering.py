"""Rows in the order of a key and of what follows it, in pieces of about equal size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from goldseam.session import shared_folder


def in_pieces(df: DataFrame, key: str, order: Sequence[str], piece: str, purpose: str) -> DataFrame:
    """``df`` with a column ``piece``: pieces ascend with (key, order) and hold about equally many rows.

    The borders come from a sample of all sort columns, so a key with a third of all rows, even at one
    moment, is spread over as many pieces as its size calls for. Only rows equal in every sort column
    stay together. A window by (key, piece) sorts one piece of a key; what must pass from one piece to
    the next is a row per key and piece. The rows are written, as another run over them might sample
    other borders.
    """
    path = shared_folder(df.sparkSession, purpose)
    ranged = df.repartitionByRange(key, *order).withColumn(piece, F.spark_partition_id())
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)
