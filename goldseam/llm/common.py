"""What several operators share: written intermediate tables, joins of checked size, column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldseam.session import shared_folder

#: Rows of at most this many bytes in all are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24 * 1024 * 1024

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the folders that ``staged`` writes meanwhile, for ``dropped`` once nothing reads them."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [p for p in _recording if p is not paths]  # lists of equal content are not one list


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written intermediate tables; the caller knows that no DataFrame reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting while the block runs; the caller's own is restored afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written once to the shared folder and read back: a cut of the lineage that survives executors.

    Shuffle files of the rows are not needed any more then, and do not wait for the driver's garbage collection.
    ``options`` are more options of the Parquet writer.
    """
    path = shared_folder(df.sparkSession, purpose)
    for paths in _recording:
        paths.append(path)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**{"compression": "zstd", **(options or {})}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small`` (a written table, so that counting is cheap) with a broadcast hint if its counted size allows."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def fresh(taken: list[str], name: str) -> str:
    """``name``, or with underscores appended until no column has it, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocked_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: int = 4096
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in the order of ``order``, as column ``out``.

    The first order column is a long without nulls. A plain window would put a whole key into one task.
    Here rows are summed per (key, block of values of that column); only block totals of a key meet in
    one window, and inside a block a window sees the rows of ``block`` consecutive values.
    """
    b, base, own = (fresh([*df.columns, out], x) for x in ("_block", "_base", "_own"))
    cut = df.withColumn(b, F.floor(F.col(order[0]) / F.lit(block)))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, b).agg(F.sum(value).alias(own))
    totals = totals.withColumn(base, F.coalesce(F.sum(own).over(before), F.lit(0))).drop(own)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn(own, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    s, t = summed.alias("s"), totals.alias("t")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, b)]
    return s.join(t, same, "inner").select(
        *[F.col(f"s.{c}") for c in df.columns], (F.col(f"s.{own}") + F.col(f"t.{base}")).alias(out)
    )
