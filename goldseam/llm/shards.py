"""Shuffled shards of a corpus: scatter into buckets that fit in memory, then shuffle each bucket.

Pass one scatters every record by a seeded hash into the buckets of its shard; the number of buckets of a
shard follows from its bytes, so a bucket is about BUCKET_BYTES whatever the corpus. Pass two shuffles each
bucket (Fisher-Yates, Spark's ``shuffle``) and writes it. Both passes are one Spark exchange: its map side
is the scatter to disk, its reduce side holds one bucket at a time.

The shard of a record is decided by doc_id and the number of shards alone (law ``key``): the shard whose
seeded hash with the doc_id is the highest. One more shard can only win records for itself.

Written are ``<path>/records`` (bucket, position in it, and the input's row as one struct, in folders by
shard) and ``<path>/buckets`` with the slot at which each bucket starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.llm.common import if_small

BUCKET_BYTES = 8 * 1024 * 1024
SEED = 20
LAW = "key"


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, 0 to ``shards`` - 1, whose hash with ``doc_id`` is the highest; null is a key like any other."""
    scores = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), doc_id) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Writes all rows and columns of ``docs`` (with doc_id and text) to shuffled shards at ``path``.

    Repeated rows and rows that share a doc_id are all written; those with one doc_id share its shard,
    but their bucket comes from a hash that also takes their place in the input, so that they spread
    over the buckets of the shard. A record is one struct, so no column name can clash. An empty
    table gives empty files.
    """
    sized = docs.groupBy(shard_of(F.col("doc_id"), shards, seed).alias("s")).agg(
        F.sum(size_of(F.col("text"))).alias("bytes")
    )
    held = {row["s"]: row["bytes"] for row in sized.collect()}  # a row per shard
    counts = [max(1, -(-held.get(s, 0) // BUCKET_BYTES)) for s in range(shards)]
    records = docs.select(
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
    ).withColumn("bucket", F.pmod("hash", F.array(*map(F.lit, counts))[F.col("shard")]).cast("int"))
    # in the order of hashes, so that the same seed and input shuffle to the same order again
    buckets = (
        records.repartition(sum(counts), "shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "hash")
        .groupBy("shard", "bucket")
        .agg(F.collect_list("record").alias("held"))
    )
    dealt = buckets.select(
        "shard", "bucket", F.posexplode(F.shuffle("held", seed)).alias("position", "record")
    )
    dealt.write.partitionBy("shard").parquet(f"{path}/records")
    _write_starts(docs.sparkSession, path)


def _write_starts(spark: SparkSession, path: str) -> None:
    """Per bucket the slot of its first record: a row per bucket, summed within each shard."""
    records = spark.read.schema("bucket int, shard int").parquet(f"{path}/records")
    counts = records.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts.select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    ).write.parquet(f"{path}/buckets")


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(shard, slot, record) of all written rows; slots count from 0 within a shard, without gaps.

    ``schema`` is that of the written rows; ``record`` has their columns.
    """
    stored = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("position", T.IntegerType()),
            T.StructField("record", schema),
            T.StructField("shard", T.IntegerType()),
        ]
    )
    records = spark.read.schema(stored).parquet(f"{path}/records")
    starts = spark.read.schema("shard int, bucket int, start long").parquet(f"{path}/buckets")
    return records.join(if_small(starts, 16), ["shard", "bucket"]).select(
        "shard", (F.col("start") + F.col("position")).alias("slot"), "record"
    )
