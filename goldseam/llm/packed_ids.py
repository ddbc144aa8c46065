"""Token ids as fixed-width bit fields in blocks: written in document order, read back block by block.

File format: a Parquet table ``<path>/blocks`` with one row per block,

    shard, block        place in document order (shard by shard, block by block)
    width               bits of an id: the fewest that hold vocabulary size - 1
    first_id            ids of the same shard before this block
    n_ids               ids in the block
    doc_ids, n_tokens   the documents of the block in order, and how many ids each has
    payload             the ids, ``width`` bits each, most significant bit first, zero bits at the end

and ``<path>/shards`` with the ids that precede each shard. A block holds whole documents and is closed
at ``BLOCK_IDS`` ids, so document j of a block lies at bits ``width * sum(n_tokens[:j])`` and can be
unpacked alone, and Parquet's statistics lead to the rows of a shard and block. Any store that Spark
reads will do.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldseam.llm.pretokens import PreTokenizer, byte_symbols, tokenizer

BLOCK_IDS = 1 << 16
#: Words of one of the two generations that a worker keeps.
REMEMBERED_WORDS = 500_000
_BLOCK_SCHEMA = (
    "shard int, block int, width int, first_id long, n_ids long,"
    " doc_ids array<long>, n_tokens array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``, one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits of each id behind one another, most significant first."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id needs more bits than the vocabulary has")
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.reshape(-1)).tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block, without reading the others."""
    if width == 16:
        return np.frombuffer(payload, ">u2", count, start * 2).astype("<u4")
    first = start * width // 8
    last = -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first))
    skip = start * width - first * 8
    fields = bits[skip : skip + count * width].reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, 32 - width :] = fields
    return np.packbits(full, axis=1).view(">u4").reshape(-1).astype("<u4")


class Words:
    """Ids of pre-tokens, as bytes; each is made by the library once and kept while it recurs.

    Two generations: when the newer is full it becomes the older, and a word found there moves up
    again, so frequent words are never made anew.
    """

    def __init__(self, name: str) -> None:
        self.pre = PreTokenizer(name)
        self.library = tokenizer(name)[0]
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.symbols = dict(enumerate(byte_symbols()))

    def made(self, words: list[str]) -> list[bytes]:
        """Ids by the library: byte-level words go to its model, which takes printable symbols for bytes."""
        if self.pre.by_word:
            codes = ([*e.ids] for e in self.library.encode_batch_fast(words, add_special_tokens=False))
        else:
            tokenize, symbols = self.library.model.tokenize, self.symbols
            codes = ([t.id for t in tokenize(w.encode().decode("latin-1").translate(symbols))] for w in words)
        return [array("I", ids).tobytes() for ids in codes]

    def codes(self, words: list[str]) -> Iterator[bytes]:
        if len(self.newer) > REMEMBERED_WORDS:
            self.older, self.newer = self.newer, {}
        missing = set(words).difference(self.newer)
        new = []
        for word in missing:
            code = self.older.get(word)
            if code is None:
                new.append(word)
            else:
                self.newer[word] = code
        if new:
            self.newer.update(zip(new, self.made(new), strict=True))
        return map(self.newer.__getitem__, words)


@lru_cache(maxsize=2)
def _words(name: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(name)


def encode_ids(text: str | None, name: str) -> np.ndarray:
    """Ids of a whole text, as little-endian unsigned 32-bit integers."""
    words = _words(name)
    parts: list[bytes] = []
    for segment in words.pre.segments(text or ""):
        if segment in words.pre.special:
            parts.append(np.uint32(words.pre.special[segment]).tobytes())
        else:
            parts.extend(words.codes(words.pre.split(segment)))
    return np.frombuffer(b"".join(parts), "<u4")


def vocabulary_size(name: str) -> int:
    return tokenizer(name)[0].get_vocab_size(with_added_tokens=True)


def write_packed(
    docs: DataFrame, path: str, name: str, end_id: int, partitions: int | None = None
) -> None:
    """Encodes every text, appends ``end_id``, and writes the ids to ``path`` in ascending doc_id order.

    Null texts count as empty and so have only the end id; null doc_ids come first. Rows that share a
    doc_id are all written, in an order made of their text and a seeded number, so that even one
    doc_id with a third of the rows is spread by the range partitioning. Other columns are not read.
    A task holds one block and one Arrow batch. An empty table gives an empty file.
    """
    width = bits_for(vocabulary_size(name))
    spark = docs.sparkSession
    count = partitions or max(docs.rdd.getNumPartitions(), 1)
    tie, place = "_tie", "_place"
    ordered = (
        docs.select("doc_id", "text")
        .withColumn(tie, F.xxhash64("text"))
        .withColumn(place, F.rand(10))
        .repartitionByRange(count, "doc_id", tie, place)
        .sortWithinPartitions("doc_id", tie, place)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        docs_in: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(arrays)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([state["block"]], pa.int32()),
                    pa.array([width], pa.int32()),
                    pa.array([state["first"]], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([docs_in], pa.list_(pa.int64())),
                    pa.array([[len(a) for a in arrays]], pa.list_(pa.int64())),
                    pa.array([pack(ids, width)], pa.binary()),
                ],
                names=["shard", "block", "width", "first_id", "n_ids", "doc_ids", "n_tokens", "payload"],
            )
            state["block"] += 1
            state["first"] += len(ids)
            return row

        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids_of, batch.column("text"), strict=True):
                ids = np.concatenate([encode_ids(text.as_py(), name), end])
                docs_in.append(doc_id)
                arrays.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield close()
                    docs_in, arrays, held = [], [], 0
        if arrays:
            yield close()

    blocks = ordered.mapInArrow(run, _BLOCK_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    totals = (
        spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
        .groupBy("shard")
        .agg(F.sum("n_ids").alias("ids"))
    )
    # one row per written partition, not per document
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select(
        "shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start")
    ).write.parquet(f"{path}/shards")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``path``.

    start counts the ids of all documents before it; ids_crc32 is over the ids as little-endian
    unsigned 32-bit integers. A block is unpacked in one numpy step, then cut into documents.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")
    placed = blocks.join(F.broadcast(shards), "shard")  # a row per partition of the write

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"])
                sizes = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begin = ends - sizes
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begin + row["first_id"] + row["shard_start"], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select(
        "width", "first_id", "n_ids", "doc_ids", "n_tokens", "payload", "shard_start"
    ).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) for the documents named in ``doc_ids``: random access through the block index."""
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    listed = blocks.select(
        "shard", "block", F.posexplode("doc_ids").alias("at", "doc_id"), "n_tokens"
    ).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    spans = listed.select(
        "shard", "block", "doc_id",
        F.expr("aggregate(slice(n_tokens, 1, at), 0L, (s, x) -> s + x)").alias("begin"),
        F.expr("n_tokens[at]").alias("size"),
    )
    found = spans.join(blocks.select("shard", "block", "width", "payload"), ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], row["begin"], row["size"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))],
                    names=["doc_id", "ids"],
                )

    return found.select("doc_id", "width", "begin", "size", "payload").mapInArrow(
        run, "doc_id long, ids array<long>"
    )
