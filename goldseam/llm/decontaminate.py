"""Benchmark items inside documents: size-partitioned MinHash search, then exact containment.

A shingle is five words in a row, lower-cased, joined by spaces (a word is a run of letters, digits and
underscores). An item of n different shingles is contained if a document has at least 80 % of them.

Items are partitioned by n into classes [2^c, 2^(c+1)). The MinHash signature of an item is its m smallest
shingle hashes, with m for the upper end of the class: at most a fifth of the shingles may be missing, so
of any floor(n/5) + 1 at least one is in the document, and no contained item is missed. Documents are
probed against the signatures of all classes through a bit array of fixed size; only documents that meet
one hand on the shingles they share with items. Those are compared as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import fresh, if_small, staged

SHINGLE_WORDS = 5
CONTAINMENT_PERCENT = 80
#: Bits of the array that documents are probed against. It is 2 MB whatever the benchmark's size; a
#: fuller array lets more documents through to the join, and none is missed.
PROBE_BITS = 1 << 24
REMEMBERED_WORDS = 500_000

_WORD = re.compile(r"\w+")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_words_known: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of all five-word shingles, in order; empty if there are fewer words."""
    if len(words) < SHINGLE_WORDS:
        return np.empty(0, np.uint64)
    if len(_words_known) > REMEMBERED_WORDS:
        _words_known.clear()
    for word in set(words):
        if word not in _words_known:
            _words_known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    each = np.fromiter(map(_words_known.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE_WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for i, m in enumerate(_MULTIPLIERS):
        mixed += (each[i : i + n] ^ (each[i : i + n] >> np.uint64(31))) * np.uint64(m)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def signature_size(n: int) -> int:
    """Smallest hashes in the signature of an item with n shingles: by the upper end of its size class."""
    upper = (1 << n.bit_length()) - 1
    return upper * (100 - CONTAINMENT_PERCENT) // 100 + 1


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n_item, hash, shingle, in_signature): the different shingles of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(
                batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                words = words_of(text)
                hashes = shingle_hashes(words).view(np.int64).tolist()
                own = {h: " ".join(words[i : i + SHINGLE_WORDS]) for i, h in enumerate(hashes)}
                smallest = sorted(own)[: signature_size(len(own))]
                rows += [(item, len(own), h, s, h <= smallest[-1]) for h, s in own.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["item_id", "n_item", "hash", "shingle", "in_signature"],
            )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, n_item long, hash long, shingle string, in_signature boolean"
    )


def _probe_array(hashes: DataFrame) -> np.ndarray:
    """The bit array of the given hashes, two bits each, folded per 64-bit word before it is fetched."""
    bits = hashes.select(
        F.explode(
            F.array(
                F.col("hash").bitwiseAND(F.lit(PROBE_BITS - 1)),
                F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(PROBE_BITS - 1)),
            )
        ).alias("bit")
    )
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("word")
    )
    array = np.zeros(PROBE_BITS // 64, np.int64)
    for at, word in words.toLocalIterator():  # at most PROBE_BITS / 64 rows
        array[at] = word
    return array.view(np.uint64)


def _test(array: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = np.uint64(PROBE_BITS - 1)
    six, sixty_three, one = np.uint64(6), np.uint64(63), np.uint64(1)
    first, second = hashes & low, (hashes >> np.uint64(32)) & low
    hit = (array[(first >> six).astype(np.int64)] >> (first & sixty_three)) & one
    return (hit & (array[(second >> six).astype(np.int64)] >> (second & sixty_three)) & one) != 0


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, n_shared, n_item, containment) for every item contained in a row of ``docs``.

    ``row`` tells rows of one doc_id apart. n_shared counts the item's different shingles that the text
    has, containment is n_shared / n_item. Null and empty texts, texts and items of fewer than five
    words have no shingle and match nothing. Repeated documents and repeated items are all reported;
    null ids stay null. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    place = "_copy"
    own = staged(
        item_shingles(
            items.select(F.monotonically_increasing_id().alias("item_id"), "text")
        ).withColumnRenamed("item_id", place),
        "benchmark-shingles",
    )
    names = staged(
        items.select(F.monotonically_increasing_id().alias(place), F.col("item_id").cast("long")),
        "benchmark-items",
    )
    probes = spark.sparkContext.broadcast(
        (_probe_array(own.where("in_signature").select("hash")), _probe_array(own.select("hash")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, shared = probes.value
        base = TaskContext.get().partitionId() << 33
        seen = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text"), strict=True
            ):
                seen += 1
                words = words_of(text.as_py())
                hashes = shingle_hashes(words)
                if not len(hashes) or not _test(signatures, hashes).any():
                    continue
                hits = np.flatnonzero(_test(shared, hashes)).tolist()
                found = {" ".join(words[i : i + SHINGLE_WORDS]): i for i in hits}
                signed = hashes.view(np.int64)
                rows += [(base + seen, doc_id, int(signed[i]), s) for s, i in found.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["row", "doc_id", "hash", "shingle"],
            )

    hits = docs.select("doc_id", "text").mapInArrow(
        run, "row long, doc_id long, hash long, shingle string"
    )
    matched = hits.join(if_small(own, 200), ["hash", "shingle"])
    counted = (
        matched.groupBy("row", "doc_id", place)
        .agg(
            F.count("*").alias("n_shared"),
            F.first("n_item").alias("n_item"),
            F.max("in_signature").alias("candidate"),
        )
        .where(F.col("candidate") & (F.col("n_shared") * 100 >= F.col("n_item") * CONTAINMENT_PERCENT))
    )
    return counted.join(if_small(names, 24), place).select(
        "row", "doc_id", "item_id", "n_shared", "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item.

    Whether it does depends on the text alone, so rows go by a hash of their text, and all rows of a
    text go or stay together.
    """
    names = docs.columns
    place = fresh(names, "_text_hash")
    copy = docs.withColumn(place, F.xxhash64(F.lit(4), "text"))
    found = find_items(copy.select(F.col(place).alias("doc_id"), "text"), items)
    bad = staged(found.select(F.col("doc_id").alias(place)).distinct(), "contaminated-texts")
    return copy.join(if_small(bad, 16), place, "left_anti").select(*names)
