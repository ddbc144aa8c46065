"""Near-duplicates by SimHash, searched with an inverted index over the bytes of the fingerprints.

Two fingerprints with at most three differing bits have at least five of their eight bytes in common,
byte by byte. One posting list per (position, byte value) would hold a 256th of everything, so the lists
here are of four positions at once: the fourteen sets {a, b, c, d} of positions with a ^ b ^ c ^ d = 0 hold
every three positions once, and with a set its complement. So for any three positions that may differ
one of the fourteen sets avoids them all, and the pair meets in that list. Within a list the bytes that a
pair shares are tallied, pairs with five or more are kept, and their bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import fresh, staged
from goldseam.llm.components import components

BITS, BYTES = 64, 8
MAX_DIFFERENT_BITS = 3
SEED = 42
#: Longer posting lists are split by further half bytes; what results cannot be longer than this.
LIST_LIMIT = 1 << 16

#: The fourteen sets of four places of eight, any three of which lie in exactly one set.
FOURS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of one text: a bit is 1 if it is 1 in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        runs = zip(*(words[i:] for i in range(words_per_shingle)), strict=False)
        shingles = map(b" ".join, runs)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row: the fingerprint as a signed long; zero for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "fp"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def byte_masks() -> list[int]:
    """For each of the fourteen sets the 64-bit mask of its four bytes."""
    return [sum(0xFF << (8 * p) for p in four) for four in FOURS]


def half_byte_masks(four: tuple[int, ...]) -> list[int]:
    """For one set of bytes, masks that add four of the eight half bytes outside it: sixteen bits stay free."""
    free = [4 * h for p in range(8) if p not in four for h in (2 * p, 2 * p + 1)]
    inside = sum(0xFF << (8 * p) for p in four)
    return [inside | sum(0xF << free[i] for i in pick) for pick in FOURS]


def near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` are within three bits: first the tally of equal bytes, then the bits of the rest."""
    xor = others ^ one
    shared = (xor.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    close = shared >= BYTES - MAX_DIFFERENT_BITS
    close[close] = np.bitwise_count(xor[close]) <= MAX_DIFFERENT_BITS
    return close


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, first of its component) that connect what is near within one list.

    Every fingerprint is compared with those that nothing has reached yet, so a dense list, most of
    which the first one reaches, costs about its length.
    """
    links = []
    rest = np.sort(fps)
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            close = near(frontier.pop(), rest)
            reached, rest = rest[close], rest[~close]
            frontier.extend(reached)
            links.extend((int(x), int(root)) for x in reached.view(np.int64))
    return [(a, int(np.uint64(b).view(np.int64))) for a, b in links]


def _links(lists: DataFrame) -> DataFrame:
    """Links within posting lists (rows of array ``fps``, none longer than LIST_LIMIT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps"):
                members = np.array(fps.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                for x, y in spanning_links(members):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return lists.select("fps").mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between the different fingerprints ``fp`` to connect all that are near.

    A posting list that is longer than LIST_LIMIT is dealt out again by the half bytes outside its four
    bytes: three differing bits touch at most three of the eight, so the same fourteen sets serve,
    and lists of 48 fixed bits hold 65,536 different fingerprints at most. So no list is unbounded and
    no pair is lost.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in byte_masks()])
    keyed = distinct.select("fp", F.posexplode(masks).alias("q", "mask")).select(
        "q", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp"
    )
    # counted before anything is gathered; on ordinary data no list is over the limit
    hot = staged(
        keyed.groupBy("q", "k").count().where(F.col("count") > LIST_LIMIT).select("q", "k"),
        "simhash-long-lists",
    )
    gathered = keyed
    if not hot.isEmpty():
        finer = F.array(
            *[F.array(*[F.lit(_signed(m)) for m in half_byte_masks(four)]) for four in FOURS]
        )
        split = (
            keyed.join(hot, ["q", "k"], "left_semi")
            .select("q", "fp", F.posexplode(finer[F.col("q")]).alias("h", "mask"))
            .select(
                (F.lit(len(FOURS)) * (F.col("q") + 1) + F.col("h")).alias("q"),
                F.col("fp").bitwiseAND(F.col("mask")).alias("k"),
                "fp",
            )
        )
        gathered = keyed.join(hot, ["q", "k"], "left_anti").union(split)
    lists = gathered.groupBy("q", "k").agg(F.collect_list("fp").alias("fps"))
    return _links(lists.where(F.size("fps") > 1))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id of the component.

    Fingerprints that differ in three bits or fewer are linked, and links are followed. Texts without
    words have fingerprint zero and are linked like any other. Rows with one fingerprint (copies,
    repeated rows) are one node; they meet again only in aggregates and joins that split hot keys.
    A null doc_id stays null and counts only if a component has no other id: its component_id is null.
    An empty table gives an empty table; other columns are not read.
    """
    rows = staged(with_fingerprints(docs, words_per_shingle), "simhash-fingerprints")
    return rows.join(component_ids(rows).drop("root"), "fp")


def component_ids(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every different fingerprint of ``rows``; root names its component."""
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(fingerprint_links(distinct.select("fp")), "simhash-components")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: its smallest doc_id.

    Rows that share that doc_id (repeated rows) are told apart by their place in the written copy of
    ``docs``: one stays. If a component has only null ids, one of its rows stays.
    """
    names = docs.columns
    place, fp = fresh(names, "_place"), fresh([*names, "_place"], "_fp")
    copy = staged(docs.withColumn(place, F.monotonically_increasing_id()), "simhash-input")
    prints = with_fingerprints(copy.select(F.col(place).alias("doc_id"), "text"), words_per_shingle)
    prints = staged(prints.select(F.col("doc_id").alias(place), F.col("fp").alias(fp)), "simhash-places")
    known = copy.select(place, "doc_id").join(prints, place)
    groups = component_ids(known.select("doc_id", F.col(fp).alias("fp")))
    first = (
        known.join(groups.withColumnRenamed("fp", fp), fp)
        .where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
        .groupBy("root")  # rows of one doc_id may be in different components
        .agg(F.min(place).alias(place))
        .select(place)
    )
    return copy.join(first, place, "left_semi").select(*names)
