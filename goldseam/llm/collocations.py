"""Phrase collocations by set-oriented mining (SETM): sorted occurrence relations, extended length by length.

An occurrence relation R_k says which frequent phrase of k words begins at which position. It is kept as
written blocks: a block holds the occurrences of some whole documents of one language, sorted by position;
positions count words and piece borders alike, so that two words are adjacent only within a piece. They are
written as distances from one to the next, which are small.

A step from R_k to longer phrases has four parts. The relation is merged with itself one position on: where a
frequent phrase begins at p and another at p + 1, a longer one begins at p (both parts of a frequent phrase
are frequent, so none is lost). Each block folds its occurrences into its different candidates. Those are
shuffled once, to be counted over all blocks; what is not frequent goes, and the rest is numbered, all
copies of a candidate by the first. This semi-join leaves R_(k+1), which is written, sorted as before.

What is shuffled are different candidates of a block, never occurrences; a phrase that fills a third of a
language is one row of each block. The plan is the same at every size, and nothing is broadcast by hint.

A block is a row of some MB, so what holds rows by the thousand elsewhere holds one block here, however many a
task has: every block is written as a row group of its own, blocks are read and sent to Python one by one, and
a block's candidates are rows, exploded without zipping lists and grouped by sorting, never lists of objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import dropped, recorded, setting, staged

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE = 2_000_000
#: A phrase goes if a longer candidate has this many percent of its occurrences.
COVERED = 80
NO_LANG = "und"
#: A block ends with the document that brings it to so many words.
BLOCK_WORDS = 1 << 20
#: An entry of a block is numbered over all blocks: the block's number, then that many bits of its own.
_ENTRY_BITS, _BLOCKS_BITS = 31, 12

#: Every written block is a row group: a reader holds the rows of a row group side by side, thousands at once.
_BLOCK_FILES = {"parquet.block.row.count.limit": "1"}
#: What goes to Python goes in batches that end with the row that brings them to so many bytes, so a block goes
#: alone; and so many rows of a file, documents for one, are read at once.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "256"}

_BORDER = b"."
#: A-Z to a-z, all that ends a piece to the border sign, tab to space.
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _BORDER * 9 + b" "
)


class _Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


class _Block:
    """Documents of one language while they are read."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.numbers[_BORDER] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(_PLAIN).replace(_BORDER, b" . ").split()
        words.append(_BORDER)  # the next document is another piece
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> dict:
        ids = np.concatenate(self.parts) - 1  # borders are -1
        spelled = list(self.numbers)[1:]
        return {
            "ids": ids,
            "words": [w.decode("utf-8") for w in spelled],
            "counts": np.bincount(ids[ids >= 0], minlength=len(spelled)),
        }


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    return pa.array(arrays, pa.list_(kind))


def word_blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, ids, words, counts): all words in blocks, in order; ids index the block's words, -1 is a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[str, _Block] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            row = open_blocks.pop(lang).row()
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << _BLOCKS_BITS) + made], pa.int64()),
                    pa.array([lang]),
                    _lists([row["ids"]], pa.int32()),
                    _lists([row["words"]], pa.string()),
                    _lists([row["counts"]], pa.int64()),
                ],
                names=["block", "lang", "ids", "words", "counts"],
            )

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                block = open_blocks.setdefault(lang.as_py(), _Block())
                before = block.size
                block.add(text.as_py())
                held += block.size - before
                # a full block goes; and the fullest, when several languages together hold as much as two
                if block.size >= BLOCK_WORDS or held >= 2 * BLOCK_WORDS:
                    fullest = max(open_blocks, key=lambda name: open_blocks[name].size)
                    held -= open_blocks[fullest].size
                    yield closed(fullest)
        for lang in list(open_blocks):
            yield closed(lang)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    plain = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), text)
    return plain.mapInArrow(
        run,
        "block long, lang string, ids array<int>, words array<string>, counts array<long>",
    )


def _numpy(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _gaps(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0).astype(np.int32)


def _kept_occurrences(blocks: DataFrame, kept: DataFrame, purpose: str) -> DataFrame:
    """R_k: (block, lang, gaps, local, phrases) of the occurrences whose candidate is frequent.

    ``kept`` has (entry, phrase) of the candidates that stay. ``phrases`` numbers the block's phrases
    for all blocks, ``local`` indexes it. ``blocks`` without gaps have an entry for every position.
    """
    dense = "gaps" not in blocks.columns
    own = ["block", "lang", "ids"] + ([] if dense else ["gaps"])
    own_id = F.col("entry").bitwiseAND(F.lit((1 << _ENTRY_BITS) - 1)).cast("int").alias("id")
    rows = kept.select(F.shiftright("entry", _ENTRY_BITS).alias("block"), own_id, "phrase")
    columns = {
        "block": pa.int64(),
        "lang": pa.string(),
        "gaps": pa.list_(pa.int32()),
        "local": pa.list_(pa.int32()),
        "phrases": pa.list_(pa.int64()),
    }

    def run(block: pa.Table, entries: pa.Table) -> pa.Table:
        made = []
        if entries.num_rows:
            old, phrases = entries.column("id").to_numpy(), entries.column("phrase").to_numpy()
            order = np.argsort(old)
            old, phrases = old[order], phrases[order]
            for batch in block.to_batches():
                for i in range(batch.num_rows):
                    ids = _numpy(batch.column("ids"), i)
                    new = np.full(int(ids.max()) + 2, -1, np.int32)  # the last entry is for borders
                    new[old] = np.arange(len(old), dtype=np.int32)
                    local = new[ids]
                    frequent = np.flatnonzero(local >= 0)
                    places = frequent if dense else np.cumsum(_numpy(batch.column("gaps"), i))[frequent]
                    made.append(
                        pa.RecordBatch.from_arrays(
                            [
                                batch.column("block").slice(i, 1),
                                batch.column("lang").slice(i, 1),
                                _lists([_gaps(places)], pa.int32()),
                                _lists([local[frequent]], pa.int32()),
                                _lists([phrases], pa.int64()),
                            ],
                            names=list(columns),
                        )
                    )
        return pa.Table.from_batches(made, pa.schema(columns))

    schema = "block long, lang string, gaps array<int>, local array<int>, phrases array<long>"
    met = blocks.select(*own).groupBy("block").cogroup(rows.groupBy("block"))
    return staged(met.applyInArrow(run, schema), purpose, _BLOCK_FILES)


def _extended(occurrences: DataFrame, purpose: str) -> DataFrame:
    """(block, lang, gaps, ids, head, tail, counts): R_k merged with itself one position on.

    A candidate is (head, tail): the phrases without its last and without its first word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gaps, local = _numpy(batch.column("gaps"), i), _numpy(batch.column("local"), i)
                phrases = _numpy(batch.column("phrases"), i)
                # both sides are sorted by position, so the merge looks at neighbours only
                begins = np.flatnonzero(gaps[1:] == 1)
                pairs = local[begins].astype(np.int64) * len(phrases) + local[begins + 1]
                different, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
                if not len(different):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(i, 1),
                        batch.column("lang").slice(i, 1),
                        _lists([_gaps(np.cumsum(gaps)[begins])], pa.int32()),
                        _lists([ids.astype(np.int32)], pa.int32()),
                        _lists([phrases[different // len(phrases)]], pa.int64()),
                        _lists([phrases[different % len(phrases)]], pa.int64()),
                        _lists([counts], pa.int64()),
                    ],
                    names=["block", "lang", "gaps", "ids", "head", "tail", "counts"],
                )

    schema = (
        "block long, lang string, gaps array<int>, ids array<int>,"
        " head array<long>, tail array<long>, counts array<long>"
    )
    return staged(occurrences.mapInArrow(run, schema), purpose, _BLOCK_FILES)


def _entries(blocks: DataFrame, names: list[str], carried: list[str]) -> DataFrame:
    """(carried..., names..., count, entry): the different candidates of every block as rows.

    One list is exploded and the others are looked up in place; zipped they would be an object for every entry.
    """
    first, *others = names
    rows = blocks.select("block", *carried, *others, "counts", F.posexplode(first).alias("id", first))
    entry = F.shiftleft(F.col("block"), _ENTRY_BITS) + F.col("id")
    own = [F.col(first), *[F.get(n, "id").alias(n) for n in others]]
    return rows.select(*carried, *own, F.get("counts", "id").alias("count"), entry.alias("entry"))


def _frequent(entries: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys..., entry, a, phrase) of the entries of frequent candidates: how often in all, and their number.

    A candidate's rows, one of each block that has it, meet once: they are sorted, not gathered.
    """
    whole = Window.partitionBy(*keys)
    rows = entries.withColumn("a", F.sum("count").over(whole)).withColumn("phrase", F.min("entry").over(whole))
    return staged(rows.where(F.col("a") >= least).drop("count"), "collocation-kept")


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST
) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of the frequent phrases of 1, 2, ... words, and (lang, n) of all words.

    Each has phrase (its number), lang, a (its occurrences), text, last (its last word), and what cutting
    it needs: head and tail (numbers of the phrases without its last and first word), and the occurrences
    of those (f_head, f_tail), of its first and last word (f_first, f_last) and of its first and last two
    (f_first2, f_last2). A relation is deleted once the next one is written.
    """
    with ExitStack() as batches:
        for key, value in _BATCHES.items():
            batches.enter_context(setting(docs.sparkSession, key, value))
        return _frequent_phrases(docs, least, longest)


def _frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    spark = docs.sparkSession
    with recorded() as before:
        blocks = staged(word_blocks(docs), "collocation-words", _BLOCK_FILES)
    per_block = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    total = staged(blocks.groupBy("lang").agg(F.sum(per_block).alias("n")), "collocation-totals")
    with recorded() as kept_path:
        words = _entries(blocks, ["words"], ["lang"])
        kept = _frequent(words.withColumnRenamed("words", "text"), ["lang", "text"], least)
    no = F.lit(None).cast("long")
    first = kept.where("entry = phrase").select(
        "phrase", "lang", "a", "text", F.col("text").alias("last"),
        *[no.alias(c) for c in ("head", "tail", "f_head", "f_tail")],
        F.col("a").alias("f_first"), F.col("a").alias("f_last"), no.alias("f_first2"), no.alias("f_last2"),
    )
    tables = [staged(first, "collocation-frequent")]
    for length in range(2, longest + 1):
        with recorded() as occurrences_path:
            occurrences = _kept_occurrences(blocks, kept, "collocation-occurrences")
        dropped(spark, before)
        dropped(spark, kept_path)
        with recorded() as before:
            blocks = _extended(occurrences, "collocation-candidates")
        dropped(spark, occurrences_path)
        with recorded() as kept_path:
            kept = _frequent(_entries(blocks, ["head", "tail"], []), ["head", "tail"], least)
        shorter = tables[-1]
        head = shorter.select(
            F.col("phrase").alias("head"), "lang", F.col("text").alias("begin"), F.col("a").alias("f_head"),
            "f_first", F.col("f_first2").alias("h"),
        )
        tail = shorter.select(
            F.col("phrase").alias("tail"), "last", F.col("a").alias("f_tail"), "f_last",
            F.col("f_last2").alias("t"),
        )
        first2 = F.col("a") if length == 2 else F.col("f_head") if length == 3 else F.col("h")
        last2 = F.col("a") if length == 2 else F.col("f_tail") if length == 3 else F.col("t")
        different = kept.where("entry = phrase").select("head", "tail", "a", "phrase")
        found = different.join(head, "head").join(tail, "tail").select(
            "phrase", "lang", "a", F.concat_ws(" ", "begin", "last").alias("text"), "last", "head", "tail",
            "f_head", "f_tail", "f_first", "f_last", first2.alias("f_first2"), last2.alias("f_last2"),
        )
        tables.append(staged(found, "collocation-frequent"))
    dropped(spark, before)
    dropped(spark, kept_path)
    return tables, total


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of every language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces
    and tabs. A phrase that occurs ``least`` times is a candidate. Cut after k words into parts that occur l
    and r times it scores floor(2000000 a / (l + r)); the cut of least score counts, of equal ones the
    first. Candidates inside a longer candidate with ``covered`` percent of their occurrences go: a phrase
    inside one two words longer is also inside the one between, which is at least as frequent.

    Null texts have no words, and a null lang is ``und``. Repeated rows count as often as they come. No
    document is cut, a very long one is a block of its own. An empty table gives an empty table; other
    columns are not read. Sums are decimals of 38 digits.
    """
    tables, total = frequent_phrases(docs, least)
    rest = []
    for length, found in enumerate(tables[1:], start=2):
        cuts = [("f_first", "f_tail")]
        if length == 4:
            cuts.append(("f_first2", "f_last2"))
        if length > 2:
            cuts.append(("f_head", "f_last"))
        big = "decimal(38,0)"
        scored = [
            F.struct(
                F.expr(f"(cast(a as {big}) * {SCALE}) div (cast({x} as {big}) + cast({y} as {big}))").alias("score"),
                F.lit(k).alias("k"),
                F.col(x).alias("l"),
                F.col(y).alias("r"),
            )
            for k, (x, y) in enumerate(cuts)
        ]
        if length < 4:
            longer = tables[length]
            around = longer.select(F.col("head").alias("inner"), "a").union(longer.select("tail", "a"))
            around = around.groupBy("inner").agg(F.max("a").alias("around"))
            open_end = found.join(around, F.col("phrase") == F.col("inner"), "left").where(
                F.expr(f"around IS NULL OR cast(around as {big}) * 100 < cast(a as {big}) * {covered}")
            )
        else:
            open_end = found
        least_cut = F.array_min(F.array(*scored))
        rest.append(open_end.select("lang", "text", "a", least_cut.alias("cut")))
    candidates = rest[0].union(rest[1]).union(rest[2])
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "text")
    ranked = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        F.col("text").alias("phrase"),
        "a",
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        "n",
        F.col("cut.score").cast("long").alias("score"),
    )
