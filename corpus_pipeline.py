"""From raw documents to digests of encoded ones, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from goldseam.llm import decontaminate, line_dedup, prefix_bpe, quality, simhash
from goldseam.llm.common import dropped, recorded, staged, table
from goldseam.llm.queries import WORD_BPE


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left_behind: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the stage before, whose rows are written by then."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, _left_behind)
        with recorded() as paths:
            result = function(spark, docs, sf_dir)
        _left_behind.extend(paths)
        return result

    return run_stage


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs learnt from the labels of these documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line is similar to."""
    return line_dedup.without_repeated_lines(docs)


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one_per_component(docs)


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return prefix_bpe.encoding_digests(docs, WORD_BPE)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", first_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("encode", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
