"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.llm import (
    collocations,
    decontaminate,
    line_dedup,
    nn_descent,
    oracles,
    packed_ids,
    prefix_bpe,
    quality,
    quotes,
    shards,
    simhash,
    token_counts,
    url_filter,
    whitening,
)
from goldseam.llm.common import table
from goldseam.session import shared_folder

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
CONTEXT_TOKENS = 1024
END_ID = 0
SHARDS = 16
URL_RULES = [
    url_filter.UrlRule("block", "net", "/"),
    url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"),
    url_filter.UrlRule("allow", "org", "/fr/"),
]


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with the message it replies to and its place in reply order."""
    return quotes.linked_messages(table(spark, sf_dir, "conversations"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, CONTEXT_TOKENS)


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return prefix_bpe.encoding_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    found = decontaminate.find_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document; cutoffs from all labels."""
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line with a word, and whether it is the one that stays."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("place")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as packed ids and read back."""
    path = shared_folder(spark, "packed-ids")
    packed_ids.write_packed(table(spark, sf_dir, "documents"), path, BYTE_BPE, END_ID)
    return packed_ids.read_packed(spark, path)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to shuffled shards and read back."""
    docs = table(spark, sf_dir, "documents")
    path = shared_folder(spark, "shards")
    shards.write_shards(docs, path, SHARDS)
    text, doc_id = F.col("record.text"), F.col("record.doc_id")
    return shards.read_shards(spark, path, docs.schema).select(
        doc_id.alias("doc_id"),
        shards.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(shards.LAW).alias("law"),
        "shard",
        "slot",
        shards.shard_of(doc_id, SHARDS + 1).alias("grown_shard"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of all vectors, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings")).drop("audited_recall")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_token_counts": op2_token_counts,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_packed_ids": op9_packed_ids,
    "op10_shards": op10_shards,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_nn_descent": op13_nn_descent,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quotation_linking": oracles.quotation_linking(),
    "op5_url_filter": oracles.url_filter(URL_RULES),
    "op6_quality": oracles.quality(),
    "op12_collocations": oracles.collocations(),
    "op13_nn_descent": oracles.embedding_links(),
}
