"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, attribution, bpe, conversations, decontaminate, fingerprint, language, pii, quality, sharding, simhash, substrings, warc
from ._util import shared_dir
from .oracles import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of each document and the verdict of its group's robust estimate."""
    return quality.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC archives and reads their records back."""
    root = shared_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), root)
    back = warc.read(spark, root, with_payload=False)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, rendered with its source as a heading and encoded as a whole."""
    return attribution.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["source", "text"], rule="majority")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document once passages of 35 words that occur twice are removed."""
    return substrings.report(table(spark, sf_dir, "documents"), width=35)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document and the terms that disclose it."""
    return pii.report(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learnt from the documents that are not held out."""
    return language.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimax shard and slot of each document, by bytes."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document and the text that they decode to, as digests."""
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in each document."""
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the damaged conversations and their cheapest repair."""
    return conversations.report(table(spark, sf_dir, "conversations"))


def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprint of each document and of its edited text, and how alike it is to that and to the next document."""
    return fingerprint.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_warc, op4_attribution, op5_substrings, op6_pii, op7_language, op8_simhash, op9_sharding, op10_bpe, op11_alignment, op12_conversations, op13_syncmers)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
