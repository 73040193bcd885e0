"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm import bpe, quality
from lakequill.llm.line_dedup import LONG_TOKENS, drop_recurring_lines
from lakequill.llm.mixing import mix_sources
from lakequill.llm.shared import WORD
from lakequill.llm.simhash import keep_one_of_similar
from lakequill.scale import table
from lakequill.session import checkpoint_dir, ship_package

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The last stage hashes ids, which SQL has no means to make; tests compare all stages with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates but for the first text with each; n_chars follows the text."""
    ship_package(spark)
    return drop_recurring_lines(docs, keep_first="doc_id", long_tokens=LONG_TOKENS).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    ship_package(spark)
    return keep_one_of_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut gives only its words before it."""
    ship_package(spark)
    mixed = mix_sources(docs)
    whole = F.col("epochs_full")
    part = F.col("taken") - whole * F.col("size")
    begun = F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))
    last = F.when(part > 0, F.array(F.when(part < F.col("size"), part))).otherwise(F.array().cast("array<bigint>"))
    rows = mixed.withColumn("_words", F.explode(F.concat(begun, last)))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(words))
    return rows.select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hashes of ids and of the bytes that they decode to."""
    ship_package(spark)
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode_and_check(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "coded.n_tokens", "coded.ids", "coded.ids_sha256", "coded.decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written to the shared checkpoint folder."""
    folder = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
