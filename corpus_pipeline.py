"""A corpus from raw documents to packed training sequences, each stage over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import packing, quality, secret_scan, simhash
from orelode.llm.runtime import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null texts have no words and go; repeated rows stay or go together; an empty table gives an empty one."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more.

    Null texts have no words and are alike; repeated rows are one group; an empty table gives an empty one.
    """
    return simhash.similar_kept(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the secrets' kinds. Null texts stay null, and repeated rows stay; an empty table gives an empty one."""
    return secret_scan.redact(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence, with its ids.

    A null text counts as empty and is its end id alone; repeated rows are documents each; an empty table gives no piece.
    """
    out = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("secret scans", secret_scans), ("packing", pack)]

#: Ball hashing, the decoding worklist and BPE are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
