"""From documents to token ids: quality, exact duplicates, near duplicates, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and read
again before the next. All but the last return the columns of documents. Rows whose doc_id is null pass the two stages
that drop by doc_id; rows with the same doc_id stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import decontamination, exact_dedup, near_dedup, quality, word_codec
from chunkloom.llm.common import documents, materialise, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at least 0.3; it is fitted on labelled rows outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the one with the largest doc_id."""
    return without(docs, exact_dedup.deduplicate(docs).where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles (0.8 or more), the one with the smallest doc_id."""
    return without(docs, near_dedup.link(docs, shingle=5, percent=80).where("not kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and digests of the ids and of the decoded text."""
    return word_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Models and similarity confirmation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
