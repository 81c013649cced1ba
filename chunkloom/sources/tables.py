"""The driver's tables as the engine's data model."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import text as T

#: Leaves of one knowledge document, and the number that separates parents' ids from leaves'.
LEAVES, PARENT_BASE = 4, 1_000_000_000


#: Bytes a core below which a table of fewer files than cores is dealt out anew: Spark reads such files in fewer tasks than there are cores.
SMALL_SHARE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files, dealt to all cores; others as they are (a large table has files or splits enough and isn't shuffled)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in ("documents", "pages", "conversations") else df  # texts, which are worked on row by row


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, name, file_type, status, content_text, file_md5, file_size_bytes, one row for each text."""
    state = F.when(F.col("doc_id") % 10 == 0, "embed_failed").when(F.col("doc_id") % 10 == 1, "embedding").otherwise("ready")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr("try_cast(substring(source, 4) as int)").alias("user_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
        F.lit("txt").alias("file_type"), state.alias("status"), F.col("text").alias("content_text"), F.md5("text").alias("file_md5"), F.octet_length("text").cast("long").alias("file_size_bytes"),
        F.col("n_chars"), F.col("lang"),
    )


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf chunks: every four neighbouring texts are the leaves of one knowledge document."""
    doc = F.floor(F.col("doc_id") / LEAVES)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), doc.alias("document_id"), (doc % 3).alias("user_id"), (F.col("doc_id") % LEAVES).alias("chunk_index"), (doc + PARENT_BASE).alias("parent_chunk_id"),
        F.lit("leaf").alias("chunk_role"), F.lit("text").alias("block_type"), F.concat_ws("/", "source", doc.cast("string")).alias("document_name"),
        F.col("lang").alias("parent_title"), F.col("text").alias("content"), T.retrieval_text("lang", F.lit("text"), "text").alias("retrieval_content"),
        (F.col("doc_id") % LEAVES + 1).cast("int").alias("source_page"), F.concat(F.lit("page_"), (F.col("doc_id") % 2 + 1).cast("string")).alias("source_section"),
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent chunks: the texts of their leaves in order."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")))
    return leaves(spark, sf_dir).groupBy("parent_chunk_id").agg(F.array_join(F.transform(own, lambda x: x.content), "\n").alias("parent_content"))


def leaf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question and its vector (that of the same number; NULL where there is none)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("question_vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).join(vectors, "question_id", "left")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run steps from the event stream: one step for each event of a user's run."""
    state = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), F.col("event_type").alias("step_type"), state.alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.col("props").alias("payload"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
