"""Whole retrievals, from questions to ranked units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import understanding as U
from chunkloom.operators import ranking as R
from chunkloom.operators.blocked import top_hits


def two_arms(questions: DataFrame, leaves: DataFrame, vectors: DataFrame, depth: int, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first `depth` vector hits with a positive score, and the keyword hits, of all questions over the same leaves."""
    held = vectors.join(leaves.select("chunk_id", "chunk_index"), "chunk_id").select("chunk_id", "chunk_index", "vector")
    near = top_hits(questions, held, depth, ties=("chunk_index", "chunk_id"), positive=True).drop("rank")
    return near, R.bm25(leaves, R.question_terms(questions, weighted))


def hybrid_leaves(questions: DataFrame, leaves: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    return R.hybrid(*two_arms(questions, leaves, vectors, 4 * k), k)


def retrieve(questions: DataFrame, leaves: DataFrame, vectors: DataFrame, parents: DataFrame, k: int = 5, spread: int = 5, carry_parent: bool = True) -> DataFrame:
    """k reranked units of each question: recall k * spread, fuse, widen to parents, rerank by rules.

    A question without text is answered by its vector alone.
    """
    wide = k * max(spread, 1)
    hits = R.small_to_big(hybrid_leaves(questions, leaves, vectors, wide), leaves, parents, 2 * wide, carry_parent)
    known = U.with_intent(questions.select("question_id", "question"))
    pairs = hits.join(R.few(known), "question_id").withColumn("chunk_index", F.col("unit_id"))
    return R.rule_rerank(pairs.withColumnRenamed("unit_id", "chunk_id"), "unit_content", k)
