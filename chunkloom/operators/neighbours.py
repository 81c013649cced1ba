"""Nearest vectors: the exact scan, the choice of an index, a guard of its hits, and recall. `vector_index` holds the index itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.operators.blocked import top_hits
from chunkloom.operators.ranking import few

#: Vectors up to which an exact scan is chosen, and from which lists number 1024.
FLAT_BELOW, LARGE_FROM = 10_000, 200_000

def choose(n: int, kind: str = "auto") -> str:
    """Index type for n vectors; unknown types are flat."""
    if kind == "auto":
        return "flat" if n < FLAT_BELOW else "ivf"
    return kind if kind in ("flat", "ivf") else "flat"


def lists_for(n: int) -> int:
    return max(1, min(n, 256 if n < 50_000 else 1024))


def exact(questions: DataFrame, vectors: DataFrame, k: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """question_id, chunk_id, vector_score, rank: the first k of a scan over all vectors given (filter them before), or over those of the question's scope."""
    return top_hits(questions, vectors, k, scope)


def guarded(questions: DataFrame, near: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """near: each question's first 2k hits; they stand if one of them shares a token with the question, else the first k with a positive score do.

    tokens(chunk_id, tokens): token sets of the chunks. A question without text is not guarded.
    """
    asked = questions.select("question_id", T.token_set("question").alias("asked"))
    shown = near.where(F.col("rank") <= 2 * k).join(few(asked), "question_id").join(tokens, "chunk_id")
    met = shown.groupBy("question_id").agg(F.max(F.arrays_overlap("asked", "tokens").cast("int")).alias("met"))
    return near.join(met, "question_id").where((F.col("rank") <= 2 * k) & ((F.col("met") == 1) | ((F.col("rank") <= k) & (F.col("vector_score") > 0)))).select(*near.columns)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean share of the true neighbours that were found."""
    both = truth.select("question_id", "chunk_id").join(found.select("question_id", "chunk_id", F.lit(1).alias("f")), ["question_id", "chunk_id"], "left")
    return both.groupBy("question_id").agg((F.count("f") / F.count(F.lit(1))).alias("r")).agg(F.round(F.avg("r"), 6).alias("recall"), F.count(F.lit(1)).alias("n_questions"))
