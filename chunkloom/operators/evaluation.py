"""Retrieval evaluation: recall, reciprocal rank, hits, by category and against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(expected: Column, found: Column, k: int) -> Column:
    """Share of the expected ids among the first k (NULL if nothing is expected)."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.array_distinct(expected), F.slice(found, 1, k))) / F.size(F.array_distinct(expected)))


def reciprocal_rank(expected: Column, found: Column, k: int) -> Column:
    """1 / place of the first expected id among the first k, else 0 (NULL if nothing is expected)."""
    places = F.filter(F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(expected) > 0, F.coalesce(1 / F.array_min(places), F.lit(0.0)))


def per_question(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions(question_id, category, expected), hits(question_id, chunk_id, rank) -> metrics; a question that expects nothing is a hit only if nothing came."""
    found = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id).alias("found"))
    both = questions.join(found, "question_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    hit = F.when(F.size("expected") > 0, F.arrays_overlap("expected", F.slice("found", 1, 10))).otherwise(F.size("found") == 0)
    return both.select("question_id", "category", recall_at(F.col("expected"), F.col("found"), 5).alias("recall_5"), recall_at(F.col("expected"), F.col("found"), 10).alias("recall_10"), reciprocal_rank(F.col("expected"), F.col("found"), 10).alias("mrr_10"), hit.cast("int").alias("hit_10"))


METRICS = ("recall_5", "recall_10", "mrr_10", "hit_10")


def _means() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_questions"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS)]


def summary(results: DataFrame) -> DataFrame:
    """Means over all questions; those without a value do not count."""
    return results.agg(*_means())


def by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(*_means())


def against_baseline(results: DataFrame, baseline: DataFrame, metric: str = "recall_10", top: int = 3) -> DataFrame:
    """The questions that gained and lost most, up to `top` of each; those missing from either side or without a value are left out."""
    both = results.select("question_id", F.col(metric).alias("now")).join(baseline.select("question_id", F.col(metric).alias("before")), "question_id")
    moved = both.where("now is not null and before is not null").withColumn("delta", F.round(F.col("now") - F.col("before"), 6))
    up = moved.where("delta > 0").orderBy(F.desc("delta"), "question_id").limit(top).withColumn("direction", F.lit("improved"))
    down = moved.where("delta < 0").orderBy(F.asc("delta"), "question_id").limit(top).withColumn("direction", F.lit("regressed"))
    return up.unionByName(down)
