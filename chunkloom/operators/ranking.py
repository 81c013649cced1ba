"""Recall, fusion and reranking of chunks for a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.functions import understanding as U

K1, B = 1.5, 0.75
VECTOR_SHARE, KEYWORD_SHARE = 0.65, 0.35
#: Added before rounding to six places, so that exact halves go up whatever their binary form.
HALF_UP = 1e-9
#: Questions (rows of a question table) that may be broadcast; a larger table joins by shuffle.
BROADCAST_QUESTIONS = 20_000
#: Terms of all questions together (rows of some 60 bytes) that may be broadcast.
BROADCAST_TERMS = 1_000_000
#: Pairs of a question and a chunk, and terms of chunks, that one task scores (some 200 bytes a pair and 100 a term while it runs). Tasks grow in number with the tables, not in size.
TASK_PAIRS, TASK_TERMS = 1_000_000, 3_000_000
#: Bytes of a text that stand for one term when tasks are counted.
TERM_BYTES = 5


def are_few(questions: DataFrame, most: int = BROADCAST_QUESTIONS) -> bool:
    return questions.limit(most + 1).count() <= most


def few(questions: DataFrame) -> DataFrame:
    """A hint to broadcast the questions, given only if they are proven few."""
    return F.broadcast(questions) if are_few(questions) else questions


def tasks_for(spark: SparkSession, pairs: int, terms: int) -> int:
    """Partitions that keep a task to TASK_PAIRS and TASK_TERMS; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, min(1 << 16, max(-(-pairs // TASK_PAIRS), -(-terms // TASK_TERMS))))


def extent(chunks: DataFrame, text: str | Column = "content") -> tuple[int, int]:
    """How many chunks there are, and about how many terms: from the texts' lengths, no text is taken apart."""
    n, size = chunks.select(F.octet_length(F.col(text) if isinstance(text, str) else text).alias("size")).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n, size // TERM_BYTES


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their place within `by`; with k, the first k."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def postings(chunks: DataFrame, text: str | Column = "content", keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """keys, term, tf, dl: how often each term occurs in each chunk, and the chunk's length in terms."""
    bags = chunks.select(*keys, T.term_bag(text).alias("bag")).withColumn("dl", F.size("bag"))
    terms = bags.select(*keys, "dl", F.explode("bag").alias("term"))  # the length is taken once a chunk, before the terms are spread
    return terms.groupBy(*keys, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def question_terms(questions: DataFrame, weighted: bool = False) -> DataFrame:
    """question_id, term, weight: terms of a question, or of all its rewrites with the largest weight of each."""
    if not weighted:
        return questions.select("question_id", F.explode(F.array_distinct(T.term_bag("question"))).alias("term"), F.lit(1.0).alias("weight"))
    forms = U.with_intent(questions.select("question_id", "question")).select("question_id", F.explode("intent.forms").alias("form"))
    terms = forms.select("question_id", F.explode(F.array_distinct(T.term_bag("form.text"))).alias("term"), F.col("form.weight").alias("weight"))
    return terms.groupBy("question_id", "term").agg(F.max("weight").alias("weight"))


def bm25(chunks: DataFrame, terms: DataFrame, scope: tuple[str, ...] = (), text: str | Column = "content") -> DataFrame:
    """question_id, chunk_id, chunk_index, keyword_score > 0. Statistics are those of the chunks given, or of each scope of them.

    terms(question_id, term, weight) may carry the scope columns; then a question meets its own scope only.
    The texts' terms are cut down to the asked ones where they are read; what is left is placed by chunk once, and counting,
    document frequencies and the sums of questions' scores all start from that one exchange. Its partitions are counted out by
    chunks, questions and lengths: Spark would join them by bytes, and few bytes here become many pairs.
    """
    n_chunks, n_terms = extent(chunks, text)
    tasks = tasks_for(chunks.sparkSession, n_chunks * terms.select("question_id").distinct().count(), n_terms)
    keys = (*scope, "chunk_id", "chunk_index")
    hint = F.broadcast if are_few(terms, BROADCAST_TERMS) else lambda x: x
    asked = terms.select(*[c for c in scope if c in terms.columns], "term").distinct()
    bags = chunks.select(*keys, T.term_bag(text).alias("bag")).withColumn("dl", F.size("bag"))
    whole = bags.where("dl > 0").groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    placed = bags.select(*keys, "dl", F.explode("bag").alias("term")).join(hint(asked), asked.columns, "left_semi").repartition(tasks, "chunk_id")
    met = placed.groupBy(*keys, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = met.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    stats = df.join(F.broadcast(whole), list(scope)) if scope else df.crossJoin(F.broadcast(whole))  # one row for each scope
    stats = stats.select(*scope, "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    rated = met.join(stats if scope else hint(stats), [*scope, "term"]).select(*keys, "term", share.alias("share"))  # one row for each asked term at most
    scored = rated.join(hint(terms), [*scope, "term"])
    total = scored.groupBy("question_id", "chunk_id", "chunk_index").agg(F.round(F.sum(F.col("weight") * F.col("share")), 6).alias("keyword_score"))
    return total.where("keyword_score > 0")


def coarse_scores(pairs: DataFrame) -> DataFrame:
    """pairs(intent, content, vector_score) with coarse_score: vector, words, phrases over all forms, evidence and relation."""
    return with_signals(pairs, "content").withColumn(
        "coarse_score",
        F.when(F.size("intent.forms") == 0, F.col("vector_score")).otherwise(
            F.col("vector_score") + 0.03 * F.col("kw_plain") + 0.05 * F.col("ph_plain") + F.array_max(F.transform("by_form", lambda f: (0.20 * f.kw + 0.28 * f.ph) * f.w)) + 0.40 * F.col("evidence") + 0.18 * F.col("relation")
        ),
    )


def with_signals(pairs: DataFrame, text: str) -> DataFrame:
    """Adds kw_plain, ph_plain (of the question's plain form), by_form (kw, ph, w of each rewrite), evidence and relation of a text column."""

    def overlaps(body: Column) -> Column:
        def shares(asked: Column, weight: Column) -> Column:
            return T.let(T.prepared(asked), lambda q: F.struct(T.keyword_share(q, body).alias("kw"), T.phrase_share(q, body).alias("ph"), weight.alias("w")))

        return F.struct(shares(F.col("intent.normalized_query"), F.lit(1.0)).alias("plain"), F.transform("intent.forms", lambda f: shares(f.text, f.weight)).alias("by_form"))

    def stated(normal: Column) -> Column:
        related = U.relation_evidence(F.col("intent"), normal)
        return T.let(related, lambda r: F.struct(r.alias("relation"), U.evidence(F.col("intent"), normal, r).alias("evidence")))

    both = pairs.withColumn("_o", T.let(T.prepared(text), overlaps)).withColumn("_s", T.let(T.compact(text), stated))
    return both.select(*pairs.columns, "_s.relation", "_s.evidence", F.col("_o.plain.kw").alias("kw_plain"), F.col("_o.plain.ph").alias("ph_plain"), F.col("_o.by_form").alias("by_form"))


def max_normal(df: DataFrame, column: str, by: str = "question_id") -> DataFrame:
    """Divides a score by the largest of its question (all 0 if that is not positive), to six places."""
    top = F.max(column).over(Window.partitionBy(by))
    return df.withColumn(column, F.when(top > 0, F.round(F.col(column) / top, 6)).otherwise(0.0))


def min_max_normal(column: str, by: str = "question_id") -> Column:
    """Stretches a score to 0..1 within its question; 0.5 where all are equal."""
    low, high = F.min(column).over(Window.partitionBy(by)), F.max(column).over(Window.partitionBy(by))
    return F.when(high <= low, 0.5).otherwise((F.col(column) - low) / (high - low))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int) -> DataFrame:
    """The best 4k of both arms, each brought to its maximum, joined by chunk and mixed; the best 3k with a positive score.

    Both hits: question_id, chunk_id, chunk_index and their score.
    """
    one = ranked(vector_hits.where("vector_score > 0"), ["question_id"], [F.desc("vector_score"), F.desc("chunk_index"), F.desc("chunk_id")], 4 * k).drop("rank")
    two = ranked(keyword_hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 4 * k).drop("rank")
    one, two = max_normal(one, "vector_score"), max_normal(two, "keyword_score")
    keys = ["question_id", "chunk_id", "chunk_index"]
    both = one.select(*keys, "vector_score").join(two.select(*keys, "keyword_score"), keys, "full_outer").select(*keys, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.col("vector_score").isNotNull().alias("by_vector"))
    mixed = both.withColumn("final_score", F.round(VECTOR_SHARE * F.col("vector_score") + KEYWORD_SHARE * F.col("keyword_score") + HALF_UP, 6)).where("final_score > 0")
    return ranked(mixed, ["question_id"], [F.desc("final_score"), F.desc("vector_score"), F.desc("keyword_score"), F.asc("chunk_index"), F.asc("chunk_id")], 3 * k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """lists of (question_id, chunk_id, rank) -> question_id, chunk_id, rrf_score: the sum of 1 / (k + rank)."""
    if k < 0:
        raise ValueError("k must not be negative")
    joined = reduce(DataFrame.unionByName, [x.select("question_id", "chunk_id", "rank") for x in lists])
    return joined.groupBy("question_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf_score"))


def small_to_big(hits: DataFrame, leaves: DataFrame, parents: DataFrame, k: int, carry_parent: bool = True) -> DataFrame:
    """Leaves of one parent become one hit with the parent's text: best scores, and the best leaf as matched_child.

    carry_parent=False: leaves that the vector arm found have lost their parent and stand for themselves.
    """
    own = hits.join(leaves.select("chunk_id", "parent_chunk_id"), "chunk_id")
    if not carry_parent:
        own = own.withColumn("parent_chunk_id", F.when(F.col("by_vector"), F.lit(None)).otherwise(F.col("parent_chunk_id")))
    keyed = own.withColumn("unit_id", F.coalesce("parent_chunk_id", "chunk_id"))
    best = F.struct("final_score", "vector_score", "keyword_score", (-F.col("rank")).alias("r"))
    units = keyed.groupBy("question_id", "unit_id").agg(
        F.max("final_score").alias("final_score"), F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"),
        F.max_by("chunk_id", best).alias("matched_child"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_leaves"),
    )
    texts = units.join(parents.select(F.col("parent_chunk_id").alias("unit_id"), "parent_content"), "unit_id", "left")
    filled = texts.join(leaves.select(F.col("chunk_id").alias("matched_child"), "content"), "matched_child", "left")
    out = filled.withColumn("unit_content", F.coalesce("parent_content", "content")).drop("parent_content", "content")
    return ranked(out, ["question_id"], [F.desc("final_score"), F.desc("vector_score"), F.desc("keyword_score"), F.asc("first")], k).drop("first")


def rule_rerank(hits: DataFrame, text: str, k: int) -> DataFrame:
    """hits(intent, vector_score, keyword_score, chunk_index, text) -> the best k by rule_score."""
    kw = F.array_max(F.transform("by_form", lambda f: f.kw * f.w))
    ph = F.array_max(F.transform("by_form", lambda f: f.ph * f.w))
    parts = 0.35 * F.col("vector_score") + 0.12 * F.col("keyword_score") + 0.04 * F.col("kw_plain") + 0.04 * F.col("ph_plain")
    parts += 0.16 * F.coalesce(kw, F.lit(0.0)) + 0.20 * F.coalesce(ph, F.lit(0.0)) + 0.30 * F.col("evidence") + 0.18 * F.col("relation")
    scored = with_signals(hits, text).withColumn("rule_score", F.round(parts, 6)).drop("by_form", "kw_plain", "ph_plain")
    return ranked(scored, ["question_id"], [F.desc("rule_score"), F.desc("vector_score"), F.desc("chunk_index"), F.desc("chunk_id")], k)


def shares(model: float = 0.65, rule: float = 0.35) -> tuple[float, float]:
    """Weights brought to a sum of one; the usual ones if their sum is not positive."""
    return (model / (model + rule), rule / (model + rule)) if model + rule > 0 else (0.65, 0.35)


def fuse_scores(hits: DataFrame, k: int, candidates: int = 30, model: float = 0.65, rule: float = 0.35) -> DataFrame:
    """hits(rule_score, rank, model_score): within the first max(k, candidates) of each question both scores are stretched and mixed; the rest follows in its old order."""
    m, r = shares(model, rule)
    pool = hits.withColumn("in_pool", F.col("rank") <= max(k, candidates))
    one = pool.where("in_pool").withColumn("mixed", F.round(m * min_max_normal("model_score") + r * min_max_normal("rule_score") + HALF_UP, 6))
    both = one.unionByName(pool.where("not in_pool"), allowMissingColumns=True).withColumnRenamed("rank", "rule_rank")
    return ranked(both, ["question_id"], [F.desc("in_pool"), F.desc_nulls_last("mixed"), F.asc("rule_rank")], k).drop("in_pool")
