"""Scores of any number of questions against any number of vectors: block products, and the first k of each block.

Questions go to the tasks in chunks of a bounded size; a task multiplies the blocks of its own vectors by the blocks of the
chunk and keeps k hits for each question, which Spark merges over the tasks. No pair of a question and a vector is ever a
row, and vectors are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.versions import shared_dir

#: Vectors and questions of a block; the scores of two blocks take 8 MB.
VECTOR_BLOCK, QUESTION_BLOCK = 2048, 512
#: Bytes of the questions' vectors, and of the hits kept for them in a task, that one reading of the vectors carries.
CHUNK_BYTES = 32 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows, short ones padded with zeros, and the lists' lengths; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    out = np.zeros((len(length), int(length.max(initial=0))))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out, length


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=rows.copy(), where=norm > 0)


class Best:
    """For each of n questions the first k hits: higher scores first, then larger tie numbers, in any order of merging."""

    def __init__(self, n: int, k: int, ties: int):
        self.k, self.score, self.tie = k, np.full((n, k), -np.inf), np.zeros((ties, n, k), np.int64)

    def merge(self, at: np.ndarray, score: np.ndarray, ties: np.ndarray) -> None:
        """at: the questions; score (questions x candidates), -inf for no hit; ties (numbers x candidates), candidates in falling order of them."""
        if score.shape[1] > self.k:
            least = np.partition(score, score.shape[1] - self.k, 1)[:, score.shape[1] - self.k, None]
            above, level = score > least, score == least
            take = above | level & (np.cumsum(level, 1) <= self.k - above.sum(1, keepdims=True))
            place = np.nonzero(take)[1].reshape(len(score), self.k)
            score, ties = np.take_along_axis(score, place, 1), ties[:, place]
        else:
            ties = np.broadcast_to(ties[:, None, :], (len(ties), *score.shape))
        score = np.concatenate([self.score[at], score], 1)
        ties = np.concatenate([self.tie[:, at], ties], 2)
        order = np.lexsort((*(-t for t in ties[::-1]), -score), 1)[:, : self.k]
        self.score[at] = np.take_along_axis(score, order, 1)
        for i, t in enumerate(ties):
            self.tie[i, at] = np.take_along_axis(t, order, 1)


def _chunk_hits(vectors: DataFrame, asked: pa.Table, k: int, scope: tuple[str, ...], ties: tuple[str, ...], positive: bool) -> DataFrame:
    """Hits of one chunk of questions."""
    q, q_length = matrix(asked.column("question_vector"))
    scopes = [asked.column(c).to_pylist() for c in scope]
    chunk = vectors.sparkSession.sparkContext.broadcast((unit(q), q_length, scopes))
    ids = asked.column("question_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_length, scopes = chunk.value
        best = Best(len(q), k, len(ties))
        for batch in batches:
            for start in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(start, VECTOR_BLOCK)
                numbers = np.array([part.column(c).to_numpy(zero_copy_only=False) for c in ties], np.int64)
                order = np.lexsort([-n for n in numbers[::-1]])
                numbers = numbers[:, order]
                v, length = matrix(part.column("vector"))
                v, length = unit(v)[order], length[order]
                own = [np.array(part.column(c).to_pylist(), object)[order] for c in scope]
                for size in set(length.tolist()) - {0}:
                    held, asking = np.flatnonzero(length == size), np.flatnonzero(q_length == size)
                    for at in range(0, len(asking), QUESTION_BLOCK):
                        block = asking[at : at + QUESTION_BLOCK]
                        score = np.round(q[block, :size] @ v[held, :size].T, 6)
                        score[np.isnan(score)] = -np.inf  # of a vector with a missing component
                        if positive:
                            score[score <= 0] = -np.inf
                        for wanted, there in zip(scopes, own):
                            own_scope = np.array([wanted[i] for i in block], object)[:, None]
                            score[(own_scope != there[held][None, :]) | (own_scope == None)] = -np.inf  # noqa: E711  element by element; no scope meets none
                        best.merge(block, score, numbers[:, held])
        query, place = np.nonzero(best.score > -np.inf)
        for at in range(0, len(query), 100_000):
            own = query[at : at + 100_000], place[at : at + 100_000]
            columns = [pa.array(own[0]), pa.array(best.score[own]), *(pa.array(t[own]) for t in best.tie)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "vector_score", *ties])

    found = vectors.select("vector", *scope, *ties).mapInArrow(run, ", ".join(["query long", "vector_score double", *(f"{c} long" for c in ties)]))
    order = Window.partitionBy("query").orderBy(F.desc("vector_score"), *[F.desc(c) for c in ties])
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = vectors.sparkSession.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids))), "question_id": ids}))
    return found.join(F.broadcast(names), "query").select("question_id", *ties, F.round("vector_score", 6).alias("vector_score"), "rank")  # as many names as the chunk has questions


def top_hits(questions: DataFrame, vectors: DataFrame, k: int, scope: tuple[str, ...] = (), ties: tuple[str, ...] = ("chunk_id",), positive: bool = False) -> DataFrame:
    """question_id, the tie columns, vector_score (cosine, six places), rank: the first k vectors of each question, ties by the larger numbers.

    questions(question_id, question_vector, scope...), vectors(vector, scope..., ties...). A question meets vectors of its own length, and of
    its own scope; with `positive`, only those it scores above 0. Chunks of questions pass the driver one at a time; more than one is
    written to the shared folder chunk by chunk.
    """
    spark = vectors.sparkSession
    asked = questions.where(F.size("question_vector") > 0).select("question_id", "question_vector", *scope)
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("question_vector")), F.lit(0))).first()
    chunks = max(1, -(-n * max(8 * width, 8 * k * (1 + len(ties))) // CHUNK_BYTES))
    if chunks == 1:
        return _chunk_hits(vectors, asked.toArrow(), k, scope, ties, positive)
    parts = []
    for i in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(chunks)) == i).toArrow()
        if chunk.num_rows:
            hits = _chunk_hits(vectors, chunk, k, scope, ties, positive)
            path = f"{shared_dir(spark)}/hits-{uuid4().hex}"
            hits.write.parquet(path)
            parts.append(spark.read.schema(hits.schema).parquet(path))
    return reduce(DataFrame.unionByName, parts)
