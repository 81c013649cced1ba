"""Hard negatives for contrastive training: integer products of anchors and candidates, then bounded heaps.

Vectors become integers (floor of 256 times each component). The anchors are the stated query set: they go to the tasks in
chunks of at most CHUNK_BYTES, and every task multiplies the tiles of its own candidates by the tiles of the chunk, by
Strassen's recursion with zero padding over int64. Additions and products are those of the ring modulo 2**64, so a score
that fits in 64 bits is exact whatever the sums on the way are; tiles whose scores could leave 64 bits raise an error.

Nothing of the score matrix is kept. A first round keeps the best positives of each anchor, a second one, for each anchor
and positive, the best candidates whose score lies in the positive's window. Both are heaps of a fixed size for each anchor,
merged from tile to tile inside a task and from task to task by Spark, in any order with the same result.

Rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Defined results: vectors of
unequal lengths are padded with zeros; of rows that share a vec_id the one with the smallest (label, vector) counts, so
repeated rows change nothing; ties go to the smaller vec_id; an anchor without a positive, or with no row in a window, has
no rows for it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import materialise, outlive, scratch, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a window in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows of a tile of candidates and of one of anchors; the scores of a pair of tiles take 8 MB.
CANDIDATE_TILE, ANCHOR_TILE = 2048, 512
#: Bytes of the anchors' vectors that one round over the candidates carries. More anchors take more rounds.
CHUNK_BYTES = 32 << 20
#: Edge below which the recursion multiplies plainly.
PLAIN_EDGE = 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b over int64 modulo 2**64, by seven products of halves while all three edges exceed PLAIN_EDGE; odd edges are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= PLAIN_EDGE:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products of every anchor (row) with every candidate (row)."""
    width = max(anchors.shape[1], candidates.shape[1])
    reach = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (anchors, candidates)]
    if reach[0] * reach[1] * width >= 1 << 63:
        raise OverflowError("scores of these vectors may not fit in 64 bits")
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, candidates))
    with np.errstate(over="ignore"):
        return strassen(a, np.ascontiguousarray(b.T))


NONE = np.iinfo(np.int64).min


def usable(embeddings: DataFrame) -> DataFrame:
    """embeddings(vec_id, label, embedding) -> vec_id, label, v: the rows that take part, one for each vec_id, as integers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    refused = F.raise_error(F.lit("a component leaves 62 bits")).cast("bigint")
    whole = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < float(1 << 62), F.floor(c * SCALE)).otherwise(refused))
    own = F.struct(F.col("label").cast("long").alias("label"), whole.alias("v"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("own")).groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows, short ones padded with zeros."""
    length = np.diff(column.offsets.to_numpy().astype(np.int64))
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    flat = column.flatten().to_numpy()
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


class Heaps:
    """For each of n queries the first k (score, id): higher scores first, ties by smaller id. Empty places hold NONE."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), NONE)

    def merge(self, low: int, high: int, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Adds to the queries low..high the allowed ones of the candidates `ids` (ascending)."""
        held = np.where(allowed, score, NONE)
        if held.shape[1] > self.k:
            least = -np.partition(-held, self.k - 1, 1)[:, self.k - 1 : self.k] if held.min() > NONE else np.partition(held, held.shape[1] - self.k, 1)[:, held.shape[1] - self.k][:, None]
            # of those above the k-th score all stay, of those equal to it the ones with the smallest ids
            above, level = held > least, held == least
            take = above | level & (np.cumsum(level, 1) <= self.k - above.sum(1, keepdims=True))
            at = np.nonzero(take)[1].reshape(len(held), self.k)
            held, ids = np.take_along_axis(held, at, 1), ids[at]
        else:
            ids = np.broadcast_to(ids, held.shape)
        both = np.concatenate([self.score[low:high], held], 1), np.concatenate([self.id[low:high], np.where(held == NONE, NONE, ids)], 1)
        order = np.lexsort((both[1], ~both[0]), 1)[:, : self.k]  # ~x falls as x rises, without overflow
        self.score[low:high], self.id[low:high] = (np.take_along_axis(x, order, 1) for x in both)


#: score of (anchors of a tile x candidates), candidates' ids and labels, place of the tile's first anchor -> into the heaps
Offer = Callable[[Heaps, np.ndarray, np.ndarray, np.ndarray, int], None]


def _round(candidates: DataFrame, vectors: np.ndarray, heaps: Callable[[], Heaps], offer: Offer) -> DataFrame:
    """candidates(vec_id, label, v) against one chunk of anchors -> query (place in the heaps), id, score."""
    chunk = candidates.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = heaps()
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_TILE):
                part = batch.slice(at, CANDIDATE_TILE)
                ids, labels, v = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"))
                order = np.argsort(ids)
                ids, labels, v = ids[order], labels[order], v[order]
                for first in range(0, len(chunk.value), ANCHOR_TILE):
                    offer(kept, scores(chunk.value[first : first + ANCHOR_TILE], v), ids, labels, first)
        query, place = np.nonzero(kept.id != NONE)
        for at in range(0, len(query), 100_000):
            own = query[at : at + 100_000], place[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(kept.id[own]), pa.array(kept.score[own])], ["query", "id", "score"])

    return candidates.select("vec_id", "label", "v").mapInArrow(run, "query long, id long, score long")


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The heaps of all tasks merged: rank, and no more than k."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_chunk(candidates: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one chunk of anchors(vec_id, label, v)."""
    spark = candidates.sparkSession
    ids, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    vectors = _matrix(anchors.column("v").combine_chunks())
    n = len(ids)

    def same_label(kept: Heaps, score: np.ndarray, held: np.ndarray, label: np.ndarray, first: int) -> None:
        own = slice(first, first + len(score))
        kept.merge(first, first + len(score), score, held, (label == labels[own, None]) & (held != ids[own, None]))

    found = _first(_round(candidates, vectors, lambda: Heaps(n, positives), same_label), ["query"], positives).toArrow()  # at most `positives` rows an anchor
    query, rank, positive, reached = (found.column(c).to_numpy() for c in ("query", "rank", "id", "score"))
    least, most = np.full((positives, n), 1), np.full((positives, n), 0)  # windows that hold nothing
    for q, r, s in zip(query.tolist(), rank.tolist(), reached.tolist()):
        least[r - 1, q], most[r - 1, q] = -(-low * s // 100), high * s // 100

    def in_window(kept: Heaps, score: np.ndarray, held: np.ndarray, label: np.ndarray, first: int) -> None:
        own = slice(first, first + len(score))
        other = label != labels[own, None]
        for r in range(positives):
            at = r * n + first
            kept.merge(at, at + len(score), score, held, other & (score >= least[r, own, None]) & (score <= most[r, own, None]))

    hits = _first(_round(candidates, vectors, lambda: Heaps(positives * n, negatives), in_window), ["query"], negatives)
    windows = pa.table({"query": (rank.astype(np.int64) - 1) * n + query, "anchor_id": ids[query], "positive_id": positive, "positive_score": reached})
    named = hits.join(F.broadcast(spark.createDataFrame(windows)), "query")  # as long as the chunk, times `positives`
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows(vec_id, label, v), anchors: some of them -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vec_ids must be unique. Positives are an anchor's best other rows of its label; negatives are the best rows of other labels that
    score from `low` to `high` hundredths of the positive's score.
    """
    with scratch():
        rows = materialise(rows, "candidates")
        chosen = materialise(rows.join(anchors.select("vec_id"), "vec_id", "left_semi") if anchors is not rows else rows, "anchors")
        n, width = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        chunks = max(1, -(-n * max(width, 1) * 8 // CHUNK_BYTES))
        parts = []
        for i in range(chunks):  # each chunk's anchors pass the driver, CHUNK_BYTES at a time
            chunk = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).select("vec_id", "label", "v").toArrow()
            if chunk.num_rows:
                parts.append(outlive(materialise(_of_chunk(rows, chunk, positives, negatives, low, high), "negatives")))
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return mine(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM own
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), windowed AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windowed WHERE rank <= 10
"""
