"""A stored graph of near neighbours: built by joins of neighbours' neighbours, searched best-first for whole batches.

Build: vectors of the same few inverted lists are compared in blocks, which gives each vector its first neighbours. Then, in
rounds, the neighbours of a vector (and those that have it as a neighbour), a bounded number of them, are compared with each
other, as they are likely to be near each other too; each keeps the DEGREE best it has met. The graph links both ways.

Search: every question starts at the best of a bounded set of entry points. A round opens the best nodes of each question
that are not open yet, among the first `breadth` that it has met, and scores their neighbours that it has not met. It ends
when these first are all open. Nodes met are rows of a table (question, node, score), not state of a process. Each round
joins the nodes to be opened with the graph, so it reads the graph once for the whole batch: the graph saves products, not
reading, and suits large batches; for few questions `vector_index` reads less.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import vectors as V
from chunkloom.operators.blocked import matrix, top_hits, unit
from chunkloom.operators.neighbours import lists_for
from chunkloom.operators.ranking import few
from chunkloom.operators.vector_index import TRAIN_ROWS, fit_centres
from chunkloom.sources.versions import Version, Versions, shared_dir

#: Neighbours that a node keeps, and links that it has at most, both ways together.
DEGREE, LINKS = 16, 32
#: Lists that a vector is put into at first, and vectors of one block of a list.
SPILL, BLOCK_ROWS = 3, 1_000
#: Rounds of the build, and members of a neighbourhood that are compared with each other in one.
ROUNDS, MEMBERS = 3, 24
#: Vectors that every question is compared with at first.
ENTRIES = 256
#: First hits of a question that must be open in the end, and nodes that a round opens for it.
BREADTH, OPENED, MOST_ROUNDS = 40, 16, 12


def _pairs(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, other, score: for each of the rows its k best others."""
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-score, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
    row = np.repeat(np.arange(len(ids)), at.shape[1])
    return ids[row], ids[at.ravel()], score[row, at.ravel()]


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    node, other, score = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
    return pa.table({"node": pa.array(node.astype(np.int64)), "other": pa.array(other.astype(np.int64)), "score": pa.array(score.astype(np.float64))})


_EDGES = "node long, other long, score double"


def _first_edges(vectors: DataFrame, n: int) -> DataFrame:
    """Each vector against the others of its blocks of SPILL lists."""
    sample = unit(matrix(vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // TRAIN_ROWS))) == 0).select("v").toArrow().column("v"))[0])
    centres = fit_centres(sample, max(1, min(lists_for(n), -(-n // (BLOCK_ROWS // 4)))), seed=7)
    width = sample.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))[0]
            own = np.argsort(-(v @ centres.T), 1)[:, :SPILL]
            row = np.repeat(np.arange(len(v)), own.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * width), pa.array(v[row].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel().astype(np.int32)), batch.column("chunk_id").take(pa.array(row)), lists], ["list_id", "chunk_id", "v"])

    def compare(rows: pa.Table) -> pa.Table:
        return _edges([_pairs(rows.column("chunk_id").to_numpy(), matrix(rows.column("v"))[0], DEGREE)])

    listed = vectors.mapInArrow(run, "list_id int, chunk_id long, v array<double>")
    sizes = vectors.mapInArrow(run, "list_id int, chunk_id long, v array<double>").groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))  # one row for each list
    block = F.pmod(F.xxhash64("chunk_id", "list_id"), F.col("parts")).alias("block")
    return listed.join(F.broadcast(sizes), "list_id").select("list_id", block, "chunk_id", "v").groupBy("list_id", "block").applyInArrow(compare, _EDGES)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Of each node its k best edges; an edge met twice counts once."""
    once = edges.groupBy("node", "other").agg(F.max("score").alias("score"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), F.asc("other"))
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "score"))


def _met(edges: DataFrame, vectors: DataFrame, turn: int) -> DataFrame:
    """Members of each neighbourhood compared with each other; which MEMBERS of a large one, changes from round to round."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn)))
    some = _both_ways(edges).select("node", "other").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= MEMBERS)
    held = some.join(vectors.withColumnRenamed("chunk_id", "other"), "other").select("node", "other", "v").repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            node = table.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last neighbourhood may go on in the next batch
            rest = table.slice(last)
            yield from compared(table.slice(0, last))
        if rest is not None:
            yield from compared(rest)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            node, ids, v = table.column("node").to_numpy(), table.column("other").to_numpy(), matrix(table.column("v"))[0]
            cuts = np.flatnonzero(np.diff(node)) + 1
            parts = [_pairs(i, x, 8) for i, x in zip(np.split(ids, cuts), np.split(v, cuts)) if len(i) > 1]
            yield from _edges(parts).to_batches()

    return held.mapInArrow(run, _EDGES)


class NeighbourGraph:
    """One version of a graph, opened."""

    def __init__(self, version: Version):
        self.version, self.facts, self.spark = version, version.facts, version.spark

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> NeighbourGraph | None:
        version = Versions(spark, root).current()
        return cls(version) if version else None

    @classmethod
    def build(cls, vectors: DataFrame, root: str, rounds: int = ROUNDS) -> NeighbourGraph:
        """vectors(chunk_id, vector), ids unique -> a new version at root. Vectors of another length than the longest are left out."""
        store = Versions(vectors.sparkSession, root)
        width = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
        held = vectors.where(F.size("vector") == max(width, 1)).select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>"))
        nodes = store.write("nodes", held)
        units = store.read(nodes).select("chunk_id", V.unit(F.col("vector")).alias("v"))
        n = units.count()
        edges = store.read(store.write("edges", _best(_first_edges(units, n), DEGREE))) if n else vectors.sparkSession.createDataFrame([], _EDGES)
        for turn in range(rounds if n else 0):  # each round's edges are a table: nothing is computed twice, lost executors lose nothing
            edges = store.read(store.write("edges", _best(edges.unionByName(_met(edges, units, turn)), DEGREE)))
        links = _best(_both_ways(edges), LINKS).groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("others"))  # LINKS numbers a node
        entries = store.read(nodes).orderBy(F.xxhash64("chunk_id", F.lit(9))).limit(ENTRIES)
        return cls(store.publish({"nodes": nodes, "links": links, "entries": entries}, {"index_type": "graph", "dimension": width, "num_vectors": n, "degree": DEGREE}, store.current()))

    def _met_at_first(self, asked: DataFrame) -> DataFrame:
        entries = self.version.table("entries")
        hits = top_hits(asked, entries, OPENED)
        return hits.select("question_id", F.col("chunk_id").alias("node"), F.col("vector_score").alias("score"), F.lit(False).alias("open"))

    def met(self, questions: DataFrame, breadth: int = BREADTH) -> DataFrame:
        """question_id, node, score of every node that a question was compared with after the entry points."""
        asked = questions.where(F.size("question_vector") == max(self.facts["dimension"], 1)).select("question_id", "question_vector")
        units = asked.select("question_id", V.unit(F.col("question_vector").cast("array<double>")).alias("q"))
        nodes, links = self.version.table("nodes"), self.version.table("links")
        store = Versions(self.spark, f"{shared_dir(self.spark)}/graph-search-{uuid4().hex}")
        state = store.read(store.write("met", self._met_at_first(asked)))
        for _ in range(MOST_ROUNDS):
            order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("node"))
            first = state.withColumn("at", F.row_number().over(order)).where(F.col("at") <= breadth).where("not open")
            due = first.withColumn("at", F.row_number().over(order)).where(F.col("at") <= OPENED).select("question_id", "node")
            due = store.read(store.write("due", due))
            if due.isEmpty():
                break
            near = links.join(few(due), "node").select("question_id", F.explode("others").alias("node")).distinct()
            new = near.join(state.select("question_id", "node"), ["question_id", "node"], "left_anti")
            scored = nodes.withColumnRenamed("chunk_id", "node").join(new, "node").join(few(units), "question_id")
            scored = scored.select("question_id", "node", F.round(V.on_unit(F.col("q"), F.col("vector")), 6).alias("score"), F.lit(False).alias("open"))
            opened = state.join(due.withColumn("now", F.lit(True)), ["question_id", "node"], "left").select("question_id", "node", "score", (F.col("open") | F.coalesce("now", F.lit(False))).alias("open"))
            state = store.read(store.write("met", opened.unionByName(scored)))
        return state.select("question_id", "node", "score")

    def search(self, questions: DataFrame, k: int, breadth: int = BREADTH) -> DataFrame:
        """question_id, chunk_id, vector_score, rank: the first k of what each question met."""
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("node"))
        found = self.met(questions, max(breadth, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return found.select("question_id", F.col("node").alias("chunk_id"), F.col("score").alias("vector_score"), "rank")
