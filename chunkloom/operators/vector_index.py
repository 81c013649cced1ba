"""A stored vector index: inverted lists behind centroids, product-quantised codes, exact re-ranking.

Build: centroids and code books are fitted on a bounded sample, every vector is put into the list of its nearest centroid,
and the lists are written as partitions of a table, in segments of a bounded size. How many lists to probe, and how many
hits of the codes to re-rank, is measured on a sample of questions so that the target recall is reached; both become facts
of the index version.

Search: questions rank the centroids; the probed partitions alone are read (a join with the probed lists prunes the others
while the query runs); a segment's vectors, or what its codes stand for, are multiplied with all questions that probe it,
in one product; each question keeps its first hits of each segment. Hits of the codes are scored again by their vectors.

Versions (`sources.versions`) are immutable. `add` and `remove` write what is new; nothing is fitted again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import vectors as V
from chunkloom.operators.blocked import matrix, top_hits, unit
from chunkloom.operators.neighbours import lists_for
from chunkloom.operators.ranking import are_few, few, ranked
from chunkloom.sources.versions import Version, Versions

#: Vectors that centroids and code books are fitted on (chosen by a hash of their id), and questions that the settings are measured with.
TRAIN_ROWS, MEASURE_ROWS = 65_536, 256
#: Vectors of one segment of a list, on average.
SEGMENT_ROWS = 20_000
#: Bytes of a code; a shorter vector has one byte for four components.
CODE_BYTES = 64
#: Hits of the codes from which the number to re-rank is chosen, for each hit that is wanted.
RERANK_MOST = 100
#: Hits that the settings are measured for.
MEASURE_K = 10
#: What is asked for above the target when the settings are measured, as other questions do a little worse than those of the sample.
MARGIN = 0.01
#: Questions' probes of one segment that are multiplied at once.
BLOCK = 2048


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centre of each row by distance."""
    bias = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmax(rows[i : i + BLOCK] @ centres.T - bias, 1) for i in range(0, len(rows), BLOCK)]) if len(rows) else np.zeros(0, np.int64)


def fit_centres(rows: np.ndarray, n: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means over a bounded sample; centres that lose all their rows take up rows drawn anew."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], rows[rng.integers(0, len(rows), len(centres))])
    return centres


class Codes:
    """Product quantisation: each stretch of components is one byte, the number of its nearest centre in that stretch's book."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.ends = np.cumsum([b.shape[1] for b in books])

    @classmethod
    def fit(cls, rows: np.ndarray, n_bytes: int) -> Codes:
        parts = np.array_split(np.arange(rows.shape[1]), n_bytes)
        return cls([fit_centres(np.ascontiguousarray(rows[:, p]), min(256, len(rows)), seed=i) for i, p in enumerate(parts)])

    def encode(self, rows: np.ndarray) -> np.ndarray:
        parts = np.split(rows, self.ends[:-1], 1)
        return np.stack([_nearest(np.ascontiguousarray(p), b) for p, b in zip(parts, self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)


def code_bytes_for(width: int, n_bytes: int = CODE_BYTES) -> int:
    """Bytes of a code; one for four components where that is fewer."""
    return max(1, min(n_bytes, width // 4))


def _of_length(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.select("chunk_id", "vector").where(F.size("vector") == width)


def _listed(vectors: DataFrame, centres: np.ndarray, codes: Codes | None) -> DataFrame:
    """chunk_id, vector -> list_id, chunk_id, code (null without codes), vector."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = unit(matrix(part.column("vector"))[0])
                own = _nearest(v, centres)
                coded = pa.array([c.tobytes() for c in codes.encode(v - centres[own])], pa.binary()) if codes else pa.nulls(len(v), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column("chunk_id"), coded, part.column("vector")], ["list_id", "chunk_id", "code", "vector"])

    return vectors.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "list_id int, chunk_id long, code binary, vector array<double>")


class VectorIndex:
    """One version of an index, opened."""

    def __init__(self, version: Version):
        self.version, self.facts, self.spark = version, version.facts, version.spark
        held = version.table("centres").orderBy("list_id").toArrow()  # lists_for() bounds them
        self.centres = matrix(held.column("centre"))[0]
        books = version.table("books").orderBy("part", "code").toArrow()  # 256 times the width of a vector
        part = books.column("part").to_numpy()
        rows = [books.filter(pa.array(part == p)).column("centre") for p in range(int(part.max(initial=-1)) + 1)]
        self.codes = Codes([matrix(r)[0] for r in rows]) if rows else None

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorIndex | None:
        version = Versions(spark, root).current()
        return cls(version) if version else None

    @classmethod
    def build(cls, vectors: DataFrame, root: str, n_lists: int | None = None, code_bytes: int | None = None, target: float = 0.95, questions: DataFrame | None = None) -> VectorIndex:
        """vectors(chunk_id, vector) -> a new version at root. Vectors of another length than the longest are left out, as a question of that length meets none of them.

        code_bytes: 0 for lists without codes. questions(question_vector): what the settings are measured with; else some of the vectors themselves.
        """
        spark, store = vectors.sparkSession, Versions(vectors.sparkSession, root)
        width = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
        held = _of_length(vectors, max(width, 1))
        n = held.count()
        sample = unit(matrix(held.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // TRAIN_ROWS))) == 0).select("vector").toArrow().column("vector"))[0])
        centres = fit_centres(sample, n_lists or lists_for(n), seed=11) if len(sample) else np.zeros((0, width))
        n_bytes = code_bytes_for(width) if code_bytes is None else code_bytes
        codes = Codes.fit(sample - centres[_nearest(sample, centres)], n_bytes) if n_bytes and len(sample) else None
        facts = {"index_type": "ivf_pq" if codes else "ivf", "dimension": width, "num_vectors": n, "n_lists": len(centres), "code_bytes": n_bytes if codes else 0, "target": target, "segments": 1, "removals": []}
        tables = {
            "centres": spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centre array<double>"),
            "books": spark.createDataFrame([(p, i, c.tolist()) for p, b in enumerate(codes.books if codes else []) for i, c in enumerate(b)], "part int, code int, centre array<double>"),
            "lists-0": (_segmented(held, centres, codes), ["list_id"]),
        }
        first = store.publish(tables, facts | {"probes": len(centres), "rerank": RERANK_MOST}, store.current())
        facts |= cls(first)._measured(held, questions, target) if n else {"probes": 0, "rerank": 0}
        return cls(store.publish(dict(first.tables), facts, first))

    # What is held

    def lists(self) -> DataFrame:
        """list_id, segment, chunk_id, code, vector of all parts, without the ids removed since."""
        parts = []
        for i in range(self.facts["segments"]):
            part = self.version.table(f"lists-{i}")
            later = [self.version.table(f"gone-{j}") for j, after in enumerate(self.facts["removals"]) if after > i]
            if later:
                part = part.join(reduce(DataFrame.unionByName, later), "chunk_id", "left_anti")
            parts.append(part.withColumn("segment", F.col("segment") + F.lit(i << 20)))
        return reduce(DataFrame.unionByName, parts)

    def sizes(self) -> DataFrame:
        """list_id, segment, n: as many rows as there are segments."""
        return self.lists().groupBy("list_id", "segment").agg(F.count(F.lit(1)).alias("n"))

    def add(self, vectors: DataFrame) -> VectorIndex:
        """A version with more vectors; an id that is there already is replaced."""
        held = _of_length(vectors, self.facts["dimension"])
        return self._changed(held.select("chunk_id"), held)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """A version without the vectors of ids(chunk_id)."""
        return self._changed(ids, None)

    def _changed(self, ids: DataFrame, more: DataFrame | None) -> VectorIndex:
        gone = ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct()
        dropped = self.lists().join(gone, "chunk_id", "left_semi").count()
        facts, tables = dict(self.facts), dict(self.version.tables)
        facts["num_vectors"] -= dropped
        if dropped:
            tables[f"gone-{len(facts['removals'])}"] = gone
            facts["removals"] = [*facts["removals"], facts["segments"]]  # it holds for the parts written before it
        if more is not None:
            tables[f"lists-{facts['segments']}"] = _segmented(more, self.centres, self.codes), ["list_id"]
            facts["segments"] += 1
            facts["num_vectors"] += more.count()
        return VectorIndex(Versions(self.spark, self.version.root).publish(tables, facts, self.version))

    # Search

    def probed(self, questions: DataFrame, probes: int) -> DataFrame:
        """question_id, q (at length 1), list_id, place: the lists whose centroids are nearest."""
        centres, width = self.centres, self.facts["dimension"]

        def run(batches):
            for batch in batches:
                q = unit(matrix(batch.column("question_vector"))[0])
                order = np.argsort(-(q @ centres.T), 1, kind="stable")[:, :probes]
                n = order.shape[1]
                row = np.repeat(np.arange(len(q)), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * width), pa.array(q[row].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("question_id").take(pa.array(row)), lists, pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(q)))], ["question_id", "q", "list_id", "place"])

        asked = questions.where(F.size("question_vector") == width).select("question_id", F.col("question_vector").cast("array<double>").alias("question_vector"))
        return asked.mapInArrow(run, f"question_id {dict(questions.dtypes)['question_id']}, q array<double>, list_id int, place int")

    def _scan(self, probed: DataFrame, k: int, coded: bool) -> DataFrame:
        """question_id, list_id, chunk_id, score: the first k of the probed lists, by codes or by vectors."""
        centres, codes = self.centres, self.codes
        kind = dict(probed.dtypes)["question_id"]

        def score(held: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if held.num_rows and asked.num_rows:
                ids, at = held.column("chunk_id").to_numpy(), held.column("list_id")[0].as_py()
                own = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(ids), -1) if coded else None
                v = codes.decode(own) + centres[at] if coded else unit(matrix(held.column("vector"))[0])
                order = np.argsort(-ids)
                ids, v = ids[order], v[order]
                for start in range(0, asked.num_rows, BLOCK):
                    block = asked.slice(start, BLOCK)
                    s = matrix(block.column("q"))[0] @ v.T
                    s = s if coded else np.round(s, 6)
                    top = np.argsort(-s, 1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(s)), top.shape[1])
                    names = block.column("question_id").take(pa.array(row))
                    out.append(pa.table({"question_id": names, "list_id": pa.array(np.full(len(row), at, np.int32)), "chunk_id": pa.array(ids[top.ravel()]), "score": pa.array(s[row, top.ravel()])}))
            empty = pa.table({"question_id": asked.column("question_id").slice(0, 0), "list_id": pa.array([], pa.int32()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.concat_tables([empty, *out])

        wanted = probed.select("list_id").distinct()  # at most as many as there are lists
        lists = self.lists().join(F.broadcast(wanted), "list_id", "left_semi").select("list_id", "segment", "chunk_id", "code" if coded else "vector")
        asked = probed.join(F.broadcast(self.sizes().select("list_id", "segment")), "list_id").select("list_id", "segment", "question_id", "q")
        hits = lists.groupBy("list_id", "segment").cogroup(asked.groupBy("list_id", "segment")).applyInArrow(score, f"question_id {kind}, list_id int, chunk_id long, score double")
        return ranked(hits, ["question_id"], [F.desc("score"), F.desc("chunk_id")], k)

    def search(self, questions: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """question_id, chunk_id, vector_score, rank: the first k that the probed lists hold; with codes, of `rerank` times k hits of theirs."""
        probed = self.probed(questions, self.facts["probes"] if probes is None else probes)
        if not self.codes:
            return self._scan(probed, k, False).select("question_id", "chunk_id", F.round("score", 6).alias("vector_score"), "rank")
        near = self._scan(probed, k * (self.facts["rerank"] if rerank is None else rerank), True).select("question_id", "list_id", "chunk_id")
        asked = questions.select("question_id", V.unit(F.col("question_vector")).alias("q"))
        near = F.broadcast(near) if are_few(near) else near
        found = self.lists().join(near, ["list_id", "chunk_id"]).join(few(asked), "question_id")
        scored = found.select("question_id", "chunk_id", F.round(V.on_unit(F.col("q"), F.col("vector")), 6).alias("vector_score"))
        return ranked(scored, ["question_id"], [F.desc("vector_score"), F.desc("chunk_id")], k)

    def scanned(self, questions: DataFrame, probes: int | None = None) -> DataFrame:
        """scanned: mean share of the vectors that lie in the lists that a question probes."""
        sizes = self.sizes().groupBy("list_id").agg(F.sum("n").alias("n"))
        met = self.probed(questions, self.facts["probes"] if probes is None else probes).join(F.broadcast(sizes), "list_id").groupBy("question_id").agg(F.sum("n").alias("n"))
        return met.agg(F.round(F.avg("n") / max(self.facts["num_vectors"], 1), 6).alias("scanned"))

    # Settings

    def _measured(self, vectors: DataFrame, questions: DataFrame | None, target: float) -> dict:
        """probes and rerank: the least that reach the target recall of the first MEASURE_K on a sample of questions, other than the vector itself."""
        n, target = self.facts["num_vectors"], min(1.0, target + MARGIN)
        if questions is None:
            some = vectors.orderBy(F.xxhash64("chunk_id", F.lit(5))).limit(MEASURE_ROWS)
            asked = some.select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("question_vector"))
        else:
            asked = questions.where(F.size("question_vector") == self.facts["dimension"]).limit(MEASURE_ROWS).select(F.monotonically_increasing_id().alias("question_id"), "question_vector")
        asked = self.spark.createDataFrame(asked.toArrow())
        k = min(MEASURE_K, n - 1) if questions is None else min(MEASURE_K, n)
        if k < 1:
            return {"probes": self.facts["n_lists"], "rerank": 1, "measured": None}
        true = top_hits(asked, vectors, k + (questions is None)).where("question_id <> chunk_id" if questions is None else "true")
        true = self.spark.createDataFrame(true.select("question_id", "chunk_id").toArrow())  # MEASURE_ROWS * MEASURE_K rows
        at = self.lists().select("chunk_id", "list_id").join(F.broadcast(true), "chunk_id").join(self.probed(asked, self.facts["n_lists"]).select("question_id", "list_id", "place"), ["question_id", "list_id"])
        places = np.sort(at.select("place").toArrow().column("place").to_numpy())
        first = 1 - (1 - target) / 2 if self.codes else target  # lists and codes share what may be lost
        probes = int(places[min(len(places) - 1, int(np.ceil(first * len(places))))]) + 1
        if not self.codes:
            return {"probes": probes, "rerank": 1}
        hits = self._scan(self.probed(asked, probes), (k + 1) * RERANK_MOST, True)
        ranks = np.sort(hits.join(F.broadcast(true), ["question_id", "chunk_id"]).select("rank").toArrow().column("rank").to_numpy())
        wanted = min(len(ranks) - 1, int(np.ceil(target * len(places))))
        return {"probes": probes, "rerank": int(-(-(ranks[wanted] + 1) // k))}


def _segmented(vectors: DataFrame, centres: np.ndarray, codes: Codes | None) -> DataFrame:
    """The lists, each cut into segments of some SEGMENT_ROWS by a hash of the id, rows of a segment together and in order of their ids."""
    sizes = _listed(vectors, centres, None).groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / SEGMENT_ROWS).cast("int").alias("parts"))  # one row for each list
    rows = _listed(vectors, centres, codes).join(F.broadcast(sizes), "list_id")
    cut = rows.withColumn("segment", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    return cut.repartition("list_id", "segment").sortWithinPartitions("list_id", "segment", "chunk_id").select("segment", "chunk_id", "code", "vector", "list_id")
