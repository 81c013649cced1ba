"""Blocked scoring, the stored vector index and the versions it lies in."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import blocked as B
from chunkloom.operators import neighbour_graph as G
from chunkloom.operators import neighbours as N
from chunkloom.operators import vector_index as X
from chunkloom.sources.versions import Conflict, Versions


def vectors_of(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], "chunk_id long, vector array<double>")


def questions_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "question_id long, question_vector array<double>")


def plain(asked, held, k, allowed=lambda q, v: True):
    """The first k by cosine, six places, ties by the larger id."""
    out = {}
    for i, q in enumerate(asked):
        scores = [(round(float(np.dot(q, v) / ((np.linalg.norm(q) * np.linalg.norm(v)) or 1)), 6), j) for j, v in enumerate(held) if len(v) == len(q) and allowed(i, j)]
        out[i] = [(j, s) for s, j in sorted(scores, reverse=True)[:k]]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.question_id, []).append((r.chunk_id, r.vector_score))
    return out


@pytest.mark.parametrize("chunk", [32 << 20, 600])
def test_blocked_as_plain(spark, monkeypatch, chunk):
    """Ties, zero vectors, unequal lengths and scopes; in one chunk of questions and in many."""
    monkeypatch.setattr(B, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(1)
    held = [rng.integers(-2, 3, 4) for _ in range(300)] + [[1, 0], [0, 0, 0, 0], [2, 2]]
    asked = [rng.integers(-2, 3, 4) for _ in range(40)] + [[1, 1]]
    assert found(B.top_hits(questions_of(spark, asked), vectors_of(spark, held).repartition(3), 7)) == plain(asked, held, 7)
    scoped = B.top_hits(questions_of(spark, asked).withColumn("user", F.col("question_id") % 3), vectors_of(spark, held).withColumn("user", F.col("chunk_id") % 3), 5, scope=("user",))
    assert found(scoped) == {q: x for q, x in plain(asked, held, 5, lambda q, v: q % 3 == v % 3).items() if x}
    none = F.lit(None).cast("long")
    assert B.top_hits(questions_of(spark, asked).withColumn("user", none), vectors_of(spark, held).withColumn("user", none), 5, scope=("user",)).isEmpty()
    near = found(B.top_hits(questions_of(spark, asked), vectors_of(spark, held), 400, positive=True))
    assert near == {q: [y for y in x if y[1] > 0] for q, x in plain(asked, held, 400).items() if any(y[1] > 0 for y in x)}


def test_ties_by_two_numbers(spark):
    held = spark.createDataFrame([(i, i % 4, [1.0, 0.0]) for i in range(30)], "chunk_id long, chunk_index long, vector array<double>").repartition(4)
    got = B.top_hits(questions_of(spark, [[2, 0]]), held, 9, ties=("chunk_index", "chunk_id")).orderBy("rank").collect()
    assert [(r.chunk_index, r.chunk_id) for r in got] == sorted(((i % 4, i) for i in range(30)), reverse=True)[:9]


def test_more_questions_than_are_broadcast(spark):
    """21,000 questions against 50 vectors: the same rows as the plain ranking, with no pair of them as a row of a join."""
    rng = np.random.default_rng(2)
    held, asked = rng.normal(size=(50, 3)), rng.normal(size=(21_000, 3))
    hits = N.exact(questions_of(spark, asked), vectors_of(spark, held), 1)
    assert "size(" not in hits._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argmax(unit(asked) @ unit(held).T, 1)
    got = {r.question_id: r.chunk_id for r in hits.collect()}
    assert len(got) == 21_000 and all(got[i] == best[i] for i in range(21_000))


@pytest.fixture(scope="module")
def cloud():
    """Vectors around 30 centres, and questions near them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    return centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16)), centres[rng.integers(0, 30, 60)] + 0.3 * rng.normal(size=(60, 16))


@pytest.mark.parametrize("code_bytes", [0, None])
def test_index_reaches_its_target(spark, tmp_path, cloud, code_bytes, monkeypatch):
    monkeypatch.setattr(X, "SEGMENT_ROWS", 40)
    held, asked = cloud
    v, q, root = vectors_of(spark, held), questions_of(spark, asked), f"file://{tmp_path}/index"
    X.VectorIndex.build(v, root, n_lists=40, code_bytes=code_bytes)
    index = X.VectorIndex.open(spark, root)
    truth = N.exact(q, v, 10).cache()
    assert N.recall(index.search(q, 10), truth).first().recall >= 0.95
    assert index.scanned(q).first().scanned <= 0.1 and index.facts["num_vectors"] == 3000
    assert found(index.search(q, 10, probes=40, rerank=300)) == found(truth)
    plan = index.search(q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan  # the lists that no question probes are not read
    assert index.sizes().count() > 60  # segments


def test_index_changes(spark, tmp_path, cloud):
    """Vectors added, replaced and removed are searched like an index built from what is left; older versions stay as they were."""
    held, asked = cloud
    q, root = questions_of(spark, asked), f"file://{tmp_path}/index"
    first = X.VectorIndex.build(vectors_of(spark, held[:1000]), root, n_lists=10)
    added = first.add(vectors_of(spark, held[900:2000] * [[-1.0] * 16], 900))
    last = added.remove(spark.range(500).withColumnRenamed("id", "chunk_id")).add(vectors_of(spark, held[100:200], 100))
    now = {**{i: x for i, x in enumerate(held[:900]) if i >= 500}, **{900 + i: -x for i, x in enumerate(held[900:2000])}, **{100 + i: x for i, x in enumerate(held[100:200])}}
    left = spark.createDataFrame([(i, x.tolist()) for i, x in now.items()], "chunk_id long, vector array<double>")
    assert found(last.search(q, 10, probes=10, rerank=500)) == found(N.exact(q, left, 10))
    assert last.facts["num_vectors"] == len(now) and X.VectorIndex.open(spark, root).version.number == last.version.number
    assert found(first.search(q, 10, probes=10, rerank=500)) == found(N.exact(q, vectors_of(spark, held[:1000]), 10))


def test_odd_indexes(spark, tmp_path):
    empty = X.VectorIndex.build(spark.createDataFrame([], "chunk_id long, vector array<double>"), f"file://{tmp_path}/a")
    assert empty.search(questions_of(spark, [[1, 2]]), 3).collect() == [] and X.VectorIndex.open(spark, f"file://{tmp_path}/none") is None
    one = X.VectorIndex.build(vectors_of(spark, [[1, 0], [1]]), f"file://{tmp_path}/b")
    assert [r.chunk_id for r in one.search(questions_of(spark, [[1, 2], [3]]), 3).collect()] == [0]
    same = X.VectorIndex.build(vectors_of(spark, [[1, 0]] * 300), f"file://{tmp_path}/c", code_bytes=0)
    assert [r.chunk_id for r in same.search(questions_of(spark, [[1, 0]]), 2, probes=300).orderBy("rank").collect()] == [299, 298]


def test_versions_are_pinned_and_claimed(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    assert store.current() is None and store.numbers() == []
    first = store.publish({"t": (spark.range(10).selectExpr("id", "id % 2 as p"), ["p"])}, {"n": 10}, None)
    second = store.publish({"t": first.tables["t"], "u": spark.range(3).where("id > 5")}, {"n": 3}, first)
    with pytest.raises(Conflict):
        store.publish({"t": spark.range(1)}, {}, first)  # it started from a version that is no longer the last
    assert store.current().number == second.number == 1 and store.current().facts == {"n": 3}
    assert store.current().table("u").count() == 0 and store.at(0).table("t").where("p = 1").count() == 5
    third = store.publish({"t": spark.range(4)}, {}, second)
    assert store.vacuum(keep=2) == 1 and store.numbers() == [1, 2]  # the folder of the writer that lost
    assert store.vacuum(keep=1) == 2 and store.numbers() == [2] and third.table("t").count() == 4


def test_readers_while_versions_are_written(spark, tmp_path):
    """A reader sees whole versions only: every table of a version has as many rows as its facts say."""
    store = Versions(spark, f"file://{tmp_path}/v")
    version, stop, seen = store.publish({"a": spark.range(1), "b": spark.range(1)}, {"n": 1}, None), threading.Event(), []

    def read():
        while not stop.is_set():
            v = store.current()
            seen.append((v.facts["n"], v.table("a").count(), v.table("b").count()))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(2, 8):
            version = store.publish({"a": spark.range(n), "b": spark.range(n)}, {"n": n}, version)
    finally:
        stop.set()
        reader.join()
    assert seen and all(n == a == b for n, a, b in seen)


def test_graph_finds_neighbours(spark, tmp_path, cloud):
    """Recall against the exact scan while a question meets a small share of the vectors; among them many equal ones."""
    held, asked = cloud
    held = np.concatenate([held[:900], np.repeat(held[:1], 300, 0)])
    v, q, root = vectors_of(spark, held), questions_of(spark, asked[:20]), f"file://{tmp_path}/graph"
    G.NeighbourGraph.build(v, root, rounds=1)
    graph = G.NeighbourGraph.open(spark, root)
    links = graph.version.table("links").collect()
    assert len(links) == 1200 and max(len(r.others) for r in links) <= G.LINKS and all(r.node not in r.others for r in links)
    met = graph.met(q).cache()
    assert met.groupBy("question_id", "node").count().where("count > 1").isEmpty() and met.count() < 0.5 * 20 * 1200
    truth = {r.question_id: r.least for r in N.exact(q, v, 10).groupBy("question_id").agg(F.min("vector_score").alias("least")).collect()}
    first = graph.search(q, 10).collect()
    assert np.mean([r.vector_score >= truth[r.question_id] for r in first]) >= 0.95 and len(first) == 200


def test_odd_graphs(spark, tmp_path):
    empty = G.NeighbourGraph.build(spark.createDataFrame([], "chunk_id long, vector array<double>"), f"file://{tmp_path}/a")
    assert empty.search(questions_of(spark, [[1, 2]]), 3).collect() == []
    one = G.NeighbourGraph.build(vectors_of(spark, [[1, 0], [1]]), f"file://{tmp_path}/b", rounds=1)
    assert [r.chunk_id for r in one.search(questions_of(spark, [[1, 2], [3]]), 3).collect()] == [0]
