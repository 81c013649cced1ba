"""Keyed state on streams against the batch computations over the same events."""

import datetime as dt
import random

import pytest

from chunkloom.operators import records as D
from chunkloom.streaming import states as S

T0 = dt.datetime(2024, 1, 1)
RUNS = "run_id long, step_id long, status string, started_at timestamp"


def feed(spark, folder, batches, schema, first=0):
    """Each batch as one file, in order of arrival."""
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(query):
    assert query.awaitTermination(240)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_in_any_order_as_the_batch(spark, tmp_path):
    """Shuffled, repeated and late events in four micro-batches, with a restart in between."""
    rng = random.Random(4)
    steps = [(r, r * 100 + i, "failed" if (r + i) % 5 == 0 else "completed", T0 + dt.timedelta(minutes=r + 7 * i)) for r in range(12) for i in range(1 + r % 4)]
    events = [*steps, *[(r, i, "running", t) for r, i, _, t in steps], *rng.sample(steps, 10)]
    rng.shuffle(events)
    folder, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    quarter = len(events) // 4 + 1
    parts = [events[i : i + quarter] for i in range(0, len(events), quarter)]
    for first, part in ((0, parts[:2]), (10, parts[2:])):  # the second start goes on from the checkpoint
        feed(spark, folder, part, RUNS, first)
        run(S.written(S.run_states(stream(spark, folder, RUNS)), target, checkpoint))
    got = {r.run_id: (r.status, r.n_steps, r.n_failed, r.started_at, r.finished_at) for r in S.latest(spark, target, "run_id", S.RUN_ROWS).collect()}
    want = {r.run_id: (r.status, r.n_steps, r.n_failed, r.started_at, r.finished_at) for r in D.run_states(spark.createDataFrame(steps, RUNS)).collect()}
    assert got == want


def test_open_steps_fail_by_timer(spark, tmp_path):
    """Step 2 of run 1 never ends: event time passes and it fails; a late word that it completed is believed."""
    folder, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    feed(spark, folder, [[(1, 1, "completed", at(0)), (1, 2, "running", at(1))], [(2, 9, "completed", at(300))], [(2, 10, "completed", at(301))]], RUNS)

    def state():
        run(S.written(S.run_states(stream(spark, folder, RUNS), open_seconds=600, lateness="1 minute"), target, checkpoint))
        r = S.latest(spark, target, "run_id", S.RUN_ROWS).where("run_id = 1").first()
        return r.status, r.n_failed, r.n_open

    assert state() == ("failed", 1, 0)


IMPORTS = "document_id long, kind string, chunk_id long, total long"


def test_imports_in_any_order(spark, tmp_path):
    """Settled as the batch settles them; stages never lead back; a chunk that succeeds at last isn't failed."""
    chunks = {1: [None] * 3, 2: ["x"] * 2, 3: ["x", None], 4: [None, None]}
    events = [(d, "chunks", None, len(c)) for d, c in chunks.items()] + [(d, s, None, None) for d in chunks for s in ("parsing", "embedding", "parsed")]
    events += [(d, "chunk_error" if e else "embedded", d * 10 + i, None) for d, c in chunks.items() for i, e in enumerate(c)] + [(1, "chunk_error", 10, None), (3, "chunk_error", 30, None)]
    events = [e for e in events if e[:3] != (4, "embedded", 41)] + [(5, "parse_failed", None, None), (5, "parsing", None, None), (None, "parsing", None, None)]
    rng = random.Random(9)
    events += rng.sample(events, 6)
    rng.shuffle(events)
    folder, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    feed(spark, folder, [events[:9], events[9:20], events[20:]], IMPORTS)
    run(S.written(S.import_states(stream(spark, folder, IMPORTS)), target, checkpoint))
    got = {r.document_id: (r.status, r.total_chunks, r.processed_chunks, r.failed_chunks) for r in S.latest(spark, target, "document_id", S.IMPORT_ROWS).collect()}
    rows = [(d, d * 10 + i, e) for d, c in chunks.items() for i, e in enumerate(c) if d < 4]
    batch = D.settle_import(spark.createDataFrame([(d,) for d in (1, 2, 3)], "id long"), spark.createDataFrame(rows, "document_id long, chunk_id long, error string"))
    want = {r.id: (r.status, r.total_chunks, r.processed_chunks, r.failed_chunks) for r in batch.collect()}
    assert {d: got[d] for d in (1, 2, 3)} == want and got[4] == ("embedding", 2, 1, 0) and got[5][0] == "parse_failed"


def test_equal_files_come_in_once_a_user(spark, tmp_path):
    schema = "user_id string, path string, file_type string, content binary"
    folder, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    one, two = bytearray(b"one"), bytearray(b"two")
    feed(spark, folder, [[("a", "/a/2", "txt", one), ("a", "/a/1", "txt", one), ("b", "/b/1", "txt", one)], [("a", "/a/3", "txt", one), ("a", "/a/4", "txt", two), (None, "/n", "txt", one)]], schema)

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = S.first_files(stream(spark, folder, schema)).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run(query)
    assert sorted((r.user_id, r.path) for r in spark.read.parquet(target).collect()) == [("", "/n"), ("a", "/a/1"), ("a", "/a/4"), ("b", "/b/1")]


def test_watched_folder_takes_equal_files_once(spark, tmp_path):
    """A second batch with a file that is there already yields no chunks; another user's is its own."""
    from chunkloom.streaming import imports

    def drop(name, text):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    def go():
        run(imports.watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True))
        return sorted({r.document_id.split("/in/")[1] for r in spark.read.parquet(f"{tmp_path}/out").collect()})

    drop("anna/a.txt", "Some words.")
    assert go() == ["anna/a.txt"]
    drop("anna/b.txt", "Some words.")
    drop("ben/c.txt", "Some words.")
    drop("anna/d.txt", "Other words.")
    assert go() == ["anna/a.txt", "anna/d.txt", "ben/c.txt"]
