"""Runs and imports as keyed state on a stream of events.

Events may come late, more than once and in any order; the state of a run is that of the set of its events, so the rows that
come out last are those of the batch queries over the same events. The state is kept by Spark under the stream's checkpoint:
a stream started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How good a later word on a step is: what ended stays ended, a failure outweighs all.
WORTH = {"running": 0, "completed": 1, "failed": 2}
#: Seconds of event time after the last event of a run until its open steps count as failed.
OPEN_SECONDS = 3600
RUN_ROWS = "run_id long, version long, status string, n_steps long, n_failed long, n_open long, started_at timestamp, finished_at timestamp"
_RUN_STATE = "version long, steps array<long>, began array<timestamp>, status array<string>, timed_out boolean"


def _run_row(run: int, version: int, steps: dict[int, tuple[pd.Timestamp, str]]) -> pd.DataFrame:
    last = max(steps, key=lambda s: (steps[s][0], s))
    states = [x for _, x in steps.values()]
    times = [t for t, _ in steps.values()]
    return pd.DataFrame({"run_id": [run], "version": [version], "status": [steps[last][1]], "n_steps": [len(steps)], "n_failed": [states.count("failed")], "n_open": [states.count("running")], "started_at": [min(times)], "finished_at": [max(times)]})


def run_states(events: DataFrame, open_seconds: int = OPEN_SECONDS, lateness: str = "7 days") -> DataFrame:
    """events(run_id, step_id, status, started_at), a stream -> the state of each run that changed (RUN_ROWS), a higher version for each change.

    A step has the best-worth status heard of it, and the earliest start. When event time has passed the last event of a run by `open_seconds`, its
    open steps become failed; a late event that says how such a step ended is believed. A run's state holds its steps, a few numbers each.
    """

    def advance(key: tuple[int], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, began, status, timed_out = state.get if state.exists else (0, [], [], [], False)
        steps = {i: (pd.Timestamp(t), s) for i, t, s in zip(ids, began, status)}
        before = dict(steps)
        if state.hasTimedOut:
            steps = {i: (t, "failed" if s == "running" else s) for i, (t, s) in steps.items()}
            timed_out = True
        else:
            for rows in batches:
                for i, t, s in zip(rows["step_id"], rows["started_at"], rows["status"]):
                    held = steps.get(i)
                    if held is None:
                        steps[i] = (t, s)
                    else:  # what the timer failed is taken back by a word on how it ended
                        taken = s if WORTH[s] > WORTH[held[1]] or (timed_out and held[1] == "failed" and s == "completed") else held[1]
                        steps[i] = (min(t, held[0]), taken)
        if steps != before:
            version += 1
            yield _run_row(key[0], version, steps)
        if not steps:
            return
        state.update((version, list(steps), [t.to_pydatetime() for t, _ in steps.values()], [s for _, s in steps.values()], timed_out))
        if any(s == "running" for _, s in steps.values()):
            due = int(max(t for t, _ in steps.values()).timestamp() * 1000) + open_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    told = events.where("run_id is not null and step_id is not null and started_at is not null").withColumn("status", F.when(F.col("status").isin(*WORTH), F.col("status")).otherwise("running"))
    told = told.select(F.col("run_id").cast("long"), F.col("step_id").cast("long"), "status", "started_at").withWatermark("started_at", lateness)
    return told.groupBy("run_id").applyInPandasWithState(advance, RUN_ROWS, _RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


IMPORT_ROWS = "document_id long, version long, status string, total_chunks long, processed_chunks long, failed_chunks long"
_IMPORT_STATE = "version long, total long, done array<long>, failed array<long>, stage string, stage_at long"
#: States of a document on its way, in their order; a later event can't lead back.
STAGES = ("uploaded", "parsing", "parsed", "chunking", "chunked", "embedding", "indexing")


def import_states(events: DataFrame) -> DataFrame:
    """events(document_id, kind, chunk_id, total), a stream -> the state of each document that changed (IMPORT_ROWS).

    kind: a stage of STAGES, `upload_failed`, `parse_failed` or `chunk_failed`, `chunks` (total: how many there will be), `embedded` or `chunk_error` (of one
    chunk; a later success of it counts). A document is settled when every chunk is: embed_failed if all failed, else ready.
    """

    def advance(key: tuple[int], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, total, done, failed, stage, at = state.get if state.exists else (0, -1, [], [], "uploaded", 0)
        done, failed = set(done), set(failed)
        before = (total, frozenset(done), frozenset(failed), stage) if state.exists else None
        for rows in batches:
            for kind, chunk, n in zip(rows["kind"], rows["chunk_id"], rows["total"]):
                if kind == "embedded":
                    done.add(int(chunk))
                elif kind == "chunk_error":
                    failed.add(int(chunk))
                elif kind == "chunks":
                    total = max(total, int(n))
                elif kind in STAGES and STAGES.index(kind) > at and at < len(STAGES):
                    stage, at = kind, STAGES.index(kind)
                elif kind in ("upload_failed", "parse_failed", "chunk_failed"):
                    stage, at = (min(stage, kind) if at == len(STAGES) else kind), len(STAGES)  # of several failures always the same one
        lost = failed - done
        if (total, frozenset(done), frozenset(failed), stage) != before:
            version += 1
            settled = total > 0 and len(done) + len(lost) >= total and at < len(STAGES)
            shown = ("embed_failed" if not done else "ready") if settled else stage
            yield pd.DataFrame({"document_id": [key[0]], "version": [version], "status": [shown], "total_chunks": [max(total, 0)], "processed_chunks": [len(done)], "failed_chunks": [len(lost)]})
        state.update((version, total, sorted(done), sorted(failed), stage, at))

    told = events.where("document_id is not null and kind is not null").select(F.col("document_id").cast("long"), "kind", F.coalesce(F.col("chunk_id").cast("long"), F.lit(-1)).alias("chunk_id"), F.coalesce(F.col("total").cast("long"), F.lit(-1)).alias("total"))
    return told.groupBy("document_id").applyInPandasWithState(advance, IMPORT_ROWS, _IMPORT_STATE, "update", GroupStateTimeout.NoTimeout)


def first_files(files: DataFrame) -> DataFrame:
    """files(user_id, path, file_type, content), a stream -> those whose user has not had an equal file before, in this batch or an earlier one; of equal ones in a batch the first path.

    The state of a (user, digest of the content) is the path that came in.
    """

    def advance(key: tuple[str, str], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        first = None
        for rows in batches:
            own = rows.sort_values("path").head(1)
            first = own if first is None or own["path"].iloc[0] < first["path"].iloc[0] else first
        if first is not None:
            state.update((first["path"].iloc[0],))
            yield first[["user_id", "path", "file_type", "content", "file_md5"]]

    keyed = files.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id"), "path", "file_type", "content", F.md5("content").alias("file_md5"))
    schema = "user_id string, path string, file_type string, content binary, file_md5 string"
    return keyed.groupBy("user_id", "file_md5").applyInPandasWithState(advance, schema, "path string", "append", GroupStateTimeout.NoTimeout)


def written(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream of states gives, each micro-batch under its own number (a repeated batch replaces itself), until the input is used up."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str, schema: str) -> DataFrame:
    """The last state of each key that `written` has put down."""
    order = Window.partitionBy(key).orderBy(F.desc("version"))
    held = spark.read.schema(f"{schema}, batch long").parquet(target)
    return held.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at", "batch")
