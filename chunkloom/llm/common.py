"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir, or one of our own where it is unset and everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("chunkloom.local.checkpoint", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("chunkloom.local.checkpoint", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class _Scratch(threading.local):
    """Tables written inside the scratch blocks of this thread, innermost last."""

    def __init__(self):
        self.held: list[dict[str, DataFrame]] = []


_SCRATCH = _Scratch()


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (by another codec than Spark's, if one is named) and read it again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCRATCH.held:
        _SCRATCH.held[-1][path] = out
    return out


@contextmanager
def scratch():
    """Tables that materialise() writes inside are deleted at the end, but for those that outlive() names."""
    _SCRATCH.held.append({})
    try:
        yield
    finally:
        for path, df in _SCRATCH.held.pop().items():
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def outlive(df: DataFrame) -> DataFrame:
    """df, a table written in the innermost scratch block, handed on to the block around it, or for good where there is none."""
    for path, held in _SCRATCH.held[-1].items():
        if held is df:
            del _SCRATCH.held[-1][path]
            if len(_SCRATCH.held) > 1:
                _SCRATCH.held[-2][path] = df
            break
    return df


def share_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Put a small artefact in the shared folder, hand it to every executor as a Spark file, return its file name."""
    base = f"{name}-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{base}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return base


#: Rows of an Arrow batch that a step works on at once.
SLICE_ROWS = 2_000


def map_rows(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with set-up per task: work() is called once in each task, its result once for every SLICE_ROWS of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        try:
            for batch in batches:
                for at in range(0, max(batch.num_rows, 1), SLICE_ROWS):  # Python's copies of texts and results stay small beside Arrow's
                    out = step(batch.slice(at, SLICE_ROWS))
                    if out is not None:
                        yield out
        finally:
            pa.default_memory_pool().release_unused()  # workers live on from task to task and would hold what Arrow has freed

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null is the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def filter_rows(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, that work()'s step marks true; rows stay in their tasks."""

    def set_up():
        step = work()
        return lambda batch: batch.filter(pa.array(step(batch), pa.bool_()))

    return map_rows(df, set_up, df.schema)


#: Ids up to which a list of documents to drop is broadcast (some 30 bytes each in memory: 120 MB); a longer one is joined by shuffle.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in dropped(doc_id). A row without doc_id stays."""
    ids = materialise(dropped.select("doc_id").where("doc_id is not null").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


#: Rows of one group that one task joins; a larger group is dealt to as many tasks as it needs.
SPLIT_ROWS = 2_000
#: Groups that may be split: the share of the rows from which a group counts as large follows from it, so their list is bounded.
SPLIT_GROUPS = 20_000


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], deal: list[str], n_rows: int) -> DataFrame:
    """rows joined with groups(keys, n = rows of the group among the rows, ...) by keys; rows of a large group are dealt by a hash of `deal`.

    Both are tables; n_rows: all rows. At most SPLIT_GROUPS groups are large; their keys are broadcast, and they are repeated for each part.
    """
    most = max(SPLIT_ROWS, n_rows // SPLIT_GROUPS)
    parts = F.ceil(F.col("n") / most).cast("int")
    large = groups.where(F.col("n") > most).select(*keys, parts.alias("_parts"))
    if large.isEmpty():
        return rows.join(groups, keys)
    part = F.coalesce(F.pmod(F.xxhash64(*deal), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_part", part).drop("_parts")
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, parts - 1).otherwise(0))))
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")
