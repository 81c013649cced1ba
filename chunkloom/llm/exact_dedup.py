"""Exact duplicates: static binary-fuse filters of immutable snapshots screen incoming digests.

A corpus arrives as batches. The digests of each batch are grouped among themselves first; of every earlier snapshot
there is one filter per digest bucket. A digest that no filter admits is new. Those admitted join the snapshots' exact
buckets on the whole digest, and the texts of documents that share a digest are compared byte by byte.

Equal texts are those identical after lower-casing A-Z only. Defined results: null text counts as empty; a null doc_id is
never the one that stays unless all are null (then keep_id is null); repeated rows count as copies of each other; very long
texts are hashed and compared whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import fuse_filter
from chunkloom.llm.common import documents, map_rows, materialise, outlive, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests of one bucket, on average; a bucket's filter and its incoming digests are one task's work.
BUCKET_DIGESTS = 250_000
#: Documents in groups up to which their ids and digests (some 100 bytes each in memory: 100 MB) are broadcast to the scan that fetches their texts.
BROADCAST_ROWS = 1_000_000
#: Copies of one text that one task compares; a larger group is dealt to as many tasks as it needs.
SALT_ROWS = 50_000


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def digests(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, digest of the text in UTF-8 after lower-casing A-Z; with `texts`, that text as normal."""

    def work():
        def step(batch):
            normal = [(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # bytes.lower() touches A-Z only
            columns = [batch.column("doc_id"), pa.array([digest(t) for t in normal], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(normal, pa.binary()).cast(pa.string())][: 2 + texts], ["doc_id", "digest", "normal"][: 2 + texts])

        return step

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, digest binary" + ", normal string" * texts)


def _key(column: pa.ChunkedArray) -> np.ndarray:
    """The first 8 bytes of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), ">u8").astype(np.uint64)


def build_filters(groups: DataFrame) -> DataFrame:
    """groups(batch, bucket, digest) -> batch, bucket, filter: one static filter for each bucket of each batch."""

    def build(table: pa.Table) -> pa.Table:
        data = fuse_filter.build(_key(table.column("digest")))
        return pa.table({"batch": table.column("batch").slice(0, 1), "bucket": table.column("bucket").slice(0, 1), "filter": pa.array([data], pa.binary())})

    return groups.select("batch", "bucket", "digest").groupBy("batch", "bucket").applyInArrow(build, "batch int, bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows (batch, bucket, digest) that a filter of an earlier snapshot admits; all others are certainly new."""

    def probe(own: pa.Table, held: pa.Table) -> pa.Table:
        batch, keys = own.column("batch").to_numpy(), _key(own.column("digest"))
        hit = np.zeros(len(keys), bool)
        for snapshot, data in zip(held.column("batch").to_pylist(), held.column("filter").to_pylist()):
            later = np.flatnonzero(batch > snapshot)
            hit[later] |= fuse_filter.probe(data, keys[later])
        return own.filter(pa.array(hit)).select(["batch", "digest"])

    return incoming.select("batch", "bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "batch int, digest binary")


def exact_groups(hashed: DataFrame, n_buckets: int) -> DataFrame:
    """hashed(doc_id, digest, batch) -> digest, keep_id, group_size for every digest held by several documents."""
    spread = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")
    groups = materialise(hashed.groupBy("batch", "digest").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).withColumn("bucket", spread), "groups")
    positives = materialise(screen(groups, build_filters(groups)), "positives")
    exact = groups.alias("g").join(positives.select("digest").distinct().alias("p"), "digest", "left_semi")
    alone = groups.join(positives.select("digest").distinct(), "digest", "left_anti").where("n > 1")
    merged = exact.groupBy("digest").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    return merged.unionByName(alone.select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size")))


def deduplicate(docs: DataFrame, batches: int = 3, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256 (the digest in hex), one row per row of docs.

    `batches`: the table is taken as so many arrivals (by a hash of doc_id); each is frozen as a snapshot for the later ones.
    `digest`: at least 8 bytes for a text; texts that share one are told apart by their bytes, however weak it is.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    with scratch():
        hashed = outlive(materialise(digests(docs, digest).withColumn("batch", batch), "digests"))
        n_buckets = max(1, -(-hashed.count() // BUCKET_DIGESTS)) * batches
        groups = outlive(materialise(exact_groups(hashed, n_buckets), "exact"))
        members = materialise(hashed.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size"), "members")
        checked = _byte_checked(docs, members)
        clash = not checked.where("not same").isEmpty()
        if clash:
            groups = outlive(materialise(_regrouped(digests(docs, digest, texts=True), checked, groups), "regrouped"))
    if clash:
        keyed = _with_text_key(digests(docs, digest, texts=True), groups)
    else:
        keyed = hashed.join(groups, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return keyed.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _normal(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def _byte_checked(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members with same: whether the text equals, byte for byte, that of the document that stays."""
    small = members.count() <= BROADCAST_ROWS
    parts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    ids = members.select("doc_id", "digest", "keep_id", parts.alias("parts")).where("doc_id is not null").distinct()
    texts = docs.select("doc_id", _normal().alias("normal")).join(F.broadcast(ids) if small else ids, "doc_id")
    texts = materialise(texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int")), "texts")
    kept = texts.where("doc_id = keep_id").groupBy("doc_id", "digest", "parts").agg(F.max("normal").alias("first_normal")).withColumnRenamed("doc_id", "keep_id")
    kept = materialise(kept, "kept").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return materialise(texts.join(kept, ["keep_id", "digest", "salt"]).select("digest", (F.col("normal") == F.col("first_normal")).alias("same")), "checked")


def _regrouped(texts: DataFrame, checked: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups whose digest covers different texts are grouped anew by the text itself (column normal; null elsewhere)."""
    clash = checked.where("not same").select("digest").distinct()
    again = texts.join(clash, "digest", "left_semi")
    again = again.groupBy("digest", "normal").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.join(clash, "digest", "left_anti").withColumn("normal", F.lit(None).cast("string")).unionByName(again, allowMissingColumns=True)


def _with_text_key(texts: DataFrame, groups: DataFrame) -> DataFrame:
    texts = texts.withColumnRenamed("normal", "own")
    same = (texts.digest == groups.digest) & (groups.normal.isNull() | (groups.normal == texts.own))
    return texts.join(groups, same, "left").select(texts.doc_id, texts.digest, "keep_id", "group_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), grouped AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM normal n JOIN grouped g ON n.t = g.t
"""
