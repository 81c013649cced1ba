"""Vector index tables: one partition for each user, replaced whole, with their facts beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.operators.neighbours import FLAT_BELOW
from chunkloom.sources.versions import Version, Versions

#: Parts in which a user's rows are numbered, so that no user is one task's work.
NUMBERED_PARTS = 64


def write_index(vectors: DataFrame, path: str) -> None:
    """Replaces the partitions of the users given and leaves the others; the committer makes it all or nothing."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(path)


def index_facts(vectors: DataFrame, kind: str = "flat") -> DataFrame:
    """user_id, index_type, dimension, num_vectors: what an index holds."""
    return vectors.groupBy("user_id").agg(F.lit(kind).alias("index_type"), F.max(F.size("vector")).alias("dimension"), F.count(F.lit(1)).alias("num_vectors"))


def read_index(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    index = spark.read.parquet(path)
    return index if user_id is None else index.where(F.col("user_id") == user_id)


class UserIndexes:
    """The vector rows of all users as one versioned table: users are replaced or removed whole, readers keep the version they opened.

    A version holds segments of rows and one small table, `users`: which segment is a user's own, and what it holds. Rows that a later
    segment replaced, and those of users that are gone, are rows of no one until `compact` leaves them out.
    """

    def __init__(self, spark: SparkSession, root: str, version: Version | None = None):
        self.spark, self.store = spark, Versions(spark, root)
        self.version = version or self.store.current()

    def users(self) -> DataFrame:
        """user_id, segment, index_type, dimension, num_vectors of every user that has vectors."""
        if self.version is None:
            return self.spark.createDataFrame([], "user_id long, segment int, index_type string, dimension int, num_vectors long")
        return self.version.table("users")

    def rows(self, user_id: int | None = None) -> DataFrame:
        """user_id, position, chunk_id, document_id, vector. A position is the place of a row in its user's index, from 0."""
        if self.version is None:
            return self.spark.createDataFrame([], "user_id long, position long, chunk_id long, document_id long, vector array<double>")
        parts = [self.version.table(f"rows-{i}").withColumn("segment", F.lit(i)) for i in range(self.version.facts["segments"])]
        held = reduce(DataFrame.unionByName, parts)
        users = self.users().select("user_id", "segment")
        if user_id is not None:
            held, users = held.where(F.col("user_id") == user_id), users.where(F.col("user_id") == user_id)
        return held.join(users, ["user_id", "segment"], "left_semi").select("user_id", "position", "chunk_id", "document_id", "vector")

    def chunk_ids(self, hits: DataFrame) -> DataFrame:
        """hits(user_id, position, ...) with the chunk and document that stand there; positions that a user's index doesn't have are left out."""
        return hits.join(self.rows().select("user_id", "position", "chunk_id", "document_id"), ["user_id", "position"])

    def replace(self, vectors: DataFrame, users: DataFrame | None = None) -> UserIndexes:
        """A version in which each of users(user_id) has just the given vectors(user_id, chunk_id, document_id, vector); without any, it has no index any more.

        users: by default those of the vectors. Other users' rows stay as they are, unread.
        """
        named = (vectors if users is None else users).select(F.col("user_id").cast("long").alias("user_id")).where("user_id is not null").distinct()
        new = vectors.where(F.size("vector") > 0).select(F.col("user_id").cast("long").alias("user_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), F.col("vector").cast("array<double>").alias("vector"))
        segment = self.version.facts["segments"] if self.version else 0
        rows = self.store.write(f"rows-{segment}", _numbered(new.join(named, "user_id", "left_semi")))
        own = self.store.read(rows).groupBy("user_id").agg(F.lit(segment).alias("segment"), F.max(F.size("vector")).alias("dimension"), F.count(F.lit(1)).alias("num_vectors"))
        own = own.select("user_id", "segment", F.when(F.col("num_vectors") < FLAT_BELOW, "flat").otherwise("ivf").alias("index_type"), "dimension", "num_vectors")
        tables = dict(self.version.tables) if self.version else {}
        tables |= {f"rows-{segment}": rows, "users": self.users().join(named, "user_id", "left_anti").unionByName(own)}
        return UserIndexes(self.spark, self.store.root, self.store.publish(tables, {"segments": segment + 1}, self.version))

    def compact(self) -> UserIndexes:
        """A version with one segment that holds no row of no one."""
        rows = self.store.write("rows-0", self.rows())
        users = self.users().withColumn("segment", F.lit(0))
        return UserIndexes(self.spark, self.store.root, self.store.publish({"rows-0": rows, "users": users}, {"segments": 1}, self.version))

    def differences(self, leaves: DataFrame) -> DataFrame:
        """leaves(user_id, chunk_id) that should be indexed -> user_id, chunk_id, state: `missing` from the index, or `stale` in it."""
        held, wanted = self.rows().select("user_id", "chunk_id"), leaves.select("user_id", "chunk_id").distinct()
        missing = wanted.join(held, ["user_id", "chunk_id"], "left_anti").withColumn("state", F.lit("missing"))
        return missing.unionByName(held.join(wanted, ["user_id", "chunk_id"], "left_anti").withColumn("state", F.lit("stale")))

    def repair(self, vectors: DataFrame) -> UserIndexes:
        """A version in which every user whose index differs from vectors(user_id, chunk_id, document_id, vector) is rebuilt from them; this one if none does."""
        held = vectors.where(F.size("vector") > 0)
        users = self.differences(held).select("user_id").distinct()
        path = self.store.write("differing", users)
        users = self.store.read(path)
        return self if users.isEmpty() else self.replace(held.join(users, "user_id", "left_semi"), users)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with position: numbers from 0 without gaps for each user. Parts of a user are numbered by themselves, then moved behind each other."""
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(NUMBERED_PARTS)).cast("int")
    parted = rows.withColumn("part", part)
    sizes = parted.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))  # NUMBERED_PARTS rows a user
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("user_id", "part", F.coalesce(before, F.lit(0)).alias("first"))
    placed = parted.withColumn("at", F.row_number().over(Window.partitionBy("user_id", "part").orderBy("chunk_id")) - 1)
    return placed.join(first, ["user_id", "part"]).select("user_id", (F.col("first") + F.col("at")).alias("position"), "chunk_id", "document_id", "vector")


def write_results(results: DataFrame, path: str, baseline: str | None = None) -> None:
    """Evaluation results as JSON lines; the baseline file leaves the found ids out."""
    results.write.mode("overwrite").json(path)
    if baseline:
        results.drop("found").write.mode("overwrite").json(baseline)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A YAML question set: id, category, difficulty, question, expected_chunk_ids, expected_keywords, ground_truth_answer."""
    import yaml

    with open(path, encoding="utf-8") as f:  # a small configuration file on the driver
        loaded = yaml.safe_load(f) or []
    rows = loaded.get("questions", loaded.get("testset", [])) if isinstance(loaded, dict) else loaded
    schema = "id string, category string, difficulty string, question string, expected_chunk_ids array<bigint>, expected_keywords array<string>, ground_truth_answer string"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) if n != "id" else str(r.get("id")) for n in names) for r in rows], schema)
