"""Tables that change by whole versions: immutable folders, and numbered manifests of which the last one counts.

A version names its tables (folders, old or new) and carries facts about them. Publishing writes new folders first and then
claims the next number by one rename that fails if the number is taken: a reader sees either all of a version or nothing of
it, two writers that started from the same version can't both win, and a writer that dies leaves only folders that no
manifest names. Readers are pinned: what `current` or `at` returned goes on reading the same files while versions come.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_PREFIX, _DIGITS = "manifest-", 10


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


def shared_dir(spark: SparkSession) -> str:
    """The folder every node sees: spark.checkpoint.dir, or one of our own where it is unset and everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("chunkloom.local.checkpoint", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("chunkloom.local.checkpoint", root)
    return root.rstrip("/")


@dataclass(frozen=True)
class Version:
    """One version, pinned: number, facts, and the folder of each table."""

    spark: SparkSession
    root: str
    number: int
    tables: dict[str, dict[str, str]]
    facts: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The table, with the schema it was written with, so that an empty one can be read too."""
        held = self.tables[name]
        return self.spark.read.schema(held["schema"]).parquet(f"{self.root}/{held['path']}")


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._context = self._fs.FileContext.getFileContext(jvm.java.net.URI(self.root), spark._jsc.hadoopConfiguration())
        self._files = self._fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions, oldest first; manifests that a writer hasn't claimed a number for don't count."""
        folder = self._fs.Path(self.root)
        if not self._files.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        return sorted(int(n[len(_PREFIX) : -5]) for n in names if n.startswith(_PREFIX) and n.endswith(".json") and n[len(_PREFIX) : -5].isdigit())

    def current(self) -> Version | None:
        return self.at(numbers[-1]) if (numbers := self.numbers()) else None

    def at(self, number: int) -> Version:
        stream = self._files.open(self._fs.Path(self._manifest(number)))
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(self.spark, self.root, number, held["tables"], held["facts"])

    def write(self, name: str, df: DataFrame, by: list[str] | None = None) -> dict[str, str]:
        """A table in a folder of its own, for a version to be published; it may be read before."""
        by = by or []
        path = f"{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.root}/{path}")
        fields = [f for f in df.schema.fields if f.name not in by] + [f for f in df.schema.fields if f.name in by]  # as Spark reads partition columns
        return {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)}

    def read(self, held: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(held["schema"]).parquet(f"{self.root}/{held['path']}")

    def publish(self, tables: Mapping[str, DataFrame | tuple[DataFrame, list[str]] | dict[str, str]], facts: dict, after: Version | None) -> Version:
        """Write a version that follows `after` (None: the first).

        tables: new ones as DataFrames, with the columns of their partition folders if they have any, and entries of `after.tables` that go on.
        """
        entries = {}
        for name, given in tables.items():
            df, by = given if isinstance(given, tuple) else (given, [])
            entries[name] = given if isinstance(given, dict) else self.write(name, df, by)
        number = after.number + 1 if after else 0
        tmp = self._fs.Path(f"{self.root}/.{uuid.uuid4().hex}.json")
        out = self._files.create(tmp, False)
        try:
            out.write(bytearray(json.dumps({"tables": entries, "facts": facts}).encode()))
        finally:
            out.close()
        try:  # without OVERWRITE: fails if the number is taken
            self._context.rename(tmp, self._fs.Path(self._manifest(number)), self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._files.delete(tmp, False)
            if "AlreadyExists" in str(e.java_exception.getClass()):
                raise Conflict(f"version {number} of {self.root} is there already") from e
            raise
        return Version(self.spark, self.root, number, entries, facts)

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last `keep` versions and delete the folders that none of these names; returns how many went.

        Not beside a writer: folders of a version that isn't published yet would go too. Readers pinned to a version forgotten lose its files.
        """
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._files.delete(self._fs.Path(self._manifest(n)), False)
        named = {t["path"] for n in numbers[-keep:] for t in self.at(n).tables.values()}
        gone = [x.getPath() for x in self._files.listStatus(self._fs.Path(self.root)) if x.isDirectory() and x.getPath().getName() not in named]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)

    def _manifest(self, number: int) -> str:
        return f"{self.root}/{_PREFIX}{number:0{_DIGITS}d}.json"
