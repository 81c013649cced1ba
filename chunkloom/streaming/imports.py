"""Import as a stream: files dropped into a folder become chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators import chunking as C
from chunkloom.sources import parsers as P
from chunkloom.streaming.states import first_files


def import_batch(files: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """files(path, file_type, content[, user_id]) -> chunks of all files that can be read; equal files are imported once (by each user)."""
    keys = ["user_id"] if "user_id" in files.columns else []
    once = files.withColumn("file_md5", F.md5("content")).groupBy(*keys, "file_md5").agg(F.min_by(F.struct("path", "file_type", "content"), "path").alias("f"))
    parsed = P.parse_rows(once.select("f.*"))
    cut = P.segments(parsed.withColumnRenamed("path", "document_id"), "document_id")
    return C.hierarchy(cut, size, overlap)


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, once: bool = False) -> StreamingQuery:
    """Reads new files, writes each micro-batch's chunks under its own number (a repeated batch replaces itself).

    A file's user is the folder that it lies in; a file that its user has had before, in any batch, is not imported again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        chunks = import_batch(batch.select("user_id", "path", "file_type", "content"))
        chunks.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after:
            after(spark.read.parquet(f"{target}/batch={number}"))

    owned = stream.select(F.element_at(F.split("path", "/"), -2).alias("user_id"), "path", P.file_type("path").alias("file_type"), "content")
    writer = first_files(owned).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
