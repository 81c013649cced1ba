"""Documents, imports, sessions and runs: scans, look-ups, states, nestings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T

# Document states and the progress each of them shows.
FAILED_STATES = ("upload_failed", "parse_failed", "chunk_failed", "embed_failed")
PROGRESS = {"uploaded": 5, "parsing": 5, "parsed": 5, "chunking": 5, "chunked": 30, "indexing": 95, "ready": 100}
FAILED_PROGRESS = {"upload_failed": None, "parse_failed": 10, "chunk_failed": 25, "embed_failed": 30}


def in_list(column: str, values: list | None) -> Column:
    """Membership; an empty or missing list is no filter."""
    return F.col(column).isin(values) if values else F.lit(True)


def user_leaves(chunks: DataFrame, documents: DataFrame, user_id: int, document_ids: list | None = None) -> DataFrame:
    """Leaf chunks of a user's own documents, both sides of the join filtered, in document and chunk order."""
    own = chunks.where((F.col("user_id") == user_id) & (F.col("chunk_role") == "leaf") & in_list("document_id", document_ids))
    held = documents.where(F.col("user_id") == user_id).select("document_id", "document_name")
    return own.drop("document_name").join(held, "document_id").orderBy("document_id", "chunk_index")


def by_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(list_id, ids) -> rows in the order of each list; ids that do not exist are left out."""
    placed = wanted.select("list_id", F.posexplode("ids").alias("place", key))
    return placed.join(rows, key).orderBy("list_id", "place")


def newest_duplicates(documents: DataFrame) -> DataFrame:
    """The newest ready document of each user and file digest."""
    w = Window.partitionBy("user_id", "file_md5").orderBy(F.desc("id"))
    return documents.where("status = 'ready'").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def progress(status: Column, done: Column, total: Column) -> Column:
    """Per cent of an import: by state, and by chunks while embedding."""
    table = {k: v for k, v in {**PROGRESS, **FAILED_PROGRESS}.items() if v is not None}
    shown = F.when(status == "embedding", F.lit(30) + F.when(total > 0, F.least(F.lit(60), F.floor(done * 60 / total).cast("int"))).otherwise(0))
    for state, value in table.items():
        shown = shown.when(status == state, value)
    return shown.cast("int")


def dead_letters(chunks: DataFrame, error: str = "error") -> DataFrame:
    """Chunks whose step failed, with 500 characters to recognise them by."""
    return chunks.where(F.col(error).isNotNull()).select("document_id", "chunk_id", F.col(error).alias("error_message"), F.left("content", F.lit(500)).alias("preview"), F.lit(0).alias("retry_count"))


def settle_import(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """State after embedding: failed only if every leaf failed; ready with a note if some did."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.count("error").alias("failed_chunks"))
    state = F.when(F.col("total_chunks") == F.col("failed_chunks"), "embed_failed").otherwise("ready")
    return documents.join(counts, documents.id == counts.document_id).select("id", state.alias("status"), "total_chunks", (F.col("total_chunks") - F.col("failed_chunks")).alias("processed_chunks"), "failed_chunks")


def latest_steps(steps: DataFrame) -> DataFrame:
    """Of each run its newest step."""
    w = Window.partitionBy("run_id").orderBy(F.desc("started_at"), F.desc("step_id"))
    return steps.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def run_states(steps: DataFrame) -> DataFrame:
    """State of every run: failed if its last step failed; how many steps it has and when it began and ended."""
    return steps.groupBy("run_id").agg(F.max_by("status", F.struct("started_at", "step_id")).alias("status"), F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.min("started_at").alias("started_at"), F.max("started_at").alias("finished_at"))


def step_durations(steps: DataFrame) -> DataFrame:
    """Seconds from each step to the next of its run (NULL for the last)."""
    w = Window.partitionBy("run_id").orderBy("started_at", "step_id")
    gap = (F.unix_micros(F.lead("started_at").over(w)) - F.unix_micros("started_at")) / 1e6
    return steps.withColumn("seconds", F.round(gap, 6))


def fail_open_steps(steps: DataFrame, failed_runs: DataFrame) -> DataFrame:
    """Steps still running in a failed run become failed."""
    marked = steps.join(failed_runs.select("run_id", F.lit(True).alias("run_failed")), "run_id", "left")
    return marked.withColumn("status", F.when((F.col("status") == "running") & F.coalesce("run_failed", F.lit(False)), "failed").otherwise(F.col("status"))).drop("run_failed")


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Each parent with its children as an ordered array of structs (empty if none)."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def chat_history(messages: DataFrame, preview: int | None = None) -> DataFrame:
    """Whole messages (or their first `preview` characters) of each session, system messages first, then by turn, as one text; title from the first message."""
    content = lambda x: x.content if preview is None else F.left(x.content, F.lit(preview))
    row = F.struct(F.when(F.col("role") == "system", 0).otherwise(1).alias("a"), "turn", "role", "content")
    own = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("m"), F.count(F.lit(1)).alias("n_messages"), F.min_by("content", "turn").alias("first_message"))
    said = F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit(": "), content(x))), "\n")
    return own.select("session_id", "n_messages", T.session_title(F.lit(""), "first_message").alias("title"), said.alias("history"))


def without_document(rows: DataFrame, removed: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of documents that are not removed (a delete with its cascade is this, written over)."""
    return rows.join(removed.select(key), key, "left_anti")


def has_rows(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """keys with in_use: whether any row has the key (what is in use may not be deleted). Each key is looked up once, whatever its number of rows."""
    held = rows.select(key).distinct().withColumn("in_use", F.lit(True))
    return keys.join(held, key, "left").withColumn("in_use", F.coalesce("in_use", F.lit(False)))


def owned(wanted: DataFrame, rows: DataFrame, key: str, owner: str) -> DataFrame:
    """wanted(key, owner) with the row of that key if it is the owner's, and status 200, or 404 where there is none."""
    found = rows.withColumn("status", F.lit(200))
    return wanted.join(found, [key, owner], "left").withColumn("status", F.coalesce("status", F.lit(404)))
