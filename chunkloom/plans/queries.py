"""Registered queries over the driver's tables, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.functions import understanding as U
from chunkloom.functions import vectors as V
from chunkloom.operators import answers as A
from chunkloom.operators import chunking as C
from chunkloom.operators import evaluation as E
from chunkloom.operators import neighbours as N
from chunkloom.operators import ranking as R
from chunkloom.operators import records as D
from chunkloom.operators.neighbour_graph import NeighbourGraph
from chunkloom.operators.postings import Postings
from chunkloom.operators.vector_index import VectorIndex
from chunkloom.plans import retrieval
from chunkloom.sources import parsers as P
from chunkloom.sources import plugins as M
from chunkloom.sources import tables as S
from chunkloom.sources.versions import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCUMENTS = """kd AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS user_id, source || '/' || doc_id AS name,
    CASE doc_id % 10 WHEN 0 THEN 'embed_failed' WHEN 1 THEN 'embedding' ELSE 'ready' END AS status,
    text AS content_text, md5(text) AS file_md5, CAST(strlen(text) AS BIGINT) AS file_size_bytes, n_chars, lang
  FROM documents)"""
LEAVES = """leaves AS (
  SELECT doc_id AS chunk_id, doc_id // 4 AS document_id, (doc_id // 4) % 3 AS user_id, doc_id % 4 AS chunk_index, doc_id // 4 + 1000000000 AS parent_chunk_id,
    source || '/' || (doc_id // 4) AS document_name, lang AS parent_title, text AS content, CAST(doc_id % 4 + 1 AS INTEGER) AS source_page, 'page_' || (doc_id % 2 + 1) AS source_section
  FROM documents)"""
KEYWORDS = """tok AS (SELECT chunk_id, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM leaves),
tf AS (SELECT chunk_id, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY chunk_id),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT question_id, term FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)),
kw AS (
  SELECT question_id, tf.chunk_id, tf.chunk_index, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS keyword_score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id) CROSS JOIN st GROUP BY 1, 2, 3)"""
USER_KEYWORDS = """tok AS (SELECT user_id, chunk_id, chunk_index, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM leaves),
tf AS (SELECT user_id, chunk_id, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT user_id, chunk_id, count(*) AS dl FROM tok GROUP BY ALL),
st AS (SELECT user_id, count(*) AS n, avg(dl) AS mean FROM dl GROUP BY 1),
df AS (SELECT user_id, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT question_id, question_id % 3 AS user_id, term FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)),
kw AS (
  SELECT question_id, tf.chunk_id, tf.chunk_index, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS keyword_score
  FROM qt JOIN tf ON tf.term = qt.term AND tf.user_id = qt.user_id JOIN df ON df.term = tf.term AND df.user_id = tf.user_id JOIN dl ON dl.chunk_id = tf.chunk_id JOIN st ON st.user_id = tf.user_id GROUP BY 1, 2, 3)"""
VECTORS = """vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
vs AS (
  SELECT item_id AS question_id, x.chunk_id, x.chunk_id % 4 AS chunk_index, round(list_cosine_similarity(q.v, x.v), 6) AS vector_score
  FROM benchmark JOIN vec q ON q.chunk_id = item_id CROSS JOIN vec x WHERE x.chunk_id IN (SELECT doc_id FROM documents))"""
HYBRID = """v20 AS (SELECT * FROM vs WHERE vector_score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_index DESC, chunk_id DESC) <= 20),
k20 AS (SELECT * FROM kw WHERE keyword_score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) <= 20),
vn AS (SELECT question_id, chunk_id, chunk_index, round(vector_score / max(vector_score) OVER (PARTITION BY question_id), 6) AS vector_score FROM v20),
kn AS (SELECT question_id, chunk_id, chunk_index, round(keyword_score / max(keyword_score) OVER (PARTITION BY question_id), 6) AS keyword_score FROM k20),
mixed AS (
  SELECT question_id, chunk_id, chunk_index, coalesce(vector_score, 0.0) AS vector_score, coalesce(keyword_score, 0.0) AS keyword_score, vector_score IS NOT NULL AS by_vector,
    round(0.65 * coalesce(vector_score, 0.0) + 0.35 * coalesce(keyword_score, 0.0) + 1e-9, 6) AS final_score
  FROM vn FULL JOIN kn USING (question_id, chunk_id, chunk_index)),
hy AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, vector_score DESC, keyword_score DESC, chunk_index, chunk_id) AS rank
  FROM mixed WHERE final_score > 0 QUALIFY rank <= 15)"""
SHOWN = """shown AS (
  SELECT question_id, rank, final_score AS score, l.* FROM hy JOIN leaves l USING (chunk_id))"""
SECTION = "CASE WHEN CAST(substr(source_section, 6) AS INTEGER) = source_page THEN '' ELSE '第' || substr(source_section, 6) || '页' END"
SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n。！？；;]*[.!?\n。！？；;]|[^.!?\n。！？；;]+$'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Documents, imports, sessions, runs


@query("q_user_docs_list", _with(DOCUMENTS) + "SELECT id, name, status, file_size_bytes, left(content_text, 120) AS preview FROM kd WHERE user_id = 3 AND status <> 'embed_failed'")
def user_docs_list(spark, d):
    own = S.knowledge_documents(spark, d).where("user_id = 3 and status <> 'embed_failed'").orderBy(F.desc("id"))
    return own.select("id", "name", "status", "file_size_bytes", F.left("content_text", F.lit(120)).alias("preview"))


@query("q_user_leaf_scan", _with(LEAVES) + "SELECT chunk_id, document_id, chunk_index, document_name, CAST(length(content) AS INTEGER) AS n FROM leaves l JOIN (SELECT document_id, min(document_name) AS dn FROM leaves WHERE user_id = 1 GROUP BY 1) USING (document_id) WHERE user_id = 1 AND dn = document_name")
def user_leaf_scan(spark, d):
    leaves = S.leaves(spark, d)
    documents = leaves.groupBy("document_id", "user_id").agg(F.min("document_name").alias("document_name"))
    hits = D.user_leaves(leaves.withColumn("own", F.col("document_name")), documents, 1)
    return hits.where("own = document_name").select("chunk_id", "document_id", "chunk_index", "document_name", F.length("content").alias("n"))


@query("q_fetch_by_ids_ordered", "SELECT item_id AS list_id, CAST(place AS INTEGER) AS place, id AS chunk_id, n_chars FROM (SELECT item_id, unnest([item_id * 7, 9000000 + item_id, item_id]) AS id, unnest([0, 1, 2]) AS place FROM benchmark) JOIN documents ON doc_id = id")
def fetch_by_ids(spark, d):
    wanted = S.table(spark, d, "benchmark").select(F.col("item_id").alias("list_id"), F.array(F.col("item_id") * 7, F.col("item_id") + 9000000, F.col("item_id")).alias("ids"))
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    return D.by_ids(rows, wanted, "chunk_id").select("list_id", "place", "chunk_id", "n_chars")


@query("q_missing_embeddings", "SELECT doc_id AS chunk_id, n_chars FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR len(embedding) = 0")
def missing_embeddings(spark, d):
    rows = S.leaves(spark, d).join(S.leaf_vectors(spark, d), "chunk_id", "left").where("vector is null or size(vector) = 0")
    return rows.select("chunk_id", F.length("content").cast("long").alias("n_chars"))


@query("q_dedup_md5_newest", _with(DOCUMENTS) + "SELECT user_id, file_md5, max(id) AS id FROM kd WHERE status = 'ready' GROUP BY 1, 2")
def dedup_md5(spark, d):
    return D.newest_duplicates(S.knowledge_documents(spark, d)).select("user_id", "file_md5", "id")


@query("q_import_progress", _with(DOCUMENTS) + "SELECT id, status, CAST(CASE status WHEN 'ready' THEN 100 WHEN 'embed_failed' THEN 30 ELSE 30 + least(60, (n_chars // 2) * 60 // n_chars) END AS INTEGER) AS progress FROM kd")
def import_progress(spark, d):
    done = F.floor(F.col("n_chars") / 2)
    return S.knowledge_documents(spark, d).select("id", "status", D.progress(F.col("status"), done, F.col("n_chars")).alias("progress"))


@query("q_import_settled", _with(DOCUMENTS) + "SELECT id, CASE WHEN total = failed THEN 'embed_failed' ELSE 'ready' END AS status, total AS total_chunks, total - failed AS processed_chunks, failed AS failed_chunks FROM kd JOIN (SELECT doc_id // 4 AS g, count(*) AS total, count(*) FILTER (doc_id % 5 IN (0, 1, 2, 3) AND n_chars < 900) AS failed FROM documents GROUP BY 1) ON id = g")
def import_settled(spark, d):
    error = F.when((F.col("chunk_id") % 5 < 4) & (F.length("content") < 900), "too short")
    return D.settle_import(S.knowledge_documents(spark, d), S.leaves(spark, d).withColumn("error", error))


@query("q_import_states_streamed", SQL["q_import_settled"])
def import_states_streamed(spark, d):
    """The same settlement from events of single chunks, and of how many there are, in any order."""
    from chunkloom.streaming import states as W

    chunks = S.table(spark, d, "documents").select(F.floor(F.col("doc_id") / S.LEAVES).alias("document_id"), F.when((F.col("doc_id") % 5 < 4) & (F.col("n_chars") < 900), "chunk_error").otherwise("embedded").alias("kind"), F.col("doc_id").alias("chunk_id"), F.lit(None).cast("long").alias("total"))
    totals = chunks.groupBy("document_id").agg(F.lit("chunks").alias("kind"), F.lit(None).cast("long").alias("chunk_id"), F.count(F.lit(1)).alias("total"))
    settled = _streamed(spark, chunks.unionByName(totals), W.import_states, "document_id", W.IMPORT_ROWS)
    return settled.select(F.col("document_id").alias("id"), "status", "total_chunks", "processed_chunks", "failed_chunks")


@query("q_dead_letters", "SELECT doc_id // 4 AS document_id, doc_id AS chunk_id, 'no vector' AS error_message, left(text, 500) AS preview, 0 AS retry_count FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def dead_letters(spark, d):
    rows = S.leaves(spark, d).join(S.leaf_vectors(spark, d), "chunk_id", "left").withColumn("error", F.when(F.col("vector").isNull(), "no vector"))
    return D.dead_letters(rows)


@query("q_failures_by_step", "SELECT event_type AS step_type, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_failed, max(ts) AS last_at FROM events GROUP BY 1")
def failures_by_step(spark, d):
    return S.runs(spark, d).groupBy("step_type").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.max("started_at").cast("timestamp_ntz").alias("last_at"))


@query("q_latest_run", "SELECT user_id AS run_id, event_id AS step_id, event_type AS step_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, d):
    return D.latest_steps(S.runs(spark, d)).select("run_id", "step_id", "step_type")


@query("q_run_latest_state", "SELECT user_id AS run_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1")
def run_states(spark, d):
    return D.run_states(S.runs(spark, d)).select("run_id", "status", "n_steps", "n_failed")


def _streamed(spark, events, states, key, rows):
    """The last states after all events went through a stream: in four parts by a hash, in several micro-batches, every seventh event a second time in the last part."""
    from chunkloom.streaming import states as W

    root = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    part = F.pmod(F.xxhash64(*[c for c in events.columns]), F.lit(28))
    for i in range(4):
        own = events.where(part % 4 == i)
        (own.unionByName(events.where(part % 7 == 0)) if i == 3 else own).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    W.written(states(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return W.latest(spark, f"{root}/out", key, rows)


@query("q_run_states_streamed", SQL["q_run_latest_state"])
def run_states_streamed(spark, d):
    from chunkloom.streaming import states as W

    events = S.runs(spark, d).select("run_id", "step_id", "status", "started_at")
    return _streamed(spark, events, lambda x: W.run_states(x, lateness="36500 days"), "run_id", W.RUN_ROWS).select("run_id", "status", "n_steps", "n_failed")


@query("q_step_durations", "SELECT user_id AS run_id, event_id AS step_id, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 6) AS seconds FROM events")
def step_durations(spark, d):
    return D.step_durations(S.runs(spark, d)).select("run_id", "step_id", "seconds")


@query("q_run_detail_steps", "SELECT user_id AS run_id, count(*) AS n, string_agg(event_type || ':' || event_id, ',' ORDER BY ts, event_id) AS steps FROM events GROUP BY 1")
def run_detail(spark, d):
    steps = S.runs(spark, d)
    whole = D.nested(steps.select("run_id").distinct(), steps, "run_id", ["started_at", "step_id"], ["step_type"], "steps")
    shown = F.array_join(F.transform("steps", lambda s: F.concat(s.step_type, F.lit(":"), s.step_id.cast("string"))), ",")
    return whole.select("run_id", F.size("steps").cast("long").alias("n"), shown.alias("steps"))


@query("q_open_steps_failed", "SELECT event_id AS step_id, CASE WHEN event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'failed' WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events")
def open_steps(spark, d):
    steps = S.runs(spark, d)
    opened = steps.withColumn("status", F.when(F.col("step_type") == "view", "running").otherwise(F.col("status")))
    return D.fail_open_steps(opened, steps.where("status = 'failed'").select("run_id").distinct()).select("step_id", "status")


@query("q_session_history", r"SELECT conv_id AS session_id, count(*) AS n_messages, left(regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g'), 20) AS title, string_agg(role || ': ' || left(text, 120), chr(10) ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, turn, role, text) AS history FROM conversations GROUP BY 1")
def session_history(spark, d):
    """A preview of each message, as the statement has it; q_session_history_whole gives the texts."""
    return D.chat_history(S.messages(spark, d), preview=120)


@query("q_session_history_whole", r"SELECT conv_id AS session_id, count(*) AS n_messages, left(regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g'), 20) AS title, string_agg(role || ': ' || text, chr(10) ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, turn, role, text) AS history FROM conversations GROUP BY 1")
def session_history_whole(spark, d):
    return D.chat_history(S.messages(spark, d))


@query("q_payload_fields", "SELECT event_id AS step_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def payload_fields(spark, d):
    return S.runs(spark, d).where("payload is not null").select("step_id", F.from_json("payload", "k bigint").k.alias("k"))


@query("q_users_in_use", "SELECT c_custkey AS run_id, c_custkey IN (SELECT user_id FROM events) AS in_use FROM customer")
def users_in_use(spark, d):
    """Customers with runs may not be deleted."""
    return D.has_rows(S.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id")), S.runs(spark, d), "run_id")


@query("q_owned_documents", _with(DOCUMENTS) + "SELECT w.doc_id AS id, w.doc_id % 20 AS user_id, name, CASE WHEN kd.id IS NULL THEN 404 ELSE 200 END AS status FROM documents w LEFT JOIN kd ON kd.id = w.doc_id AND kd.user_id = w.doc_id % 20")
def owned_documents(spark, d):
    """Each document asked for by one user: the owner gets it, others a 404."""
    held = S.knowledge_documents(spark, d).select("id", F.col("user_id").cast("long").alias("user_id"), "name")
    return D.owned(S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 20).alias("user_id")), held, "id", "user_id")


@query("q_document_delete", _with(LEAVES) + "SELECT chunk_id, document_id FROM leaves WHERE document_id NOT IN (SELECT doc_id // 4 FROM documents WHERE n_chars < 200)")
def document_delete(spark, d):
    leaves = S.leaves(spark, d).select("chunk_id", "document_id", "content")
    return D.without_document(leaves, leaves.where(F.length("content") < 200).select("document_id").distinct()).select("chunk_id", "document_id")


# Text


@query("q_normalize_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def normalize_text(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.normal_lines("text")).alias("digest"))


@query("q_tokenize_set", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_terms, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')) AS digest FROM documents")
def tokenize_set(spark, d):
    own = S.table(spark, d, "documents").select("doc_id", T.token_set("text").alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("q_term_bag", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2")
def term_bag(spark, d):
    return R.postings(S.table(spark, d, "documents"), "text", ("doc_id",)).select("doc_id", "term", "tf")


@query("q_doc_freq", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1")
def doc_freq(spark, d):
    terms = S.table(spark, d, "documents").select(F.explode(F.array_distinct(T.term_bag("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("q_sentence_split", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark, d):
    own = S.table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return own.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("q_paragraph_split", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS INTEGER) AS n FROM documents")
def paragraph_split(spark, d):
    spaced = F.regexp_replace("text", "\n", "\n \n")
    return S.table(spark, d, "documents").select("doc_id", F.size(T.paragraphs(spaced)).alias("n"))


@query("q_md_sections", r"SELECT page_id, CAST(len(p) AS INTEGER) AS n_sections FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS p FROM pages) WHERE len(p) > 0")
def md_sections(spark, d):
    rows = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), T.strip), lambda x: x != "")
    as_md = S.table(spark, d, "pages").select("page_id", F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("## "), i.cast("string"), F.lit("\n"), x)), "\n").alias("md")).where("md <> ''")
    return P.markdown_sections(as_md, "page_id", "md").groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_sections"))


@query("q_retrieval_content", "SELECT doc_id AS chunk_id, md5('[父级主题] ' || lang || chr(10) || '[内容类型] 正文' || chr(10) || text) AS digest FROM documents")
def retrieval_content(spark, d):
    return S.leaves(spark, d).select("chunk_id", F.md5("retrieval_content").alias("digest"))


# Chunks


def _order_tables(spark, d):
    """Each customer's orders as a Markdown table."""
    row = F.struct("o_orderkey", F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |")).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.r)
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.array(F.lit("| key | status | priority |"), F.lit("| --- | --- | --- |")), rows).alias("lines"))


@query("q_table_chunks", """WITH t AS (SELECT o_custkey, list('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' ORDER BY o_orderkey) AS r FROM orders GROUP BY 1),
s AS (SELECT *, greatest(3, least(12, 700 // greatest(1, CAST(floor(list_sum(list_transform(r, lambda x: length(x))) / len(r)) AS BIGINT)))) AS step FROM t)
SELECT o_custkey, CAST(i + 1 AS INTEGER) AS row_from, CAST(least(i + step, len(r)) AS INTEGER) AS row_to, md5('| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(r[i + 1 : i + step], chr(10))) AS digest
FROM (SELECT *, unnest(range(0, len(r), step)) AS i FROM s)""")
def table_chunks(spark, d):
    cut = _order_tables(spark, d).select("o_custkey", F.explode(C.table_chunks(F.col("lines"))).alias("c"))
    return cut.select("o_custkey", "c.row_from", "c.row_to", F.md5("c.text").alias("digest"))


@query("q_md_blocks", "SELECT o_custkey, block, CASE block WHEN 1 THEN 'text' ELSE 'table' END AS kind, CAST(CASE block WHEN 1 THEN 1 ELSE n + 2 END AS INTEGER) AS n_lines FROM (SELECT o_custkey, count(*) AS n, CAST(unnest([1, 2]) AS BIGINT) AS block FROM orders GROUP BY 1)")
def md_blocks(spark, d):
    lines = _order_tables(spark, d).select("o_custkey", F.posexplode(F.concat(F.array(F.concat(F.lit("Orders of "), F.col("o_custkey").cast("string"))), F.col("lines"))).alias("at", "line"))
    blocks = C.markdown_blocks(lines, "o_custkey", "at", "line")
    return blocks.select("o_custkey", "block", "kind", F.size(F.split("text", "\n")).alias("n_lines"))


NORMAL = r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("q_long_unit_pack", f"""WITH n AS (SELECT doc_id, {NORMAL} AS text FROM documents), s AS (SELECT doc_id, text, {SENTENCES} AS u FROM n),
p AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN length(text) <= 500 THEN [text]
  WHEN len(u) = 1 THEN list_filter(list_transform(range(0, length(text), 500), lambda i: trim(substr(text, CAST(i + 1 AS BIGINT), 500))), lambda x: x <> '')
  ELSE string_split(list_reduce(u, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) > 500 THEN a || chr(1) || x ELSE a || ' ' || x END), chr(1)) END AS parts FROM s)
SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS piece, unnest(parts) AS content FROM p""")
def long_unit_pack(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.posexplode(C.long_unit(F.col("text"), 500)).alias("piece", "content"))


def _sentences_of(x: str) -> str:
    return SENTENCES.replace("regexp_extract_all(text,", f"regexp_extract_all({x},")


TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
#: A chunk's end that the next one repeats: whole sentences from the last until 80 characters are reached.
TAIL = f"""list_transform([{_sentences_of('n')}], lambda s: CASE WHEN length(n) <= 80 THEN n WHEN len(s) <= 1 THEN {TRIM.format(x='right(n, 80)')}
  ELSE array_to_string(s[len(s) - coalesce(list_filter(range(1, len(s) + 1), lambda k: list_sum(list_transform(s[len(s) - k + 1 :], lambda y: length(y))) >= 80)[1], len(s)) + 1 :], ' ') END)[1]"""
HEURISTIC = f"""l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format(x='x')}), lambda x: x <> '') AS lines FROM documents),
u AS (SELECT doc_id, flatten(list_transform(lines, lambda v: CASE WHEN length(v) <= 500 THEN [v] ELSE list_transform([{_sentences_of('v')}], lambda s: CASE
  WHEN len(s) = 1 THEN list_filter(list_transform(range(0, length(v), 500), lambda i: trim(substr(v, CAST(i + 1 AS BIGINT), 500))), lambda x: x <> '')
  ELSE string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) > 500 THEN a || chr(1) || x ELSE a || ' ' || x END), chr(1)) END)[1] END)) AS units FROM l),
h AS (SELECT doc_id, string_split(list_reduce(units, lambda a, x: list_transform([string_split(a, chr(1))[-1]], lambda n: CASE WHEN length(n) + 2 + length(x) > 500 AND length(n) >= 120
  THEN a || chr(1) || list_transform([{TAIL}], lambda t: CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END)[1] || x ELSE a || chr(10) || chr(10) || x END)[1]), chr(1)) AS parts FROM u WHERE len(units) > 0)"""


@query("q_heuristic_chunks", _with(HEURISTIC) + "SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS piece, unnest(parts) AS content FROM h")
def heuristic_chunks(spark, d):
    spaced = F.regexp_replace("text", "\n", "\n\n")
    return S.table(spark, d, "documents").select("doc_id", F.posexplode(C.heuristic_chunks(spaced, 500, 80)).alias("piece", "content"))


@query("q_semantic_chunks")
def semantic_chunks(spark, d):
    """Sentences with vectors of their own, cut where neighbours are least alike."""
    own = S.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))
    vectors = M.embed(own, "sentence", M.HashedWords(32))
    rows = vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "sentence", "vector"))).alias("r"))
    alike = F.zip_with(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 2, F.size("r")), lambda a, b: V.cosine(a.vector, b.vector))
    cut = rows.withColumn("breaks", C.breakpoints(alike).cast("array<int>"))
    return cut.select("doc_id", F.posexplode(C.semantic_chunks(F.transform("r", lambda x: x.sentence), F.col("breaks"))).alias("piece", "content"))


@query("q_hier_chunks", "WITH RECURSIVE " + HEURISTIC + """,
seg AS (SELECT doc_id, lang, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
walk AS (
  SELECT doc_id, t, parts, 0 AS i, greatest(strpos(t, parts[1]), 1) - 1 AS start FROM h JOIN seg USING (doc_id)
  UNION ALL
  SELECT doc_id, t, parts, i + 1, CASE WHEN strpos(substr(t, stop + 1), parts[i + 2]) > 0 THEN stop + strpos(substr(t, stop + 1), parts[i + 2]) - 1 ELSE stop END
  FROM (SELECT *, least(start + length(parts[i + 1]), length(t)) AS stop FROM walk) WHERE i + 1 < len(parts)),
rows AS (
  SELECT doc_id, -1 AS child, 0 AS start, length(t) AS stop, t AS content FROM seg
  UNION ALL SELECT doc_id, i, start, least(start + length(parts[i + 1]), length(t)), parts[i + 1] FROM walk)
SELECT doc_id AS document_id, CAST(child + 1 AS INTEGER) AS chunk_index, CASE WHEN child < 0 THEN 'parent' ELSE 'leaf' END AS chunk_role, CAST(child AS INTEGER) AS child_index, CAST(start AS INTEGER) AS start_offset, CAST(stop AS INTEGER) AS end_offset,
  '[父级主题] ' || lang || chr(10) || '[内容类型] 正文' || chr(10) || regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS retrieval_content FROM rows JOIN seg USING (doc_id)""")
def hier_chunks(spark, d):
    segments = S.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("segment"), F.col("lang").alias("title"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return C.hierarchy(segments).select("document_id", "chunk_index", "chunk_role", "child_index", "start_offset", "end_offset", "retrieval_content")


@query("q_adjacent_similarity", "SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[])), 6) AS similarity FROM embeddings QUALIFY lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NOT NULL")
def adjacent_similarity(spark, d):
    return _adjacent(spark, d).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def _adjacent(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = S.leaf_vectors(spark, d).withColumnRenamed("chunk_id", "vec_id").withColumn("after", F.lead("vector").over(w)).where("after is not null")
    return rows.withColumn("similarity", V.cosine(F.col("vector"), F.col("after")))


@query("q_percentile_breaks", "WITH s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[])) AS x FROM embeddings), p AS (SELECT label, quantile_cont(x, 0.2) AS t FROM s WHERE x IS NOT NULL GROUP BY 1) SELECT vec_id, label FROM s JOIN p USING (label) WHERE x <= t + 1e-12")
def percentile_breaks(spark, d):
    own = _adjacent(spark, d)
    limit = own.groupBy("label").agg(F.percentile("similarity", F.lit(0.2)).alias("t"))
    return own.join(F.broadcast(limit), "label").where("similarity <= t + 1e-12").select("vec_id", "label")


# Vectors


@query("q_vector_topk", _with(VECTORS) + "SELECT question_id, chunk_id, vector_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM vs WINDOW w AS (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 10")
def vector_topk(spark, d):
    held = S.leaf_vectors(spark, d).join(S.leaves(spark, d).select("chunk_id"), "chunk_id")
    return N.exact(S.questions(spark, d), held, 10).select("question_id", "chunk_id", "vector_score", "rank")


@query("q_vector_topk_filtered", _with(VECTORS) + "SELECT question_id, chunk_id, vector_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM vs WHERE chunk_id // 4 % 3 = 1 AND chunk_id // 4 < 60 WINDOW w AS (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def vector_topk_filtered(spark, d):
    scope = S.leaves(spark, d).where("user_id = 1 and document_id < 60").select("chunk_id")
    return N.exact(S.questions(spark, d), S.leaf_vectors(spark, d).join(scope, "chunk_id"), 5).select("question_id", "chunk_id", "vector_score", "rank")


@query("q_vector_topk_by_user", _with(VECTORS) + "SELECT question_id, chunk_id, vector_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM vs WHERE chunk_id // 4 % 3 = question_id % 3 AND chunk_id // 4 NOT IN (SELECT doc_id // 4 FROM documents WHERE n_chars < 200) WINDOW w AS (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def vector_topk_by_user(spark, d):
    """Each question searches its own user's documents, listed by join: those without a text below 200 characters."""
    short = S.table(spark, d, "documents").where("n_chars < 200").select(F.floor(F.col("doc_id") / S.LEAVES).alias("document_id")).distinct()
    scope = D.without_document(S.leaves(spark, d), short).select("chunk_id", "user_id")
    return N.exact(_of_users(S.questions(spark, d)), S.leaf_vectors(spark, d).join(scope, "chunk_id"), 5, scope=("user_id",)).select("question_id", "chunk_id", "vector_score", "rank")


def _of_users(rows: DataFrame) -> DataFrame:
    """Questions (or their terms) spread over the three users."""
    return rows.withColumn("user_id", F.col("question_id") % 3)


@query("q_guarded_topk", _with(LEAVES, VECTORS) + """, r AS (SELECT question_id, chunk_id, vector_score, row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id DESC) AS rank FROM vs),
t AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS own FROM leaves), q AS (SELECT item_id AS question_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS asked FROM benchmark),
m AS (SELECT question_id, bool_or(list_has_any(own, asked)) AS met FROM r JOIN t USING (chunk_id) JOIN q USING (question_id) WHERE rank <= 10 GROUP BY 1)
SELECT question_id, chunk_id, vector_score, CAST(rank AS INTEGER) AS rank FROM r JOIN m USING (question_id) WHERE rank <= 10 AND (met OR (rank <= 5 AND vector_score > 0))""")
def guarded_topk(spark, d):
    """Twice as many vector hits if their words speak for them, else the exact scan's."""
    leaves, asked = S.leaves(spark, d), S.questions(spark, d)
    near = N.exact(asked, S.leaf_vectors(spark, d).join(leaves.select("chunk_id"), "chunk_id"), 10).select("question_id", "chunk_id", "vector_score", "rank")
    return N.guarded(asked, near, leaves.select("chunk_id", T.token_set("content").alias("tokens")), 5)


def _index(spark, d, **how):
    """An index of the table's vectors, stored and opened again."""
    root = f"{shared_dir(spark)}/vector-index-{uuid4().hex}"
    VectorIndex.build(S.leaf_vectors(spark, d), root, **how)
    return VectorIndex.open(spark, root)


def _recall(spark, d, index):
    """Recall at 10 of the index with its own settings, beside what it read for it."""
    vectors, asked = S.leaf_vectors(spark, d), S.questions(spark, d)
    found = N.recall(index.search(asked, 10), N.exact(asked, vectors, 10))
    return found.crossJoin(index.scanned(asked)).withColumns({"n_vectors": F.lit(index.facts["num_vectors"]), "n_lists": F.lit(index.facts["n_lists"]), "probes": F.lit(index.facts["probes"])})  # one row each


@query("q_ivf_topk")
def ivf_topk(spark, d):
    return _index(spark, d, code_bytes=0).search(S.questions(spark, d), 10).select("question_id", "chunk_id", "vector_score", "rank")


@query("q_ann_recall")
def ann_recall(spark, d):
    return _recall(spark, d, _index(spark, d, code_bytes=0))


@query("q_pq_topk")
def pq_topk(spark, d):
    """Hits of the lists' codes, scored again by their vectors."""
    return _index(spark, d).search(S.questions(spark, d), 10).select("question_id", "chunk_id", "vector_score", "rank")


@query("q_pq_recall")
def pq_recall(spark, d):
    index = _index(spark, d)
    scored = min(10 * index.facts["rerank"], index.facts["num_vectors"]) / max(index.facts["num_vectors"], 1)
    return _recall(spark, d, index).withColumns({"bytes_a_vector": F.lit(index.facts["code_bytes"]), "scored_again": F.lit(round(scored, 6))})


@query("q_graph_recall")
def graph_recall(spark, d):
    """Recall at 10 of the neighbour graph, beside the share of the vectors that a question meets."""
    vectors, asked, root = S.leaf_vectors(spark, d), S.questions(spark, d), f"{shared_dir(spark)}/graph-{uuid4().hex}"
    NeighbourGraph.build(vectors, root)
    graph = NeighbourGraph.open(spark, root)
    met = graph.met(asked)
    found = R.ranked(met, ["question_id"], [F.desc("score"), F.desc("node")], 10).select("question_id", F.col("node").alias("chunk_id"))
    share = met.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n") / max(graph.facts["num_vectors"], 1), 6).alias("met"))
    return N.recall(found, N.exact(asked, vectors, 10)).crossJoin(share)  # one row each


# Keywords


@query("q_bm25_topk", _with(LEAVES, KEYWORDS) + "SELECT question_id, chunk_id, keyword_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM kw WINDOW w AS (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def bm25_topk(spark, d):
    """From an index that is written and opened again; the search reads postings, not texts."""
    root = f"{shared_dir(spark)}/postings-{uuid4().hex}"
    Postings.build(S.leaves(spark, d), root)
    return _first_keyword_hits(Postings.open(spark, root).search(R.question_terms(S.questions(spark, d))))


def _first_keyword_hits(hits):
    return R.ranked(hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 5).select("question_id", "chunk_id", "keyword_score", "rank")


@query("q_bm25_incremental", _with(LEAVES.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 7)"), KEYWORDS) + "SELECT question_id, chunk_id, keyword_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM kw WINDOW w AS (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def bm25_incremental(spark, d):
    """Built from two of three chunks with a wrong text in some, then given the rest and the right texts, then rid of every tenth: scored like an index of what is left."""
    leaves, root = S.leaves(spark, d).select("chunk_id", "chunk_index", "content"), f"{shared_dir(spark)}/postings-{uuid4().hex}"
    wrong = F.when(F.col("chunk_id") % 5 == 1, F.concat_ws(" ", "content", F.lit("draft"), "content")).otherwise(F.col("content"))
    Postings.build(leaves.where("chunk_id % 3 < 2").withColumn("content", wrong), root)
    Postings.open(spark, root).add(leaves.where("chunk_id % 3 = 2 or chunk_id % 5 = 1"))
    Postings.open(spark, root).remove(leaves.where("chunk_id % 10 = 7").select("chunk_id"))
    return _first_keyword_hits(Postings.open(spark, root).search(R.question_terms(S.questions(spark, d))))


@query("q_bm25_scoped", _with(LEAVES.replace("FROM documents)", "FROM documents WHERE (doc_id // 4) % 3 = 2)"), KEYWORDS) + "SELECT question_id, chunk_id, keyword_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM kw WINDOW w AS (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def bm25_scoped(spark, d):
    """All users' scopes in one pass; each question belongs to user 2 here."""
    terms = R.question_terms(S.questions(spark, d)).withColumn("user_id", F.lit(2).cast("long"))
    hits = R.bm25(S.leaves(spark, d), terms, scope=("user_id",))
    return R.ranked(hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 5).select("question_id", "chunk_id", "keyword_score", "rank")


@query("q_bm25_by_user", _with(LEAVES, USER_KEYWORDS) + "SELECT question_id, chunk_id, keyword_score, CAST(row_number() OVER w AS INTEGER) AS rank FROM kw WINDOW w AS (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 5")
def bm25_by_user(spark, d):
    """Questions of all users, each in its own user's scope with that scope's statistics."""
    hits = R.bm25(S.leaves(spark, d), _of_users(R.question_terms(S.questions(spark, d))), scope=("user_id",))
    return R.ranked(hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 5).select("question_id", "chunk_id", "keyword_score", "rank")


@query("q_bm25_weighted", SQL["q_bm25_topk"])
def bm25_weighted(spark, d):
    """Terms of all rewrites, each with its largest weight. The tables' questions have no words that a rewrite replaces: all terms are the question's own, whose weight is 1, so the statement is that of plain terms."""
    hits = R.bm25(S.leaves(spark, d), R.question_terms(S.questions(spark, d), weighted=True))
    return R.ranked(hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 5).select("question_id", "chunk_id", "keyword_score", "rank")


@query("q_keyword_overlap", _with(LEAVES, KEYWORDS) + "SELECT question_id, chunk_id, round(count(*) / any_value(n), 6) AS overlap FROM qt JOIN tf USING (term) JOIN (SELECT question_id, count(*) AS n FROM qt GROUP BY 1) USING (question_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(count(*) / any_value(n), 6) DESC, chunk_id) <= 5")
def keyword_overlap(spark, d):
    """The share of a question's tokens in each chunk, by an equi-join on tokens."""
    terms = R.question_terms(S.questions(spark, d))
    sized = terms.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    own = S.leaves(spark, d).select("chunk_id", F.explode(T.token_set("content")).alias("term"))
    met = own.join(R.few(terms), "term").groupBy("question_id", "chunk_id").agg(F.count(F.lit(1)).alias("c"))
    scored = met.join(R.few(sized), "question_id").select("question_id", "chunk_id", F.round(F.col("c") / F.col("n"), 6).alias("overlap"))
    return R.ranked(scored, ["question_id"], [F.desc("overlap"), F.asc("chunk_id")], 5).drop("rank")


# Hybrid retrieval


def _hybrid(spark, d, k=5):
    return retrieval.hybrid_leaves(S.questions(spark, d), S.leaves(spark, d), S.leaf_vectors(spark, d), k)


@query("q_hybrid_leaf", _with(LEAVES, KEYWORDS, VECTORS, HYBRID) + "SELECT question_id, chunk_id, vector_score, keyword_score, final_score, CAST(rank AS INTEGER) AS rank FROM hy")
def hybrid_leaf(spark, d):
    return _hybrid(spark, d).select("question_id", "chunk_id", "vector_score", "keyword_score", "final_score", "rank")


#: The tables hold no CJK text: phrase terms are the Latin runs of a text without white space, and a question has no focused form.
PHRASES = _with(LEAVES, KEYWORDS, VECTORS, HYBRID) + r""", p AS (SELECT question_id, chunk_id, text AS q, content AS t FROM hy JOIN benchmark ON item_id = question_id JOIN leaves USING (chunk_id)),
c AS (SELECT *, lower(regexp_replace(q, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', '', 'g')) AS qc, lower(regexp_replace(t, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', '', 'g')) AS tc FROM p),
x AS (SELECT *, list_distinct(list_filter(regexp_extract_all(qc, '[a-z0-9]+'), lambda w: length(w) >= 2)) AS qo, list_distinct(list_filter(regexp_extract_all(tc, '[a-z0-9]+'), lambda w: length(w) >= 2)) AS own,
  list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS tt FROM c),
y AS (SELECT *, len(list_filter(qo, lambda w: contains(tc, w))) / len(qo) AS forth, len(list_filter(own, lambda w: contains(qc, w))) / len(own) AS back FROM x)
SELECT question_id, chunk_id, round(CASE WHEN qc = '' OR tc = '' THEN 0.0 WHEN contains(tc, qc) THEN 1.0 WHEN len(qo) = 0 THEN 0.0 WHEN len(own) = 0 THEN forth ELSE greatest(forth, 0.8 * back) END, 6) AS phrase,
  round(CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, tt)) / len(qt) END, 6) AS words FROM y"""


@query("q_phrase_overlap", PHRASES)
def phrase_overlap(spark, d):
    hits = _hybrid(spark, d).select("question_id", "chunk_id")
    pairs = hits.join(S.questions(spark, d).select("question_id", "question"), "question_id").join(S.leaves(spark, d).select("chunk_id", "content"), "chunk_id")
    return pairs.select("question_id", "chunk_id", F.round(T.phrase_overlap("question", "content"), 6).alias("phrase"), F.round(T.keyword_overlap("question", "content"), 6).alias("words"))


@query("q_rrf", _with(LEAVES, KEYWORDS, VECTORS) + """, a AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id DESC) AS r FROM vs QUALIFY r <= 20),
b AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_id DESC) AS r FROM kw QUALIFY r <= 20)
SELECT question_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def rrf(spark, d):
    asked, leaves = S.questions(spark, d), S.leaves(spark, d)
    k = R.bm25(leaves, R.question_terms(asked))
    lists = [N.exact(asked, S.leaf_vectors(spark, d).join(leaves.select("chunk_id"), "chunk_id"), 20), R.ranked(k, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_id")], 20)]
    return R.reciprocal_rank_fusion(lists).withColumn("rrf_score", F.round("rrf_score", 9))


def _units_sql(unit: str) -> str:
    return _with(LEAVES, KEYWORDS, VECTORS, HYBRID) + f"""SELECT question_id, unit_id, final_score, matched_child, CAST(row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, vector_score DESC, keyword_score DESC, f) AS INTEGER) AS rank FROM (
SELECT question_id, {unit} AS unit_id, max(final_score) AS final_score, max(vector_score) AS vector_score, max(keyword_score) AS keyword_score, min(rank) AS f, arg_max(chunk_id, (final_score, vector_score, keyword_score, -rank)) AS matched_child
FROM hy JOIN leaves USING (chunk_id) GROUP BY 1, 2) QUALIFY rank <= 10"""


def _units(spark, d, carry):
    return R.small_to_big(_hybrid(spark, d), S.leaves(spark, d), S.parents(spark, d), 10, carry)


@query("q_small_to_big", _units_sql("parent_chunk_id"))
def small_to_big(spark, d):
    return _units(spark, d, True).select("question_id", "unit_id", "final_score", "matched_child", "rank")


@query("q_small_to_big_observed", _units_sql("CASE WHEN by_vector THEN chunk_id ELSE parent_chunk_id END"))
def small_to_big_observed(spark, d):
    return _units(spark, d, False).select("question_id", "unit_id", "final_score", "matched_child", "rank")


@query("q_coarse_topk")
def coarse_topk(spark, d):
    """The vector arm in the order of its coarse score."""
    questions = U.with_intent(S.questions(spark, d).select("question_id", "question"))
    near = N.exact(S.questions(spark, d), S.leaf_vectors(spark, d), 20).drop("rank")
    pairs = near.join(R.few(questions), "question_id").join(S.leaves(spark, d).select("chunk_id", "chunk_index", "content"), "chunk_id")
    ordered = R.ranked(R.coarse_scores(pairs.where("vector_score > 0")), ["question_id"], [F.desc("coarse_score"), F.desc("vector_score"), F.desc("chunk_index"), F.desc("chunk_id")], 10)
    return ordered.select("question_id", "chunk_id", "vector_score", F.round("coarse_score", 6).alias("coarse_score"), "rank")


@query("q_rule_rerank")
def rule_rerank(spark, d):
    hits = _reranked(spark, d)
    return hits.select("question_id", "chunk_id", "rule_score", "rank")


def _reranked(spark, d, k=10):
    questions = U.with_intent(S.questions(spark, d).select("question_id", "question"))
    pairs = _hybrid(spark, d).drop("rank").join(R.few(questions), "question_id").join(S.leaves(spark, d).select("chunk_id", "content"), "chunk_id")
    return R.rule_rerank(pairs, "content", k)


@query("q_retrieve")
def retrieve(spark, d):
    got = retrieval.retrieve(S.questions(spark, d), S.leaves(spark, d), S.leaf_vectors(spark, d), S.parents(spark, d), k=3, spread=2)
    return got.select("question_id", "chunk_id", "matched_child", "rule_score", "rank")


@query("q_pair_scorer_fusion", _with(LEAVES, KEYWORDS, VECTORS, HYBRID) + """, m AS (SELECT question_id, chunk_id, final_score AS rule_score, rank, 1.0 / (1 + abs(length(text) - length(content))) AS model_score FROM hy JOIN leaves USING (chunk_id) JOIN benchmark ON item_id = question_id),
p AS (SELECT *, rank <= 15 AS pool FROM m),
x AS (SELECT *, CASE WHEN pool THEN round(0.65 * (CASE WHEN max(model_score) OVER w <= min(model_score) OVER w THEN 0.5 ELSE (model_score - min(model_score) OVER w) / (max(model_score) OVER w - min(model_score) OVER w) END) + 0.35 * (CASE WHEN max(rule_score) OVER w <= min(rule_score) OVER w THEN 0.5 ELSE (rule_score - min(rule_score) OVER w) / (max(rule_score) OVER w - min(rule_score) OVER w) END) + 1e-9, 6) END AS mixed FROM p WINDOW w AS (PARTITION BY question_id, pool))
SELECT question_id, chunk_id, mixed, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pool DESC, mixed DESC NULLS LAST, rank) AS INTEGER) AS rank FROM x""")
def pair_scorer_fusion(spark, d):
    """A scorer that likes texts as long as the question stands for the model."""
    pairs = _hybrid(spark, d).join(S.questions(spark, d).select("question_id", "question"), "question_id").join(S.leaves(spark, d).select("chunk_id", "content"), "chunk_id")
    scored = pairs.withColumn("model_score", M.model_scores(F.col("question"), F.col("content"), lambda ps: [1.0 / (1 + abs(len(a) - len(b))) for a, b in ps])).withColumn("rule_score", F.col("final_score"))
    return R.fuse_scores(scored, 15, candidates=10).select("question_id", "chunk_id", "mixed", "rank")


# Answers


def _shown(spark, d):
    """Hybrid hits with what is shown of their chunks."""
    return _hybrid(spark, d).select("question_id", "chunk_id", "rank", F.col("final_score").alias("score")).join(S.leaves(spark, d), "chunk_id")


@query("q_context_blocks", _with(LEAVES, KEYWORDS, VECTORS, HYBRID, SHOWN) + f""", b AS (
SELECT question_id, rank, '[' || rank || '] ' || document_name || ' | 第' || source_page || '页' || CASE WHEN ({SECTION}) = '' THEN '' ELSE ' | 章节：' || ({SECTION}) END || ' | 相关度:' || printf('%.2f', score) AS header,
  regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body FROM shown),
c AS (SELECT question_id, rank, header, CASE WHEN length(body) > 2000 THEN left(body, 1000) || chr(10) || '...[内容过长已截断]...' || chr(10) || right(body, 1000) ELSE body END AS content FROM b),
d AS (SELECT *, sum(length(header) + 1 + length(content)) OVER (PARTITION BY question_id ORDER BY rank) AS after FROM c),
e AS (SELECT *, coalesce(max(CASE WHEN after > 12000 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken, 12000 - (after - (length(header) + 1 + length(content))) AS rest FROM d)
SELECT question_id, CAST(rank AS INTEGER) AS rank, header, CASE WHEN after > 12000 THEN substr(content, 1, CAST(rest AS BIGINT)) ELSE content END AS content FROM e WHERE broken = 0 AND (after <= 12000 OR rest > 200)""")
def context_blocks(spark, d):
    return A.context_blocks(_shown(spark, d))


@query("q_citations", _with(LEAVES, KEYWORDS, VECTORS, HYBRID, SHOWN) + f"""SELECT question_id, document_id, source_page, source_section, score, chunk_id, chunk_count, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, f) AS INTEGER) AS place FROM (
SELECT question_id, document_id, source_page, {SECTION} AS source_section, max(score) AS score, arg_max(chunk_id, (score, -rank)) AS chunk_id, count(*) AS chunk_count, min(rank) AS f FROM shown GROUP BY 1, 2, 3, 4)""")
def citations(spark, d):
    return A.citations(_shown(spark, d)).select("question_id", "document_id", "source_page", "source_section", "score", "chunk_id", "chunk_count", "place")


@query("q_reference_lines", _with(LEAVES, KEYWORDS, VECTORS, HYBRID, SHOWN) + f"""SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS INTEGER) AS number,
document_name || ' · 第' || source_page || '页' || CASE WHEN ({SECTION}) = '' THEN '' ELSE ' · ' || ({SECTION}) END AS line FROM shown""")
def reference_lines(spark, d):
    return A.reference_lines(A.citations(_shown(spark, d)))


@query("q_answer_citations", """SELECT b.item_id AS question_id, 'See [2].' || CASE WHEN doc_id IS NULL THEN '' ELSE chr(10) || chr(10) || '参考来源：' || chr(10) || '[2] ' || source || '/' || doc_id || ' · 第2页' END AS answer FROM benchmark b LEFT JOIN documents ON doc_id = b.item_id * 3""")
def answer_citations(spark, d):
    asked = S.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("See [2].").alias("answer"))
    docs = S.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.floor(F.col("doc_id") / 3).alias("question_id"), T.reference_line(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit(2), F.lit("")).alias("line"))
    lines = docs.join(R.few(asked.select("question_id")), "question_id", "left_semi").select("question_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("number"), "line")
    return A.complete_citations(asked, lines)


@query("q_instructions", _with(LEAVES, KEYWORDS, VECTORS, HYBRID) + """, t AS (SELECT question_id, max(final_score) AS top, count(*) AS n FROM hy GROUP BY 1),
s AS (SELECT item_id AS question_id, CASE WHEN t.n IS NULL THEN 'none_strict' WHEN top < 0.55 THEN 'weak_strict' ELSE 'grounded' END AS state, CASE WHEN regexp_replace(text, '\\s+$', '') LIKE '%?' THEN 'yes_no' ELSE 'fact' END AS kind, n FROM benchmark LEFT JOIN t ON question_id = item_id)
SELECT question_id, state, CASE WHEN state = 'none_strict' THEN '' ELSE kind END AS style, state = 'grounded' AND coalesce(n, 0) >= 2 AS several FROM s""")
def instructions(spark, d):
    """What each question's answer is to be told, by the state of its evidence and its type."""
    hits = _shown(spark, d)
    contexts = A.context(A.context_blocks(hits)).join(hits.groupBy("question_id").agg(F.max("score").alias("top_score"), F.count(F.lit(1)).alias("n_sources")), "question_id")
    judged = A.verdicts(U.with_intent(S.questions(spark, d).select("question_id", "question")), contexts)
    return A.instructions(judged).drop("instruction")


@query("q_decision_path")
def decision_path(spark, d):
    questions = U.with_intent(S.questions(spark, d).select("question_id", "question"))
    hits = _shown(spark, d)
    contexts = A.context(A.context_blocks(hits)).join(hits.groupBy("question_id").agg(F.max("score").alias("top_score")), "question_id")
    return A.verdicts(questions, contexts).select("question_id", A.decision_path().alias("path"), F.round("evidence_score", 6).alias("evidence"), F.round("relation_score", 6).alias("relation"), "weak", "conflict")


def _parts(spark, d):
    """Chinese sentences about the parts of the catalogue, and a question for each brand."""
    part = S.table(spark, d, "part")
    said = F.when(F.col("p_size") % 3 == 0, "不支持").when(F.col("p_size") % 3 == 1, "支持").otherwise("建议每3天清理")
    texts = part.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("本产品"), "p_brand", said, F.lit("语音助手"), "p_type", F.lit("。")).alias("content"), "p_brand")
    asked = part.select("p_brand").distinct().select("p_brand", F.concat(F.lit("扫地机器人是否支持"), "p_brand", F.lit("吗？")).alias("question"))
    return texts, asked


@query("q_evidence", "SELECT p_partkey AS chunk_id, CAST(CASE p_size % 3 WHEN 2 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS relation, CAST(CASE p_size % 3 WHEN 2 THEN 0.8 ELSE 0.96 END AS DOUBLE) AS evidence, 'yes_no' AS question_type FROM part")
def evidence(spark, d):
    texts, asked = _parts(spark, d)
    pairs = texts.join(R.few(U.with_intent(asked)), "p_brand").withColumn("normal", T.compact("content"))
    related = pairs.withColumn("relation", F.round(U.relation_evidence(F.col("intent"), F.col("normal")), 6))
    return related.select("chunk_id", "relation", F.round(U.evidence(F.col("intent"), F.col("normal"), F.col("relation")), 6).alias("evidence"), "intent.question_type")


@query("q_direct_answers")
def direct_answers(spark, d):
    texts, asked = _parts(spark, d)
    known = U.with_intent(asked).withColumnRenamed("p_brand", "question_id")
    contexts = texts.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("context"), F.lit(1.0).alias("top_score")).withColumnRenamed("p_brand", "question_id")
    judged = A.verdicts(known, contexts)
    return judged.select("question_id", A.decision_path().alias("path"), A.direct_answer(F.col("intent"), F.col("context"), F.col("conflict")).alias("answer"))


@query("q_rewrite_forms")
def rewrite_forms(spark, d):
    asked = _parts(spark, d)[1]
    return U.with_intent(asked).select("p_brand", "intent.question_type", "intent.relation", F.posexplode("intent.forms").alias("place", "form")).select("p_brand", "question_type", "relation", "place", "form.text", "form.weight", "form.strategy")


@query("q_query_type", "SELECT item_id AS question_id, CASE WHEN regexp_replace(text, '\\s+$', '') LIKE '%?' THEN 'yes_no' ELSE 'fact' END AS question_type FROM benchmark")
def query_type(spark, d):
    return U.with_intent(S.questions(spark, d).select("question_id", "question")).select("question_id", "intent.question_type")


@query("q_embed_backfill", "SELECT doc_id AS chunk_id, CAST(64 AS INTEGER) AS dimension, CAST(NULL AS VARCHAR) AS error FROM documents WHERE trim(text) <> ''")
def embed_backfill(spark, d):
    chunks = S.leaves(spark, d).select("chunk_id", "content").join(S.leaf_vectors(spark, d).select("chunk_id", "vector"), "chunk_id", "left")
    return M.backfill(chunks, M.HashedWords()).select("chunk_id", F.size("vector").alias("dimension"), "error")


@query("q_index_facts", "SELECT (vec_id // 4) % 3 AS user_id, 'flat' AS index_type, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) AS num_vectors FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1")
def index_facts(spark, d):
    from chunkloom.sources.indexes import index_facts

    return index_facts(S.leaf_vectors(spark, d).join(S.leaves(spark, d).select("chunk_id", "user_id"), "chunk_id"))


def _user_vectors(spark, d):
    return S.leaf_vectors(spark, d).join(S.leaves(spark, d).select("chunk_id", "user_id", "document_id"), "chunk_id").select("user_id", "chunk_id", "document_id", "vector")


def _drifted(spark, d):
    """Indexes written when every seventh vector was not there yet and every eleventh belonged to the next chunk; user 2 has none any more."""
    from chunkloom.sources.indexes import UserIndexes

    held = _user_vectors(spark, d)
    old = held.where("chunk_id % 7 <> 3").withColumn("chunk_id", F.when(F.col("chunk_id") % 11 == 5, F.col("chunk_id") + 100_000).otherwise(F.col("chunk_id")))
    indexes = UserIndexes(spark, f"{shared_dir(spark)}/indexes-{uuid4().hex}").replace(old)
    return held, indexes.replace(held.where("1 = 0"), spark.createDataFrame([(2,)], "user_id long"))


_OF_USERS = "v AS (SELECT (vec_id // 4) % 3 AS user_id, vec_id AS chunk_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id)"


@query("q_index_differences", f"""WITH {_OF_USERS}, held AS (SELECT user_id, CASE WHEN chunk_id % 11 = 5 THEN chunk_id + 100000 ELSE chunk_id END AS chunk_id FROM v WHERE chunk_id % 7 <> 3 AND user_id <> 2)
SELECT user_id, chunk_id, 'missing' AS state FROM v ANTI JOIN held USING (user_id, chunk_id) UNION ALL SELECT user_id, chunk_id, 'stale' FROM held ANTI JOIN v USING (user_id, chunk_id)""")
def index_differences(spark, d):
    held, indexes = _drifted(spark, d)
    return indexes.differences(held)


@query("q_index_repair", f"WITH {_OF_USERS} SELECT user_id, CASE WHEN count(*) < {N.FLAT_BELOW} THEN 'flat' ELSE 'ivf' END AS index_type, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) AS num_vectors, count(*) AS n_positions, max(chunk_id) AS last_chunk FROM v GROUP BY 1")
def index_repair(spark, d):
    """After the repair every user has the vectors of the table, at positions without gaps; an index of FLAT_BELOW vectors or more is one of lists."""
    held, indexes = _drifted(spark, d)
    after = indexes.repair(held)
    rows = after.rows().groupBy("user_id").agg((F.max("position") + 1).alias("n_positions"), F.max("chunk_id").alias("last_chunk"))
    return after.users().join(rows, "user_id").select("user_id", "index_type", "dimension", "num_vectors", "n_positions", "last_chunk")


# Evaluation

EXPECTED = """lt AS (SELECT chunk_id, ' ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+'), ' ') || ' ' AS t FROM leaves),
ql AS (SELECT item_id AS question_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS g FROM benchmark),
ex AS (SELECT question_id, chunk_id FROM ql JOIN lt ON len(g) > 0 AND contains(t, ' ' || array_to_string(g, ' ') || ' ')),
top AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_index DESC, chunk_id DESC) AS r FROM kw QUALIFY r <= 10),
ne AS (SELECT question_id, count(*) AS n FROM ex GROUP BY 1),
hit AS (SELECT question_id, count(*) FILTER (r <= 5) AS h5, count(*) AS h10, min(r) AS best FROM ex JOIN top USING (question_id, chunk_id) GROUP BY 1),
per AS (SELECT q.question_id, CASE WHEN n IS NULL THEN 'out_of_scope' ELSE 'known' END AS category, CASE WHEN n > 0 THEN round(coalesce(h5, 0) / n, 6) END AS recall_5, CASE WHEN n > 0 THEN round(coalesce(h10, 0) / n, 6) END AS recall_10,
  CASE WHEN n > 0 THEN round(coalesce(1.0 / best, 0.0), 6) END AS mrr_10, CAST(CASE WHEN n > 0 THEN best IS NOT NULL ELSE q.question_id NOT IN (SELECT question_id FROM top) END AS INTEGER) AS hit_10
  FROM ql q LEFT JOIN ne USING (question_id) LEFT JOIN hit USING (question_id))"""


def expected(spark, d):
    """Chunks that hold all words of a question in a row: found by an equi-join on its first words (eight, or all of a shorter one), then held against the whole."""
    lead, padded = 8, lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    asked = S.questions(spark, d).select("question_id", T.latin_tokens("question").alias("q")).where("size(q) > 0")
    asked = asked.select("question_id", F.least(F.size("q"), F.lit(lead)).alias("m"), F.array_join(F.slice("q", 1, lead), " ").alias("g"), padded(F.col("q")).alias("whole"))
    lengths = asked.select("m").distinct().agg(F.collect_set("m").alias("lengths"))  # eight numbers at most
    words = S.leaves(spark, d).select("chunk_id", T.latin_tokens("content").alias("w"))
    own = words.crossJoin(F.broadcast(lengths)).withColumn("m", F.explode("lengths")).where("size(w) >= m")
    runs = own.select("chunk_id", "m", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " ")))).alias("g"))
    met = runs.join(R.few(asked), ["m", "g"]).select("question_id", "chunk_id", "whole")
    return met.join(words, "chunk_id").where(F.contains(padded(F.col("w")), F.col("whole"))).select("question_id", "chunk_id").distinct()


def _evaluated(spark, d, scorer=None):
    wanted = expected(spark, d).groupBy("question_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("expected"))
    asked = S.questions(spark, d).select("question_id").join(wanted, "question_id", "left").withColumn("category", F.when(F.col("expected").isNull(), "out_of_scope").otherwise("known")).withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>")))
    hits = R.bm25(S.leaves(spark, d), R.question_terms(S.questions(spark, d)))
    got = E.per_question(asked, R.ranked(hits, ["question_id"], [F.desc("keyword_score"), F.desc("chunk_index"), F.desc("chunk_id")], 10))
    return got.select("question_id", "category", *[F.round(m, 6).alias(m) if m != "hit_10" else m for m in E.METRICS])


@query("q_eval_per_question", _with(LEAVES, KEYWORDS, EXPECTED) + "SELECT * FROM per")
def eval_per_question(spark, d):
    return _evaluated(spark, d)


_MEANS = "count(*) AS n_questions, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10, round(avg(hit_10), 6) AS hit_10"


@query("q_eval_summary", _with(LEAVES, KEYWORDS, EXPECTED) + f"SELECT {_MEANS} FROM per")
def eval_summary(spark, d):
    return E.summary(_evaluated(spark, d))


@query("q_eval_by_category", _with(LEAVES, KEYWORDS, EXPECTED) + f"SELECT category, {_MEANS} FROM per GROUP BY 1")
def eval_by_category(spark, d):
    return E.by_category(_evaluated(spark, d))


@query("q_eval_vs_baseline", _with(LEAVES, KEYWORDS, EXPECTED) + """, m AS (SELECT question_id, recall_5 AS now, CASE question_id % 3 WHEN 0 THEN round(recall_5 / 2, 6) WHEN 1 THEN round(recall_5 + question_id / 1000, 6) ELSE recall_5 END AS before FROM per WHERE recall_5 IS NOT NULL),
x AS (SELECT *, round(now - before, 6) AS delta FROM m)
(SELECT *, 'improved' AS direction FROM x WHERE delta > 0 ORDER BY delta DESC, question_id LIMIT 3) UNION ALL (SELECT *, 'regressed' AS direction FROM x WHERE delta < 0 ORDER BY delta, question_id LIMIT 3)""")
def eval_vs_baseline(spark, d):
    now = _evaluated(spark, d)
    moved = F.when(F.col("question_id") % 3 == 0, F.round(F.col("recall_5") / 2, 6)).when(F.col("question_id") % 3 == 1, F.round(F.col("recall_5") + F.col("question_id") / 1000, 6)).otherwise(F.col("recall_5"))
    return E.against_baseline(now, now.select("question_id", moved.alias("recall_5")), "recall_5")
