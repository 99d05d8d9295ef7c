"""Chunks, states, deletions, incremental reads and file events over whole tables."""

from pyspark.sql import functions as F

from findwell.functions import metadata as M
from findwell.operators import store as S
from findwell.sources import files
from findwell.streaming import watch as W
from findwell.suite.common import CLEAN, CUR, clean, current, table


def _chunks(spark, d):
    return table(spark, d, "document_chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index").distinct()


def q_current_rows(spark, d):
    c = current(spark, d)
    return c.select("id", "title", F.md5("content").alias("content_md5"), "eff")


def q_list_documents(spark, d):
    """A page of the documents, newest first."""
    return S.list_documents(clean(spark, d).select("id", "title", "created_at"), 20, 50)


def q_counts(spark, d):
    return S.counts(documents=current(spark, d).select("id"), chunks=_chunks(spark, d), results=table(spark, d, "search_results").select("search_id"))


def q_chunks_of_doc(spark, d):
    """Chunks of one document in order: that of the greatest id."""
    last = table(spark, d, "document_chunks").agg(F.max("document_id")).first()[0]
    return S.chunks_of(_chunks(spark, d), last or "")


def q_delete_cascade(spark, d):
    """What is left of documents and chunks once those with errors in the log are deleted."""
    bad = table(spark, d, "index_log").where(F.trim(F.lower("outcome")) == "error").select("id").distinct()
    left = S.cascade({"documents": (current(spark, d).select("id"), "id"), "chunks": (_chunks(spark, d), "document_id")}, bad)
    return left["documents"].select(F.lit("document").alias("kind"), "id").unionAll(left["chunks"].select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))


def q_update(spark, d):
    """The corpus with the titles of its German texts replaced."""
    x = table(spark, d, "documents").select("doc_id", "lang", "title")
    return S.update(x, x.where("lang = 'de'").withColumn("title", F.concat(F.lit("de/"), F.coalesce("title", F.lit("")))), "doc_id")


def q_hydrate_chunks(spark, d):
    """Chunks with the title of their document's current state; chunks of unknown documents are dropped."""
    x = current(spark, d).select(F.col("id").alias("document_id"), "title")
    return _chunks(spark, d).join(x, "document_id")


def q_incremental_diff(spark, d):
    """Source files of all states that the current states don't have with the same path, time and size."""
    s = table(spark, d, "stored_documents").select(M.from_json("metadata").alias("m"))
    listed = s.select(M.source_path("m").alias("path"), M.modified_at(F.try_element_at("m", F.lit("source_mtime"))).alias("mtime"), M.digits(F.try_element_at("m", F.lit("source_size"))).alias("size"))
    return files.changed(listed.where("path <> ''").distinct(), clean(spark, d)).select("path", F.col("mtime").cast("timestamp_ntz").alias("mtime"), "size")


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("action"), "ts", "event_id")


def q_debounce(spark, d):
    """Events of a user less than ten minutes apart, as one with the last kind."""
    x = W.debounced(_events(spark, d), 600_000, tie="event_id")
    return x.select("path", F.col("start").cast("timestamp_ntz").alias("start"), "events", "last")


def q_last_event(spark, d):
    return W.last_events(_events(spark, d)).select("path", "at")


def q_trailing_edges(spark, d):
    return W.trailing_edges(_events(spark, d), 600_000).select("path", "event_id")


QUERIES = {f.__name__: f for f in (q_current_rows, q_list_documents, q_counts, q_chunks_of_doc, q_delete_cascade, q_update, q_hydrate_chunks, q_incremental_diff, q_debounce, q_last_event, q_trailing_edges)}

_CHUNKS = "ch AS (SELECT DISTINCT id AS chunk_id, document_id, chunk_index FROM document_chunks)"
_META = "CASE WHEN json_valid(metadata) THEN metadata END"
_FILE = """coalesce(json_extract_string(m, '$.source_path'), '') AS path, make_timestamp(coalesce(try_cast(json_extract_string(m, '$.source_mtime') AS BIGINT), 0) // 1000) AS mtime,
  coalesce(try_cast(json_extract_string(m, '$.source_size') AS BIGINT), 0) AS size"""

SQL = {
    "q_current_rows": f"WITH {CUR} SELECT id, title, md5(content) AS content_md5, eff FROM cur",
    "q_list_documents": f"WITH {CLEAN} SELECT id, title, created_at FROM doc ORDER BY created_at DESC, id LIMIT 50 OFFSET 20",
    "q_counts": f"WITH {CUR}, {_CHUNKS} SELECT (SELECT count(*) FROM cur) AS documents, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM search_results) AS results",
    "q_chunks_of_doc": f"WITH {_CHUNKS} SELECT * FROM ch WHERE document_id = (SELECT max(document_id) FROM document_chunks)",
    "q_delete_cascade": f"""WITH {CUR}, {_CHUNKS}, bad AS (SELECT DISTINCT id FROM index_log WHERE trim(lower(outcome)) = 'error' AND id IS NOT NULL)
SELECT 'document' AS kind, id FROM cur WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'chunk', chunk_id FROM ch WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM bad)""",
    "q_update": "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'de/' || coalesce(title, '') ELSE title END AS title FROM documents",
    "q_hydrate_chunks": f"WITH {CUR}, {_CHUNKS} SELECT document_id, chunk_id, chunk_index, title FROM ch JOIN (SELECT id AS document_id, title FROM cur) USING (document_id)",
    "q_incremental_diff": f"""WITH {CUR}, a AS (SELECT DISTINCT {_FILE} FROM (SELECT {_META} AS m FROM stored_documents)), k AS (SELECT DISTINCT {_FILE} FROM (SELECT {_META} AS m FROM cur))
SELECT path, mtime, size FROM a WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.path = a.path AND k.mtime = a.mtime AND k.size = a.size)""",
    "q_debounce": """WITH g AS (SELECT user_id::VARCHAR AS path, event_type, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE AND ts <> lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM g) SELECT path, min(ts) AS start, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last FROM s GROUP BY path, k""",
    "q_last_event": "SELECT user_id::VARCHAR AS path, max(ts) AS at FROM events GROUP BY user_id",
    "q_trailing_edges": """SELECT path, event_id FROM (SELECT user_id::VARCHAR AS path, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) WHERE nx IS NULL OR nx - ts >= INTERVAL 10 MINUTE""",
}
