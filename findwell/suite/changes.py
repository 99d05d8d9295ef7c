"""Problem 6: which records no successful run has taken in."""

from pyspark.sql import functions as F

from findwell.operators.incremental import oldest_open, pending_from_mark, pending_states, processed_ledger


def _tables(spark, d):
    return [spark.read.parquet(f"{d}/{t}.parquet") for t in ("stored_documents", "index_log", "index_runs")]


def p6_found(spark, d):
    """Ids whose current state isn't in the ledger of successful runs: those seen from the mark on, and the backlog."""
    return pending_from_mark(*_tables(spark, d)).select("id")


def p6_reread(spark, d):
    """Of what arrived from the mark on, the ids whose current state isn't in the ledger."""
    tables = _tables(spark, d)
    return pending_states(*tables, reread_from=oldest_open(tables[2]).first()["open_since"]).select("id")


def p6_ledger(spark, d):
    """Per id the newest state taken in, and how many of its states were."""
    _, log, runs = _tables(spark, d)
    return processed_ledger(log, runs).groupBy("id").agg(F.max("version").alias("newest"), F.count("*").alias("states"))


def p6_open(spark, d):
    """Where the next run has to begin to reread."""
    return oldest_open(_tables(spark, d)[2])


QUERIES = {"p6_found": p6_found, "p6_reread": p6_reread, "p6_ledger": p6_ledger, "p6_open": p6_open}

_TAKEN = r"""taken AS (
  SELECT DISTINCT l.id, l.updated_at AS version FROM index_log l
  WHERE regexp_replace(lower(l.outcome), '^\s+|\s+$', '', 'g') = 'indexed' AND l.id IS NOT NULL AND l.updated_at IS NOT NULL
    AND l.run_id IN (SELECT run_id FROM index_runs WHERE regexp_replace(lower(status), '^\s+|\s+$', '', 'g') = 'succeeded'))"""

_MARK = r"""runs AS (SELECT *, coalesce(regexp_replace(lower(status), '^\s+|\s+$', '', 'g') = 'succeeded', false) AS good FROM index_runs),
  mark AS (SELECT CASE WHEN c IS NOT NULL THEN least(c, o) END AS open_since FROM (SELECT max(coalesce(high_mark, started_at)) FILTER (good) AS c FROM runs),
    (SELECT min(least(started_at, high_mark)) AS o FROM runs b WHERE NOT good AND NOT EXISTS (SELECT 1 FROM runs g WHERE g.good AND g.started_at > b.started_at AND CASE WHEN b.high_mark IS NOT NULL THEN g.high_mark >= b.high_mark ELSE g.started_at >= b.finished_at END)))"""

SQL = {
    "p6_found": f"""WITH {_TAKEN}, cur AS (
  SELECT id, max(coalesce(updated_at, created_at)) AS version FROM stored_documents WHERE id IS NOT NULL GROUP BY id)
SELECT c.id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = c.id AND t.version = c.version)""",
    "p6_ledger": f"WITH {_TAKEN} SELECT id, max(version) AS newest, count(*) AS states FROM taken GROUP BY id",
    "p6_open": f"WITH {_MARK} SELECT open_since FROM mark",
    "p6_reread": f"""WITH {_TAKEN}, {_MARK}, cur AS (
  SELECT id, max(coalesce(updated_at, created_at)) AS version FROM stored_documents WHERE id IN (SELECT id FROM stored_documents, mark WHERE open_since IS NULL OR arrived_at IS NULL OR arrived_at >= open_since) GROUP BY id)
SELECT c.id FROM cur c WHERE c.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = c.id AND t.version = c.version)""",
}
