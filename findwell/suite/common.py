"""Inputs that the queries share, in Spark and as SQL."""

from pyspark.sql import functions as F

from findwell.functions import metadata as M
from findwell.functions.text import TOKEN, preprocess
from findwell.operators.state import current_rows

AS_OF = "2025-06-01 00:00:00"


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def current(spark, d):
    """(id, title, content, metadata text, created_at, eff) of the current rows of stored_documents."""
    s = table(spark, d, "stored_documents")
    return current_rows(s, {c: F.col(c) for c in ("title", "content", "metadata", "created_at")}).withColumnRenamed("effective_at", "eff")


def clean(spark, d):
    """The current rows as they are indexed: nulls empty, contents cleaned."""
    c = current(spark, d)
    return c.select("id", F.coalesce("title", F.lit("")).alias("title"), preprocess(F.coalesce("content", F.lit(""))).alias("content"), M.from_json("metadata").alias("metadata"), "created_at", "eff")


def asked(spark, d):
    """(query_id, query): the search queries that have a text."""
    q = table(spark, d, "search_queries")
    return q.select("query_id", preprocess("query_text").alias("query")).where("query <> ''")


SPACES = r"[\s\p{Z}\x{85}\x{0B}]+"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN.replace(chr(39), chr(39) * 2)}')"


CUR = """raw AS (SELECT id, title, content, metadata, created_at, coalesce(updated_at, created_at) AS eff,
    row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST) AS r FROM stored_documents WHERE id IS NOT NULL),
  cur AS (SELECT id, title, content, metadata, created_at, eff FROM raw WHERE r = 1)"""
CLEAN = CUR + f""",
  doc AS (SELECT id, coalesce(title, '') AS title, {sql_clean("coalesce(content, '')")} AS content, metadata, created_at, eff FROM cur)"""
ASKED = f"asked AS (SELECT query_id, {sql_clean('query_text')} AS query FROM search_queries WHERE {sql_clean('query_text')} <> '')"
POSTINGS = f"""fields AS (SELECT id, 'title' AS field, {sql_tokens("replace(title, '_', ' ')")} AS t FROM doc
    UNION ALL SELECT id, 'content', {sql_tokens("content")} FROM doc),
  flat AS (SELECT id, field, unnest(t) AS term, unnest(range(len(t))) AS position FROM fields),
  postings AS (SELECT field, term, id, count(*)::INT AS tf FROM flat GROUP BY ALL),
  lengths AS (SELECT field, id, len(t)::INT AS len FROM fields)"""


def sql_edits(a: str, b: str) -> str:
    """Edits between two texts in characters. DuckDB counts bytes, so the characters of both are renamed to ASCII first."""
    both = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '(?s).')), '')"
    named = lambda x: f"translate({x}, {both}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!?#$%&()*+-/<=>@[]^_{{}}|~')"
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE levenshtein({named(a)}, {named(b)}) END"
