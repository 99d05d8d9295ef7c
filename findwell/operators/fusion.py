"""Two disjoint ranked lists out of keyword and semantic hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_document(chunk_hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, score): each document's best chunk; hits on unknown chunks are dropped."""
    owner = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "document_id").distinct()
    return chunk_hits.join(owner, "chunk_id").groupBy("query_id", F.col("document_id").alias("id")).agg(F.max("score").alias("score"))


def split_by_source(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, id, source, score, keyword_score, semantic_score).

    A document with a keyword hit is in the keyword list alone, with both scores; the semantic
    list holds the others.
    """
    k = keyword.groupBy("query_id", "id").agg(F.max("score").alias("keyword_score"))
    s = semantic.groupBy("query_id", "id").agg(F.max("score").alias("semantic_score"))
    both = k.join(s, ["query_id", "id"], "full_outer")
    lexical = F.col("keyword_score").isNotNull()
    return both.select(
        "query_id", "id", F.when(lexical, "keyword").otherwise("semantic").alias("source"), F.coalesce("keyword_score", "semantic_score").alias("score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
    )


def above(fused: DataFrame, keyword: float, semantic: float) -> DataFrame:
    """Hits of at least their list's score; a threshold of 0 or less keeps all."""
    least = F.when(F.col("source") == "keyword", F.lit(keyword)).otherwise(F.lit(semantic))
    return fused.where((least <= 0) | (F.col("score") >= least))


def totals(fused: DataFrame) -> DataFrame:
    """(query_id, source, total) before paging."""
    return fused.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("total"))


def page(fused: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each list, ranked from 1 on each page; ties by id."""
    if offset < 0:
        raise ValueError("offset cannot be negative")
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "id"))
    rows = fused.withColumn("rank", place).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.withColumn("rank", F.col("rank") - offset)


def hydrate(paged: DataFrame, documents: DataFrame) -> DataFrame:
    """The page with its documents' columns; hits on unknown documents are dropped."""
    return paged.join(documents, "id")
