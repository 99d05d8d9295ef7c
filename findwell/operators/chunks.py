"""Overlapping word windows: texts to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.functions.text import col, words


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """How many windows ``n`` words give: 1 for up to ``size``, 0 for none."""
    step = max(1, size - overlap)
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")


def word_windows(text, size: int, overlap: int) -> Column:
    """array<string> of the windows; each begins ``size - overlap`` words after the one before (1 at least).

    The last is the first to reach the end of the text.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    step, w = max(1, size - overlap), words(text)
    count = chunk_count(F.size(w), size, overlap)
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1) * step, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))


def chunk_documents(documents: DataFrame, key: str = "id", text: str = "content", size: int = 512, overlap: int = 50) -> DataFrame:
    """(chunk_id, document_id, chunk_index, content). A document without words is one empty chunk.

    Row by row, without a shuffle. Null ids are left out; a null text counts as empty.
    """
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("document_id"), word_windows(F.coalesce(col(text), F.lit("")), size, overlap).alias("w"))
    filled = F.when(F.size("w") == 0, F.array(F.lit(""))).otherwise(F.col("w"))
    parts = rows.select("document_id", F.posexplode(filled).alias("chunk_index", "content"))
    return parts.select(F.concat(F.col("document_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", "content")
