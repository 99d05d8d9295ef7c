"""Spelling suggestions from the terms of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findwell.functions.text import query_words
from findwell.operators.keyword import deletions, of_near_length


def misspelled(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The terms that the dictionary (term, df) doesn't hold."""
    return terms.join(dictionary.where("df > 0").select("term"), "term", "left_anti")


def suggest(terms: DataFrame, dictionary: DataFrame, distance: int = 2, frequency: int = 1, most: int = 3) -> DataFrame:
    """(term, suggestion, distance, df, score, rank): dictionary terms near each term, the frequent and near ones first.

    Score is df / (distance + 1). The term itself is no suggestion. Ties go to the smaller term.
    Terms meet their neighbours by common deletions, not by comparison with the whole dictionary.
    """
    asked = deletions(terms.select("term").distinct(), distance).withColumnRenamed("term", "asked")
    near_length = of_near_length(dictionary.where(F.col("df") >= frequency).select("term"), terms.select("term"), distance)
    known = deletions(near_length, distance)
    near = asked.join(known, "stub").select("asked", "term").distinct().where(F.col("asked") != F.col("term"))
    near = near.withColumn("distance", F.levenshtein("asked", "term", distance)).where("distance >= 0")
    scored = near.join(dictionary, "term").withColumn("score", F.col("df") / (F.col("distance") + 1.0))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("asked").alias("term"), F.col("term").alias("suggestion"), "distance", "df", "score", "rank")


def check(queries: DataFrame, dictionary: DataFrame, **settings) -> DataFrame:
    """(query_id, corrected, misspelled): each unknown word of a query replaced by its best suggestion.

    A word without any suggestion stays. A query without words is corrected to an empty text.
    """
    words = queries.select("query_id", F.posexplode(query_words("query")).alias("place", "term"))
    unknown = misspelled(words.select("term").distinct(), dictionary)
    best = suggest(unknown, dictionary, **{**settings, "most": 1}).select("term", "suggestion")
    marked = words.join(unknown.withColumn("bad", F.lit(True)), "term", "left").join(best, "term", "left")
    word = F.struct("place", F.coalesce("suggestion", "term").alias("w"), F.when(F.col("bad"), F.col("term")).alias("b"))
    rows = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    texts = rows.select("query_id", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("corrected"), F.array_join(F.transform("ws", lambda x: x["b"]), " ").alias("misspelled"))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("corrected", F.lit("")).alias("corrected"), F.coalesce("misspelled", F.lit("")).alias("misspelled"))
