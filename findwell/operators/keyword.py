"""Lexical retrieval over an inverted index kept as DataFrames.

``postings`` (field, term, id, tf, len, positions, first), ``lengths`` (field, id, len), and what is
counted of them: ``dictionary`` (field, term, df), where the field ``any`` counts documents that
hold the term in any field, and ``sizes`` (field, n, words). All are built once per collection.
Queries come as a DataFrame (query_id, query): many at once is the usual case, one is a DataFrame of
one row. A posting meets only the queries that hold its term, in one join with all that the score
needs, and what is shuffled by document is a score and the places where a phrase can begin.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findwell.functions.text import preprocess, query_words, title_for_search, tokens

K1, B = 1.2, 0.75
FIELDS = ("title", "content")
POSTINGS = "field string, term string, id {0}, tf int, len int, positions array<int>, first boolean"


def _postings(batches):
    """Postings of documents, each from its own row: an index is built without a shuffle."""
    for batch in batches:
        owners: list[int] = []
        names, terms, positions, counts, sizes, first = [], [], [], [], [], []
        for row, fields in enumerate(zip(*[batch.column(f).to_pylist() for f in FIELDS])):
            seen: set[str] = set()
            for name, words in zip(FIELDS, fields):
                places: dict[str, list[int]] = {}
                for at, word in enumerate(words):
                    places.setdefault(word, []).append(at)
                terms.extend(places)
                first.extend([w not in seen for w in places] if seen else [True] * len(places))
                seen.update(places)
                owners.extend([row] * len(places))
                names.extend([name] * len(places))
                counts.extend(map(len, places.values()))
                sizes.extend([len(words)] * len(places))
                for p in places.values():
                    positions.extend(p)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()), pa.array(terms, pa.string()), batch.column("id").take(pa.array(owners, pa.int64())), pa.array(counts, pa.int32()), pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(positions, pa.int32())), pa.array(first, pa.bool_()),
            ],
            names=["field", "term", "id", "tf", "len", "positions", "first"],
        )


def by_term(postings: DataFrame) -> DataFrame:
    """Postings in ranges of term and id, sorted: a lookup skips most files, and a term that every
    document holds is spread over as many tasks and files as its postings fill."""
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "field", "id")


class KeywordIndex:
    """The index tables of a collection.

    Ids are unique. A null field is an empty one; a document without tokens has no postings but
    counts as a document. ``dictionary`` and ``sizes`` are counted from the others if left out.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, dictionary: DataFrame | None = None, sizes: DataFrame | None = None):
        self.postings, self.lengths, self._dictionary, self._sizes = postings, lengths, dictionary, sizes

    @classmethod
    def build(cls, documents: DataFrame, key: str = "id", title: str = "title", content: str = "content", stop_words: list[str] | None = None) -> "KeywordIndex":
        fields = documents.where(F.col(key).isNotNull()).select(
            F.col(key).alias("id"), tokens(title_for_search(F.coalesce(F.col(title), F.lit(""))), stop_words).alias("title"), tokens(F.coalesce(F.col(content), F.lit("")), stop_words).alias("content"),
        )
        postings = fields.mapInArrow(_postings, POSTINGS.format(fields.schema["id"].dataType.simpleString()))
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f).alias("len")) for f in FIELDS])).alias("f")
        return cls(postings, fields.select("id", each).select("f.field", "id", "f.len"))

    def write(self, path: str) -> "KeywordIndex":
        """The tables as Parquet."""
        spark = self.postings.sparkSession
        self.postings.write.mode("overwrite").parquet(f"{path}/unsorted")
        plain = spark.read.parquet(f"{path}/unsorted")
        by_term(plain).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        stored = KeywordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))
        stored.dictionary().sort("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        stored.sizes().write.mode("overwrite").parquet(f"{path}/sizes")
        return KeywordIndex.open(spark, path)

    @classmethod
    def open(cls, spark, path: str) -> "KeywordIndex":
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "dictionary", "sizes")])

    def without(self, ids: DataFrame) -> "KeywordIndex":
        """The index less the documents whose id is listed."""
        return KeywordIndex(self.postings.join(ids.select("id"), "id", "left_anti"), self.lengths.join(ids.select("id"), "id", "left_anti"))

    def plus(self, other: "KeywordIndex") -> "KeywordIndex":
        return KeywordIndex(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths))

    # statistics

    def dictionary(self) -> DataFrame:
        """(field, term, df) of each field and of ``any``: counted where the postings lie, then added up."""
        if self._dictionary is not None:
            return self._dictionary
        fields = F.explode(F.when(F.col("first"), F.array("field", F.lit("any"))).otherwise(F.array("field"))).alias("field")
        return self.postings.select(fields, "term").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def sizes(self) -> DataFrame:
        """(field, n, words): the documents and words of each field; at most two rows."""
        return self._sizes if self._sizes is not None else self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words"))

    def document_count(self) -> DataFrame:
        return self.sizes().where("field = 'content'").agg(F.coalesce(F.max("n"), F.lit(0)).alias("documents"))

    def term_frequencies(self) -> DataFrame:
        """(term, df): in how many documents each term stands, in any field."""
        if self._dictionary is not None:
            return self._dictionary.where("field = 'any'").select("term", "df")
        return self.postings.where("first").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def vocabulary(self) -> DataFrame:
        """The distinct terms of all fields."""
        return self.term_frequencies().select("term")

    def corpus_stats(self, terms: DataFrame) -> DataFrame:
        """(documents, term, df) of the listed terms; 0 for those that don't occur."""
        df = self.term_frequencies()
        rows = terms.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
        return rows.withColumn("documents", self.document_count().scalar())

    # scores

    def with_statistics(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (query_id, term, ...) with field, df, n and average length, for each field that holds the term."""
        stats = self.sizes().select("field", "n", (F.col("words") / F.col("n")).alias("average"))  # at most two rows
        known = self.dictionary().where(F.col("field") != "any").join(wanted.select("term").distinct(), "term", "left_semi")
        return wanted.join(known.join(F.broadcast(stats), "field"), "term")

    def hits(self, weighed: DataFrame, scorer: str = "bm25") -> DataFrame:
        """The postings that ``weighed`` asks for, each with its query and score ``s``."""
        met = self.postings.select("field", "term", "id", "tf", "len", "positions").join(weighed, ["field", "term"])
        return met.withColumn("s", score(scorer, F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("average")))


def score(scorer: str, tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """Weight of a term in a field: ``bm25``, or ``tfidf`` (root of tf, idf, root of the length)."""
    if scorer == "bm25":
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    if scorer == "tfidf":
        return F.sqrt(tf.cast("double")) * (1 + F.log(n / (df + 1.0))) / F.sqrt(length.cast("double"))
    raise ValueError(f"unknown scorer {scorer}")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, words, places, distinct) of the index tokens of each query, without a shuffle.

    ``times`` and ``places`` say how often and where the token stands in the query, ``words`` how many words
    the query has, ``distinct`` how many different tokens, ``count`` how many tokens.
    """
    rows = queries.select("query_id", tokens("query").alias("__t"), F.size(query_words("query")).alias("words"))
    rows = rows.select("query_id", "words", "__t", F.size("__t").alias("count"), F.size(F.array_distinct("__t")).alias("distinct"), F.explode(F.array_distinct("__t")).alias("term"))
    places = F.filter(F.transform("__t", lambda t, i: F.when(t == F.col("term"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places).drop("__t")
    return rows.withColumn("times", F.size("places").cast("bigint"))


def fuzzy_terms(index: KeywordIndex, wanted: DataFrame, fuzziness: int = 2) -> DataFrame:
    """``wanted`` with each term replaced by the index terms within ``fuzziness`` edits; asked keeps the term.

    Instead of comparing all pairs, terms meet under the strings that deleting up to ``fuzziness``
    characters leaves of them; two terms within that distance have one in common.
    """
    asked = wanted.select("term").distinct()
    left, right = deletions(asked, fuzziness), deletions(of_near_length(index.vocabulary(), asked, fuzziness), fuzziness)
    near = left.withColumnRenamed("term", "asked").join(right, "stub").select("asked", "term").distinct()
    near = near.where(F.levenshtein("asked", "term", fuzziness) >= 0)
    return wanted.withColumnRenamed("term", "asked").join(near, "asked")


def of_near_length(terms: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The terms whose length differs by at most ``most`` from that of any asked term; long junk is left out."""
    sizes = asked.select(F.explode(F.sequence(F.length("term") - most, F.length("term") + most)).alias("__n")).distinct()
    return terms.join(sizes, F.length("term") == F.col("__n"), "left_semi")


def deletions(terms: DataFrame, most: int) -> DataFrame:
    """(term, stub): what is left of each term after deleting at most ``most`` characters."""

    def shorter(xs: Column) -> Column:
        one = F.flatten(F.transform(xs, lambda x: F.transform(F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
        return F.array_distinct(F.concat(xs, one))

    stubs = reduce(lambda c, _: shorter(c), range(most), F.array(F.col("term")))
    return terms.select("term", F.explode(stubs).alias("stub"))


def expanded(index: KeywordIndex, queries: DataFrame, fuzzy: bool = False, fuzziness: int = 2) -> DataFrame:
    """The terms to look up for each query, with the token ``asked`` that each stands for and all that scores need."""
    wanted = query_terms(queries)
    wanted = fuzzy_terms(index, wanted, fuzziness) if fuzzy else wanted.withColumn("asked", F.col("term"))
    return index.with_statistics(wanted)


def match_any(index: KeywordIndex, queries: DataFrame, scorer: str = "bm25", fuzzy: bool = False, fuzziness: int = 2) -> DataFrame:
    """(query_id, id, score): documents that hold any term of the query, both fields as one score."""
    hits = index.hits(expanded(index, queries, fuzzy, fuzziness), scorer)
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("s") * F.col("times")).alias("score"))


def _begins() -> Column:
    """Where a phrase can begin by one token: the places at which all its places in the query fit."""
    at = lambda place: F.transform("positions", lambda p: p - place)
    rest = F.slice("places", F.lit(2), F.size("places"))
    return F.aggregate(rest, at(F.element_at("places", 1)), lambda found, place: F.array_intersect(found, at(place)))


def _phrase(entries: Column, distinct: Column) -> Column:
    """Whether all tokens of the query stand next to each other in one field, by (field, begins) of each token."""

    def together(field: str) -> Column:
        mine = F.filter(entries, lambda e: e["field"] == field)
        common = F.aggregate(mine, F.element_at(mine, 1)["begins"], lambda found, e: F.array_intersect(found, e["begins"]))
        return F.when(F.size(mine) == distinct, F.size(common) > 0).otherwise(False)

    return together("title") | together("content")


def _entry() -> Column:
    exact = (F.col("count") > 1) & (F.col("term") == F.col("asked"))
    return F.collect_list(F.when(exact, F.struct("field", _begins().alias("begins"))))  # at most the tokens of the query, twice


def phrase_hits(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """(query_id, id): documents that hold all words of the query next to each other in one field."""
    hits = index.hits(expanded(index, queries).where(F.col("count") > 1))
    entries = hits.groupBy("query_id", "id").agg(_entry().alias("entries"), F.max("distinct").alias("distinct"))
    return entries.where(_phrase(F.col("entries"), F.col("distinct"))).select("query_id", "id")


def boosted(index: KeywordIndex, queries: DataFrame, title_boost: float = 3.0, phrase_boost: float = 1.5, scorer: str = "bm25", fuzzy: bool = False, fuzziness: int = 2) -> DataFrame:
    """(query_id, id, score): title score times its boost plus content score, times the squared share
    of the query's words that the document holds, times the phrase boost where they stand together.

    Boosts that aren't positive count as 1. Words are counted with their repetitions. A query of one
    word has no coverage and no phrase. The phrase is matched exactly in fuzzy search too.
    """
    return boosted_hits(index.hits(expanded(index, queries, fuzzy, fuzziness), scorer), title_boost, phrase_boost)


def boosted_hits(hits: DataFrame, title_boost: float = 3.0, phrase_boost: float = 1.5) -> DataFrame:
    """The same from the hits: one aggregation by query and document."""
    title_boost, phrase_boost = (b if b > 0 else 1.0 for b in (title_boost, phrase_boost))
    weight = F.when(F.col("field") == "title", title_boost).otherwise(1.0)
    held = F.collect_set(F.struct("asked", "times"))  # at most the words of the query
    matched = F.aggregate(held, F.lit(0).cast("bigint"), lambda n, w: n + w["times"])
    phrase = [_entry().alias("entries"), F.max("distinct").alias("distinct")] if phrase_boost > 1 else []
    merged = hits.groupBy("query_id", "id").agg(F.sum(F.col("s") * F.col("times") * weight).alias("s"), matched.alias("matched"), F.max("words").alias("words"), *phrase)
    share = F.least(F.lit(1.0), F.greatest("matched", F.lit(1)) / F.col("words"))
    total = F.col("s") * F.when(F.col("words") > 1, share * share).otherwise(1.0)
    if phrase_boost > 1:
        total = total * F.when((F.col("words") > 1) & _phrase(F.col("entries"), F.col("distinct")), phrase_boost).otherwise(1.0)
    return merged.select("query_id", "id", total.alias("score"))


def search(index: KeywordIndex, queries: DataFrame, title_boost: float = 3.0, phrase_boost: float = 1.5, **options) -> DataFrame:
    """The boosted score if any boost is over 1, else the plain one over all fields."""
    if title_boost > 1 or phrase_boost > 1:
        return boosted(index, queries, title_boost, phrase_boost, **options)
    return match_any(index, queries, **options)


def top(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The ``k`` best hits of each query, ties by id; k of 0 or less gives none."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def clean_documents(documents: DataFrame, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """(id, title, content) as they are indexed: white space collapsed, nulls empty."""
    return documents.select(F.col(key).alias("id"), F.coalesce(F.col(title), F.lit("")).alias("title"), preprocess(F.coalesce(F.col(content), F.lit(""))).alias("content"))
