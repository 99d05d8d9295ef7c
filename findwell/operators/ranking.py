"""Content-aware ranking: four scores of a document, weighted, times multipliers.

All of it is column arithmetic, so a page or a whole collection is ranked in one pass without a
shuffle. The query is a column too: one query for all rows or another one for each. Terms match as
substrings, also inside words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findwell.config import AUTHOR_FIELDS, TAG_FIELDS, RankingConfig
from findwell.functions import metadata as M
from findwell.functions import paths as P
from findwell.functions import query as Q
from findwell.functions import text as T


@dataclass(frozen=True)
class Context:
    """What a scorer sees of a row. Null parts count as absent."""

    query: Column
    tokens: Column
    phrases: Column
    title: Column
    content: Column
    name: Column  # words of the title as a file name
    low: Column  # the content in lower case
    n_words: Column  # of the content
    headers: Column  # of the content
    metadata: Column
    path: Column
    size: Column
    modified: Column
    as_of: Column
    documents: Column  # how many the collection has; 0 switches the rarity of terms off
    frequencies: Column  # map from term to how many documents hold it
    name_found: Column  # how many of the tokens the name holds
    name_phrase: Column  # whether it holds any phrase
    name_order: Column  # whether it holds all tokens, in their order
    low_found: Column  # the same of the content
    low_phrase: Column
    low_order: Column


DOCUMENT_PARTS = ["title", "content", "name", "low", "n_words", "headers", "metadata", "path", "size", "modified"]
QUERY_PARTS = ["query", "tokens", "phrases", "as_of", "documents", "frequencies"]
FOUND_PARTS, ORDER_PARTS = ["name_found", "name_phrase", "low_found", "low_phrase"], ["name_order", "low_order"]


def _computed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once per row, however often it is used.

    A projection would be merged into each of its uses; a generator of one row isn't.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def prepared(df: DataFrame, title="title", content="content", metadata="metadata") -> DataFrame:
    """Documents with what scorers need of them, worked out once per document, before they meet queries.

    Path, size and time of the file come from the metadata (a map of strings).
    """
    m, text, name = T.col(metadata), F.coalesce(T.col(content), F.lit("")), F.coalesce(T.col(title), F.lit(""))
    parts = {
        "title": name, "content": text, "name": T.filename_words(name), "low": F.lower(text), "n_words": F.size(T.words(text)), "headers": T.headers(text), "metadata": m,
        "path": M.source_path(m), "size": M.digits(F.coalesce(F.try_element_at(m, F.lit("source_size")), F.lit("0"))),
        "modified": F.when(F.map_contains_key(m, F.lit("source_mtime")), M.modified_at(F.try_element_at(m, F.lit("source_mtime")))),
    }
    return _computed(df, F.struct(*[parts[n].alias(n) for n in DOCUMENT_PARTS]), "__doc")


def with_context(df: DataFrame, query: Column, title="title", content="content", metadata="metadata", as_of=None, documents=None, frequencies=None) -> tuple[DataFrame, Context]:
    """The rows with the parts of the context as columns, computed once; and the context over them.

    Rows that are :func:`prepared` already keep what they have.
    """
    rows = df if "__doc" in df.columns else prepared(df, title, content, metadata)
    parts = {
        "query": query, "tokens": Q.match_tokens(query), "phrases": Q.phrases(query), "as_of": F.current_timestamp() if as_of is None else as_of,
        "documents": F.lit(0) if documents is None else documents,
        "frequencies": F.expr("cast(map() as map<string,bigint>)") if frequencies is None else frequencies,
    }
    rows = _computed(rows, F.struct(*[parts[n].alias(n) for n in QUERY_PARTS]), "__ctx")
    named = {n: F.col(f"__doc.{n}") for n in DOCUMENT_PARTS} | {n: F.col(f"__ctx.{n}") for n in QUERY_PARTS}
    # What several scores need of a document and a query together, once; the order only where all is found.
    rows = _computed(rows, F.struct(*[x.alias(n) for n, x in _found(named).items()]), "__found")
    named |= {n: F.col(f"__found.{n}") for n in FOUND_PARTS}
    rows = _computed(rows, F.struct(*[x.alias(n) for n, x in _order(named).items()]), "__order")
    return rows, Context(**named, **{n: F.col(f"__order.{n}") for n in ORDER_PARTS})


def _found(c: dict[str, Column]) -> dict[str, Column]:
    any_phrase = lambda text: F.exists(c["phrases"], lambda p: F.contains(text, p))
    return {f"{x}_found": T.count_terms_in(c["tokens"], c[x], True) for x in ("name", "low")} | {f"{x}_phrase": any_phrase(c[x]) for x in ("name", "low")}


def _order(c: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}_order": F.when(c[f"{x}_found"] == F.size(c["tokens"]), T.terms_in_order(c["tokens"], c[x], True)).otherwise(False) for x in ("name", "low")}


def _best(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def _any_phrase(ctx: Context, low: Column) -> Column:
    return F.exists(ctx.phrases, lambda p: F.contains(low, p))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# --- filename ----------------------------------------------------------------------------------


def filename_parts(ctx: Context, c: RankingConfig) -> dict[str, Column]:
    """The parts of the filename score; ``bonus`` is added to the greatest of the others."""
    name, n = ctx.name, F.size(ctx.tokens)
    asked = F.lower(F.trim(ctx.query))
    same = F.replace(name, F.lit(" "), F.lit("")) == F.replace(asked, F.lit(" "), F.lit(""))
    found = ctx.name_found
    length = lambda t: F.octet_length(t)

    def near(t: Column) -> Column:
        long = F.greatest(F.lit(0), length(t) - 3)
        prefix = F.when(F.exists(T.words(name), lambda w: F.startswith(w, t)), c.filename_prefix * (1 + 0.05 * long)).otherwise(0.0)
        inside = F.when(F.contains(name, t), c.filename_substring * (1 + 0.03 * long)).otherwise(0.0)
        return F.greatest(prefix, inside)

    def repeated(t: Column) -> Column:
        k = T.occurrences(t, name, True)
        return F.when(k > 1, c.occurrence_bonus * (1 - 1 / k)).otherwise(0.0)

    ext = T.extension(ctx.title)
    return {
        "exact": F.when(name == asked, c.exact_filename).when(same, c.near_exact_filename).otherwise(0.0),
        "phrase": F.when(ctx.name_phrase, c.filename_phrase).otherwise(0.0),
        "words": F.when(n == 0, 0.0).when(found == n, F.when(ctx.name_order, c.filename_in_order).otherwise(c.filename_all_words)).otherwise(c.filename_substring * found / n),
        "extension": F.when((ext != "") & F.exists(ctx.tokens, lambda t: F.regexp_replace(t, r"^\.", "") == ext), c.extension).otherwise(0.0),
        "near": _best(F.transform(ctx.tokens, near)),
        "bonus": _sum(F.transform(ctx.tokens, repeated)),
    }


def filename_score(ctx: Context, c: RankingConfig) -> Column:
    p = filename_parts(ctx, c)
    bonus = p.pop("bonus")
    nothing = (ctx.title == "") | ((F.size(ctx.tokens) == 0) & (F.size(ctx.phrases) == 0))
    return F.when(nothing, 0.0).otherwise(F.greatest(*p.values()) + bonus)


def score_filename(query: Column, name: Column, c: RankingConfig | None = None) -> Column:
    """The filename score of a name by itself; a null name counts as an empty one."""
    title = F.coalesce(name, F.lit(""))
    parts = {n: F.lit(None) for n in DOCUMENT_PARTS + QUERY_PARTS} | {"query": query, "tokens": Q.match_tokens(query), "phrases": Q.phrases(query), "title": title, "name": T.filename_words(title), "low": F.lit("")}
    parts |= _found(parts)
    return filename_score(Context(**parts, **_order(parts)), c or RankingConfig())


def score_filename_or_path(query: Column, title: Column, path: Column, c: RankingConfig | None = None) -> Column:
    """The same of the title, or of the last part of the path where there is no title."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "([^/]*)$", 1)
    return score_filename(query, F.when(F.coalesce(title, F.lit("")) == "", base).otherwise(title), c)


def filename_details(ctx: Context, c: RankingConfig) -> Column:
    name, found, n = ctx.name, ctx.name_found, F.size(ctx.tokens)
    kind = (
        F.when(ctx.title == "", "none").when(name == F.lower(F.trim(ctx.query)), "exact")
        .when((n > 0) & (found == n), F.when(ctx.name_order, "phrase").otherwise("all_words"))
        .when(found > 0, "partial").otherwise("none")
    )
    return F.struct(filename_score(ctx, c).alias("score"), kind.alias("match_type"), F.filter(ctx.tokens, lambda t: F.contains(name, t)).alias("matched_terms"))


# --- content -----------------------------------------------------------------------------------


def idf(documents: Column, df: Column) -> Column:
    """1 for an empty collection, 1 + N for a term it doesn't hold, else 1 + N / df."""
    n = documents.cast("double")
    return F.when(n == 0, 1.0).when(F.coalesce(df, F.lit(0)) == 0, 1 + n).otherwise(1 + n / df)


def term_frequency(term, text) -> Column:
    """Occurrences as a substring over the number of words; 0 without words."""
    n = F.size(T.words(text))
    return F.when(n > 0, T.occurrences(term, text) / n).otherwise(0.0)


def tf_idf(term, text, documents: Column, df: Column) -> Column:
    return term_frequency(term, text) * idf(documents, df)


def tfidf_multiplier(ctx: Context, c: RankingConfig) -> Column:
    n = ctx.n_words
    weights = F.filter(F.transform(ctx.tokens, lambda t: T.occurrences(t, ctx.low, True) / n * idf(ctx.documents, F.try_element_at(ctx.frequencies, t))), lambda w: w > 0)
    mean = _sum(weights) / F.size(weights)
    return F.when((ctx.documents == 0) | (n == 0), 1.0).when(F.size(weights) == 0, 1.0).otherwise(F.least(1 + mean * 10, F.lit(c.max_tfidf)))


def position_multiplier(ctx: Context, c: RankingConfig) -> Column:
    """More if a phrase or token stands in the first part of the content (at least 100 characters)."""
    early = F.left(ctx.low, F.greatest(F.lit(100), F.floor(F.length(ctx.content) * c.position_share).cast("int")))
    hit = _any_phrase(ctx, early) | F.exists(ctx.tokens, lambda t: F.contains(early, t))
    return F.when(hit, c.position_multiplier).otherwise(1.0)


def header_score(ctx: Context, c: RankingConfig) -> Column:
    n = F.size(ctx.tokens)
    each = F.transform(ctx.headers, lambda h: c.header * (1 + (5 - h["level"]) * 0.1) * T.count_terms_in(ctx.tokens, h["text"]) / n)
    return F.when(n > 0, _best(each)).otherwise(0.0)


def phrase_score(ctx: Context, c: RankingConfig) -> Column:
    def one(p: Column) -> Column:
        k = T.occurrences(p, ctx.low, True)
        return F.when(k == 0, 0.0).otherwise(c.content_phrase + F.when(k > 1, F.least(c.phrase_repeat * (k - 1), F.lit(c.phrase_repeat_most))).otherwise(0.0))

    return _best(F.transform(ctx.phrases, one))


def words_score(ctx: Context, c: RankingConfig) -> Column:
    n, found = F.size(ctx.tokens), ctx.low_found
    base = F.when((n == 0) | (found == 0), 0.0).when(found == n, F.when(ctx.low_order, c.content_in_order).otherwise(c.content_scattered)).otherwise(c.content_scattered * found / n)
    return base * tfidf_multiplier(ctx, c) if c.tfidf_enabled else base


def content_score(ctx: Context, c: RankingConfig) -> Column:
    best = F.greatest(phrase_score(ctx, c), header_score(ctx, c), words_score(ctx, c))
    placed = best * position_multiplier(ctx, c) if c.position_enabled else best
    return F.when((ctx.content == "") | ((F.size(ctx.tokens) == 0) & (F.size(ctx.phrases) == 0)), 0.0).otherwise(placed)


def content_details(ctx: Context, c: RankingConfig) -> Column:
    low, n = ctx.low, F.size(ctx.tokens)
    found = ctx.low_found
    kind = (
        F.when(ctx.content == "", "none").when(ctx.low_phrase, "phrase")
        .when((n > 0) & (found == n), F.when(ctx.low_order, "phrase").otherwise("all_words"))
        .when(found > 0, "partial").otherwise("none")
    )
    heads = F.filter(ctx.headers, lambda h: T.count_terms_in(ctx.tokens, h["text"]) > 0)
    return F.struct(
        content_score(ctx, c).alias("score"), kind.alias("match_type"), F.filter(ctx.phrases, lambda p: F.contains(low, p)).alias("phrase_matches"),
        F.filter(ctx.tokens, lambda t: F.contains(low, t)).alias("matched_terms"), F.transform(heads, lambda h: h["text"]).alias("header_matches"),
    )


# --- path and metadata -------------------------------------------------------------------------


def path_score(ctx: Context, c: RankingConfig) -> Column:
    """Sum over folders of the best match of any token, plus a bonus for each further folder that matches."""

    def match(folder: Column, t: Column) -> Column:
        part = F.when(F.contains(folder, t), c.path_partial + (c.path_exact - c.path_partial) * F.octet_length(t) / F.octet_length(folder)).otherwise(0.0)
        begin = F.when(F.startswith(folder, t), c.path_partial * 1.2).otherwise(0.0)
        return F.when(folder == t, c.path_exact).otherwise(F.greatest(part, begin))

    scores = F.filter(F.transform(P.path_components(ctx.path), lambda f: _best(F.transform(ctx.tokens, lambda t: match(F.lower(f), t)))), lambda s: s > 0)
    return F.when(ctx.path == "", 0.0).otherwise(_sum(scores) + F.when(F.size(scores) > 1, c.path_bonus * (F.size(scores) - 1)).otherwise(0.0))


def path_details(ctx: Context, c: RankingConfig) -> Column:
    hit = lambda f: F.filter(ctx.tokens, lambda t: F.contains(F.lower(f), t))
    folders = F.filter(P.path_components(ctx.path), lambda f: F.size(hit(f)) > 0)
    return F.struct(path_score(ctx, c).alias("score"), folders.alias("matched_components"), F.transform(folders, lambda f: F.element_at(hit(f), 1)).alias("matched_terms"))


def _base(key: Column, c: RankingConfig) -> Column:
    k = F.lower(key)
    return F.when(k.isin(*AUTHOR_FIELDS), c.author).when(k.isin(*TAG_FIELDS), c.tag).otherwise(c.other_metadata)


def metadata_score(ctx: Context, c: RankingConfig) -> Column:
    """Sum over the visible fields of their base times the share of tokens they hold."""
    n = F.size(ctx.tokens)
    fields = F.array_sort(F.map_entries(M.visible(ctx.metadata)))
    each = F.transform(fields, lambda e: _base(e["key"], c) * T.count_terms_in(ctx.tokens, M.as_text(e["value"])) / n)
    return F.when((n == 0) | ctx.metadata.isNull(), 0.0).otherwise(_sum(each))


def metadata_details(ctx: Context, c: RankingConfig) -> Column:
    hits = F.transform_values(M.visible(ctx.metadata), lambda k, v: F.filter(ctx.tokens, lambda t: F.contains(F.lower(M.as_text(v)), t)))
    return F.struct(metadata_score(ctx, c).alias("score"), F.map_filter(hits, lambda k, v: F.size(v) > 0).alias("matched_fields"))


# --- multipliers -------------------------------------------------------------------------------


def recency_multiplier(ctx: Context, c: RankingConfig) -> Column:
    """By the age of the file at ``as_of``: under a day, a week, thirty days; 1 without a time."""
    age = F.unix_micros(ctx.as_of.cast("timestamp")) - F.unix_micros(ctx.modified.cast("timestamp"))
    day = 86_400_000_000
    return F.when(age < day, c.recent_day).when(age < 7 * day, c.recent_week).when(age < 30 * day, c.recent_month).otherwise(1.0)


def quality_type(ctx: Context) -> Column:
    """phrase, all_words, partial or none: the filename's match, unless partial, before the content's."""
    n = F.size(ctx.tokens)
    order = lambda ordered: F.when(ordered, "phrase").otherwise("all_words")
    return (
        F.when((ctx.title != "") & ctx.name_phrase, "phrase").when((ctx.title != "") & (n > 0) & (ctx.name_found == n), order(ctx.name_order))
        .when(ctx.low_phrase, "phrase").when((ctx.content != "") & (n > 0) & (ctx.low_found == n), order(ctx.low_order))
        .when(ctx.low_found > 0, "partial").otherwise("none")
    )


def quality_multiplier(ctx: Context, c: RankingConfig) -> Column:
    kind = quality_type(ctx)
    return F.when(kind == "phrase", c.phrase_quality).when(kind == "all_words", c.all_words_quality).when(kind == "partial", c.partial_quality).otherwise(1.0)


def size_multiplier(ctx: Context, c: RankingConfig) -> Column:
    """Small files up to a tenth more, large ones up to a tenth less."""
    s = ctx.size.cast("double")
    return F.when(s <= 0, 1.0).when(s < 1024, 1 + 0.1 * (1 - s / 1024)).when(s > 1048576, 1 - F.least(0.05 * F.log10(s / 1048576), F.lit(0.1))).otherwise(1.0)


Multiplier = Callable[[Context, RankingConfig], Column]
Scorer = Callable[[Context, RankingConfig], Column]


def default_multipliers(c: RankingConfig) -> dict[str, Multiplier]:
    chosen = {"recency": (c.recency_enabled, recency_multiplier), "query_quality": (c.quality_enabled, quality_multiplier), "file_size": (c.size_enabled, size_multiplier)}
    return {n: m for n, (on, m) in chosen.items() if on}


def match_type(ctx: Context) -> Column:
    """The best match of filename and content by name; exact only for the whole file name."""
    name, n, titled = ctx.name, F.size(ctx.tokens), ctx.title != ""
    order = lambda ordered: F.when(ordered, "phrase").otherwise("all_words")
    by_name = F.when(titled & ctx.name_phrase, "phrase").when(titled & (n > 0) & (ctx.name_found == n), order(ctx.name_order)).otherwise("none")
    by_text = (
        F.when(ctx.low_phrase, "phrase").when((ctx.content != "") & (n > 0) & (ctx.low_found == n), order(ctx.low_order))
        .when((n > 0) & (ctx.low_found > 0), "partial").otherwise("none")
    )
    # All words in the name are bettered by a phrase of the content only.
    after_words = F.when(ctx.low_phrase, "phrase").otherwise("all_words")
    return F.when(titled & (name == T.filename_words(ctx.query)), "exact").when(by_name == "phrase", "phrase").when(by_name == "all_words", after_words).otherwise(by_text)


SCORERS: dict[str, Scorer] = {"filename": filename_score, "content": content_score, "path": path_score, "metadata": metadata_score}


def ranked(df: DataFrame, query: Column, config: RankingConfig | None = None, multipliers: dict[str, Multiplier] | None = None, scorers: dict[str, tuple[Scorer, float]] | None = None, positive: bool = False, **context) -> DataFrame:
    """``df`` with rank_score and breakdown (the four scores, the multipliers, the match type).

    ``multipliers`` replaces the configured ones, ``scorers`` adds scores with weights of their own.
    With ``positive`` only rows of a score over 0 stay.
    """
    c = config or RankingConfig()
    rows, ctx = with_context(df, query, **context)
    weights = {"filename": c.filename_weight, "content": c.content_weight, "path": c.path_weight, "metadata": c.metadata_weight}
    chosen = {n: (s, weights[n]) for n, s in SCORERS.items()} | (scorers or {})
    factors = default_multipliers(c) if multipliers is None else multipliers
    parts = [s(ctx, c).cast("double").alias(n) for n, (s, _) in chosen.items()] + [m(ctx, c).cast("double").alias(f"x_{n}") for n, m in factors.items()]
    rows = _computed(rows, F.struct(*parts, match_type(ctx).alias("match_type")), "__s")
    base = reduce(lambda a, b: a + b, [F.col(f"__s.{n}") * w for n, (_, w) in chosen.items()])
    final = reduce(lambda a, b: a * b, [F.col(f"__s.x_{n}") for n in factors], base)
    details = F.struct(
        final.alias("final_score"), *[F.col(f"__s.{n}").alias(f"{n}_score") for n in chosen],
        (F.create_map(*[x for n in factors for x in (F.lit(n), F.col(f"__s.x_{n}"))]) if factors else F.expr("cast(map() as map<string,double>)")).alias("multipliers"),
        F.col("__s.match_type").alias("match_type"),
    )
    out = rows.select(*[F.col(n) for n in df.columns if n != "__doc"], final.alias("rank_score"), details.alias("breakdown"))
    return out.where("rank_score > 0") if positive else out


def at_least(rows: DataFrame, score: float) -> DataFrame:
    """Ranked rows of at least that score."""
    return rows.where(F.col("rank_score") >= score)


def top(rows: DataFrame, n: int, by: str | None = None, key: str = "id") -> DataFrame:
    """The ``n`` best ranked rows, of all or of each value of ``by``; ties by ``key``. 0 or less gives none."""
    order = [F.desc("rank_score"), F.col(key)]
    if by is None:
        return rows.orderBy(*order).limit(max(0, n))
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__p") <= n).drop("__p")


query_tokens = Q.match_tokens


def corpus_stats(documents: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """(term, df): in how many documents each token of the *query* analysis of content and title stands."""
    text = F.concat(F.coalesce(F.col(content), F.lit("")), F.lit(" "), F.coalesce(F.col(title), F.lit("")))
    rows = documents.select(F.explode(F.array_distinct(Q.terms(text))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequencies_of(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, frequencies): for each query the map of its tokens' document frequencies."""
    tokens = queries.select("query_id", F.explode(Q.match_tokens("query")).alias("term"))
    found = tokens.join(stats, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("frequencies"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("frequencies", F.expr("cast(map() as map<string,bigint>)")).alias("frequencies"))
