"""Content-aware ranking of the current documents, with a query of its own for each."""

from pyspark.sql import functions as F

from findwell.config import RankingConfig
from findwell.functions import query as Q
from findwell.operators import ranking as R
from findwell.suite.common import AS_OF, CUR, asked, clean, table

CONFIG = RankingConfig(size_enabled=True)


def _pairs(spark, d):
    """Each query with the documents that it hit in the stored searches, where their texts are still kept."""
    hits = table(spark, d, "search_results").select("query_id", F.col("document_id").alias("id")).distinct()
    return R.prepared(clean(spark, d)).join(hits, "id").join(asked(spark, d), "query_id")


def _context(spark, d):
    rows = _pairs(spark, d)
    return R.with_context(rows, F.col("query"), as_of=F.lit(AS_OF).cast("timestamp_ntz"))


def _score(spark, d, scorer):
    rows, ctx = _context(spark, d)
    return rows.select("query_id", "id", F.round(scorer(ctx, CONFIG), 6).alias("score"))


def q_rank_filename(spark, d):
    return _score(spark, d, R.filename_score)


def q_rank_content(spark, d):
    return _score(spark, d, R.content_score)


def q_rank_path(spark, d):
    return _score(spark, d, R.path_score)


def q_rank_metadata(spark, d):
    return _score(spark, d, R.metadata_score)


def q_position(spark, d):
    return _score(spark, d, R.position_multiplier)


def q_recency(spark, d):
    return _score(spark, d, R.recency_multiplier)


def q_quality(spark, d):
    rows, ctx = _context(spark, d)
    return rows.select("query_id", "id", R.quality_type(ctx).alias("quality"), R.quality_multiplier(ctx, CONFIG).alias("score"))


def q_filesize(spark, d):
    return _score(spark, d, R.size_multiplier)


def q_match_type(spark, d):
    rows, ctx = _context(spark, d)
    return rows.select("query_id", "id", R.match_type(ctx).alias("match_type"))


def q_rank_corpus(spark, d):
    """Document frequencies as the ranking counts them."""
    return R.corpus_stats(clean(spark, d))


def _frequencies(spark, d):
    return R.frequencies_of(asked(spark, d), R.corpus_stats(clean(spark, d)))


def q_tfidf(spark, d):
    """tf, idf and their product of each query token in the documents it hit."""
    n = clean(spark, d).agg(F.count("*").alias("n"))
    rows = _pairs(spark, d).withColumn("term", F.explode(Q.match_tokens("query"))).join(R.corpus_stats(clean(spark, d)), "term", "left").withColumn("n", n.scalar())
    tf, idf = R.term_frequency("term", "content"), R.idf(F.col("n"), F.col("df"))
    return rows.select("query_id", "id", "term", F.round(tf, 9).alias("tf"), F.round(idf, 6).alias("idf"), F.round(R.tf_idf("term", "content", F.col("n"), F.col("df")), 9).alias("tfidf"))


def _ranked(spark, d):
    n = clean(spark, d).agg(F.count("*").alias("n"))
    rows = _pairs(spark, d).join(_frequencies(spark, d), "query_id").withColumn("n", n.scalar())
    return R.ranked(rows, F.col("query"), CONFIG, as_of=F.lit(AS_OF).cast("timestamp_ntz"), documents=F.col("n"), frequencies=F.col("frequencies"), positive=True)


def q_rank_full(spark, d):
    return _ranked(spark, d).select("query_id", "id", F.round("rank_score", 4).alias("score"))


def q_rank_breakdown(spark, d):
    b = "breakdown"
    x = _ranked(spark, d)
    return x.select(
        "query_id", "id", *[F.round(f"{b}.{n}_score", 4).alias(n) for n in ("filename", "content", "path", "metadata", "final")],
        *[F.round(F.element_at(f"{b}.multipliers", F.lit(n)), 6).alias(n) for n in ("recency", "query_quality", "file_size")], F.col(f"{b}.match_type").alias("match_type"),
    )


def q_rank_details(spark, d):
    rows, ctx = _context(spark, d)
    return rows.select(
        "query_id", "id", R.filename_details(ctx, CONFIG).alias("f"), R.content_details(ctx, CONFIG).alias("c"), R.path_details(ctx, CONFIG).alias("p"),
    ).select("query_id", "id", F.col("f.match_type").alias("file_match"), F.col("f.matched_terms").alias("file_terms"), F.col("c.match_type").alias("text_match"), F.col("c.matched_terms").alias("text_terms"), F.col("p.matched_components").alias("folders"), F.col("p.matched_terms").alias("folder_terms"))


def q_rank_metadata_fields(spark, d):
    """The query's tokens that the visible metadata fields hold."""
    rows, ctx = _context(spark, d)
    x = rows.select("query_id", "id", R.metadata_details(ctx, CONFIG).alias("m"))
    field = lambda name: F.coalesce(F.try_element_at("m.matched_fields", F.lit(name)), F.expr("cast(array() as array<string>)")).alias(name)
    return x.select("query_id", "id", field("author"), field("tags"), F.round("m.score", 6).alias("score"))


def q_filename_only(spark, d):
    """File names scored by themselves; the name from the path where there is no title."""
    x = _pairs(spark, d).select("query_id", "id", "query", "title", F.concat(F.lit("/some/folder/"), "title").alias("path"))
    return x.select("query_id", "id", F.round(R.score_filename(F.col("query"), F.col("title"), CONFIG), 6).alias("score"), F.round(R.score_filename_or_path(F.col("query"), F.lit(""), F.col("path"), CONFIG), 6).alias("by_path"))


def q_rank_least(spark, d):
    """Ranked rows of a least score."""
    return R.at_least(_ranked(spark, d), 60.0).select("query_id", "id")


def q_rank_top(spark, d):
    """The three best ranked rows of each query."""
    x = _ranked(spark, d).withColumn("rank_score", F.round("rank_score", 4))
    return R.top(x, 3, by="query_id").select("query_id", "id", F.col("rank_score").alias("score"))


QUERIES = {f.__name__: f for f in (
    q_rank_filename, q_rank_content, q_rank_path, q_rank_metadata, q_position, q_recency, q_quality, q_filesize, q_match_type, q_rank_corpus, q_tfidf, q_rank_full, q_rank_breakdown, q_rank_details, q_rank_metadata_fields, q_filename_only, q_rank_least, q_rank_top,
)}

_SP = r"[\s\p{Z}\x{85}\x{0B}]+"
_EDGE = r"^[^\P{P}_-]+|[^\P{P}_-]+$"
_PHRASE = """["'']([^"'']+)["'']"""


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SP}'), lambda w: w <> '')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '{_EDGE}', '', 'g')"


def _terms(x: str) -> str:
    rest = _words(f"regexp_replace({x}, '{_PHRASE}', ' ', 'g')")
    return f"list_filter(list_transform(list_filter({rest}, lambda w: NOT starts_with(w, '-') AND lower(w) NOT IN ('not', 'and', 'or')), lambda w: {_norm('w')}), lambda w: w <> '')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}', ' ', 'g'))"


def _count(t: str, x: str) -> str:
    return f"((length({x}) - length(replace({x}, {t}, ''))) // length({t}))"


def _in_order(x: str) -> str:
    return f"(list_reduce(list_concat([{{'p': 0, 't': ''}}], list_transform(tokens, lambda t: {{'p': 0, 't': t}})), lambda a, b: {{'p': CASE WHEN a.p < 0 OR instr(substr({x}, a.p + 1), b.t) = 0 THEN -1 ELSE a.p + instr(substr({x}, a.p + 1), b.t) END, 't': b.t}})).p >= 0"


def _found(x: str) -> str:
    return f"len(list_filter(tokens, lambda t: contains({x}, t)))"


def _phrase_in(x: str) -> str:
    return f"(len(list_filter(phrases, lambda p: contains({x}, p))) > 0)"


# Scores in SQL, in the terms of the columns that PAIR gives: name, low, path, folders, m (metadata), tokens, phrases, n.
PAIR = f"""{CUR}, doc AS (SELECT id, coalesce(title, '') AS title, {_clean("coalesce(content, '')")} AS content, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM cur),
  asked AS (SELECT query_id, {_clean('query_text')} AS query FROM search_queries WHERE {_clean('query_text')} <> ''),
  phr AS (SELECT *, list_filter(list_transform(regexp_extract_all(query, '{_PHRASE}', 1), lambda x: lower(trim(x))), lambda x: x <> '') AS phrases, {_terms('query')} AS terms FROM asked),
  tok AS (SELECT query_id, query, phrases, list_concat(terms, list_filter(list_transform(flatten(list_transform(phrases, lambda x: {_words('x')})), lambda w: {_norm('w')}), lambda w: w <> '')) AS every FROM phr),
  q AS (SELECT query_id, query, phrases, list_filter(every, lambda x, i: list_position(every, x) = i) AS tokens FROM tok),
  hit AS (SELECT DISTINCT query_id, document_id AS id FROM search_results),
  pair AS (SELECT query_id, id, query, phrases, tokens, len(tokens) AS n, title, content, m, lower(content) AS low,
    lower(trim(translate(regexp_replace(title, '(?s)^(.+)\\.[^.]*$', '\\1'), '_-.', '   '))) AS name, lower(trim(translate(regexp_replace(query, '(?s)^(.+)\\.[^.]*$', '\\1'), '_-.', '   '))) AS qname,
    lower(regexp_extract(title, '(?s)^.+\\.([^.]*)$', 1)) AS ext, coalesce(json_extract_string(m, '$.source_path'), '') AS path,
    CASE WHEN json_type(m, '$.tags') = 'ARRAY' THEN array_to_string(CAST(json_extract(m, '$.tags') AS VARCHAR[]), ' ') ELSE coalesce(json_extract_string(m, '$.tags'), '') END AS tags, coalesce(json_extract_string(m, '$.author'), '') AS author,
    coalesce(try_cast(json_extract_string(m, '$.source_size') AS BIGINT), 0) AS size, CASE WHEN json_extract_string(m, '$.source_mtime') IS NOT NULL THEN coalesce(try_cast(json_extract_string(m, '$.source_mtime') AS BIGINT) // 1000, 0) END AS mtime
    FROM doc JOIN hit USING (id) JOIN q USING (query_id)),
  x AS (SELECT *, list_filter(list_transform(regexp_split_to_array(path, '/')[1:len(regexp_split_to_array(path, '/')) - 1], lambda f: f), lambda f: f NOT IN ('', '.')) AS folders FROM pair)"""

_LONG = "greatest(0, strlen(t) - 3)"
FILENAME = f"""CASE WHEN title = '' OR (n = 0 AND len(phrases) = 0) THEN 0.0 ELSE greatest(
    CASE WHEN name = lower(trim(query)) THEN 100.0 WHEN replace(name, ' ', '') = replace(lower(trim(query)), ' ', '') THEN 95.0 ELSE 0.0 END, CASE WHEN {_phrase_in('name')} THEN 90.0 ELSE 0.0 END,
    CASE WHEN n = 0 THEN 0.0 WHEN {_found('name')} = n THEN CASE WHEN {_in_order('name')} THEN 90.0 ELSE 80.0 END ELSE 60.0 * {_found('name')} / n END,
    CASE WHEN ext <> '' AND len(list_filter(tokens, lambda t: regexp_replace(t, '^\\.', '') = ext)) > 0 THEN 60.0 ELSE 0.0 END,
    coalesce(list_max(list_transform(tokens, lambda t: greatest(CASE WHEN len(list_filter({_words('name')}, lambda w: starts_with(w, t))) > 0 THEN 45.0 * (1 + 0.05 * {_LONG}) ELSE 0.0 END, CASE WHEN contains(name, t) THEN 60.0 * (1 + 0.03 * {_LONG}) ELSE 0.0 END))), 0.0))
    + coalesce(list_sum(list_transform(tokens, lambda t: CASE WHEN {_count('t', 'name')} > 1 THEN 10.0 * (1 - 1.0 / {_count('t', 'name')}) ELSE 0.0 END)), 0.0) END"""
_WORDS = f"CASE WHEN n = 0 OR {_found('low')} = 0 THEN 0.0 WHEN {_found('low')} = n THEN CASE WHEN {_in_order('low')} THEN 90.0 ELSE 70.0 END ELSE 70.0 * {_found('low')} / n END"
_PHR = f"coalesce(list_max(list_transform(phrases, lambda p: CASE WHEN {_count('p', 'low')} = 0 THEN 0.0 ELSE 120.0 + CASE WHEN {_count('p', 'low')} > 1 THEN least(5.0 * ({_count('p', 'low')} - 1), 20.0) ELSE 0.0 END END)), 0.0)"
_MD, _TAG = "(?m)^(#{{1,6}})\\s+(.+)$".replace("{{", "{").replace("}}", "}"), "(?i)<h([1-6])[^>]*>([^<]+)</h[1-6]>"
_HEADS = f"""list_concat(list_transform(list_zip(regexp_extract_all(content, '{_MD}', 1), regexp_extract_all(content, '{_MD}', 2)), lambda z: {{'level': length(z[1]), 'text': lower(z[2])}}),
    list_transform(list_zip(regexp_extract_all(content, '{_TAG}', 1), regexp_extract_all(content, '{_TAG}', 2)), lambda z: {{'level': z[1]::BIGINT, 'text': lower(z[2])}}))"""
_HEADER = f"CASE WHEN n = 0 THEN 0.0 ELSE coalesce(list_max(list_transform({_HEADS}, lambda h: 110.0 * (1 + (5 - h.level) * 0.1) * len(list_filter(tokens, lambda t: contains(h.text, t))) / n)), 0.0) END"
_EARLY = "left(low, greatest(100, floor(length(content) * 0.1)::BIGINT))"
POSITION = f"CASE WHEN {_phrase_in(_EARLY)} OR len(list_filter(tokens, lambda t: contains({_EARLY}, t))) > 0 THEN 1.3 ELSE 1.0 END"


def _content(words: str) -> str:
    return f"CASE WHEN content = '' OR (n = 0 AND len(phrases) = 0) THEN 0.0 ELSE greatest({_PHR}, {_HEADER}, {words}) * {POSITION} END"


_PIECE = "CASE WHEN f = t THEN 40.0 ELSE greatest(CASE WHEN contains(f, t) THEN 30.0 + 10.0 * strlen(t) / strlen(f) ELSE 0.0 END, CASE WHEN starts_with(f, t) THEN 36.0 ELSE 0.0 END) END"
_PIECES = f"list_filter(list_transform(list_transform(folders, lambda g: lower(g)), lambda f: coalesce(list_max(list_transform(tokens, lambda t: {_PIECE})), 0.0)), lambda s: s > 0)"
PATH = f"CASE WHEN path = '' THEN 0.0 ELSE coalesce(list_sum({_PIECES}), 0.0) + CASE WHEN len({_PIECES}) > 1 THEN 10.0 * (len({_PIECES}) - 1) ELSE 0.0 END END"
METADATA = f"CASE WHEN n = 0 OR m IS NULL THEN 0.0 ELSE 45.0 * {_found('lower(author)')} / n + 40.0 * {_found('lower(tags)')} / n END"
_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - mtime)"
RECENCY = f"CASE WHEN {_AGE} < 86400000000 THEN 1.2 WHEN {_AGE} < 604800000000 THEN 1.1 WHEN {_AGE} < 2592000000000 THEN 1.05 ELSE 1.0 END"
SIZE = "CASE WHEN size <= 0 THEN 1.0 WHEN size < 1024 THEN 1 + 0.1 * (1 - size / 1024.0) WHEN size > 1048576 THEN 1 - least(0.05 * log10(size / 1048576.0), 0.1) ELSE 1.0 END"


def _order(x: str) -> str:
    return f"CASE WHEN {_in_order(x)} THEN 'phrase' ELSE 'all_words' END"


QUALITY = f"""CASE WHEN title <> '' AND {_phrase_in('name')} THEN 'phrase' WHEN title <> '' AND n > 0 AND {_found('name')} = n THEN {_order('name')} WHEN {_phrase_in('low')} THEN 'phrase'
    WHEN content <> '' AND n > 0 AND {_found('low')} = n THEN {_order('low')} WHEN {_found('low')} > 0 THEN 'partial' ELSE 'none' END"""
QUALITY_X = f"CASE {QUALITY} WHEN 'phrase' THEN 1.3 WHEN 'partial' THEN 0.7 ELSE 1.0 END"
_NAME_MATCH = f"CASE WHEN title <> '' AND {_phrase_in('name')} THEN 'phrase' WHEN title <> '' AND n > 0 AND {_found('name')} = n THEN {_order('name')} ELSE 'none' END"
MATCH = f"""CASE WHEN title <> '' AND name = qname THEN 'exact' WHEN {_NAME_MATCH} = 'phrase' THEN 'phrase' WHEN {_NAME_MATCH} = 'all_words' THEN CASE WHEN {_phrase_in('low')} THEN 'phrase' ELSE 'all_words' END
    WHEN {_phrase_in('low')} THEN 'phrase' WHEN content <> '' AND n > 0 AND {_found('low')} = n THEN {_order('low')} WHEN n > 0 AND {_found('low')} > 0 THEN 'partial' ELSE 'none' END"""
_CORPUS = f"""ct AS (SELECT id, unnest(list_distinct({_terms("content || ' ' || title")})) AS term FROM doc), cdf AS (SELECT term, count(*) AS df FROM ct GROUP BY term)"""
_IDF = "CASE WHEN nd = 0 THEN 1.0 WHEN coalesce(df, 0) = 0 THEN 1.0 + nd ELSE 1.0 + nd / df::DOUBLE END"
_SHARES = f"""each AS (SELECT query_id, id, unnest(tokens) AS t, low, len({_words('low')}) AS nw FROM x), nd AS (SELECT count(*)::DOUBLE AS nd FROM doc),
  w AS (SELECT query_id, id, {_count('t', 'low')} / nw::DOUBLE * {_IDF} AS v FROM each LEFT JOIN cdf ON cdf.term = t, nd WHERE nw > 0 AND {_count('t', 'low')} > 0),
  mult AS (SELECT query_id, id, least(1 + avg(v) * 10, 2.0) AS boost FROM w GROUP BY ALL), y AS (SELECT x.*, coalesce(boost, 1.0) AS boost FROM x LEFT JOIN mult USING (query_id, id))"""
_PARTS = f"""parts AS (SELECT query_id, id, {FILENAME} AS filename, {_content(f'({_WORDS}) * boost')} AS content, {PATH} AS path, {METADATA} AS metadata, {RECENCY} AS recency, {QUALITY_X} AS query_quality, {SIZE} AS file_size, {MATCH} AS match_type FROM y),
  final AS (SELECT *, (1.5 * filename + content + 0.3 * path + 0.4 * metadata) * recency * query_quality * file_size AS final FROM parts)"""


def _simple(expression: str) -> str:
    return f"WITH {PAIR} SELECT query_id, id, round(({expression})::DOUBLE, 6) AS score FROM x"


SQL = {
    "q_rank_filename": _simple(FILENAME), "q_rank_content": _simple(_content(_WORDS)), "q_rank_path": _simple(PATH), "q_rank_metadata": _simple(METADATA),
    "q_position": _simple(POSITION), "q_recency": _simple(RECENCY), "q_filesize": _simple(SIZE),
    "q_quality": f"WITH {PAIR} SELECT query_id, id, {QUALITY} AS quality, ({QUALITY_X})::DOUBLE AS score FROM x",
    "q_match_type": f"WITH {PAIR} SELECT query_id, id, {MATCH} AS match_type FROM x",
    "q_rank_corpus": f"WITH {PAIR}, {_CORPUS} SELECT term, df FROM cdf",
    "q_tfidf": f"""WITH {PAIR}, {_CORPUS}, nd AS (SELECT count(*)::DOUBLE AS nd FROM doc), e AS (SELECT query_id, id, unnest(tokens) AS term, low, len({_words('low')}) AS nw FROM x),
  f AS (SELECT query_id, id, e.term, CASE WHEN nw > 0 THEN {_count('e.term', 'low')} / nw::DOUBLE ELSE 0.0 END AS tf, {_IDF} AS idf FROM e LEFT JOIN cdf ON cdf.term = e.term, nd)
SELECT query_id, id, term, round(tf, 9) AS tf, round(idf, 6) AS idf, round(tf * idf, 9) AS tfidf FROM f""",
    "q_rank_metadata_fields": f"WITH {PAIR} SELECT query_id, id, list_filter(tokens, lambda t: contains(lower(author), t)) AS author, list_filter(tokens, lambda t: contains(lower(tags), t)) AS tags, round(({METADATA})::DOUBLE, 6) AS score FROM x",
    "q_filename_only": f"WITH {PAIR} SELECT query_id, id, round(({FILENAME})::DOUBLE, 6) AS score, round(({FILENAME})::DOUBLE, 6) AS by_path FROM x",
    "q_rank_least": f"WITH {PAIR}, {_CORPUS}, {_SHARES}, {_PARTS} SELECT query_id, id FROM final WHERE final >= 60",
    "q_rank_top": f"""WITH {PAIR}, {_CORPUS}, {_SHARES}, {_PARTS}, t AS (SELECT query_id, id, round(final, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 4) DESC, id) AS k FROM final WHERE final > 0)
SELECT query_id, id, score FROM t WHERE k <= 3""",
    "q_rank_full": f"WITH {PAIR}, {_CORPUS}, {_SHARES}, {_PARTS} SELECT query_id, id, round(final, 4) AS score FROM final WHERE final > 0",
    "q_rank_breakdown": f"""WITH {PAIR}, {_CORPUS}, {_SHARES}, {_PARTS} SELECT query_id, id, round(filename, 4) AS filename, round(content, 4) AS content, round(path, 4) AS path, round(metadata, 4) AS metadata, round(final, 4) AS final,
  round(recency::DOUBLE, 6) AS recency, round(query_quality::DOUBLE, 6) AS query_quality, round(file_size::DOUBLE, 6) AS file_size, match_type FROM final WHERE final > 0""",
    "q_rank_details": f"""WITH {PAIR} SELECT query_id, id, CASE WHEN title = '' THEN 'none' WHEN name = lower(trim(query)) THEN 'exact' WHEN n > 0 AND {_found('name')} = n THEN {_order('name')} WHEN {_found('name')} > 0 THEN 'partial' ELSE 'none' END AS file_match,
  list_filter(tokens, lambda t: contains(name, t)) AS file_terms,
  CASE WHEN content = '' THEN 'none' WHEN {_phrase_in('low')} THEN 'phrase' WHEN n > 0 AND {_found('low')} = n THEN {_order('low')} WHEN {_found('low')} > 0 THEN 'partial' ELSE 'none' END AS text_match, list_filter(tokens, lambda t: contains(low, t)) AS text_terms,
  list_filter(folders, lambda f: len(list_filter(tokens, lambda t: contains(lower(f), t))) > 0) AS folders,
  list_filter(list_transform(folders, lambda f: list_filter(tokens, lambda t: contains(lower(f), t))[1]), lambda t: t IS NOT NULL) AS folder_terms FROM x""",
}
