"""Index statistics, keyword and vector retrieval, spelling, fusion: all queries of the tables at once."""

from pyspark.sql import functions as F

from findwell.functions import text as T
from findwell.operators import fusion, keyword, spelling, vector_search
from findwell.operators.chunks import chunk_documents
from findwell.operators.keyword import KeywordIndex
from findwell.plans.scratch import materialize
from findwell.suite.common import ASKED, CLEAN, POSTINGS, asked, clean, sql_edits, sql_tokens, table

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] * z[2])::DOUBLE))"


def _index(spark, d, stop_words=None):
    built = KeywordIndex.build(clean(spark, d), stop_words=stop_words)
    return KeywordIndex(materialize(built.postings, "postings"), materialize(built.lengths, "lengths"))  # read by several parts of a plan


def q_term_df(spark, d):
    return _index(spark, d).term_frequencies()


def q_vocabulary(spark, d):
    return _index(spark, d).vocabulary()


def q_field_lengths(spark, d):
    return _index(spark, d).lengths.groupBy("field").agg(F.count("*").alias("documents"), F.sum("len").alias("words"), F.max("len").alias("longest"))


def q_corpus_stats(spark, d):
    """Document counts of the terms of all queries."""
    words = asked(spark, d).select(F.explode(T.tokens("query")).alias("term"))
    return _index(spark, d).corpus_stats(words)


def q_stop_words(spark, d):
    return _index(spark, d, ["the", "of", "and", "a", "in"]).term_frequencies()


def _round(df):
    return df.select("query_id", "id", F.round("score", 6).alias("score"))


def q_match_any(spark, d):
    """Scores of all documents that hold any term of a query, for every query."""
    return _round(keyword.match_any(_index(spark, d), asked(spark, d)))


def q_match_tfidf(spark, d):
    return _round(keyword.match_any(_index(spark, d), asked(spark, d), scorer="tfidf"))


def q_boosted(spark, d):
    """Title boost, coverage and phrase boost for every query."""
    return _round(keyword.boosted(_index(spark, d), asked(spark, d)))


def q_top_keyword(spark, d):
    """The ten best of each query by the boosted score."""
    hits = _round(keyword.boosted(_index(spark, d), asked(spark, d)))
    return keyword.top(hits, 10).select("query_id", "id", "score", "rank")


def q_phrases(spark, d):
    return keyword.phrase_hits(_index(spark, d), asked(spark, d))


def q_fuzzy_terms(spark, d):
    """Index terms within two edits of the query terms, of any letters, digits and marks."""
    wanted = keyword.query_terms(asked(spark, d)).select("term").distinct()
    return keyword.fuzzy_terms(_index(spark, d), wanted).select("asked", "term")


def q_fuzzy_search(spark, d):
    return _round(keyword.boosted(_index(spark, d), asked(spark, d), fuzzy=True))


def q_misspelled(spark, d):
    words = asked(spark, d).select(F.explode(T.query_words("query")).alias("term")).distinct()
    return spelling.misspelled(words, _index(spark, d).term_frequencies())


def q_suggest(spark, d):
    """Suggestions from the whole vocabulary for all unknown words."""
    words, known = asked(spark, d).select(F.explode(T.query_words("query")).alias("term")).distinct(), _index(spark, d).term_frequencies()
    return spelling.suggest(spelling.misspelled(words, known), known)


def q_spell_check(spark, d):
    """All queries against the whole vocabulary."""
    return spelling.check(asked(spark, d), _index(spark, d).term_frequencies())


def q_chunk(spark, d):
    x = clean(spark, d)
    return chunk_documents(x, size=60, overlap=12).select("chunk_id", "document_id", "chunk_index", F.md5("content").alias("content_md5"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _nearest(spark, d, strategy="arrow"):
    hits = vector_search.nearest(_vectors(spark, d), _vector_queries(spark, d), 10, strategy=strategy)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def q_vec_topk(spark, d):
    """The ten nearest of all vectors for every fiftieth."""
    return _nearest(spark, d)


def q_vec_topk_expr(spark, d):
    return _nearest(spark, d, "expr")


def q_vec_remove(spark, d):
    bad = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").cast("string").alias("id"))
    return vector_search.remove(_vectors(spark, d), bad).select("id")


def _semantic(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), (F.col("vec_id") % 40).cast("string")).alias("document_id"))
    hits = _nearest(spark, d).select("query_id", F.col("id").alias("chunk_id"), "score")
    return fusion.by_document(hits, chunks)


def q_sem_by_doc(spark, d):
    return _semantic(spark, d)


def _lists(spark, d):
    """Keyword and semantic hits of the stored searches, each document once."""
    r = table(spark, d, "search_results").select(F.col("search_id").alias("query_id"), F.col("document_id").alias("id"), "keyword_score", "semantic_score")
    k = r.where("keyword_score is not null").select("query_id", "id", F.col("keyword_score").alias("score"))
    s = r.where("semantic_score is not null").select("query_id", "id", F.col("semantic_score").alias("score"))
    return fusion.split_by_source(k, s)


def q_split_fusion(spark, d):
    return _lists(spark, d)


def q_min_score(spark, d):
    return fusion.above(_lists(spark, d), 2.0, 0.8).select("query_id", "id", "source", "score")


def q_totals(spark, d):
    return fusion.totals(_lists(spark, d))


def q_page(spark, d):
    return fusion.page(_lists(spark, d), 2, 3).select("query_id", "source", "id", "rank")


def q_hydrate(spark, d):
    documents = clean(spark, d).select("id", "title", F.md5("content").alias("content_md5"))
    return fusion.hydrate(fusion.page(_lists(spark, d), 0, 3), documents).select("query_id", "source", "id", "rank", "title", "content_md5")


def q_hybrid(spark, d):
    """Flagship: the boosted keyword hits of every query, beside the nearest stored chunks of a vector per query.

    Both lists are scored, split, cut by their least scores and paged. Chunks whose vector isn't
    of 64 numbers take no part.
    """
    index, queries = _index(spark, d), asked(spark, d)
    lexical = keyword.top(_round(keyword.boosted(index, queries)), 20).select("query_id", "id", "score")
    first = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 400 + 1).cast("int").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    stored = table(spark, d, "document_chunks").where((F.size("embedding") == 64) & ~F.exists("embedding", F.isnan)).select(F.col("id").alias("chunk_id"), "document_id", "embedding")
    near = vector_search.nearest(stored, first.join(queries, "query_id").select("query_id", "vector"), 20, key="chunk_id")
    semantic = fusion.by_document(near.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score")), stored)
    fused = fusion.above(fusion.split_by_source(lexical, semantic), 0.0, 0.05)
    return fusion.page(fused, 0, 5).select("query_id", "source", "id", "score", "rank")


QUERIES = {f.__name__: f for f in (
    q_term_df, q_vocabulary, q_field_lengths, q_corpus_stats, q_stop_words, q_match_any, q_match_tfidf, q_boosted, q_top_keyword, q_phrases, q_fuzzy_terms, q_fuzzy_search,
    q_misspelled, q_suggest, q_spell_check, q_chunk, q_vec_topk, q_vec_topk_expr, q_vec_remove, q_sem_by_doc, q_split_fusion, q_min_score, q_totals, q_page, q_hydrate, q_hybrid,
)}

_SP = r"[\s\p{Z}\x{85}\x{0B}]+"
_QWORDS = f"list_filter(regexp_split_to_array(lower(query), '{_SP}'), lambda w: w <> '')"
_DF = "df AS (SELECT term, count(DISTINCT id) AS df FROM postings GROUP BY term)"
_WANTED = f"""{ASKED}, qt AS (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM asked),
  wanted AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL), qn AS (SELECT query_id, len({_QWORDS}) AS words FROM asked)"""
_STATS = """fs AS (SELECT field, count(*) AS n, avg(len) AS av FROM lengths GROUP BY field), fdf AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL)"""


def _scored(formula: str) -> str:
    return f"""{_STATS}, scored AS (SELECT p.field, p.term, p.id, {formula} AS s FROM postings p JOIN fdf USING (field, term) JOIN lengths l USING (field, id) JOIN fs USING (field))"""


_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))"
_TFIDF = "sqrt(tf) * (1 + ln(n / (df + 1.0))) / sqrt(len)"
_BASE = f"WITH {CLEAN}, {POSTINGS}"
_PHRASES = f"""pw AS (SELECT query_id, unnest({sql_tokens('query')}) AS term, unnest(range(len({sql_tokens('query')}))) AS place FROM asked), pn AS (SELECT query_id, count(*) AS n FROM pw GROUP BY query_id),
  together AS (SELECT DISTINCT s.query_id, s.id FROM (SELECT w.query_id, f.field, f.id, f.position - w.place AS st, count(DISTINCT w.place) AS m FROM flat f JOIN pw w USING (term) GROUP BY ALL) s JOIN pn USING (query_id) WHERE m = n AND n > 1)"""


def _boosted(wanted: str) -> str:
    return f"""{_PHRASES}, word AS (SELECT w.query_id, s.id, w.asked, sum(s * times * CASE WHEN field = 'title' THEN 3.0 ELSE 1.0 END) AS s, max(times) AS times FROM scored s JOIN {wanted} w USING (term) GROUP BY ALL),
  merged AS (SELECT query_id, id, sum(s) AS s, sum(times) AS matched FROM word GROUP BY ALL),
  boosted AS (SELECT m.query_id, m.id, round(s * CASE WHEN words > 1 THEN least(1.0, greatest(matched, 1) / words::DOUBLE) ** 2 ELSE 1.0 END * CASE WHEN t.id IS NOT NULL AND words > 1 THEN 1.5 ELSE 1.0 END, 6) AS score
    FROM merged m JOIN qn USING (query_id) LEFT JOIN together t ON t.query_id = m.query_id AND t.id = m.id)"""


_ALL = f"{_BASE}, {_WANTED}, {_scored(_BM25)}, exact AS (SELECT *, term AS asked FROM wanted), {_boosted('exact')}"
_NEAR = f"""near AS (SELECT w.term AS asked, v.term FROM (SELECT DISTINCT term FROM wanted) w, (SELECT DISTINCT term FROM postings) v WHERE abs(length(w.term) - length(v.term)) <= 2 AND {sql_edits('w.term', 'v.term')} <= 2)"""
_SUGGEST = f"""sug AS (SELECT *, df / (distance + 1.0) AS score FROM (SELECT m.term, d.term AS suggestion, ({sql_edits('m.term', 'd.term')})::INT AS distance, d.df FROM bad m, df d
  WHERE abs(length(m.term) - length(d.term)) <= 2 AND m.term <> d.term) WHERE distance <= 2)"""
_VEC = f"""q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
  top AS (SELECT query_id, vec_id::VARCHAR AS id, {_DOT.format(a='embedding', b='q')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT.format(a='embedding', b='q')} DESC, vec_id::VARCHAR)::INT AS rank FROM embeddings, q),
  hits AS (SELECT query_id, id, round(s, 6) AS score, rank FROM top WHERE rank <= 10)"""
_LISTS = """lists AS (SELECT search_id AS query_id, document_id AS id, CASE WHEN max(keyword_score) IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source, coalesce(max(keyword_score), max(semantic_score)) AS score,
  coalesce(max(keyword_score), 0.0) AS keyword_score, coalesce(max(semantic_score), 0.0) AS semantic_score FROM search_results WHERE keyword_score IS NOT NULL OR semantic_score IS NOT NULL GROUP BY ALL)"""

SQL = {
    "q_term_df": f"{_BASE} SELECT term, count(DISTINCT id) AS df FROM postings GROUP BY term",
    "q_vocabulary": f"{_BASE} SELECT DISTINCT term FROM postings",
    "q_field_lengths": f"{_BASE} SELECT field, count(*) AS documents, sum(len)::BIGINT AS words, max(len) AS longest FROM lengths GROUP BY field",
    "q_corpus_stats": f"{_BASE}, {_WANTED}, {_DF} SELECT (SELECT count(*) FROM doc) AS documents, w.term, coalesce(df, 0) AS df FROM (SELECT DISTINCT term FROM wanted) w LEFT JOIN df USING (term)",
    "q_stop_words": f"{_BASE}, {_DF} SELECT term, df FROM df WHERE term NOT IN ('the', 'of', 'and', 'a', 'in')",
    "q_match_any": f"{_BASE}, {_WANTED}, {_scored(_BM25)} SELECT query_id, id, round(sum(s * times), 6) AS score FROM scored JOIN wanted USING (term) GROUP BY ALL",
    "q_match_tfidf": f"{_BASE}, {_WANTED}, {_scored(_TFIDF)} SELECT query_id, id, round(sum(s * times), 6) AS score FROM scored JOIN wanted USING (term) GROUP BY ALL",
    "q_boosted": f"{_ALL} SELECT query_id, id, score FROM boosted",
    "q_top_keyword": f"{_ALL} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM boosted) WHERE rank <= 10",
    "q_phrases": f"{_BASE}, {_WANTED}, {_PHRASES} SELECT query_id, id FROM together",
    "q_fuzzy_terms": f"{_BASE}, {_WANTED}, {_NEAR} SELECT asked, term FROM near",
    "q_fuzzy_search": f"{_BASE}, {_WANTED}, {_scored(_BM25)}, {_NEAR}, fuzzy AS (SELECT w.query_id, n.asked, n.term, w.times FROM wanted w JOIN near n ON n.asked = w.term), {_boosted('fuzzy')} SELECT query_id, id, score FROM boosted",
    "q_misspelled": f"{_BASE}, {ASKED}, w AS (SELECT DISTINCT unnest({_QWORDS}) AS term FROM asked) SELECT term FROM w WHERE term NOT IN (SELECT term FROM postings)",
    "q_suggest": f"""{_BASE}, {ASKED}, {_DF}, bad AS (SELECT DISTINCT term FROM (SELECT unnest({_QWORDS}) AS term FROM asked) WHERE term NOT IN (SELECT term FROM df)), {_SUGGEST}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, suggestion)::INT AS rank FROM sug) WHERE rank <= 3""",
    "q_spell_check": f"""{_BASE}, {ASKED}, {_DF}, pq AS (SELECT * FROM asked), w AS (SELECT query_id, unnest({_QWORDS}) AS term, unnest(range(len({_QWORDS}))) AS place FROM pq),
  bad AS (SELECT DISTINCT term FROM w WHERE term NOT IN (SELECT term FROM df)), {_SUGGEST}, best AS (SELECT term, suggestion FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, suggestion) AS r FROM sug) WHERE r = 1)
SELECT pq.query_id, coalesce(string_agg(coalesce(best.suggestion, w.term), ' ' ORDER BY place), '') AS corrected, coalesce(string_agg(bad.term, ' ' ORDER BY place), '') AS misspelled
FROM pq LEFT JOIN w USING (query_id) LEFT JOIN bad ON bad.term = w.term LEFT JOIN best ON best.term = w.term GROUP BY pq.query_id""",
    "q_chunk": f"""WITH {CLEAN}, w AS (SELECT id, list_filter(regexp_split_to_array(content, ' '), lambda x: x <> '') AS w FROM doc),
  n AS (SELECT id, w, CASE WHEN len(w) <= 60 THEN 1 ELSE ceil((len(w) - 60) / 48.0)::INT + 1 END AS n FROM w), c AS (SELECT id, w, unnest(range(n))::INT AS i FROM n)
SELECT id || '_' || i AS chunk_id, id AS document_id, i AS chunk_index, md5(array_to_string(w[i * 48 + 1 : i * 48 + 60], ' ')) AS content_md5 FROM c""",
    "q_vec_topk": f"WITH {_VEC} SELECT * FROM hits",
    "q_vec_topk_expr": f"WITH {_VEC} SELECT * FROM hits",
    "q_vec_remove": "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE label <> 3 OR label IS NULL",
    "q_sem_by_doc": f"WITH {_VEC} SELECT query_id, 'd' || (id::BIGINT % 40) AS id, max(score) AS score FROM hits GROUP BY ALL",
    "q_split_fusion": f"WITH {_LISTS} SELECT * FROM lists",
    "q_min_score": f"WITH {_LISTS} SELECT query_id, id, source, score FROM lists WHERE score >= CASE WHEN source = 'keyword' THEN 2.0 ELSE 0.8 END",
    "q_totals": f"WITH {_LISTS} SELECT query_id, source, count(*) AS total FROM lists GROUP BY ALL",
    "q_page": f"WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id)::INT AS k FROM lists) SELECT query_id, source, id, k - 2 AS rank FROM r WHERE k > 2 AND k <= 5",
    "q_hydrate": f"""WITH {CLEAN}, {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id)::INT AS rank FROM lists)
SELECT query_id, source, r.id, rank, title, md5(content) AS content_md5 FROM r JOIN doc USING (id) WHERE rank <= 3""",
    "q_hybrid": f"""{_ALL}, lex AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM boosted) WHERE r <= 20),
  hq AS (SELECT query_id, q FROM (SELECT (vec_id % 400 + 1)::INT AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1) JOIN asked USING (query_id)),
  near AS (SELECT query_id, document_id AS id, {_DOT.format(a='embedding', b='q')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT.format(a='embedding', b='q')} DESC, c.id) AS r
    FROM document_chunks c, hq WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0),
  sem AS (SELECT query_id, id, max(round(s, 6)) AS score FROM near WHERE r <= 20 GROUP BY ALL),
  f AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, CASE WHEN l.id IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source, coalesce(l.score, s.score) AS score FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.id = s.id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id)::INT AS rank FROM f WHERE source = 'keyword' OR score >= 0.05)
SELECT query_id, source, id, score, rank FROM k WHERE rank <= 5""",
}
