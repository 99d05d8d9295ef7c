"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from findwell.functions import metadata as M
from findwell.functions import paths as P
from findwell.functions import query as Q
from findwell.functions import text as T
from findwell.functions import vectors as V
from findwell.functions.distance import damerau
from findwell.functions.hashing import MockEmbedder, string_hash, tokenized
from findwell.operators.keyword import deletions
from findwell.suite.common import ASKED, CLEAN, CUR, asked, clean, current, sql_clean, sql_edits, table


def _three():
    return F.array(F.lit("graph"), F.lit("dense"), F.lit("the"))


def q_preprocess(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.preprocess("text")).alias("clean_md5"), F.length(T.preprocess("text")).alias("n"))


def q_text_shortening(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", T.truncate("text", 40).alias("cut"), F.md5(T.one_line("text")).alias("line"), T.first_words(T.preprocess("text"), 5).alias("words"))


def q_title_norm(spark, d):
    x = current(spark, d)
    return x.select("id", T.title_for_search("title").alias("search_title"), T.filename_words("title").alias("name"), T.extension("title").alias("extension"))


def q_tokenize(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(T.tokens("text")).alias("term"))
    return x.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def q_plain_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.plain_words("text")).alias("plain"), F.size(T.words("text")).alias("words"))


def q_term_matches(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    low = F.lower("text")
    return x.select(
        "doc_id", T.all_terms_in(_three(), "text").alias("all_in"), T.count_terms_in(_three(), "text").alias("n_in"), T.terms_in_order(_three(), "text").alias("in_order"),
        T.occurrences(F.lit("the"), "text").alias("the_count"), (F.instr(low, "the") - 1).alias("the_at"), T.phrase_position(F.lit("The"), "text").alias("phrase_at"),
        T.has_prefix_word(F.lit("gra"), "text").alias("has_prefix"), F.size(T.prefix_words(F.lit("gra"), "text")).alias("n_prefix"),
    )


def q_analyze_query(spark, d):
    x = table(spark, d, "search_queries").where("query_text is not null")
    a = Q.analyzed("query_text")
    return x.select("query_id", a.alias("a")).select("query_id", *[f"a.{n}" for n in ("terms", "phrases", "negated", "tokens", "query_type", "has_wildcard")])


def q_analyze_quoted(spark, d):
    """The same over texts with quotes, hyphens and operators: the quoted titles of the documents."""
    x = clean(spark, d).select("id", F.concat(F.lit('"'), F.substring("title", 1, 9), F.lit("' NOT -old_"), F.col("title"), F.lit(" AND plan?")).alias("q"))
    return x.select("id", Q.terms("q").alias("terms"), Q.phrases("q").alias("phrases"), Q.negated("q").alias("negated"), Q.match_tokens("q").alias("tokens"), Q.query_type("q").alias("query_type"))


def q_contains_term(spark, d):
    """Whether a query has the first word of another one, in upper case, among its terms."""
    x = table(spark, d, "search_queries").where("query_text is not null").select("query_id", F.col("query_text").alias("q"))
    return x.select("query_id", Q.contains_term("q", F.upper(F.regexp_extract("q", r"^(\S+)", 1))).alias("own"), Q.contains_term("q", F.lit("THE")).alias("the"))


def q_paths(spark, d):
    x = clean(spark, d).select("id", M.source_path("metadata").alias("path"))
    return x.select(
        "id", P.path_components("path").alias("components"), P.normalize_path("path").alias("normal"), P.has_component("path", F.lit("RIBA")).alias("has"),
        P.matches_pattern("path", "/vault/*/1*_").alias("matches"), P.under_root("path", "/vault/riba").alias("below"), P.extension_allowed("path", [".TXT", "md"]).alias("allowed"), P.file_id("path").alias("file_id"),
    )


def q_headers(spark, d):
    x = current(spark, d).where("content is not null").select("id", F.explode(T.headers("content")).alias("h"))
    return x.select("id", "h.level", "h.text", "h.position").groupBy("id", "level", "text").agg(F.count("*").alias("n"))


def q_metadata(spark, d):
    m = "metadata"
    x = clean(spark, d)
    return x.select(
        "id", M.all_text(m).alias("texts"), M.field_text(m, "author").alias("author"), F.array_join(M.field_items(m, "tags"), "+").alias("tags"),
        M.digits(F.try_element_at(m, F.lit("source_size"))).alias("size"), M.modified_at(F.try_element_at(m, F.lit("source_mtime"))).cast("timestamp_ntz").alias("modified"), M.field_matches(F.lit("ticket user-149"), m, "tags").alias("hit"),
    )


def q_edit_distance(spark, d):
    """Distances between the words of the queries that begin with the same two letters or are within two edits."""
    w = asked(spark, d).select(F.explode(T.query_words("query")).alias("term")).distinct()
    begins, stubs = w.withColumn("k", F.substring("term", 1, 2)), deletions(w, 2).withColumnRenamed("stub", "k")

    def met(x):
        return x.select(F.col("term").alias("a"), "k").join(x.select(F.col("term").alias("b"), "k"), "k").where("a < b").select("a", "b", F.levenshtein("a", "b").alias("d"))

    return met(begins).unionAll(met(stubs).where("d <= 2")).distinct()


def q_osa(spark, d):
    x = q_edit_distance(spark, d)
    return x.select("a", "b", "d", damerau("a", "b").alias("aligned"))


def q_vectors(spark, d):
    """Norms, and the products of each vector with the one before."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    x = e.join(b, "vec_id")
    return x.select("vec_id", F.round(V.inner_product("embedding", "other"), 6).alias("dot"), F.round(V.cosine_of_units("embedding", "other"), 6).alias("cos"), F.round(V.l2_norm("embedding"), 6).alias("norm"))


def q_normalize(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", V.normalized_vector(F.transform("embedding", lambda v: v * F.lit(3).cast("float"))).alias("v"))
    return x.select("vec_id", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(V.l2_norm("v"), 5).alias("norm"))


def q_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", string_hash("text").alias("hash"))


def q_token_ids(spark, d):
    """Ids and mask of whole texts, 256 at most, as digests."""
    t = tokenized(F.col("text"), 256)
    x = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return x.select("doc_id", F.md5(F.array_join(F.col("t.ids").cast("array<string>"), ",")).alias("ids_md5"), F.aggregate("t.mask", F.lit(0), lambda n, m: n + m).alias("used"), F.size("t.mask").alias("n"))


def q_mock_embed(spark, d):
    """Embeddings of 384 numbers of whole texts: the first, the last and the length."""
    v = MockEmbedder(384).embed(F.col("text"))
    x = table(spark, d, "documents").where("text is not null").select("doc_id", v.alias("v"))
    return x.select("doc_id", F.size("v").alias("n"), F.round(F.element_at("v", 1).cast("double"), 3).alias("first"), F.round(F.element_at("v", -1).cast("double"), 3).alias("last"), F.round(V.l2_norm("v"), 3).alias("norm"))


QUERIES = {f.__name__: f for f in (
    q_preprocess, q_text_shortening, q_title_norm, q_tokenize, q_plain_words, q_term_matches, q_analyze_query, q_analyze_quoted, q_contains_term, q_paths, q_headers, q_metadata,
    q_edit_distance, q_osa, q_vectors, q_normalize, q_hash, q_token_ids, q_mock_embed,
)}

_FILE = r"lower(trim(translate(regexp_replace(title, '(?s)^(.+)\.[^.]*$', '\1'), '_-.', '   ')))"
_SP = r"[\s\p{Z}\x{85}\x{0B}]+"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] * z[2])::DOUBLE))"
_EDGE = r"^[^\P{P}_-]+|[^\P{P}_-]+$"
_PHRASE = """["'']([^"'']+)["'']"""


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SP}'), lambda w: w <> '')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '{_EDGE}', '', 'g')"


def _analysis(source: str, key: str) -> str:
    return f"""p AS (SELECT {key}, q, list_filter(list_transform(regexp_extract_all(q, '{_PHRASE}', 1), lambda x: lower(trim(x))), lambda x: x <> '') AS phrases,
    {_words(f"regexp_replace(q, '{_PHRASE}', ' ', 'g')")} AS rest FROM {source}),
  t AS (SELECT *, list_filter(list_transform(list_filter(rest, lambda w: NOT starts_with(w, '-') AND lower(w) NOT IN ('not', 'and', 'or')), lambda w: {_norm("w")}), lambda w: w <> '') AS terms,
    list_filter(list_transform(list_filter(rest, lambda w: starts_with(w, '-')), lambda w: {_norm("substr(w, 2)")}), lambda w: w <> '') AS negated FROM p),
  u AS (SELECT *, list_concat(terms, list_filter(list_transform(flatten(list_transform(phrases, lambda x: {_words("x")})), lambda w: {_norm("w")}), lambda w: w <> '')) AS every FROM t),
  a AS (SELECT {key}, terms, phrases, negated, list_filter(every, lambda x, i: list_position(every, x) = i) AS tokens,
    CASE WHEN regexp_matches(q, '[*?]') THEN 'wildcard' WHEN len(negated) > 0 THEN 'boolean' WHEN len(phrases) > 0 THEN 'phrase' WHEN len(terms) <= 1 THEN 'single' ELSE 'multi' END AS query_type,
    regexp_matches(q, '[*?]') AS has_wildcard FROM u)"""


_IN_ORDER = "list_reduce(list_concat([0], [1, 2, 3]), lambda p, i: CASE WHEN p < 0 THEN -1 WHEN instr(substr(low, p + 1), ['graph', 'dense', 'the'][i]) = 0 THEN -1 ELSE p + instr(substr(low, p + 1), ['graph', 'dense', 'the'][i]) END)"
_META = "CASE WHEN json_valid(metadata) THEN metadata ELSE NULL END"
_VALUE = "CASE WHEN json_type(m, '$.{k}') = 'ARRAY' THEN array_to_string(CAST(json_extract(m, '$.{k}') AS VARCHAR[]), '{s}') ELSE coalesce(json_extract_string(m, '$.{k}'), '') END"

_PAIRS = f"""{ASKED}, w AS (SELECT DISTINCT w FROM (SELECT unnest({_words('lower(query)')}) AS w FROM asked)),
  pairs AS (SELECT * FROM (SELECT a.w AS a, b.w AS b, ({sql_edits('a.w', 'b.w')})::INT AS d FROM w a JOIN w b ON a.w < b.w AND (substr(a.w, 1, 2) = substr(b.w, 1, 2) OR abs(length(a.w) - length(b.w)) <= 2)) WHERE substr(a, 1, 2) = substr(b, 1, 2) OR d <= 2)"""


def _poly(x: str) -> str:
    """The polynomial of the code points modulo 2**64."""
    return f"list_reduce(list_concat([0::HUGEINT], list_transform(regexp_extract_all({x}, '(?s).'), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616::HUGEINT)"


def _signed(h: str) -> str:
    return f"(({h} + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)"


def _abs(h: str) -> str:
    return f"(CASE WHEN {h} = -9223372036854775808::HUGEINT THEN {h} ELSE abs({h}) END)"


SQL = {
    "q_preprocess": f"SELECT doc_id, md5({sql_clean('text')}) AS clean_md5, length({sql_clean('text')})::INT AS n FROM documents",
    "q_text_shortening": f"""SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS cut, md5(trim(translate(text, chr(10) || chr(9), '  '))) AS line,
  CASE WHEN text IS NULL THEN NULL WHEN len({_words(sql_clean('text'))}) > 5 THEN array_to_string({_words(sql_clean('text'))}[1:5], ' ') || '...' ELSE {sql_clean('text')} END AS words FROM documents""",
    "q_title_norm": rf"WITH {CUR} SELECT id, replace(title, '_', ' ') AS search_title, {_FILE} AS name, lower(regexp_extract(title, '(?s)^.+\.([^.]*)$', 1)) AS extension FROM cur",
    "q_tokenize": "WITH f AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+(?:[''’.][\\p{L}\\p{M}\\p{N}_]+)*')) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM f GROUP BY ALL",
    "q_plain_words": rf"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(list_filter(regexp_split_to_array(text, '[ \n\t]'), lambda w: w <> ''))::INT END AS plain, CASE WHEN text IS NULL THEN NULL ELSE len({_words('text')})::INT END AS words FROM documents",
    "q_term_matches": f"""WITH x AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL)
SELECT doc_id, contains(low, 'graph') AND contains(low, 'dense') AND contains(low, 'the') AS all_in, (contains(low, 'graph')::INT + contains(low, 'dense')::INT + contains(low, 'the')::INT)::INT AS n_in,
  {_IN_ORDER} >= 0 AS in_order, ((length(low) - length(replace(low, 'the', ''))) // 3)::INT AS the_count, (instr(low, 'the') - 1)::INT AS the_at, (instr(low, 'the') - 1)::INT AS phrase_at,
  len(list_filter({_words('low')}, lambda w: starts_with(w, 'gra'))) > 0 AS has_prefix, len(list_filter({_words('low')}, lambda w: starts_with(w, 'gra')))::INT AS n_prefix FROM x""",
    "q_analyze_query": f"WITH s AS (SELECT query_id, query_text AS q FROM search_queries WHERE query_text IS NOT NULL), {_analysis('s', 'query_id')} SELECT query_id, terms, phrases, negated, tokens, query_type, has_wildcard FROM a",
    "q_analyze_quoted": f"""WITH {CLEAN}, s AS (SELECT id, '"' || substr(title, 1, 9) || ''' NOT -old_' || title || ' AND plan?' AS q FROM doc), {_analysis('s', 'id')} SELECT id, terms, phrases, negated, tokens, query_type FROM a""",
    "q_contains_term": f"WITH s AS (SELECT query_id, query_text AS q FROM search_queries WHERE query_text IS NOT NULL), {_analysis('s', 'query_id')} SELECT query_id, list_contains(terms, lower(regexp_extract(q, '^(\\S+)', 1))) AS own, list_contains(terms, 'the') AS the FROM a JOIN s USING (query_id)",
    "q_paths": f"""WITH {CUR}, x AS (SELECT id, coalesce(json_extract_string({_META}, '$.source_path'), '') AS path FROM cur),
  y AS (SELECT *, regexp_split_to_array(path, '/') AS parts FROM x)
SELECT id, list_filter(parts[1:len(parts) - 1], lambda c: c NOT IN ('', '.')) AS components, lower(regexp_replace(path, '/$', '')) AS normal,
  list_contains(list_transform(parts[1:len(parts) - 1], lambda c: lower(c)), 'riba') AS has, regexp_matches(lower(path), '(?s)/vault/.*/1.*_') AS matches,
  path = '/vault/riba' OR starts_with(path, '/vault/riba/') AS below, lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('txt', 'md') AS allowed, 'file:' || sha256(CASE WHEN path = '' THEN '.' ELSE path END) AS file_id FROM y""",
    "q_headers": rf"""WITH {CUR}, h AS (
  SELECT id, unnest(list_zip(regexp_extract_all(content, '(?m)^(#{{1,6}})\s+(.+)$', 1), regexp_extract_all(content, '(?m)^(#{{1,6}})\s+(.+)$', 2))) AS z, 1 AS k FROM cur
  UNION ALL SELECT id, unnest(list_zip(regexp_extract_all(content, '(?i)<h([1-6])[^>]*>([^<]+)</h[1-6]>', 1), regexp_extract_all(content, '(?i)<h([1-6])[^>]*>([^<]+)</h[1-6]>', 2))), 2 FROM cur
  UNION ALL SELECT id, unnest(list_zip(regexp_extract_all(content, '(?m)^(.+)\n[=\-~^]+\s*$', 1), regexp_extract_all(content, '(?m)^(.+)\n[=\-~^]+\s*$', 1))), 3 FROM cur)
SELECT id, CASE k WHEN 1 THEN length(z[1]) WHEN 2 THEN z[1]::INT ELSE 1 END::INT AS level, trim(z[2]) AS text, count(*) AS n FROM h GROUP BY ALL""",
    "q_metadata": f"""WITH {CUR}, x AS (SELECT id, {_META} AS m FROM cur), y AS (SELECT id, m, {_VALUE.format(k='author', s=' ')} AS author, {_VALUE.format(k='tags', s=' ')} AS tag_text, {_VALUE.format(k='tags', s='+')} AS tags FROM x)
SELECT id, array_to_string(list_filter([author, tag_text], lambda v: v <> ''), ' ') AS texts, author, tags,
  CASE WHEN regexp_full_match(json_extract_string(m, '$.source_size'), '[0-9]{{1,18}}') THEN json_extract_string(m, '$.source_size')::BIGINT WHEN json_extract_string(m, '$.source_size') IS NULL THEN 0 ELSE 0 END AS size,
  make_timestamp(CASE WHEN regexp_full_match(json_extract_string(m, '$.source_mtime'), '[0-9]{{1,20}}') THEN json_extract_string(m, '$.source_mtime')::HUGEINT // 1000 ELSE 0 END::BIGINT) AS modified,
  tag_text <> '' AND (contains(lower(tag_text), 'ticket') OR contains(lower(tag_text), 'user-149')) AS hit FROM y""",
    "q_edit_distance": f"WITH {_PAIRS} SELECT a, b, d FROM pairs",
    "q_osa": f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT a, b, d, regexp_extract_all(a, '(?s).') AS x, regexp_extract_all(b, '(?s).') AS y FROM pairs),
  s AS (SELECT a, b, 0 AS i, range(0, len(y) + 1) AS r, NULL::BIGINT[] AS p FROM c
    UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(k) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda q: k[q] - q)) + j), r FROM (
      SELECT a, b, i, r, list_concat([i + 1], list_transform(range(1, len(y) + 1), lambda j: least(r[j + 1] + 1, r[j] + (x[i + 1] <> y[j])::INT, CASE WHEN i > 0 AND j > 1 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN p[j - 1] + 1 ELSE 1000000 END))) AS k
      FROM s JOIN c USING (a, b) WHERE i < len(x)))
SELECT c.a, c.b, d, r[len(r)]::INT AS aligned FROM s JOIN c ON s.a = c.a AND s.b = c.b AND s.i = len(c.x)""",
    "q_hash": f"SELECT doc_id, ({_abs(_signed(_poly('text')))})::BIGINT AS hash FROM documents WHERE text IS NOT NULL",
    "q_token_ids": f"""WITH w AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(10) || chr(9), '  '), ' '), lambda w: w <> '')[1:254] AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w), h AS (SELECT doc_id, i, {_signed(_poly('w'))} AS h FROM e), ids AS (SELECT doc_id, list((CASE WHEN h = -9223372036854775808 THEN -({_abs('h')} % 30000) ELSE {_abs('h')} % 30000 END) ORDER BY i) AS ids FROM h GROUP BY doc_id),
  f AS (SELECT doc_id, list_concat([101::HUGEINT], coalesce(ids, []), [102::HUGEINT]) AS ids FROM w LEFT JOIN ids USING (doc_id)), g AS (SELECT doc_id, list_concat(ids, list_transform(range(256 - len(ids)), lambda i: 0::HUGEINT)) AS ids FROM f)
SELECT doc_id, md5(array_to_string(list_transform(ids, lambda i: i::VARCHAR), ',')) AS ids_md5, len(list_filter(ids, lambda i: i <> 0))::INT AS used, len(ids)::INT AS n FROM g""",
    "q_mock_embed": f"""WITH h AS (SELECT doc_id, {_abs(_signed(_poly('text')))} AS h FROM documents WHERE text IS NOT NULL),
  v AS (SELECT doc_id, list_transform(range(1, 385), lambda k: (sin(({_signed('((h * k) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT')})::BIGINT::DOUBLE) * 0.1 + 0.01)::FLOAT::DOUBLE) AS v FROM h),
  n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT doc_id, len(v)::INT AS n, round(v[1] / n, 3) AS first, round(v[384] / n, 3) AS last, 1.0::DOUBLE AS norm FROM n""",
    "q_vectors": f"""WITH x AS (SELECT e.vec_id, e.embedding AS v, o.embedding AS w FROM embeddings e JOIN embeddings o ON e.vec_id = o.vec_id + 1)
SELECT vec_id, round({_DOT.format(a='v', b='w')}, 6) AS dot, round(least(1.0, greatest(0.0, {_DOT.format(a='v', b='w')})), 6) AS cos, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM x""",
    "q_normalize": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: (v * 3::FLOAT)::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM x)
SELECT vec_id, round((v[1] / n)::FLOAT::DOUBLE, 5) AS first, round(sqrt(list_sum(list_transform(v, lambda x: (x / n)::FLOAT::DOUBLE * (x / n)::FLOAT::DOUBLE))), 5) AS norm FROM n""",
}
