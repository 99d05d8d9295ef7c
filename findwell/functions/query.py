"""Analysis of a query text as column expressions: phrases, terms, negations, kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.text import col, words

# Fixed pattern: a quoted phrase.
PHRASE = r"[\"']([^\"']+)[\"']"
# Punctuation at either end of a word, but for hyphens and underscores.
EDGES = r"^[^\P{P}_-]+|[^\P{P}_-]+$"
MATCH_TYPES = ["none", "partial", "all_words", "phrase", "exact"]


def normalized(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), EDGES, "")


def phrases(query) -> Column:
    """Quoted parts, of either kind of quote at either end, in lower case."""
    found = F.regexp_extract_all(col(query), F.lit(PHRASE), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.lower(F.trim(p))), lambda p: p != "")


def _rest(query) -> Column:
    return words(F.regexp_replace(col(query), PHRASE, " "))


def terms(query) -> Column:
    """Words outside of quotes, without the negated ones and the words and, or, not."""
    kept = F.filter(_rest(query), lambda w: ~F.startswith(w, F.lit("-")) & ~F.lower(w).isin("not", "and", "or"))
    return F.filter(F.transform(kept, normalized), lambda t: t != "")


def negated(query) -> Column:
    """Words after a hyphen."""
    kept = F.filter(_rest(query), lambda w: F.startswith(w, F.lit("-")))
    return F.filter(F.transform(kept, lambda w: normalized(F.substring(w, 2, 1 << 30))), lambda t: t != "")


def has_wildcard(query) -> Column:
    return col(query).rlike(r"[*?]")


def match_tokens(query) -> Column:
    """Distinct terms, then the distinct words of the phrases."""
    parts = F.flatten(F.transform(phrases(query), words))
    return F.array_distinct(F.concat(terms(query), F.filter(F.transform(parts, normalized), lambda t: t != "")))


def contains_term(query, term) -> Column:
    """Whether a term, in lower case, is one of the query's terms."""
    return F.array_contains(terms(query), F.lower(col(term)))


def query_type(query) -> Column:
    """wildcard, boolean, phrase, single or multi; the first that holds."""
    return (
        F.when(has_wildcard(query), "wildcard")
        .when(F.size(negated(query)) > 0, "boolean")
        .when(F.size(phrases(query)) > 0, "phrase")
        .when(F.size(terms(query)) <= 1, "single")
        .otherwise("multi")
    )


def analyzed(query) -> Column:
    """All of it as one struct."""
    q = col(query)
    return F.struct(
        q.alias("original"), terms(q).alias("terms"), phrases(q).alias("phrases"), query_type(q).alias("query_type"),
        has_wildcard(q).alias("has_wildcard"), negated(q).alias("negated"), match_tokens(q).alias("tokens"),
    )
