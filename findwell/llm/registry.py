"""All queries of this subpackage and their SQL."""

from findwell.llm import encode, fuse_scores, leaks, markup, near_copies, neighbours, spans, split, terms

MODULES = [split, near_copies, fuse_scores, terms, markup, neighbours, encode, leaks, spans]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
