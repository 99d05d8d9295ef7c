"""The queries that the driver runs, with the SQL that DuckDB runs beside them."""

from findwell.suite import changes, ranking, retrieval, scalars, storage

MODULES = [changes, scalars, retrieval, ranking, storage]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
