"""Functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.text import col


def clean_path(path) -> Column:
    """The shortest equal path: no empty or ``.`` parts, ``..`` taken back where a part is before it."""
    p = col(path)
    rooted = F.startswith(p, F.lit("/"))
    none = F.expr("cast(array() as array<string>)")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = F.when(F.coalesce(last != "..", F.lit(False)), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.array_join(F.aggregate(F.split(p, "/"), none, step), "/")
    tidy = F.concat(F.when(rooted, "/").otherwise(""), parts)
    # Most paths are clean already.
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)|//|./$|^$"), F.when(tidy == "", ".").otherwise(tidy)).otherwise(p)


def path_components(path) -> Column:
    """Names of the folders above the file, from the top."""
    p = clean_path(path)
    parts = F.split(p, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda c: ~c.isin("", "."))


def normalize_path(path) -> Column:
    """In lower case, without one slash at the end."""
    return F.lower(F.regexp_replace(col(path), "/$", ""))


def has_component(path, name) -> Column:
    """Any folder of the path has the name, without regard to case."""
    n = F.lower(col(name))
    return F.exists(path_components(path), lambda c: F.lower(c) == n)


def matches_pattern(path, pattern: str) -> Column:
    """The parts between ``*`` stand in the path in this order; without ``*`` a substring."""
    at, low = F.lit(0), F.lower(col(path))
    for part in [p for p in pattern.lower().split("*") if p] if "*" in pattern else [pattern.lower()]:
        found = F.call_function("locate", F.lit(part), low, at + 1)
        at = F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(found + len(part) - 1) if part else at
    return at >= 0


def file_id(path) -> Column:
    """Document id of a file."""
    return F.concat(F.lit("file:"), F.sha2(clean_path(path), 256))


def under_root(path, root: str) -> Column:
    """The path is the root or lies below it."""
    root = root.rstrip("/")
    return (col(path) == root) | F.startswith(col(path), F.lit(root + "/"))


def extension_allowed(path, allowed: list[str]) -> Column:
    """The extension is one of ``allowed``, dots and case aside; all are if the list is empty."""
    wanted = [a.lower().lstrip(".") for a in allowed]
    return F.lit(True) if not wanted else F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1)).isin(wanted)
