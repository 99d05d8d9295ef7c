"""Functions on document metadata, a JSON object kept as MAP<STRING, STRING>.

Values that are arrays are kept as their JSON text and read as words when needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.text import col
from findwell.functions import query as Q

INTERNAL = ["source_path", "source_mtime", "source_size"]


def from_json(text) -> Column:
    """The metadata of a JSON text; an empty map for null or broken JSON."""
    return F.coalesce(F.from_json(col(text), "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def to_json(metadata) -> Column:
    return F.to_json(col(metadata))


def visible(metadata) -> Column:
    """Without the keys that describe the source file."""
    return F.map_filter(col(metadata), lambda k, v: ~k.isin(INTERNAL))


def items(value: Column) -> Column:
    """The elements of a JSON array as strings; null for anything else."""
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))


def as_text(value: Column) -> Column:
    """A value as words: arrays joined by blanks, null as nothing."""
    return F.coalesce(F.array_join(items(value), " "), value, F.lit(""))


def field_text(metadata, key: str) -> Column:
    """The value of a key as text, empty if absent."""
    return as_text(F.try_element_at(col(metadata), F.lit(key)))


def field_items(metadata, key: str) -> Column:
    """The value of a key as a list: an array's elements, or a text's parts between , ; and |."""
    v = F.try_element_at(col(metadata), F.lit(key))
    return F.coalesce(items(v), F.filter(F.split(v, "[,;|]"), lambda x: x != ""), F.expr("cast(array() as array<string>)"))


def all_text(metadata) -> Column:
    """The texts of all visible values, in the order of their keys."""
    entries = F.array_sort(F.map_entries(visible(metadata)))
    return F.array_join(F.filter(F.transform(entries, lambda e: as_text(e["value"])), lambda t: t != ""), " ")


def field_matches(query, metadata, key: str) -> Column:
    """Any token of the query is a substring of the key's value."""
    low = F.lower(field_text(metadata, key))
    return (low != "") & F.exists(Q.match_tokens(query), lambda t: F.contains(low, t))


def integer(value) -> Column:
    """A number kept as text or number, else 0."""
    return F.coalesce(col(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def digits(value) -> Column:
    """A text of digits as a number; anything else, or too many of them, gives 0."""
    v = col(value)
    return F.coalesce(F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint")), F.lit(0).cast("bigint"))


def modified_at(value) -> Column:
    """Nanoseconds since 1970, as digits, to a timestamp."""
    return F.timestamp_micros(F.call_function("div", digits(value), F.lit(1000).cast("bigint")))


def source_path(metadata) -> Column:
    return field_text(metadata, "source_path")
