"""Edit distances."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from findwell.functions.text import col


def levenshtein(a, b, most: int | None = None) -> Column:
    """Edits between two texts in characters; -1 if more than ``most``."""
    return F.levenshtein(col(a), col(b)) if most is None else F.levenshtein(col(a), col(b), most)


def aligned_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@arrow_udf(IntegerType())
def _aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else aligned_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def damerau(a, b) -> Column:
    """Optimal string alignment distance in characters."""
    return _aligned(col(a), col(b))
