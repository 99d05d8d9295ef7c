"""Exact search by inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from findwell.functions.vectors import inner_product

QUERIES_AT_ONCE = 4096


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise products in single precision, their sums in double: as the column expression does."""
    return (x * q).astype(np.float64).sum(axis=1)


def _scan_udf(queries, k: int, kind: pa.DataType):
    """The candidates of a task: one matrix product per batch, exact scores only near the k best.

    ``queries`` is a broadcast of (ids, matrix), at most ``QUERIES_AT_ONCE`` rows.
    """

    def run(batches):
        import pyarrow.compute as pc

        ids, matrix = queries.value
        slack = 4e-7 * matrix.shape[1]  # bound on the error of a single-precision product of unit vectors
        sizes = np.linalg.norm(matrix.astype(np.float64), axis=1)
        least = np.full(len(matrix), -np.inf)  # the k-th best exact score so far
        q_kept, id_kept, s_kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object), np.zeros(0)
        for batch in batches:
            right = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(batch.column("v")), matrix.shape[1]).fill_null(False)))
            x = np.asarray(batch.column("v").take(pa.array(right)).flatten().cast(pa.float32()).fill_null(float("nan"))).reshape(len(right), matrix.shape[1])
            finite = np.isfinite(x).all(axis=1)
            x, names = x[finite], batch.column("id").take(pa.array(right[finite]))
            for at in range(0, len(x), 2048):
                part = x[at : at + 2048]
                near = part @ matrix.T
                error = slack * np.linalg.norm(part.astype(np.float64), axis=1)[:, None] * sizes[None, :]
                bar = least
                if len(part) > k:
                    bar = np.maximum(bar, np.partition(near - error, len(part) - k, axis=0)[len(part) - k])
                i, j = np.nonzero(near + error >= bar[None, :])
                q_kept = np.concatenate([q_kept, j])
                id_kept = np.concatenate([id_kept, np.array(names.take(pa.array(i + at)).to_pylist(), dtype=object)])
                s_kept = np.concatenate([s_kept, _exact(part[i], matrix[j])])
                if len(q_kept) > 4 * k * len(matrix) + 10_000:
                    q_kept, id_kept, s_kept = _best(q_kept, id_kept, s_kept, k, least)
        q_kept, id_kept, s_kept = _best(q_kept, id_kept, s_kept, k, least)
        for at in range(0, len(q_kept), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in q_kept[cut]], kind), pa.array(id_kept[cut].tolist(), pa.string()), pa.array(s_kept[cut])], names=["query_id", "id", "score"])

    return run


def _best(q, ids, s, k: int, least: np.ndarray):
    """The candidates of each query that reach its k-th best score, ties with it included; updates ``least``."""
    order = np.lexsort((-s, q))
    q, ids, s = q[order], ids[order], s[order]
    starts = np.searchsorted(q, np.arange(len(least)))
    ends = np.searchsorted(q, np.arange(len(least)), side="right")
    full = ends - starts >= k
    least[full] = s[starts[full] + k - 1]
    keep = s >= least[q]
    return q[keep], ids[keep], s[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", strategy: str = "arrow") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of all vectors for each query (query_id, vector).

    ``arrow`` reads the vectors once per block of at most 4096 queries and keeps k candidates per
    task and query; ``expr`` evaluates the inner product as a column, for a handful of queries (64 at once).
    Vectors of another length or with numbers that aren't finite, null vectors and null ids don't
    take part; ties go to the smaller id; k of 0 or less gives none.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").alias("q"))
    kind = asked.schema["query_id"].dataType.simpleString()
    if strategy not in ("arrow", "expr"):
        raise ValueError(f"unknown strategy {strategy}")
    hits, block, most = None, [], QUERIES_AT_ONCE if strategy == "arrow" else 64

    def scan(block):
        if strategy == "arrow":
            q = np.array([r["q"] for r in block], dtype=np.float32)
            sent = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in block], q))
            return rows.mapInArrow(_scan_udf(sent, k, to_arrow_type(asked.schema["query_id"].dataType)), f"query_id {kind}, id string, score double")
        asks = F.array(*[F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.array(*[F.lit(x).cast("float") for x in r["q"]]).alias("q")) for r in block])
        met = rows.select("id", "v", F.explode(asks).alias("a")).where((F.size("v") == F.size("a.q")) & F.forall("v", lambda x: F.abs(x) < float("inf")))
        return met.select("a.query_id", "id", inner_product("v", "a.q").alias("score"))

    for row in asked.toLocalIterator() if k > 0 else ():
        block.append(row)
        if len(block) == most:
            hits, block = scan(block) if hits is None else hits.unionAll(scan(block)), []
    if block:
        hits = scan(block) if hits is None else hits.unionAll(scan(block))
    if hits is None:
        hits = queries.sparkSession.createDataFrame([], f"query_id {kind}, id string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of(vectors: DataFrame, query: np.ndarray, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score) of the ``k`` best for one query vector that is known here: one scan, no shuffle, the best of each task merged."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    sent = vectors.sparkSession.sparkContext.broadcast(([0], np.asarray(query, dtype=np.float32)[None]))
    hits = rows.mapInArrow(_scan_udf(sent, k, pa.int32()), "query_id int, id string, score double")
    return hits.orderBy(F.desc("score"), "id").limit(max(0, k)).select("id", "score")


def remove(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The vectors less those whose id is listed."""
    return vectors.join(ids.select(F.col(key)), key, "left_anti")
