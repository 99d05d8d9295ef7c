"""The flat vector file: an exchange format for vectors, little-endian.

u32 dimensions, u32 count, then for each vector u32 length of its id, the id in UTF-8, its floats.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode(rows, dimensions: int, count: int):
    """The parts of a file of ``count`` (id, vector) rows."""
    yield struct.pack("<II", dimensions, count)
    for key, vector in rows:
        if len(vector) != dimensions:
            raise ValueError(f"vector {key} has {len(vector)} dimensions, not {dimensions}")
        name = key.encode()
        yield struct.pack("<I", len(name)) + name + np.asarray(vector, dtype="<f4").tobytes()


def read_parts(data: bytes, dimensions: int | None = None, rows: int = 10_000):
    """(ids, matrix) of a file, so many rows at a time."""
    dim, n = struct.unpack_from("<II", data)
    if dimensions is not None and dim != dimensions:
        raise ValueError(f"the file has {dim} dimensions, not {dimensions}")
    at = 8
    for begin in range(0, n, rows):
        keys, parts = [], []
        for _ in range(begin, min(n, begin + rows)):
            (size,) = struct.unpack_from("<I", data, at)
            keys.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
            parts.append(data[at : at + 4 * dim])
            at += 4 * dim
        yield keys, np.frombuffer(b"".join(parts), dtype="<f4").reshape(len(keys), dim)


def decode(data: bytes, dimensions: int | None = None) -> list[tuple[str, np.ndarray]]:
    return [(k, v) for keys, matrix in read_parts(data, dimensions) for k, v in zip(keys, matrix)]


def _output(spark: SparkSession, path: str):
    """A stream of the Hadoop file system, with the folders above it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    return fs.create(p, True)


def save(vectors: DataFrame, path: str, dimensions: int, key: str = "id", vector: str = "embedding") -> None:
    """Write one file, for exchange; rows come to the driver partition by partition, never all at once.

    A collection that is too large for that is written by :func:`save_parts`.
    """
    rows = vectors.select(key, vector)
    out = _output(vectors.sparkSession, path)
    try:
        for part in encode(((r[0], r[1]) for r in rows.toLocalIterator()), dimensions, rows.count()):
            out.write(bytearray(part))
    finally:
        out.close()


def save_parts(vectors: DataFrame, folder: str, dimensions: int, key: str = "id", vector: str = "embedding") -> int:
    """Write a folder with one file of the format per partition, from the executors; gives the number of vectors.

    A file appears under its name only when it is whole; a repeated task replaces its own.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        rows = [(k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        files, where = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        name = f"{where.rstrip('/')}/part-{TaskContext.get().partitionId():06d}"
        files.create_dir(where, recursive=True)
        with files.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.tmp") as out:
            for part in encode(rows, dimensions, len(rows)):
                out.write(part)
        files.move(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", f"{name}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    return vectors.select(key, vector).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def load(spark: SparkSession, paths: str, dimensions: int) -> DataFrame:
    """(id, embedding) of one file or many; none if there is no file. Other dimensions are an error."""
    schema = "id string, embedding array<float>"

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for keys, matrix in read_parts(data, dimensions):
                    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * dimensions)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()))], names=["id", "embedding"])

    try:
        files = spark.read.format("binaryFile").load(paths).select("content")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return files.mapInArrow(run, schema)


def save_numbered(vectors: DataFrame, path: str, dimensions: int, key: str = "id", vector: str = "embedding") -> None:
    """Write an index that knows its vectors by numbers: ``path``.vectors, and ``path``.idmap with the id of each number."""
    numbered = vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding")).rdd.zipWithIndex().map(lambda r: (r[1], r[0][0], r[0][1]))
    table = vectors.sparkSession.createDataFrame(numbered, "number bigint, id string, embedding array<float>")
    checked(table, dimensions).write.mode("overwrite").option("compression", "none").parquet(f"{path}.vectors")
    vectors.sparkSession.read.parquet(f"{path}.vectors").select("number", "id").write.mode("overwrite").parquet(f"{path}.idmap")


def load_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of :func:`save_numbered`; none if the index or its id map is missing."""
    try:
        vectors, ids = spark.read.parquet(f"{path}.vectors").select("number", "embedding"), spark.read.parquet(f"{path}.idmap")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string, embedding array<float>")
    return vectors.join(ids, "number").select("id", "embedding")


def checked(vectors: DataFrame, dimensions: int, vector: str = "embedding") -> DataFrame:
    """The rows, or an error at the first vector of other dimensions."""
    ok = F.assert_true(F.size(vector) == dimensions, F.lit(f"vectors must have {dimensions} dimensions")).isNull()
    return vectors.where(ok)
