"""The document store: tables in versioned folders behind a manifest.

Parquet has no update in place, so a change writes new files and then moves one small manifest that
names the files of all tables into its numbered place. Readers see the old version or the new one,
never a mixture; a job that dies half way leaves nothing that is seen, and of two that change the
same version one must begin again.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def update(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with the changed ones in place of those of the same key; changes of unknown keys are an error of the caller."""
    return stored.join(changes.select(key), key, "left_anti").select(stored.columns).unionByName(changes.select(stored.columns))


def delete(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows less those listed; unknown ids don't matter."""
    return stored.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti").select(stored.columns)


def cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (rows, column of the document's id) less the rows of the listed documents."""
    return {name: delete(rows, ids, key) for name, (rows, key) in tables.items()}


def list_documents(documents: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of documents, the newest first, ties by id."""
    return documents.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, t in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.agg(*[F.max(F.when(F.col("t") == name, F.col("n"))).alias(name) for name in tables])


class Conflict(RuntimeError):
    """Another writer has published since the version that a change was made from."""


class Store:
    """Tables of one folder, each made of folders of files that a numbered manifest lists.

    A change stages its files, which nothing shows yet, and publishes them under the next number. The
    manifest is moved into its place only if no other has that number: of two writers one wins, the
    other learns that it lost and works out its change again. Additions cost what they add. A
    deletion writes the deleted ids alone (a delete vector), and hides their rows in all folders
    that are older than itself; ``compact`` merges folders and vectors. ``keys`` names for each
    table the column with the document's id; tables without one aren't touched by deletions.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or {}
        self._read: dict[tuple[int, str], DataFrame] = {}  # so that files are listed once per version

    # files

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of what is in a folder."""
        p, fs = self._file(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The number of the newest manifest; 0 if there is none."""
        return max((int(n[:-5]) for n, _ in self._names("_manifests") if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{tables: {name: [[folder, number]]}, deleted: [[folder, number]]} of a version, the newest if left out."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "deleted": []}
        p, fs = self._file(f"_manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # reading

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table in a version, the newest if left out; None if there is no such table."""
        version = self.version() if version is None else version
        if (version, table) not in self._read:
            self._read = {k: v for k, v in self._read.items() if k[0] == version}
            now = self.manifest(version)
            folders = now["tables"].get(table)
            if not folders:
                return None
            self._read[version, table] = self._visible(folders, now["deleted"], self.keys.get(table))
        return self._read[version, table]

    def _visible(self, folders: list, deleted: list, key: str | None) -> DataFrame:
        oldest = min(n for _, n in folders)
        vectors = [v for v in deleted if v[1] > oldest] if key else []
        rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f, _ in folders])
        if not vectors:
            return rows
        made = lambda listed, file: F.element_at(F.create_map(*[F.lit(x) for f, n in listed for x in (f.rsplit("/", 1)[1], n)]), F.regexp_extract(file, r"/([0-9a-f]{32})/[^/]*$", 1))
        gone = self.spark.read.parquet(*[f"{self.path}/{f}" for f, _ in vectors])
        gone = gone.select(F.col("id").alias("__id"), made(vectors, F.col("_metadata.file_path")).alias("__gone")).groupBy("__id").agg(F.max("__gone").alias("__gone"))
        placed = rows.withColumn("__made", made(folders, F.col("_metadata.file_path")))
        return placed.join(gone, (F.col(key) == F.col("__id")) & (F.col("__made") < F.col("__gone")), "left_anti").select(rows.columns)

    # changing

    def stage(self, table: str, df: DataFrame) -> str:
        """Write rows that nothing shows yet; gives their folder."""
        where = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{where}")
        return where

    def publish(self, base: int, add: dict[str, list[str]] | None = None, delete: str | None = None, replace: dict[str, list[str]] | None = None) -> bool:
        """Show a change that was made from version ``base``; False, and nothing shown, if that isn't the newest any more.

        ``add`` and ``replace`` name staged folders of tables, ``delete`` a staged folder of ids.
        """
        now = self.manifest(base)
        for name, folders in (add or {}).items():
            now["tables"].setdefault(name, []).extend([f, base + 1] for f in folders)
        for name, folders in (replace or {}).items():
            now["tables"][name] = [[f, base + 1] for f in folders]
        if delete:
            now["deleted"].append([delete, base + 1])
        oldest = min((n for name, fs in now["tables"].items() if name in self.keys for _, n in fs), default=base + 1)
        now["deleted"] = [d for d in now["deleted"] if d[1] > oldest]  # the others hide nothing any more
        new, fs = self._file(f"_manifests/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        final, _ = self._file(f"_manifests/{base + 1:012d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # noqa: BLE001
            fs.delete(new, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def append(self, tables: dict[str, DataFrame]) -> None:
        """Add rows to tables, then show all of them at once; other writers don't matter."""
        staged = {name: [self.stage(name, df)] for name, df in tables.items()}
        while not self.publish(self.version(), add=staged):
            pass

    def write(self, tables: dict[str, DataFrame], base: int | None = None) -> None:
        """Replace tables by rows made from version ``base`` (the newest if left out), all at once."""
        base = self.version() if base is None else base
        staged = {name: [self.stage(name, df)] for name, df in tables.items()}
        if not self.publish(base, replace=staged):
            raise Conflict("the store has changed since it was read")

    def remove(self, ids: DataFrame) -> None:
        """Hide the rows of the listed documents (id) in all tables that have keys."""
        staged = self.stage("_deleted", ids.select("id").distinct())
        while not self.publish(self.version(), delete=staged):
            pass

    def compact(self, sums: dict[str, tuple[list[str], list[str]]] | None = None, order: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """Merge the folders of each table and drop what is deleted.

        ``sums`` names tables of differences (keys, numbers) that are added up; ``order`` how a table is
        laid out. Raises :class:`Conflict` if another writer publishes meanwhile.
        """
        base, tables = self.version(), {}
        for name in self.manifest(base)["tables"]:
            rows = self.read(name, base)
            if name in (sums or {}):
                by, numbers = sums[name]
                rows = rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in numbers]).select(rows.columns)
            tables[name] = (order or {}).get(name, lambda r: r)(rows)
        self.write(tables, base)

    def vacuum(self, min_age_s: float = 3600) -> None:
        """Delete the files that the newest manifest doesn't name, if they are older than ``min_age_s``.

        The age must cover the longest change and the longest read: files of a change that isn't
        published yet aren't named either.
        """
        version, before = self.version(), (time.time() - min_age_s) * 1000
        now = self.manifest(version)
        kept = {f for folders in [*now["tables"].values(), now["deleted"]] for f, _ in folders}
        for table, _ in self._names(""):
            for name, changed in self._names(table):
                stale = f"{table}/{name}" not in kept if table != "_manifests" else name != f"{version:012d}.json"
                if stale and changed <= before and (table == "_manifests" or re.fullmatch("[0-9a-f]{32}", name)):
                    p, fs = self._file(f"{table}/{name}")
                    fs.delete(p, True)

    def disk_bytes(self) -> int:
        """Bytes below the folder; 0 if there is none."""
        p, fs = self._file("")
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
