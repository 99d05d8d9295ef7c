"""Folders of files as a source of documents, and what of them is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.functions.metadata import digits
from findwell.functions.paths import extension_allowed, file_id
from findwell.sources.extract import extracted, plain_text

PLAIN = ["txt", "md", "rst", ""]


def local_path(path):
    """The path of a file without its scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def listing(spark: SparkSession, folder: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """(path, mtime, size, content) of the regular files with one of the extensions. Contents are read only where used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.select(local_path("path").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.where(extension_allowed("path", extensions))


def changed(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files that no stored document has with the same path, time and size.

    Documents keep these in their metadata (a map): nanoseconds and bytes as digits. Times are
    compared in microseconds.
    """
    known = documents.select(
        F.try_element_at("metadata", F.lit("source_path")).alias("path"),
        F.call_function("div", digits(F.try_element_at("metadata", F.lit("source_mtime"))), F.lit(1000).cast("bigint")).alias("us"),
        digits(F.try_element_at("metadata", F.lit("source_size"))).alias("size"),
    ).distinct()
    stamped = files.withColumn("us", F.unix_micros(F.col("mtime").cast("timestamp")))
    return stamped.join(known, ["path", "us", "size"], "left_anti").drop("us")


def gone(files: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """(id) of stored documents below the folder whose file isn't listed any more."""
    path = F.try_element_at("metadata", F.lit("source_path"))
    stored = documents.select("id", path.alias("path")).where(F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/")))
    return stored.join(files.select("path"), "path", "left_anti").select("id")


def one(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a single file."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(local_path("path").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def read(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """(path, mtime, size, text, error) of a listing: either a text or an error.

    Plain files never go through Python. A file that can't be read is a failure, not an error.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    is_plain = ext.isin(PLAIN) & (F.lit(True) if not extractors else ~ext.isin(list(extractors)))
    simple = files.where(is_plain).withColumn("got", F.struct(plain_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error")))
    other = files.where(~is_plain).withColumn("got", extracted(F.col("content"), ext, extractors))
    return simple.unionByName(other).select("path", "mtime", "size", F.col("got.text").alias("text"), F.col("got.error").alias("error"))


def as_documents(rows: DataFrame) -> DataFrame:
    """(id, title, content, metadata) of files that were read."""
    metadata = F.create_map(
        F.lit("source_path"), F.col("path"), F.lit("source_mtime"), (F.unix_micros(F.col("mtime").cast("timestamp")) * 1000).cast("string"), F.lit("source_size"), F.col("size").cast("string"),
    )
    return rows.select(file_id("path").alias("id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("title"), F.coalesce("text", F.lit("")).alias("content"), metadata.alias("metadata"))


def read_documents(files: DataFrame, extractors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (id, title, content, metadata), failures (path, error)) of a listing."""
    rows = read(files, extractors)
    return as_documents(rows.where("error is null")), rows.where("error is not null").select("path", "error")
