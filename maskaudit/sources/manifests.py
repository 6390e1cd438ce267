"""Checksum manifests and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.operators import reconcile


def list_files(spark: SparkSession, directory: str, dataset: str) -> DataFrame:
    """A2: every non-hidden file under a directory, as ``<dataset>/<relative path>``.

    The contents column is never selected, so files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    root = directory.rstrip("/") + "/"
    relative = F.split_part(F.col("path"), F.lit(root), F.lit(-1))
    return files.select(F.concat(F.lit(dataset + "/"), relative).alias("path")).where(
        ~F.col("path").rlike(r"(^|/)\.")
    )


def file_digests(spark: SparkSession, directory: str, dataset: str) -> DataFrame:
    """Path and SHA-256 of every non-hidden file under a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    root = directory.rstrip("/") + "/"
    relative = F.split_part(F.col("path"), F.lit(root), F.lit(-1))
    return files.select(
        F.concat(F.lit(dataset + "/"), relative).alias("path"), F.sha2("content", 256).alias("digest")
    ).where(~F.col("path").rlike(r"(^|/)\."))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A4: parsed lines of a manifest, problems included.

    A line is known by its byte order in the file, which is what repeated paths are judged by.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return reconcile.parse_manifest(lines, "value", "line")


def write_manifest(entries: DataFrame, path: str) -> None:
    """Write the manifest sorted by path; an existing one is never touched."""
    line = reconcile.manifest_line(F.col("path"), F.col("digest"))
    entries.orderBy("path").select(line.alias("value")).write.mode("errorifexists").text(path)


def check_or_write(
    spark: SparkSession, manifest: str, actual: DataFrame, *, exists: bool, write_missing: bool = False
) -> DataFrame:
    """Verify the files against the manifest, or write it where absent and asked for."""
    if exists:
        entries = read_manifest(spark, manifest)
        if not entries.where("problem IS NOT NULL").isEmpty():
            raise ValueError(f"{manifest} has malformed or repeated lines")
        return reconcile.verify_checksums(entries, actual)
    if not write_missing:
        raise FileNotFoundError(f"checksum manifest not found at {manifest}")
    if actual.isEmpty():
        raise ValueError("no files to write checksums for")
    write_manifest(actual, manifest)
    return reconcile.verify_checksums(actual, actual)
