"""File listings from storage: names, sizes and times, without reading content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str, project_id: str, hidden: bool = False) -> DataFrame:
    """Every file below `root`: (project_id, path below root, size, mtime in nanoseconds, hash still null)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", "modificationTime")  # the content column is never read
    base = root.rstrip("/") + "/"
    below = F.substring_index("path", base, -1)
    out = files.select(F.lit(project_id).alias("project_id"), below.alias("path"), F.col("length").alias("size"),
                       (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.lit(None).cast("string").alias("hash"))
    return out if hidden else out.where(~F.col("path").rlike(r"(^|/)\."))


def file_content(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """(project_id, path, content) of the same files, for hashing those whose hash is not known."""
    base = root.rstrip("/") + "/"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.lit(project_id).alias("project_id"), F.substring_index("path", base, -1).alias("path"), "content")
