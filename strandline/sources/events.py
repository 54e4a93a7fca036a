"""The append-only event log as JSON lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import EVENT


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All readable events; broken lines are left out, `corrupt_events` shows them."""
    return _all_lines(spark, path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def corrupt_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _all_lines(spark, path).where("_corrupt_record IS NOT NULL").select("_corrupt_record", "file", "offset")


def _all_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.text(path).where("trim(value) <> ''")
    parsed = text.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"),
                         F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
    return parsed.select("e.*", "file", "offset")


def event_stream(spark: SparkSession, path: str, delay: str = "10 minutes", files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream of events with a watermark on their time; late lines within `delay` still count."""
    reader = spark.readStream.schema(EVENT).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).where("_corrupt_record IS NULL").drop("_corrupt_record").withWatermark("ts", delay)


def append_events(events: DataFrame, path: str) -> None:
    """Append records as JSON lines; fields without a value are left out."""
    events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)
