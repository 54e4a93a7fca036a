"""Rows behind the watermark: a side table, and versions that are right again after them.

`split_late` cuts each micro-batch at the watermark before anything else sees it: rows on time and late rows go to tables of their
own, a folder per micro-batch. Streams with state (`keyed.version_stream`) read the table of rows on time. `corrected_versions`
replaces the numbers of artifacts that had a late row by those of the batch operator over all their snapshots; the others keep what
the stream gave them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.versions import assign_versions
from strandline.plans import cut, path_exists

NODE = ["project_id", "node_id"]
PARTS = 64  # an artifact lies in one of so many folders, so that a repair reads few of them
SNAPSHOT = "project_id STRING, node_id STRING, ts TIMESTAMP, seq BIGINT, hash STRING"


def _finished(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def _write_once(df: DataFrame, path: str, by: str | None = None) -> None:
    """What a micro-batch writes is settled once it is there: repeating the micro-batch leaves it alone, so a stream that
    already read the files sees nothing twice."""
    if not _finished(df.sparkSession, path):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)


def _rows(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """What the micro-batches up to `upto` wrote below `path`."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema + ", batch BIGINT")
    rows = spark.read.schema(schema + ", batch BIGINT").parquet(path)
    return rows if upto is None else rows.where(F.col("batch") <= upto)


def split_late(path: str, delay_seconds: int = 0, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows that are `delay_seconds` or more behind the largest time of earlier micro-batches go to
    `path`/late, the others to `path`/on_time, both in folders batch=n.

    The largest time is kept in `path`/clock, one row per micro-batch: a micro-batch asks the rows of those before it, so repeating it
    splits it as before. Rows without a time are on time.
    """
    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _rows(spark, f"{path}/clock", "newest TIMESTAMP", n - 1).agg(F.max("newest")).first()[0]
        late = F.lit(False) if before is None else F.coalesce(
            F.col(ts) + F.make_dt_interval(secs=F.lit(delay_seconds)) < F.lit(before), F.lit(False))
        kept = batch.withColumn("part", F.pmod(F.xxhash64(*NODE), F.lit(PARTS))) if set(NODE) <= set(batch.columns) else batch.withColumn("part", F.lit(0))
        _write_once(kept.where(~late), f"{path}/on_time/batch={n}", "part")
        _write_once(kept.where(late), f"{path}/late/batch={n}", "part")
        _write_once(batch.agg(F.max(ts).alias("newest")), f"{path}/clock/batch={n}")

    return run


def on_time_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows on time, as a stream for the operators with state; one micro-batch of the split at a time at most."""
    known = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.readStream.schema(known).option("maxFilesPerTrigger", PARTS).parquet(f"{path}/on_time/batch=*/part=*")


def late_rows(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """The side table."""
    return _rows(spark, f"{path}/late", schema + ", part INT").drop("part")


def repair_versions(path: str, slice_by: Column) -> Callable[[DataFrame, int], None]:
    """foreachBatch beside `split_late` on the same stream of snapshots, after it: number the artifacts anew that have rows in this
    micro-batch and had a late one now or earlier.

    Only the folders that hold such artifacts are read. The whole history of each goes to `path`/repaired/batch=n; the newest folder
    with an artifact counts, so repeating a micro-batch replaces its own rows by equal ones.
    """
    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        parted = SNAPSHOT + ", part INT"
        late = _rows(spark, f"{path}/late", parted, n)
        touched, seen = cut(batch.select(*NODE).distinct().join(late.select(*NODE, "part").distinct(), NODE), "touched")
        if not seen["rows"]:
            return
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # PARTS numbers at most
        history = _rows(spark, f"{path}/on_time", parted, n).unionByName(late).where(F.col("part").isin(parts))
        mine = history.join(touched.select(*NODE), NODE, "left_semi").select(*NODE, "ts", "seq", "hash")
        assign_versions(mine, slice_by).select(*NODE, "v", "ts", "seq", "hash").write.mode("overwrite").parquet(f"{path}/repaired/batch={n}")

    return run


def corrected_versions(streamed: DataFrame, path: str) -> DataFrame:
    """(node_id, v, ts, seq, hash): the versions that the stream gave, and for artifacts with late rows the newest repair."""
    repaired = _rows(streamed.sparkSession, f"{path}/repaired", "project_id STRING, node_id STRING, v INT, ts TIMESTAMP, seq BIGINT, hash STRING")
    newest = repaired.groupBy(*NODE).agg(F.max("batch").alias("batch"))
    columns = [*NODE, "v", "ts", "seq", "hash"]
    return (streamed.select(*columns).join(newest.select(*NODE), NODE, "left_anti")
            .unionByName(repaired.join(newest, [*NODE, "batch"]).select(*columns)))
