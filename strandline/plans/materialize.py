"""Cut a plan by writing it as a table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FILE_TO_MEMORY = "16"
FEW_ROWS = 100_000
HASHED_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of the warehouse, which is shared too, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def measured_joins(spark: SparkSession) -> None:
    """Let joins follow sizes in memory, on the session.

    Files of ids hold a tenth or less of what their rows take in memory, so a table that looks small enough to broadcast may fill the
    driver: their sizes are multiplied before planning, and adaptive execution still broadcasts what it has measured to be small.
    It also hashes the shuffled side of a join, instead of sorting both sides, where every partition of it was measured to be no
    larger than the advisory size. Larger ones, such as those of hot keys, are sorted, which can spill. A hash table can't, and holds
    30 or more bytes for each byte that was shuffled, so the advisory size is at most `HASHED_BYTES`.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_TO_MEMORY)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    jvm = spark.sparkContext._jvm
    if jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advisory)) > HASHED_BYTES:
        spark.conf.set(advisory, str(HASHED_BYTES))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", spark.conf.get(advisory))


@contextmanager
def own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in here removes the shuffle files it made as soon as it ends. Else they fill the disks until the driver happens to
    collect its garbage: all steps of a question are there at once."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "cut", path: str | None = None, counts: dict | None = None, row_group: int | None = None,
        ends: str | None = None):
    """Write `df` once and read it back, so later steps start from files instead of its whole lineage.

    Row counts come from the same pass: `counts` names further boolean columns to count. `row_group` is the size in bytes of the
    pieces that a file can be read in; smaller ones than usual suit tables whose rows cost much work later. `ends` names a column
    whose least and greatest value are told too.
    Returns (table, {"rows": n, ...}).
    """
    spark = df.sparkSession
    measured_joins(spark)
    path = path or new_folder(spark, name)
    seen = Observation()
    marks = [F.count_if(cond).alias(key) for key, cond in (counts or {}).items()]
    if ends is not None:
        marks += [F.min(ends).alias("least"), F.max(ends).alias("greatest")]
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *marks).write.mode("overwrite")
    with own_shuffles_removed(spark):
        (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def few(rows: int) -> bool:
    """Can so many counted rows be sent to every task of a join, so that the far larger side stays where it is?"""
    return rows <= FEW_ROWS


def if_few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if few(rows) else df


def forget(*stored: DataFrame) -> None:
    """Remove the files of tables, as `cut` or `keyed` returned them, that no later step reads: not for what a lazy result still joins."""
    for table in stored:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def keyed(df: DataFrame, keys: list[str], name: str = "keyed", distinct: bool = False,
          then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write `df` once, bucketed by `keys`: joins and groupings by these keys read it without a shuffle, however often.

    For the side that every round of an iteration joins. `distinct` drops repeated rows in the same shuffle, `then` does any other
    work inside the keys in it, such as a grouping by them and more columns. A key's rows lie in one
    bucket, so a join reads them in one task, as a stream. A task writes one bucket, so its rows are not sorted by bucket first.
    The name is dropped at once; the files stay as those of `cut` do.
    """
    spark = df.sparkSession
    measured_joins(spark)
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "1")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"keyed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows = rows.distinct() if distinct else rows if then is None else then(rows)
    with own_shuffles_removed(spark):
        rows.write.bucketBy(buckets, *keys).format("parquet").option(
            "path", new_folder(spark, name)).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored
