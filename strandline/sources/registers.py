"""Tab-separated registers with a header line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the registers.
COLUMNS = {
    "assets": ["key", "label", "source", "file"],
    "evidence": ["id", "target", "page", "where", "quote", "claim", "note"],
    "index": ["key", "file", "doi", "year"],
    "evidence_gaps": ["file", "anchor", "kind", "claim", "note", "cause"],
}


def read_register(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trimmed cells, missing ones empty; rows without any text are dropped, a byte order mark is ignored."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    names = [c.strip().lstrip("﻿") for c in raw.columns]
    cells = [F.trim(F.coalesce(F.col(f"`{old}`"), F.lit(""))).alias(new) for old, new in zip(raw.columns, names) if new]
    rows = raw.select(*cells)
    return rows.where(reduce(Column.__or__, [F.col(f"`{c}`") != "" for c in rows.columns]))


def write_register(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write the named columns (missing ones empty, others left out)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    rows.select(*cells).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
