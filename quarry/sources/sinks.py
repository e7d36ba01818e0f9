"""Sinks: partitioned Parquet with deterministic replacement, exports with a manifest, small text reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F


def path_token(value: str) -> str:
    """A value as part of a path: letters, digits, dots, dashes and underscores; nothing else."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", value).strip("_") or "none"


def write_partitioned(df: DataFrame, path: str, by: list[str], files_per_partition: int | None = None) -> None:
    """Replace the partitions that `df` has rows for, and no others.

    Rows are dealt by the partition columns, so that a partition has few files; with `files_per_partition` a hot partition
    is dealt over that many tasks.
    """
    if files_per_partition:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
        dealt = df.withColumn("__salt", salt).repartition(*by, "__salt").drop("__salt")
    else:
        dealt = df.repartition(*by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export(df: DataFrame, path: str, kind: str = "parquet") -> dict:
    """Write a table as Parquet, JSON lines or CSV and return its manifest."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "jsonl":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {kind}")
    spark = df.sparkSession
    reader = spark.read.schema(df.schema)
    back = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path) if kind == "jsonl" else reader.parquet(path)
    return {"path": path, "kind": kind, "rows": back.count(), "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]}


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a key, so that later joins and aggregations on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def manifest_json(manifest: dict) -> str:
    return json.dumps(manifest, sort_keys=True)
