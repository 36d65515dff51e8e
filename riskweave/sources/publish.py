"""Sinks: idempotent daily partitions, staged tables, manifests that come last."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

POINTER = "_current.json"


def exists(spark: SparkSession, path: str) -> bool:
    return store.exists(path)


def loaded_dates(spark: SparkSession, path: str) -> DataFrame:
    """The source_file_date partitions of a table; empty if there is no table."""
    if not exists(spark, f"{path}/_SUCCESS") and not exists(spark, path):
        return spark.createDataFrame([], "source_file_date date")
    return spark.read.parquet(path).select("source_file_date").distinct()


def append_new_days(df: DataFrame, path: str) -> list:
    """Write the days that the table does not have yet; returns them in order.

    Days that are there stay untouched, so a second run writes nothing.
    """
    spark = df.sparkSession
    new = df.join(F.broadcast(loaded_dates(spark, path)), "source_file_date", "left_anti") if exists(spark, path) else df
    days = [r[0] for r in new.select("source_file_date").distinct().orderBy("source_file_date").collect()]
    if days:
        new.write.mode("append").partitionBy("source_file_date").parquet(path)
    return days


def publish_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write all tables as a new version, then point to it; readers see the old version until then.

    The version before stays for readers that have begun, older ones go.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    pointer = f"{root}/{POINTER}"
    before = json.loads(store.read_text(pointer)) if store.exists(pointer) else {}
    write_json(pointer, {"version": version, "before": before.get("version")})
    for old in store.children(f"{root}/versions"):
        if old not in (version, before.get("version")):
            store.delete(f"{root}/versions/{old}")


def table_path(root: str, name: str) -> str:
    """Where the current version of a published table is."""
    pointer = f"{root}/{POINTER}"
    return f"{root}/versions/{json.loads(store.read_text(pointer))['version']}/{name}" if store.exists(pointer) else f"{root}/{name}"


def write_json(path: str | Path, content: dict) -> str:
    """Write a manifest in one step, on whatever store the path names."""
    store.write_text(path, json.dumps(content, indent=2, sort_keys=True, allow_nan=False) + "\n")
    return str(path)
