"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results, so every session needs them.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}

#: Settings for throughput; a cluster's own values take precedence.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # candidates of a search that are fitted at the same time share the cores
    "spark.scheduler.mode": "FAIR",
    # a day of ids is kept on disk, not on the heap; checkpoints hold what changed
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def create_session(name: str, *, master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {}), **REQUIRED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
