"""Intermediate tables and files in the folder that the whole cluster shares.

Executors can be lost at any time, so the operators cut long lineages with
tables written here rather than with copies kept on executors. The folder is
the one named by ``spark.checkpoint.dir``; only a local session without that
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def enough(df: DataFrame, per_core: int, part_bytes: int = 32 << 20) -> int:
    """Partitions for rows made from what ``df`` reads: ``per_core`` a core, and more where the inputs are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(8, per_core * cores(df), min(size // part_bytes, 1 << 20))


def compact(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Fewer partitions, without a shuffle, so that results come in fewer files.

    The stage that makes the rows runs in as few tasks, so it must be a light
    one, behind a shuffle of its own, and must not use its partition number.
    """
    return df.coalesce(enough(df, per_core))


def gather(df: DataFrame, per_core: int = 2) -> DataFrame:
    """The same for narrow rows of a heavy stage: they are shuffled, and the stage keeps its tasks."""
    return df.repartition(enough(df, per_core))


class Workspace:
    """A folder of one operator's run; removed when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = f"{shared_dir(spark)}/riskweave-{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        df.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.uri}/{name}")

    def narrow_table(self, name: str, df: DataFrame) -> DataFrame:
        """``table`` for rows of a few numbers from a light stage, in fewer files."""
        return self.table(name, compact(df))

    def gathered_table(self, name: str, df: DataFrame) -> DataFrame:
        """``table`` for rows of a few numbers from a heavy stage, in fewer files."""
        return self.table(name, gather(df))

    def folder(self, name: str) -> str:
        """A folder for files that tasks write themselves."""
        self._fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}"))
        return f"{self.uri}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}"), True)
