"""The ingestion stream: messages to Bronze, Silver and quarantine, and the lifecycle of its queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import require_positive, require_text
from ..schemas import KAFKA, STREAM_SILVER
from .events import DEFAULT_WATERMARK, bronze_events, deduplicate, judged_messages, parse_messages, quarantine_events, silver_events

DEFAULT_TRIGGER = "10 seconds"


def kafka_messages(spark: SparkSession, *, servers: str, topic: str, starting_offsets: str = "earliest") -> DataFrame:
    """Messages of one Kafka topic. Data loss is an error. Needs Spark's Kafka connector."""
    options = {
        "kafka.bootstrap.servers": require_text(servers, "servers"),
        "subscribe": require_text(topic, "topic"),
        "startingOffsets": require_text(starting_offsets, "starting offsets"),
        "failOnDataLoss": "true",
    }
    return spark.readStream.format("kafka").options(**options).load()


def file_messages(spark: SparkSession, path: str, *, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Messages from Kafka-shaped files in a folder, which is made if it is not there."""
    return _file_stream(spark, path, KAFKA, kind, max_files)


def silver_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """The Silver events that the ingestion stream has written."""
    return _file_stream(spark, path, STREAM_SILVER, "parquet", max_files)


def _file_stream(spark, path, schema, kind, max_files):
    place = spark._jvm.org.apache.hadoop.fs.Path(require_text(path, "path"))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    reader = spark.readStream.schema(schema).format(kind)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", require_positive(max_files, "max_files"))
    return reader.load(path)


@dataclass(frozen=True)
class StreamPaths:
    """Output and checkpoint folders of named queries; the two roots differ."""

    output: str
    checkpoints: str

    def __post_init__(self):
        if require_text(self.output, "output root").rstrip("/") == require_text(self.checkpoints, "checkpoint root").rstrip("/"):
            raise ValueError("output root and checkpoint root must differ")

    def table(self, name: str) -> str:
        return f"{self.output.rstrip('/')}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints.rstrip('/')}/{name}"


def ingestion_frames(messages: DataFrame, watermark: str = DEFAULT_WATERMARK) -> dict[str, DataFrame]:
    """The three outputs of the ingestion stream."""
    judged = judged_messages(messages)
    return {
        "bronze": bronze_events(parse_messages(messages)),
        "silver": silver_events(deduplicate(judged.filter("is_valid"), watermark)),
        "quarantine": quarantine_events(judged.filter(~F.col("is_valid"))),
    }


def start_queries(frames: dict[str, DataFrame], paths: StreamPaths, *, prefix: str, trigger: str | None = DEFAULT_TRIGGER) -> dict[str, StreamingQuery]:
    """Start an append query into Parquet per frame, each with its own checkpoint; ``trigger`` None means what is available now.

    If one does not start, those that did are stopped.
    """
    when = {"availableNow": True} if trigger is None else {"processingTime": require_text(trigger, "the trigger interval")}
    started: dict[str, StreamingQuery] = {}
    try:
        for name, frame in frames.items():
            writer = frame.writeStream.outputMode("append").queryName(f"{prefix}-{name}").format("parquet")
            started[name] = writer.option("path", paths.table(name)).option("checkpointLocation", paths.checkpoint(name)).trigger(**when).start()
    except Exception:
        stop_queries(started.values())
        raise
    return started


def stop_queries(queries) -> None:
    for query in queries:
        if query.isActive:
            query.stop()


def start_ingestion(messages: DataFrame, paths: StreamPaths, *, watermark: str = DEFAULT_WATERMARK, trigger: str | None = DEFAULT_TRIGGER) -> dict[str, StreamingQuery]:
    return start_queries(ingestion_frames(messages, watermark), paths, prefix="ingestion", trigger=trigger)


def run_until_done(spark: SparkSession, queries) -> None:
    """Wait for the first query that ends, and stop all of them whatever happens."""
    queries = list(queries)
    try:
        spark.streams.awaitAnyTermination()
    finally:
        stop_queries(queries)


def drain(queries) -> None:
    """Wait until every ``availableNow`` query has ended."""
    for query in queries:
        query.awaitTermination()
