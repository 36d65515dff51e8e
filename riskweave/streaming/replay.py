"""Replaying source rows as messages, in a fixed order and at a limited rate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..contracts import require_positive, require_text
from ..schemas import KAFKA
from ..sources import store
from ..sources.publish import write_json
from ..sources.store import scratch
from .events import build_messages


@dataclass(frozen=True)
class ReplayResult:
    messages: int
    batches: int


def numbered_messages(rows: DataFrame, produced_at: datetime, topic: str, *, partitions: int = 3, sequence: bool = False) -> DataFrame:
    """Kafka-shaped rows: each key has one partition, and offsets follow (file date, row) within it.

    Messages are range-sorted and written once; offsets follow from the counts
    of the ranges, so no key, day or partition is numbered in one task. With
    ``sequence``, a column of that name has the place among all messages.
    """
    require_positive(partitions, "partitions")
    messages = build_messages(rows, produced_at, topic)
    part = F.pmod(F.crc32(F.coalesce("key", F.lit(b""))), F.lit(partitions)).cast("int")
    order = ("source_file_date", "source_row_number")
    ranged = messages.withColumn("partition", part).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    path = f"{scratch(rows.sparkSession)}/messages"
    ranged.write.parquet(path)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_row", 33))
    counts = ranged.groupBy("_range", "partition").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = lambda w: w.orderBy("_r").rangeBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_range").alias("_r"), F.col("partition").alias("_p"), F.min("_first").over(Window.partitionBy("_range")).alias("_first"), "_n")
    before = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_p"))), F.lit(0)).alias("_before")
    all_before = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(F.lit(0)))), F.lit(0)).alias("_all_before")
    counts = counts.select("_r", "_p", "_first", before, all_before)  # a row a range and partition
    placed = ranged.withColumn("_in_range", F.row_number().over(Window.partitionBy("_range", "partition").orderBy("_row")))
    placed = placed.join(F.broadcast(counts), (F.col("_range") == F.col("_r")) & (F.col("partition") == F.col("_p")))
    stamped = placed.withColumn("offset", (F.col("_before") + F.col("_in_range") - 1).cast("bigint")).withColumn("timestamp", F.to_timestamp(F.lit(produced_at.strftime("%Y-%m-%d %H:%M:%S.%f"))))
    return stamped.select(*KAFKA.names, *([(F.col("_row") - F.col("_first") + F.col("_all_before")).alias("sequence")] if sequence else []))


@dataclass(frozen=True)
class ReplayLog:
    """Numbered messages in segments of equal numbers of events, in sending order."""

    folder: str
    events: int
    segment_events: int

    def between(self, spark: SparkSession, first: int, end: int) -> DataFrame:
        """Messages of the places from ``first`` to before ``end``; other segments are not read."""
        log = spark.read.schema(LOG).parquet(f"{self.folder}/segments")
        segments = F.col("segment").between(first // self.segment_events, max(first, end - 1) // self.segment_events)
        return log.filter(segments & (F.col("sequence") >= first) & (F.col("sequence") < end)).select(*KAFKA.names)


#: A segment's rows.
LOG = T.StructType([*KAFKA.fields, T.StructField("sequence", T.LongType()), T.StructField("segment", T.LongType())])


def write_log(rows: DataFrame, folder: str, *, produced_at: datetime, topic: str, partitions: int = 3, segment_events: int = 100_000) -> ReplayLog:
    """Number the messages of ``rows`` and write them as a log that can be replayed from any place; the description comes last."""
    require_positive(segment_events, "segment_events")
    if store.exists(f"{folder}/{DESCRIPTION}"):
        raise FileExistsError(f"{folder} holds a log already")
    messages = numbered_messages(rows, produced_at, require_text(topic, "topic"), partitions=partitions, sequence=True)
    messages = messages.withColumn("segment", F.floor(F.col("sequence") / segment_events))
    messages.repartition("segment").sortWithinPartitions("segment", "sequence").write.mode("overwrite").partitionBy("segment").parquet(f"{folder}/segments")
    spark = rows.sparkSession
    log = ReplayLog(str(folder), spark.read.schema(LOG).parquet(f"{folder}/segments").count(), segment_events)
    write_json(f"{folder}/{DESCRIPTION}", {"events": log.events, "segment_events": segment_events})
    return log


DESCRIPTION = "log.json"


def open_log(folder: str) -> ReplayLog:
    if not store.is_file(f"{folder}/{DESCRIPTION}"):
        raise FileNotFoundError(f"no finished log in {folder}")
    return ReplayLog(str(folder), **json.loads(store.read_text(f"{folder}/{DESCRIPTION}")))


def replay(rows: DataFrame, write: Callable[[DataFrame], None], *, produced_at: datetime, topic: str, events_per_second: float = 100.0, max_events: int | None = None, batch_events: int = 10_000, partitions: int = 3, clock=time.monotonic, sleep=time.sleep) -> ReplayResult:
    """Hand messages to ``write`` in order, one DataFrame per batch, on an absolute schedule.

    ``write`` gets Kafka-shaped rows: ``kafka_writer`` sends them to a topic,
    ``file_writer`` appends files for the file-backed source. The source is read
    and numbered once, into a log whose segments the batches are; offsets are
    unique in a partition and follow each other over all batches. A rate of 0
    means no waiting.
    """
    require_text(topic, "topic")
    require_positive(batch_events, "batch_events")
    if events_per_second < 0:
        raise ValueError("events_per_second must not be negative")
    if max_events is not None:
        require_positive(max_events, "max_events")
    if events_per_second == 0 and max_events is None:
        write(numbered_messages(rows, produced_at, topic, partitions=partitions))
        return ReplayResult(rows.count(), 1)
    log = write_log(rows, scratch(rows.sparkSession), produced_at=produced_at, topic=topic, partitions=partitions, segment_events=max(batch_events, 10_000))
    total = log.events if max_events is None else min(log.events, max_events)
    sent, batches, due = 0, 0, clock()
    while sent < total:
        n = min(batch_events, total - sent)
        if events_per_second:
            if (wait := due - clock()) > 0:
                sleep(wait)
            due += n / events_per_second
        write(log.between(rows.sparkSession, sent, sent + n))
        sent, batches = sent + n, batches + 1
    return ReplayResult(sent, batches)


class ReplayPartition(InputPartition):
    """Places [first, end) of one segment."""

    def __init__(self, segment: int, first: int, end: int):
        super().__init__(segment)
        self.segment, self.first, self.end = segment, first, end


class ReplaySource(DataSource):
    """A log of messages as a stream that grows at a rate.

    Options: ``folder``, ``events`` and ``segmentEvents`` of the log;
    ``eventsPerSecond`` (0: all at once), ``maxEvents``, ``batchEvents`` (0: no
    limit), ``startedAt`` (seconds since 1970, when the first event is due) and
    ``progress``, a file beside the query's checkpoint that has how far batches
    were planned.
    """

    @classmethod
    def name(cls) -> str:
        return "riskweave_replay"

    def schema(self) -> T.StructType:
        return KAFKA

    def streamReader(self, schema: T.StructType) -> ReplayReader:
        return ReplayReader(self.options)


class ReplayReader(DataSourceStreamReader):
    """Plans ranges of the log; its offset is the number of events sent.

    The schedule is absolute: event i is due i / rate seconds after the start,
    also over restarts. A batch ends at what is due, at the limit of events, or
    ``batchEvents`` after the batch planned before it. Where a stopped query
    left off is read from ``progress``, which is written when a batch is
    planned, that is after Spark has logged its end and before its rows are read.
    """

    def __init__(self, options):
        number = lambda name, default=0: int(options.get(name, default))
        self.folder, self.segment_events = options["folder"], number("segmentEvents")
        self.total = min(number("events"), number("maxEvents", 1 << 62))
        self.rate, self.started, self.batch = float(options.get("eventsPerSecond", 0)), float(options.get("startedAt", 0)), number("batchEvents")
        self.progress = options["progress"]
        self.planned = None

    def _planned(self) -> int:
        if self.planned is None:
            fs, path = _located(self.progress)
            self.planned = json.loads(fs.open_input_file(path).read())["sent"] if fs.get_file_info(path).is_file else 0
        return self.planned

    def initialOffset(self) -> dict:
        return {"sent": 0}

    def latestOffset(self) -> dict:
        due = self.total if not self.rate else min(self.total, max(0, int((time.time() - self.started) * self.rate) + 1))
        last = self._planned()
        return {"sent": max(last, min(due, last + self.batch) if self.batch else due)}

    def partitions(self, start: dict, end: dict) -> list[ReplayPartition]:
        first, end, size = start["sent"], end["sent"], self.segment_events
        if end != self.planned:
            fs, path = _located(self.progress)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(json.dumps({"sent": end}).encode())
            self.planned = end
        if first >= end:
            return []
        return [ReplayPartition(k, max(first, k * size), min(end, (k + 1) * size)) for k in range(first // size, (end - 1) // size + 1)]

    def read(self, partition: ReplayPartition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        fs, path = _located(f"{self.folder}/segments/segment={partition.segment}")
        place = ds.field("sequence")
        found = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=[*KAFKA.names, "sequence"], filter=(place >= partition.first) & (place < partition.end)).sort_by("sequence")
        found = found.set_column(found.schema.get_field_index("timestamp"), "timestamp", pc.cast(found["timestamp"], pa.timestamp("us", "UTC")))
        yield from found.select(KAFKA.names).to_batches(max_chunksize=10_000)


def _located(uri: str):
    """The file system and path that tasks open ``uri`` with."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def replayed_messages(log: ReplayLog, spark: SparkSession, *, progress: str, events_per_second: float = 100.0, max_events: int | None = None, batch_events: int | None = None, started_at: float | None = None) -> DataFrame:
    """The messages of a log as a stream; ``progress`` names a file of this query beside its checkpoint."""
    if events_per_second < 0:
        raise ValueError("events_per_second must not be negative")
    for name, value in (("max_events", max_events), ("batch_events", batch_events)):
        if value is not None:
            require_positive(value, name)
    options = {"folder": log.folder, "events": log.events, "segmentEvents": log.segment_events, "eventsPerSecond": events_per_second, "startedAt": time.time() if started_at is None else started_at, "progress": require_text(progress, "progress")}
    options |= {k: v for k, v in (("maxEvents", max_events), ("batchEvents", batch_events)) if v is not None}
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format(ReplaySource.name()).options(**{k: str(v) for k, v in options.items()}).load()


def kafka_writer(servers: str, topic: str) -> Callable[[DataFrame], None]:
    """Send messages to a topic with an idempotent producer that waits for all replicas."""
    options = {"kafka.bootstrap.servers": require_text(servers, "servers"), "topic": require_text(topic, "topic"), "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.delivery.timeout.ms": "30000"}
    return lambda df: df.select("key", "value").write.format("kafka").options(**options).save()


def file_writer(path: str) -> Callable[[DataFrame], None]:
    """Append messages to a folder of Kafka-shaped files."""
    return lambda df: df.write.mode("append").parquet(path)
