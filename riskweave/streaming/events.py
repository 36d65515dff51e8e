"""Event envelopes: building them from source rows, and reading them from messages.

All functions work on batch and streaming DataFrames alike, except
``deduplicate``, which needs a stream.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require_columns, require_text, require_utc
from ..functions.rules import Fields, evaluate_once, event_rules, reasons, stream_types, transaction_rules
from ..functions.scalars import event_id, message_key, source_text
from ..schemas import EVENT, EVENT_VERSION, SILVER_NAMES, SOURCE_COLUMNS, SOURCE_TO_SILVER, STREAM_METADATA

DEFAULT_WATERMARK = "1 day"


def build_messages(rows: DataFrame, produced_at: datetime, topic: str) -> DataFrame:
    """Messages (key, value, topic) of source rows that carry source_file, source_file_date and source_row_number.

    The value is JSON with sorted keys and without white space; nulls are kept.
    """
    topic = require_text(topic, "topic")
    require_columns(rows, [*SOURCE_COLUMNS, "source_file", "source_file_date", "source_row_number"], "Source rows")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    moment = require_utc(produced_at).strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".") + "Z"
    envelope = {
        "event_id": event_id(F.col("source_file"), F.col("source_row_number")),
        "produced_at_utc": F.lit(moment),
        "schema_version": F.lit(EVENT_VERSION),
        "source_file": F.col("source_file"),
        "source_file_date": F.col("source_file_date").cast("string"),
        "source_row_number": F.col("source_row_number").cast("bigint"),
        "transaction": F.struct(*(source_text(F.col(c), kinds[c]).alias(c) for c in sorted(SOURCE_COLUMNS))),
    }
    value = F.to_json(F.struct(*(envelope[k].alias(k) for k in sorted(envelope))), {"ignoreNullFields": "false"})
    key = message_key(F.col("TRANSACTION_ID"), kinds["TRANSACTION_ID"])
    return rows.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(topic).alias("topic"), "source_file_date", "source_row_number")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Kafka-shaped rows with decoded key and value, the parsed envelope under ``event`` and whether the value is JSON at all."""
    text = messages.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("raw_event"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
    )
    return evaluate_once(text, {"event": F.from_json("raw_event", EVENT), "valid_json": F.get_json_object("raw_event", "$").isNotNull()})


def flatten_events(parsed: DataFrame) -> DataFrame:
    """The envelope as columns: transaction fields under their source names, metadata beside them."""
    metadata = [F.col(f"event.{f.name}").alias(f.name) for f in EVENT.fields if f.name != "transaction"]
    kept = [c for c in parsed.columns if c != "event"]
    return parsed.select(*kept, *metadata, *(F.col(f"event.transaction.{c}").alias(c) for c in SOURCE_COLUMNS))


def type_events(flat: DataFrame) -> DataFrame:
    """Raw values renamed to ``raw_*``, typed ones under their Silver names."""
    raw = {silver: F.col(source) for source, (silver, _) in SOURCE_TO_SILVER.items()}
    kept = [c for c in flat.columns if c not in SOURCE_COLUMNS]
    renamed = flat.select(*kept, *(column.alias(f"raw_{name}") for name, column in raw.items()))
    typed = stream_types({name: F.col(f"raw_{name}") for name in raw})
    return evaluate_once(renamed, {**typed, "produced_at": F.try_to_timestamp("produced_at_utc"), "source_date": F.col("source_file_date").try_cast("date")})


def judge_events(typed: DataFrame) -> DataFrame:
    """Adds rejection_reasons and is_valid. All rules but the first hold for valid JSON only."""
    fields = Fields({n: F.col(f"raw_{n}") for n in SILVER_NAMES}, {n: F.col(n) for n in SILVER_NAMES}, F.col("source_date"))
    valid_json = F.col("valid_json")
    envelope, key_rules = event_rules(F.col("kafka_key"), F.col("transaction_id"), F.col("produced_at"), F.col("source_date"))
    rules = [("invalid_event_json", ~valid_json), *((r, valid_json & c) for r, c in [*envelope, *transaction_rules(fields), *key_rules])]
    return evaluate_once(typed, {"rejection_reasons": reasons(rules)}).withColumn("is_valid", F.size("rejection_reasons") == 0)


def judged_messages(messages: DataFrame) -> DataFrame:
    """From messages to typed events with their reasons."""
    return judge_events(type_events(flatten_events(parse_messages(messages))))


def deduplicate(valid: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """First event of each transaction id within the watermark; a stream only. Later ones are dropped."""
    return valid.withWatermark("tx_datetime", require_text(watermark, "the watermark")).dropDuplicatesWithinWatermark(["transaction_id"])


def bronze_events(parsed: DataFrame) -> DataFrame:
    """Messages as they came; the ingestion time is the message's."""
    names = ("kafka_key", "raw_event", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")
    return parsed.select(*names, F.col("kafka_timestamp").alias("ingested_at_utc"))


def silver_events(valid: DataFrame) -> DataFrame:
    """Typed transactions with their origin."""
    origin = {"source_file": F.col("source_file"), "source_file_date": F.col("source_date"), "source_row_number": F.col("source_row_number"), "ingested_at_utc": F.col("kafka_timestamp")}
    stream = {n: F.col("produced_at") if n == "produced_at_utc" else F.col(n) for n in STREAM_METADATA}
    return valid.select(*SILVER_NAMES, *(c.alias(n) for n, c in {**origin, **stream}.items()))


def quarantine_events(rejected: DataFrame) -> DataFrame:
    """Rejected events with their raw values and reasons."""
    raw = [F.col(f"raw_{silver}").alias(source) for source, (silver, _) in SOURCE_TO_SILVER.items()]
    names = ("schema_version", "event_id", "produced_at_utc", "kafka_key", "raw_event", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "rejection_reasons")
    return rejected.select(*raw, "source_file", "source_file_date", "source_row_number", F.col("kafka_timestamp").alias("ingested_at_utc"), *names)
