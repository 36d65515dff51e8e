"""Table layouts. The names and types are the contract between stages."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType(), "bigint": T.LongType(), "tinyint": T.ByteType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def schema(text: str) -> T.StructType:
    """A schema from ``name type`` pairs separated by commas; needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in map(str.split, text.split(","))])


#: The nine columns of a source file and their Silver names and types.
SOURCE_TO_SILVER = {
    "TRANSACTION_ID": ("transaction_id", "bigint"),
    "TX_DATETIME": ("tx_datetime", "timestamp"),
    "CUSTOMER_ID": ("customer_id", "bigint"),
    "TERMINAL_ID": ("terminal_id", "bigint"),
    "TX_AMOUNT": ("tx_amount", "double"),
    "TX_TIME_SECONDS": ("tx_time_seconds", "bigint"),
    "TX_TIME_DAYS": ("tx_time_days", "bigint"),
    "TX_FRAUD": ("tx_fraud", "tinyint"),
    "TX_FRAUD_SCENARIO": ("tx_fraud_scenario", "tinyint"),
}
SOURCE_COLUMNS = tuple(SOURCE_TO_SILVER)
SILVER_NAMES = tuple(name for name, _ in SOURCE_TO_SILVER.values())
METADATA = {"source_file": "string", "source_file_date": "date", "source_row_number": "bigint", "ingested_at_utc": "timestamp"}

#: Raw values stay text until Silver has judged them.
SOURCE = schema(", ".join(f"{c} string" for c in SOURCE_COLUMNS))
BRONZE = schema(", ".join([*(f"{c} string" for c in SOURCE_COLUMNS), *(f"{c} {t}" for c, t in METADATA.items())]))
SILVER = schema(", ".join([*(f"{n} {t}" for n, t in SOURCE_TO_SILVER.values()), *(f"{c} {t}" for c, t in METADATA.items())]))
QUARANTINE = T.StructType([*BRONZE.fields, T.StructField("rejection_reasons", T.ArrayType(T.StringType()))])

#: Columns of the Gold feature table, after those of Silver.
FEATURE_COLUMNS = (
    "transaction_date",
    "transaction_hour",
    "day_of_week",
    "is_weekend",
    "is_night",
    "customer_previous_transaction_count",
    "customer_previous_mean_amount",
    "amount_to_customer_previous_mean",
    "terminal_previous_transaction_count",
)

#: The event envelope, in which every transaction field is text so that malformed values survive, and the tables of the stream.
EVENT = T.StructType([
    *schema("schema_version string, event_id string, produced_at_utc string, source_file string, source_file_date string, source_row_number bigint").fields,
    T.StructField("transaction", SOURCE),
])
EVENT_VERSION = "1.0"
KAFKA = schema("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")
STREAM_METADATA = ("schema_version", "event_id", "produced_at_utc", "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")
STREAM_BRONZE = schema("kafka_key string, raw_event string, kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, ingested_at_utc timestamp")
STREAM_SILVER = T.StructType([*SILVER.fields, *schema("schema_version string, event_id string, produced_at_utc timestamp, kafka_key string, kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp").fields])

#: What the model reads.
MODEL_METADATA = ("transaction_id", "tx_datetime", "transaction_date", "customer_id", "terminal_id", "source_file", "source_file_date", "source_row_number", "ingested_at_utc")
MODEL_FEATURES = (
    "tx_amount",
    "transaction_hour",
    "day_of_week",
    "is_weekend",
    "is_night",
    "customer_previous_transaction_count",
    "customer_previous_mean_amount",
    "amount_to_customer_previous_mean",
    "terminal_previous_transaction_count",
)
MODEL_TARGET = "tx_fraud"
MODEL_COLUMNS = (*MODEL_METADATA, *MODEL_FEATURES, MODEL_TARGET)
