"""The validation rules, once, for batch and stream.

``Fields`` says how a mode reads its raw values; ``transaction_rules`` lists
(reason, condition) in the order in which reasons are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_VERSION, SOURCE_TO_SILVER
from .scalars import UUID_TEXT, any_true, finite_number, strict_integer, whole_number


@dataclass(frozen=True)
class Fields:
    """Raw and typed columns by Silver name. A typed column is null where the raw value does not parse."""

    raw: dict[str, Column]
    typed: dict[str, Column]
    file_date: Column

    def unparsed(self, name: str) -> Column:
        return self.raw[name].isNotNull() & self.typed[name].isNull()


def batch_types(raw: dict[str, Column]) -> dict[str, Column]:
    """Typed values of batch text: any spelling of a whole number is an integer."""
    typed = {}
    for name, kind in SOURCE_TO_SILVER.values():
        if kind == "timestamp":
            typed[name] = F.try_to_timestamp(raw[name])
        else:
            typed[name] = finite_number(raw[name]) if kind == "double" else whole_number(raw[name])
    return typed


def stream_types(raw: dict[str, Column]) -> dict[str, Column]:
    """Typed values of event text: integers are digits only and must fit their type."""
    typed = {}
    for name, kind in SOURCE_TO_SILVER.values():
        if kind == "timestamp":
            typed[name] = F.try_to_timestamp(raw[name])
        else:
            typed[name] = finite_number(raw[name]) if kind == "double" else strict_integer(raw[name], kind)
    return typed


def transaction_rules(f: Fields) -> list[tuple[str, Column]]:
    """What makes a transaction invalid, whatever way it came."""
    label, scenario = f.typed["tx_fraud"], f.typed["tx_fraud_scenario"]
    seconds, days = f.typed["tx_time_seconds"], f.typed["tx_time_days"]
    negative_id = [f.typed[n] < 0 for n in ("transaction_id", "customer_id", "terminal_id")]
    known_pair = label.isin(0, 1) & scenario.between(0, 3)
    return [
        ("missing_required_value", any_true(*(c.isNull() for c in f.raw.values()))),
        ("invalid_data_type", any_true(*(f.unparsed(n) for n in f.raw), *negative_id)),
        ("negative_transaction_amount", any_true(f.typed["tx_amount"] < 0)),
        ("invalid_fraud_label", any_true(~label.isin(0, 1))),
        ("invalid_fraud_scenario", any_true(~scenario.between(0, 3), known_pair & ((scenario > 0) != (label == 1)))),
        ("inconsistent_time_fields", any_true(seconds < 0, days < 0, days != F.floor(seconds / 86400))),
        ("source_date_mismatch", any_true(F.to_date(f.typed["tx_datetime"]) != f.file_date)),
    ]


def event_rules(key: Column, transaction_id: Column, produced_at: Column, file_date: Column) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """The rules on the envelope of valid JSON, and those on the message key."""
    names = ("schema_version", "event_id", "produced_at_utc", "source_file", "source_file_date", "source_row_number")
    present = {n: F.col(n) for n in names}
    envelope = [
        ("missing_event_metadata", any_true(key.isNull(), *(c.isNull() for c in present.values()))),
        (
            "invalid_event_metadata",
            any_true(
                ~present["event_id"].rlike(UUID_TEXT),
                present["produced_at_utc"].isNotNull() & produced_at.isNull(),
                present["source_file_date"].isNotNull() & file_date.isNull(),
                present["source_row_number"] < 0,
            ),
        ),
        ("unsupported_schema_version", any_true(present["schema_version"] != EVENT_VERSION)),
    ]
    return envelope, [("kafka_key_mismatch", any_true(key != transaction_id.cast("string")))]


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later steps use many times.

    The optimizer would copy their expressions into every use; a generator of
    one row keeps them apart, in batch and stream alike.
    """
    added = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.select("*", added).select(*df.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The reasons that hold, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(reason)) for reason, condition in rules)))
