"""The model dataset: a checked selection of Gold features and its chronological split."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require_aware, require_columns, require_none, require_rows, require_unique
from ..schemas import MODEL_COLUMNS, MODEL_FEATURES, MODEL_METADATA, MODEL_TARGET
from ..sources.publish import write_json

SPLITS = ("train", "validation", "test")
NULLABLE = ("customer_previous_mean_amount", "amount_to_customer_previous_mean")


def dataset_violations(df: DataFrame) -> dict[str, Column]:
    """What a row of the dataset must not be, by message."""
    col = F.col
    number = [c for c in MODEL_FEATURES if dict(df.dtypes)[c] in ("double", "float")]
    rules = {f"{c} must not be missing": col(c).isNull() for c in MODEL_COLUMNS if c not in NULLABLE}
    rules |= {f"{c} must be finite": F.isnan(c) | (F.abs(c) == float("inf")) for c in number}
    rules |= {f"{c} must be 0 or 1": ~col(c).isin(0, 1) for c in ("is_weekend", "is_night", MODEL_TARGET)}
    rules |= {
        "transaction_hour must be within 0..23": ~col("transaction_hour").between(0, 23),
        "day_of_week must be within 0..6": ~col("day_of_week").between(0, 6),
        "tx_amount must not be negative": col("tx_amount") < 0,
        "history counts must not be negative": (col("customer_previous_transaction_count") < 0) | (col("terminal_previous_transaction_count") < 0),
        # Gold has no ratio to a mean of 0
        "transactions with history need a previous mean and ratio": (col("customer_previous_transaction_count") > 0) & (col(NULLABLE[0]).isNull() | ((col(NULLABLE[0]) > 0) & col(NULLABLE[1]).isNull())),
        "transaction_date must be the UTC date of tx_datetime": col("transaction_date") != F.to_date("tx_datetime"),
    }
    return rules


def build_dataset(features: DataFrame) -> DataFrame:
    """The model columns of Gold features, in contract order, after all checks."""
    require_columns(features, MODEL_COLUMNS, "Gold features")
    df = features.select(*MODEL_COLUMNS)
    kinds = dict(df.dtypes)
    if text := [c for c in (*MODEL_FEATURES, MODEL_TARGET) if kinds[c] == "string"]:
        require_none(df, {f"{c} must be numeric": F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in text})
        df = df.withColumns({c: F.col(c).try_cast("double") for c in text})
    require_rows(df, "Gold features")
    require_none(df, dataset_violations(df))
    require_unique(df, "transaction_id", "Gold features")
    return df


def split_name(moment: Column, train_end: datetime, validation_end: datetime) -> Column:
    """train, validation or test, by half-open intervals of time."""
    start, end = (F.to_timestamp(F.lit(x.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"))) for x in (train_end, validation_end))
    return F.when(moment < start, SPLITS[0]).when(moment < end, SPLITS[1]).otherwise(SPLITS[2])


def split_dataset(df: DataFrame, train_end: datetime, validation_end: datetime) -> dict[str, DataFrame]:
    """Three chronological frames, none of which may be empty."""
    if require_aware(train_end, "train_end") >= require_aware(validation_end, "validation_end"):
        raise ValueError("train_end must be before validation_end")
    named = df.withColumn("_split", split_name(F.col("tx_datetime"), train_end, validation_end))
    found = {r[0] for r in named.select("_split").distinct().collect()}
    if missing := [s for s in SPLITS if s not in found]:
        raise ValueError(f"empty splits: {', '.join(missing)}")
    return {s: named.filter(F.col("_split") == s).drop("_split") for s in SPLITS}


def split_counts(df: DataFrame, train_end: datetime, validation_end: datetime) -> DataFrame:
    """Rows and frauds of each split."""
    named = df.withColumn("split", split_name(F.col("tx_datetime"), train_end, validation_end))
    return named.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(MODEL_TARGET).cast("bigint")).cast("bigint").alias("fraud_count"))


@dataclass(frozen=True)
class DatasetManifest:
    folder: str
    counts: dict[str, dict[str, int]]


def write_dataset(df: DataFrame, folder: str, train_end: datetime, validation_end: datetime, manifest_path: str) -> DatasetManifest:
    """Write the splits as partitions of one table in one job, then the manifest."""
    split_dataset(df, train_end, validation_end)
    named = df.withColumn("split", split_name(F.col("tx_datetime"), train_end, validation_end))
    named.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(folder)
    counts = {r["split"]: {"rows": r["row_count"], "frauds": r["fraud_count"]} for r in split_counts(df, train_end, validation_end).collect()}
    iso = lambda t: t.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    write_json(manifest_path, {
        "schema_version": 1,
        "metadata_columns": list(MODEL_METADATA),
        "feature_columns": list(MODEL_FEATURES),
        "target_column": MODEL_TARGET,
        "train_end": iso(train_end),
        "validation_end": iso(validation_end),
        "splits": counts,
    })
    return DatasetManifest(folder, counts)
