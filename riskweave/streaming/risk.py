"""Hourly risk windows per customer and per terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import require_text
from .ingest import DEFAULT_TRIGGER, StreamPaths, start_queries

DEFAULT_WINDOW = "1 hour"
DEFAULT_WATERMARK = "10 minutes"
DISTINCT_ERROR = 0.05  # fixed value, as are the column names below, which readers of the table expect
DISTINCT_BITS = 12  # of a sketch's registers: their deviation is below 0.02, and up to 384 values are kept as hashes


def risk_windows(transactions: DataFrame, entity: str, *, window: str = DEFAULT_WINDOW, watermark: str | None = DEFAULT_WATERMARK, exact_distinct: bool = False) -> DataFrame:
    """Tumbling windows of one entity's activity; no label is read.

    Streams need the watermark and count the other side approximately, under
    the name that readers of the published table expect, with a deviation of
    DISTINCT_ERROR at most; ``exact_distinct`` is for batch only and names its
    column ``distinct_*_count``. The 512 registers that suffice for that error
    are too few for small windows: of many with nine values, some are off by 3.
    """
    other = {"customer": "terminal", "terminal": "customer"}[entity]
    rows = transactions.withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark("tx_datetime", require_text(watermark, "the watermark"))
    distinct = F.count_distinct(f"{other}_id") if exact_distinct else F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"{other}_id"), F.lit(DISTINCT_BITS)))
    grouped = rows.groupBy(F.window("tx_datetime", require_text(window, "the window")), F.col(f"{entity}_id")).agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("tx_amount").alias("total_amount"),
        F.avg("tx_amount").alias("average_amount"),
        F.max("tx_amount").alias("maximum_amount"),
        distinct.cast("bigint").alias(f"distinct_{other}_count" if exact_distinct else f"approx_unique_{other}s"),
        F.sum(F.when(F.hour("tx_datetime").between(0, 5), 1).otherwise(0)).cast("bigint").alias("night_transaction_count"),
    )
    start_end = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return grouped.select(*start_end, *(c for c in grouped.columns if c != "window"))


def risk_frames(silver: DataFrame, *, window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK) -> dict[str, DataFrame]:
    return {f"{e}_risk_windows": risk_windows(silver, e, window=window, watermark=watermark) for e in ("customer", "terminal")}


def start_risk(silver: DataFrame, paths: StreamPaths, *, window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK, trigger: str | None = DEFAULT_TRIGGER) -> dict[str, StreamingQuery]:
    return start_queries(risk_frames(silver, window=window, watermark=watermark), paths, prefix="risk", trigger=trigger)
