"""Silver: typed, valid, unique transactions; everything else goes to quarantine with its reasons."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..contracts import require_columns
from ..functions.rules import Fields, batch_types, evaluate_once, reasons, transaction_rules
from ..schemas import BRONZE, METADATA, SILVER, SOURCE_TO_SILVER
from ..sources.publish import exists, loaded_dates
from ..sources.store import scratch
from .known_ids import build_filters, filters_path, known_ids

def place() -> Column:
    """Where a row stands in the order of file date and row number, as one decimal that hash aggregation can hold."""
    day = F.unix_date("source_file_date").cast("decimal(10,0)")
    return day * F.lit(Decimal(10**19)) + F.col("source_row_number").cast("decimal(19,0)")


@dataclass(frozen=True)
class SilverResult:
    """Accepted rows and rejected rows, both lazy."""

    silver: DataFrame
    quarantine: DataFrame


def metadata_violations() -> dict[str, Column]:
    """What Bronze metadata must not be, by message; it is an error of the job, not of a row."""
    return {
        "Bronze metadata must not be missing": F.greatest(*(F.col(c).isNull() for c in METADATA)),
        "Bronze row numbers must not be negative": F.col("source_row_number") < 0,
    }


def apply_rules(bronze: DataFrame) -> DataFrame:
    """Bronze rows with the typed columns under ``typed``, the ``reasons`` of the row's own values, and ``valid_id`` if there are none."""
    fields = Fields({n: F.col(c) for c, (n, _) in SOURCE_TO_SILVER.items()}, batch_types({n: F.col(c) for c, (n, _) in SOURCE_TO_SILVER.items()}), F.col("source_file_date"))
    once = evaluate_once(bronze.select(*BRONZE.names), {f"_{n}": c for n, c in fields.typed.items()})
    fields = Fields(fields.raw, {n: F.col(f"_{n}") for n in fields.typed}, fields.file_date)
    typed = F.struct(*(F.col(f"_{n}").alias(n) for n in fields.typed))
    judged = evaluate_once(once.select(*BRONZE.names, typed.alias("typed"), *fields.typed.values()), {"reasons": reasons(transaction_rules(fields))})
    return judged.select(*BRONZE.names, "typed", "reasons", F.when(F.size("reasons") == 0, F.col("typed.transaction_id")).alias("valid_id"))


def apply_rules_once(bronze: DataFrame) -> DataFrame:
    """``apply_rules``, written to the shared folder; metadata is checked by metrics observed in the same pass."""
    require_columns(bronze, BRONZE.names, "Bronze data")
    rules, spark = metadata_violations(), bronze.sparkSession
    seen = Observation()
    counted = bronze.select(*BRONZE.names).observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"v{i}") for i, c in enumerate(rules.values())))
    judged, place = apply_rules(counted), f"{scratch(spark)}/judged"
    judged.write.parquet(place)
    for i, message in enumerate(rules):
        if n := seen.get[f"v{i}"]:
            raise ValueError(f"{message} ({n} rows)")
    return spark.read.schema(judged.schema).parquet(place)


def mark_duplicates(judged: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """Judged rows with ``rejection_reasons``: their own, and whether they repeat an id.

    Duplicates are looked for among rows that are valid otherwise: the first in
    the order of date and row stays, unless its id is known already. The first
    of each id is a grouped minimum that is joined back, so that a hot id costs
    one aggregate row and a split join instead of a window in one task.
    """
    firsts = judged.filter("valid_id is not null").groupBy(F.col("valid_id").alias("first_id")).agg(F.min(place()).alias("first_place"))
    judged = judged.join(firsts, F.col("valid_id") == F.col("first_id"), "left")
    duplicate = F.col("first_place").isNotNull() & (F.col("first_place") != place())
    if known_ids is not None:
        known = known_ids.select(F.col("transaction_id").alias("known_id")).distinct()
        judged = judged.join(known, F.col("valid_id") == F.col("known_id"), "left")
        duplicate = duplicate | F.col("known_id").isNotNull()
    all_reasons = F.concat("reasons", F.when(duplicate, F.array(F.lit("duplicate_transaction_id"))).otherwise(F.array().cast("array<string>")))
    return judged.select(*BRONZE.names, "typed", all_reasons.alias("rejection_reasons"))


def judge(bronze: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """Bronze rows with the typed columns under ``typed`` and ``rejection_reasons``; rules are evaluated in one pass."""
    return mark_duplicates(apply_rules_once(bronze), known_ids)


def validate_bronze(bronze: DataFrame, known_ids: DataFrame | None = None) -> SilverResult:
    """Split Bronze into Silver and quarantine."""
    return split_judged(judge(bronze, known_ids))


def split_judged(judged: DataFrame) -> SilverResult:
    """Accepted and rejected rows of judged Bronze."""
    accepted = judged.filter(F.size("rejection_reasons") == 0)
    silver = accepted.select(*(F.col(f"typed.{n}").cast(kind).alias(n) for n, kind in SOURCE_TO_SILVER.values()), *METADATA)
    return SilverResult(silver.select(*SILVER.names), judged.filter(F.size("rejection_reasons") > 0).select(*BRONZE.names, "rejection_reasons"))


def ingest_silver(bronze: DataFrame, silver_path: str, quarantine_path: str) -> list:
    """Validate the days that are not in Silver yet and write them; returns the days.

    Quarantine is written first, then Silver, and a marker table of finished
    days last. A day without a marker is computed again and replaced, whatever
    an interrupted run left of it; a finished day without its quarantine is an
    error. A filter of each day's ids is written before its marker. All new days are one job, and ids of finished days win over new ones
    whatever their date.
    """
    if silver_path.rstrip("/") == quarantine_path.rstrip("/"):
        raise ValueError("Silver and quarantine need different folders")
    spark = bronze.sparkSession
    days = bronze.select("source_file_date").distinct()
    silver_days = f"{silver_path.rstrip('/')}-days"
    done = loaded_dates(spark, silver_days)
    has_silver = exists(spark, silver_path) and not done.isEmpty()
    quarantine_days = f"{quarantine_path.rstrip('/')}-days"
    closed = loaded_dates(spark, quarantine_days)
    if not done.join(closed, "source_file_date", "left_anti").isEmpty():
        raise RuntimeError("Silver holds days whose quarantine is missing")
    new = [r[0] for r in days.join(done, "source_file_date", "left_anti").orderBy("source_file_date").collect()]
    if not new:
        return []
    fresh = bronze.join(F.broadcast(spark.createDataFrame([(d,) for d in new], "source_file_date date")), "source_file_date", "left_semi").select(*BRONZE.names)
    judged = apply_rules_once(fresh)
    known = None
    if has_silver:
        known = known_ids(spark, judged.filter("valid_id is not null").select(F.col("valid_id").alias("transaction_id")).distinct(), silver_path, done)
    judged = mark_duplicates(judged, known).persist(StorageLevel.DISK_ONLY)
    try:
        _write_days(split_judged(judged), new, silver_path, quarantine_path, quarantine_days, silver_days)
    finally:
        judged.unpersist()
    return new


def _write_days(result: SilverResult, new: list, silver_path: str, quarantine_path: str, quarantine_days: str, silver_days: str) -> None:
    spark = result.silver.sparkSession
    marker = spark.createDataFrame([(d, True) for d in new], "source_file_date date, done boolean")
    for df, path in ((result.quarantine, quarantine_path), (marker, quarantine_days), (result.silver, silver_path)):
        _overwrite_days(df, path)
    written = spark.read.schema(SILVER).parquet(silver_path) if exists(spark, silver_path) else result.silver
    written = written.filter(F.col("source_file_date").isin(new)).select("transaction_id", "source_file_date")
    _overwrite_days(build_filters(written), filters_path(silver_path))
    _overwrite_days(marker, silver_days)


def _overwrite_days(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file_date").parquet(path)
