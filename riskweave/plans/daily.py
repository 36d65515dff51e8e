"""The daily batch: source files to Bronze, Silver and Gold."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..contracts import require_aware
from ..operators.bronze import ingest_bronze
from ..operators.gold import write_gold
from ..operators.gold_days import continue_gold
from ..operators.silver import ingest_silver
from ..sources.files import discover_daily_files, read_bronze, read_source_pickles


@dataclass(frozen=True)
class Folders:
    """Where the layers are."""

    bronze: str
    silver: str
    quarantine: str
    gold: str

    @classmethod
    def under(cls, root: str) -> Folders:
        root = root.rstrip("/")
        return cls(f"{root}/bronze", f"{root}/silver", f"{root}/quarantine", f"{root}/gold")


@dataclass(frozen=True)
class DailyResult:
    bronze_days: list
    silver_days: list
    gold_tables: tuple[str, ...]


def run_daily(spark: SparkSession, source: str | DataFrame, root: str, ingested_at: datetime | None = None, *, incremental: bool = False) -> DailyResult:
    """Ingest what is new and rebuild Gold, or continue it by day with ``incremental``. ``source`` is a folder of pickles or rows with source_file and row_in_file."""
    moment = require_aware(ingested_at or datetime.now(timezone.utc), "the ingestion time").astimezone(timezone.utc)
    folders = Folders.under(root)
    if isinstance(source, str):
        discover_daily_files(source)
    rows = read_source_pickles(spark, source) if isinstance(source, str) else source
    bronze_days = ingest_bronze(rows, folders.bronze, moment)
    silver_days = ingest_silver(read_bronze(spark, folders.bronze), folders.silver, folders.quarantine)
    (continue_gold if incremental else write_gold)(spark, folders.silver, folders.gold)
    return DailyResult(bronze_days, silver_days, ("customer_daily_summary", "terminal_daily_summary", "transaction_features"))
