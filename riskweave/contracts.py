"""Guards that stop a job instead of letting bad data through.

Row-level conditions are checked with one aggregate over the data: every guard
is a named ``count_if`` and the first that counts anything raises.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns, what: str, *, exact: bool = False) -> None:
    """Raise unless ``df`` has ``columns`` (and, with ``exact``, no others)."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    unexpected = sorted(set(df.columns) - set(columns))
    if exact and unexpected:
        raise ValueError(f"{what} has unexpected columns: {', '.join(unexpected)}")


def require_none(df: DataFrame, violations: dict[str, Column]) -> None:
    """Raise with the message of the first violation that any row shows."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"v{i}") for i, c in enumerate(violations.values()))).first()
    for i, message in enumerate(violations):
        if counts[f"v{i}"]:
            raise ValueError(f"{message} ({counts[f'v{i}']} rows)")


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """Raise if a non-null key occurs twice."""
    if not df.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{what} must have unique values of {key}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{what} must have at least one row")


def require_utc(moment: datetime) -> datetime:
    """A timestamp with offset 0."""
    if moment.tzinfo is None or moment.utcoffset() != timedelta(0):
        raise ValueError("the timestamp must be timezone-aware and in UTC")
    return moment


def require_aware(moment: datetime, what: str) -> datetime:
    """A timestamp with any offset."""
    if moment.tzinfo is None or moment.utcoffset() is None:
        raise ValueError(f"{what} must be timezone-aware")
    return moment


def require_text(value: str, what: str) -> str:
    """A string that is not blank, trimmed."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()


def require_positive(value: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{what} must be greater than zero")
    return value


def require_row_number(value: object) -> int:
    """A non-negative integer that is not a boolean."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError("source_row_number must be a non-negative integer")
    return value


def finite(column: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
