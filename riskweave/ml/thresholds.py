"""Card-days, alert capacity and the choice of a policy."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require_columns, require_positive
from ..functions.scalars import next_after
from .metrics import confusion, require_scores

CAPACITY_SCOPE = "unique_customer_cards_per_day"


@dataclass(frozen=True)
class CardDayMetrics:
    threshold: float
    daily_card_capacity: int
    precision: float
    recall: float
    f1: float
    alerts: int
    mean_daily_card_alerts: float
    max_daily_card_alerts: int
    budget_exceeded_days: int

    def as_dict(self) -> dict:
        return asdict(self)


def first_place(df: DataFrame) -> Column:
    """Aggregate: where a group's first row stands, by time and id as far as there are such columns."""
    return F.min(F.struct(*([c for c in ("tx_datetime", "transaction_id") if c in df.columns] or ["customer_id"])))


def card_days(df: DataFrame, score: str = "score", *, place: bool = False) -> DataFrame:
    """One row per day and card: the largest label and score and, with ``place``, where its first transaction stands."""
    require_columns(df, ["transaction_date", "customer_id", "tx_fraud", score], "scored data")
    places = [first_place(df).alias("place")] if place else []
    return df.groupBy("transaction_date", "customer_id").agg(F.max("tx_fraud").alias("tx_fraud"), F.max(score).alias("score"), *places)


def top_cards_per_day(cards: DataFrame, k: int) -> DataFrame:
    """The k cards of highest score of every day, ties to the card that comes first if ``cards`` has places, else to the smaller id."""
    order = Window.partitionBy("transaction_date").orderBy(F.desc("score"), *([F.asc("place")] if "place" in cards.columns else []), F.asc("customer_id"))
    ranked = cards.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= require_positive(k, "k"))
    return ranked.select("transaction_date", "customer_id", "score")


def daily_boundaries(cards: DataFrame, capacity: int) -> DataFrame:
    """Days with more cards than capacity, and the score of the first card beyond it."""
    order = Window.partitionBy("transaction_date").orderBy(F.desc("score"), F.asc("customer_id"))
    ranked = cards.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= require_positive(capacity, "capacity") + 1)
    return ranked.filter(F.col("r") == capacity + 1).select("transaction_date", F.col("score").alias("boundary_score"))


def daily_alerts(cards: DataFrame, threshold: float) -> DataFrame:
    """Alerted cards of every day."""
    return cards.groupBy("transaction_date").agg(F.count_if(F.col("score") >= threshold).alias("alerts"))


def alert_load(cards: DataFrame, threshold: float, capacity: int) -> DataFrame:
    """One row: total, mean and largest number of daily alerts, and days over capacity."""
    return daily_alerts(cards, threshold).agg(
        F.sum("alerts").cast("bigint").alias("alerts"),
        (F.sum("alerts").cast("double") / F.count(F.lit(1))).alias("mean_daily_card_alerts"),
        F.max("alerts").alias("max_daily_card_alerts"),
        F.count_if(F.col("alerts") > capacity).alias("budget_exceeded_days"),
    )


def evaluate_card_days(df: DataFrame, threshold: float, capacity: int, score: str = "score") -> CardDayMetrics:
    """Metrics of alerts on unique cards per day at a fixed threshold."""
    require_positive(capacity, "capacity")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be within 0..1")
    require_scores(df, "tx_fraud", score)
    return _card_day_metrics(card_days(df, score), threshold, capacity)


def _card_day_metrics(cards: DataFrame, threshold: float, capacity: int) -> CardDayMetrics:
    c, load = confusion(cards, threshold).first(), alert_load(cards, threshold, capacity).first()
    return CardDayMetrics(threshold, capacity, c["precision"], c["recall"], c["f1"], load["alerts"], load["mean_daily_card_alerts"], load["max_daily_card_alerts"], load["budget_exceeded_days"])


def capacity_threshold(df: DataFrame, capacity: int, score: str = "score") -> CardDayMetrics:
    """The least threshold that keeps every day within capacity, with its metrics.

    It is the next double above the largest boundary score; 0.0 if every day
    fits. A boundary at 1 admits none and is an error.
    """
    require_positive(capacity, "capacity")
    require_scores(df, "tx_fraud", score)
    cards = card_days(df, score)
    boundary = daily_boundaries(cards, capacity).agg(F.max("boundary_score")).first()[0]
    threshold = 0.0 if boundary is None else next_after(boundary)
    if threshold > 1:
        raise ValueError("no threshold within 0..1 keeps the daily capacity")
    return _card_day_metrics(cards, threshold, capacity)


@dataclass(frozen=True)
class PolicyCandidate:
    model_name: str
    average_precision: float
    card_days: CardDayMetrics


def select_policy(candidates: list[PolicyCandidate]) -> PolicyCandidate:
    """Most recall, then precision, then average precision, then the first name."""
    if not candidates:
        raise ValueError("no candidate policies")
    names = [c.model_name for c in candidates]
    if len(set(names)) < len(names):
        raise ValueError("candidate names must be unique")
    for c in candidates:
        if not 0 <= c.average_precision <= 1:
            raise ValueError(f"average precision of {c.model_name} must be within 0..1")
        if c.card_days.budget_exceeded_days:
            raise ValueError(f"{c.model_name} exceeds the daily capacity")
    return min(candidates, key=lambda c: (-c.card_days.recall, -c.card_days.precision, -c.average_precision, c.model_name))
