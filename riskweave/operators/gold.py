"""Gold: point-in-time features and daily summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import finite, require_columns, require_none, require_unique
from ..functions.scalars import MONEY, calendar_features, money_sum, ratio
from ..schemas import FEATURE_COLUMNS, SILVER
from ..sources.files import load_silver
from ..sources.publish import publish_tables, table_path


@dataclass(frozen=True)
class GoldTables:
    transaction_features: DataFrame
    customer_daily_summary: DataFrame
    terminal_daily_summary: DataFrame


def require_silver(silver: DataFrame) -> None:
    require_columns(silver, SILVER.names, "Silver data")
    require_unique(silver, "transaction_id", "Silver data")
    require_none(silver, {
        "Silver timestamps must not be missing": F.col("tx_datetime").isNull(),
        "Silver amounts must be finite": ~finite(F.col("tx_amount")),
    })


def history(df: DataFrame, days: DataFrame, entity: str, *, with_amount: bool, before: DataFrame | None = None) -> DataFrame:
    """Adds what an entity did before each transaction: ``{entity}_count`` and, if asked for, ``{entity}_total``.

    Before means an earlier (tx_datetime, transaction_id). ``days`` are the same
    transactions with their transaction_date, for the daily sums. The running totals
    have two levels: whole earlier days come from a window over the daily sums,
    the rest from a window within (entity, day). So a busy entity is spread over
    its days, and the join by (entity, day) reuses the windows' partitioning.
    ``before`` (entity, key, n, total) is what entities did before all these rows.
    """
    key = f"{entity}_id"
    amount = F.col("tx_amount").cast(MONEY)
    daily = days.groupBy(F.col(key).alias("_key"), F.col("transaction_date").alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"))
    earlier_days = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select("_key", "_day", F.coalesce(F.sum("_n").over(earlier_days), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier_days), F.lit(0)).alias("_s0"))
    if before is not None:
        earlier = before.filter(F.col("entity") == entity).select(F.col("key").alias("_before"), F.col("n").alias("_nb"), F.col("total").alias("_sb"))
        daily = daily.join(earlier, F.col("_key") == F.col("_before"), "left")
        daily = daily.select("_key", "_day", *((F.col(f"_{x}0") + F.coalesce(F.col(f"_{x}b"), F.lit(0))).alias(f"_{x}0") for x in "ns"))
    within = Window.partitionBy(key, "transaction_date").orderBy("tx_datetime", "transaction_id")
    df = df.withColumn("_n1", F.row_number().over(within) - 1)
    if with_amount:
        df = df.withColumn("_s1", F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = df.join(daily, (F.col(key) == F.col("_key")) & (F.col("transaction_date") == F.col("_day")))
    joined = joined.withColumn(f"{entity}_count", (F.col("_n0") + F.col("_n1")).cast("bigint"))
    if with_amount:
        joined = joined.withColumn(f"{entity}_total", (F.col("_s0") + F.col("_s1")).cast("double"))
    return joined.drop("_key", "_day", "_n0", "_s0", "_n1", "_s1")


def transaction_features(silver: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Silver rows with calendar features and the history of their customer and terminal, after what was ``before``."""
    base = silver.select(*SILVER.names, *(c.alias(n) for n, c in calendar_features(F.col("tx_datetime")).items()))
    rows = history(history(base, base, "customer", with_amount=True, before=before), base, "terminal", with_amount=False, before=before)
    mean = ratio(F.col("customer_total"), F.col("customer_count"))
    rows = rows.withColumn("customer_previous_mean_amount", mean)
    previous = F.col("customer_previous_mean_amount")
    rows = rows.withColumn("amount_to_customer_previous_mean", F.when(previous > 0, F.col("tx_amount") / previous))
    rows = rows.withColumnsRenamed({"customer_count": "customer_previous_transaction_count", "terminal_count": "terminal_previous_transaction_count"})
    return rows.select(*SILVER.names, *FEATURE_COLUMNS)


def daily_summary(features: DataFrame, entity: str) -> DataFrame:
    """Counts, amounts and fraud of an entity per day."""
    count = F.count(F.lit(1))
    total, fraud = money_sum(F.col("tx_amount")), F.sum(F.col("tx_fraud").cast("bigint"))
    columns = {"transaction_count": count.cast("bigint")}
    if entity == "terminal":
        columns["unique_customers"] = F.count_distinct("customer_id").cast("bigint")
    columns |= {"total_amount": total.cast("double"), "average_amount": total.cast("double") / count}
    if entity == "customer":
        columns["maximum_amount"] = F.max("tx_amount")
    columns |= {"fraud_count": fraud.cast("bigint"), "fraud_rate": fraud.cast("double") / count}
    return features.groupBy("transaction_date", f"{entity}_id").agg(*(c.alias(n) for n, c in columns.items()))


def build_gold(silver: DataFrame) -> GoldTables:
    """The three Gold tables of checked Silver data."""
    require_silver(silver)
    features = transaction_features(silver)
    days = silver.withColumn("transaction_date", F.to_date("tx_datetime"))
    return GoldTables(features, daily_summary(days, "customer"), daily_summary(days, "terminal"))


def write_gold(spark, silver_path: str, gold_path: str) -> GoldTables:
    """Rebuild Gold from all of Silver and put the tables in place, summaries first."""
    gold = build_gold(load_silver(spark, silver_path))
    publish_tables({
        "customer_daily_summary": gold.customer_daily_summary.orderBy("transaction_date", "customer_id"),
        "terminal_daily_summary": gold.terminal_daily_summary.orderBy("transaction_date", "terminal_id"),
        "transaction_features": gold.transaction_features.orderBy("tx_datetime", "transaction_id"),
    }, gold_path)
    return GoldTables(*(spark.read.parquet(table_path(gold_path, n)) for n in ("transaction_features", "customer_daily_summary", "terminal_daily_summary")))
