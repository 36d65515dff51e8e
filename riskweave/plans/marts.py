"""The marts over Gold: daily fraud, rolling seven-day risk, the daily report.

``LAYERS`` says what is a view and what a table; ``build_marts`` registers them
in the order of their dependencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, money_sum, ratio
from ..operators.gold import GoldTables
from ..operators.gold_days import open_gold
from ..sources.files import require_inputs

LAYERS = {
    "stg_transaction_features": "view",
    "stg_customer_daily_summary": "view",
    "stg_terminal_daily_summary": "view",
    "fct_daily_fraud": "table",
    "fct_customer_daily_risk": "table",
    "fct_terminal_daily_risk": "table",
    "rpt_daily_fraud_overview": "table",
}


def daily_fraud(features: DataFrame) -> DataFrame:
    """Transactions, amount and fraud per day."""
    fraud = F.sum(F.col("tx_fraud").cast("bigint"))
    return features.groupBy("transaction_date").agg(
        F.count(F.lit(1)).cast("bigint").alias("transaction_count"),
        money_sum(F.col("tx_amount")).cast("double").alias("total_amount"),
        fraud.cast("bigint").alias("fraud_count"),
        (fraud.cast("double") / F.count(F.lit(1))).alias("fraud_rate"),
    )


def rolling_risk(daily: DataFrame, entity: str, days: int = 7) -> DataFrame:
    """A daily summary with sums over the calendar days up to and including each day."""
    frame = Window.partitionBy(f"{entity}_id").orderBy(F.unix_date("transaction_date")).rangeBetween(-(days - 1), Window.currentRow)
    prefix = f"rolling_{days}d"
    sums = {
        f"{prefix}_transaction_count": F.sum("transaction_count").over(frame).cast("bigint"),
        f"{prefix}_total_amount": F.sum(F.col("total_amount").cast(MONEY)).over(frame).cast("double"),
        f"{prefix}_fraud_count": F.sum("fraud_count").over(frame).cast("bigint"),
    }
    rows = daily.select("*", *(c.alias(n) for n, c in sums.items()))
    return rows.withColumn(f"{prefix}_fraud_rate", ratio(F.col(f"{prefix}_fraud_count"), F.col(f"{prefix}_transaction_count")))


def activity(risk: DataFrame, entity: str) -> DataFrame:
    """How many entities were active and how many had fraud, per day."""
    return risk.groupBy("transaction_date").agg(
        F.count(F.lit(1)).cast("bigint").alias(f"active_{entity}_count"),
        F.count_if(F.col("fraud_count") > 0).cast("bigint").alias(f"{entity}s_with_fraud"),
    )


def fraud_overview(daily: DataFrame, customer_risk: DataFrame, terminal_risk: DataFrame) -> DataFrame:
    """The daily report: fraud with customer and terminal activity, days that have all three."""
    return daily.join(activity(customer_risk, "customer"), "transaction_date").join(activity(terminal_risk, "terminal"), "transaction_date")


def mart_frames(gold: GoldTables) -> dict[str, DataFrame]:
    """All staging and mart frames by name, lazy."""
    frames = {f"stg_{n}": getattr(gold, n) for n in ("transaction_features", "customer_daily_summary", "terminal_daily_summary")}
    frames["fct_daily_fraud"] = daily_fraud(gold.transaction_features)
    frames["fct_customer_daily_risk"] = rolling_risk(gold.customer_daily_summary, "customer")
    frames["fct_terminal_daily_risk"] = rolling_risk(gold.terminal_daily_summary, "terminal")
    frames["rpt_daily_fraud_overview"] = fraud_overview(frames["fct_daily_fraud"], frames["fct_customer_daily_risk"], frames["fct_terminal_daily_risk"])
    return frames


def build_catalog(spark: SparkSession, silver_path: str, gold_path: str) -> GoldTables:
    """Register the Silver and Gold tables as views, after checking that all are there."""
    require_inputs(spark, [silver_path])
    gold = open_gold(spark, gold_path)
    spark.read.option("mergeSchema", "true").parquet(silver_path).createOrReplaceTempView("stg_transactions")
    return gold


def build_marts(spark: SparkSession, gold: GoldTables, *, database: str | None = None, materialize: bool = False) -> dict[str, DataFrame]:
    """Register every layer as a view or, with ``materialize``, marts as tables."""
    built: dict[str, DataFrame] = {}
    frames = mart_frames(gold)
    for name, layer in LAYERS.items():
        if materialize and layer == "table":
            full = f"{database}.{name}" if database else name
            frames[name].write.mode("overwrite").saveAsTable(full)
            built[name] = spark.table(full)
        else:
            frames[name].createOrReplaceTempView(name)
            built[name] = spark.table(name)
    return built
