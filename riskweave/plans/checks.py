"""Data tests: each gives the rows that break an invariant, so none is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return duplicates(df.filter(F.col(column).isNotNull()), column)


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def outside(column: str, low, high=None) -> Column:
    """Whether a value lies outside low..high; bounds are numbers or column names."""
    bound = lambda b: F.col(b) if isinstance(b, str) else F.lit(b)
    broken = F.col(column) < bound(low)
    return broken if high is None else broken | (F.col(column) > bound(high))


def invalid_rates(daily: DataFrame) -> DataFrame:
    return daily.filter(outside("fraud_rate", 0, 1))


def invalid_overview(report: DataFrame) -> DataFrame:
    """Report rows whose numbers contradict each other."""
    broken = [F.col("transaction_count") <= 0, outside("total_amount", 0), outside("fraud_count", 0, "transaction_count"), outside("fraud_rate", 0, 1)]
    for entity in ("customer", "terminal"):
        hit, active = f"{entity}s_with_fraud", f"active_{entity}_count"
        broken += [F.col(active) <= 0, outside(hit, 0, active), (F.col("fraud_count") > 0) != (F.col(hit) > 0)]
    return report.filter(any_of(*broken))


def invalid_risk(customer_risk: DataFrame, terminal_risk: DataFrame) -> DataFrame:
    """Rolling metrics out of their bounds, of both marts."""
    broken = any_of(
        F.col("transaction_count") <= 0,
        outside("total_amount", 0),
        outside("fraud_count", 0, "transaction_count"),
        outside("fraud_rate", 0, 1),
        outside("rolling_7d_transaction_count", "transaction_count"),
        outside("rolling_7d_total_amount", 0),
        outside("rolling_7d_fraud_count", "fraud_count", "rolling_7d_transaction_count"),
        outside("rolling_7d_fraud_rate", 0, 1),
    )
    sides = [df.filter(broken).select(F.lit(e).alias("entity_type"), "transaction_date", F.col(f"{e}_id").alias("entity_id")) for e, df in (("customer", customer_risk), ("terminal", terminal_risk))]
    return sides[0].unionByName(sides[1])


def day_totals(df: DataFrame, prefix: str) -> DataFrame:
    """A mart summed to days again."""
    return df.groupBy("transaction_date").agg(
        F.sum("transaction_count").cast("bigint").alias(f"{prefix}_transactions"),
        F.sum(F.col("total_amount").cast("decimal(28,4)")).cast("double").alias(f"{prefix}_amount"),
        F.sum("fraud_count").cast("bigint").alias(f"{prefix}_fraud"),
    )


def differs(a: str, b: str) -> Column:
    """Whether two day totals differ, or one is missing."""
    counts = [~F.col(f"{a}_{n}").eqNullSafe(F.col(f"{b}_{n}")) for n in ("transactions", "fraud")]
    return any_of(*counts, F.coalesce(F.abs(F.col(f"{a}_amount") - F.col(f"{b}_amount")) > TOLERANCE, F.lit(False)))


def unreconciled_daily(features: DataFrame, daily: DataFrame) -> DataFrame:
    """Days on which the daily mart and the transactions disagree."""
    per_row = features.select("transaction_date", F.lit(1).alias("transaction_count"), F.col("tx_amount").alias("total_amount"), F.col("tx_fraud").alias("fraud_count"))
    return day_totals(per_row, "expected").join(day_totals(daily, "actual"), "transaction_date", "full_outer").filter(differs("expected", "actual")).select("transaction_date")


def unreconciled_risk(daily: DataFrame, customer_risk: DataFrame, terminal_risk: DataFrame) -> DataFrame:
    """Days on which the three marts disagree; the second join meets the first by its coalesced key."""
    joined = day_totals(daily, "d").join(day_totals(customer_risk, "c"), "transaction_date", "full_outer").join(day_totals(terminal_risk, "t"), "transaction_date", "full_outer")
    return joined.filter(differs("d", "c") | differs("d", "t")).select("transaction_date")


def all_checks(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every data test of the marts by name."""
    features, daily, report = frames["stg_transaction_features"], frames["fct_daily_fraud"], frames["rpt_daily_fraud_overview"]
    checks = {
        "daily_fraud_rate_valid": invalid_rates(daily),
        "daily_fraud_overview_valid": invalid_overview(report),
        "daily_risk_metrics_valid": invalid_risk(frames["fct_customer_daily_risk"], frames["fct_terminal_daily_risk"]),
        "daily_fraud_reconciles": unreconciled_daily(features, daily),
        "daily_risk_marts_reconcile": unreconciled_risk(daily, frames["fct_customer_daily_risk"], frames["fct_terminal_daily_risk"]),
        "transaction_id_unique": unique(features, "transaction_id"),
        "transaction_id_not_null": not_null(features, "transaction_id"),
        "tx_fraud_accepted": accepted_values(features, "tx_fraud", (0, 1)),
        "daily_fraud_date_unique": unique(daily, "transaction_date"),
        "overview_date_unique": unique(report, "transaction_date"),
    }
    for entity in ("customer", "terminal"):
        for table in (f"stg_{entity}_daily_summary", f"fct_{entity}_daily_risk"):
            checks[f"{table}_unique"] = duplicates(frames[table], "transaction_date", f"{entity}_id")
            checks[f"{table}_{entity}_not_null"] = not_null(frames[table], f"{entity}_id")
    return checks


def violation_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per data test with the number of rows that break it."""
    counts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in all_checks(frames).items()]
    return reduce(DataFrame.unionByName, counts)
